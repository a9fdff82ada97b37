"""Usage scoring from message and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Words of messages that tell tools, outcomes and kinds of task.
TOOLS = {
    "feishu": ["飞书", "feishu", "多维表格", "文档", "表格"], "file": ["文件", "读取", "写入", "excel", "csv"], "search": ["搜索", "查询", "查找", "search"], "web": ["网页", "浏览器", "打开", "访问"],
    "code": ["代码", "python", "脚本", "programming"], "image": ["图片", "图像", "截图", "image"], "calendar": ["日历", "日程", "会议", "calendar"], "task": ["任务", "待办", "todo", "task"],
}
DONE, FAILED = ["完成", "成功", "搞定", "ok", "好的"], ["失败", "错误", "报错", "不行"]
SCHEDULED, LASTING = ["定时", "每天", "自动", "cron", "定期"], ["长期", "项目", "持续", "跟踪"]
OFTEN, DAILY, SELDOM, NEVER = "每天多次", "每天1次", "偶尔", "无使用"


def daily_messages(messages: DataFrame) -> DataFrame:
    """messages (user_id, ts, is_bot, content) -> a row for each user and day (of the session's time zone).

    dialogues (the user's messages), success, failed, scheduled, lasting, tools (sorted, distinct): one aggregation.
    """
    tool = F.array_compact(F.array(*(F.when(T.any_of(F.col("content"), words), F.lit(name)) for name, words in TOOLS.items())))
    rows = messages.withColumn("tool", tool).withColumn("day", F.to_date("ts"))
    c = F.col("content")
    return rows.groupBy("user_id", "day").agg(
        F.count_if(~F.col("is_bot")).alias("dialogues"),
        F.count_if(T.any_of(c, DONE)).alias("success"),
        F.count_if(T.any_of(c, FAILED)).alias("failed"),
        F.bool_or(T.any_of(c, SCHEDULED)).alias("scheduled"),
        F.bool_or(T.any_of(c, LASTING)).alias("lasting"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tool")))).alias("tools"),
    )


def peak_hours(events: DataFrame) -> DataFrame:
    """events (user_id, ts, event_id) -> user_id, day, hour, n: the hour with most events; ties to the one seen first."""
    hours = events.groupBy("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return hours.groupBy("user_id", "day").agg(F.min_by(F.struct("hour", "n"), F.struct(-F.col("n"), "first")).alias("p")).select("user_id", "day", "p.hour", "p.n")


def frequency(n: Column) -> Column:
    return F.when(n >= 10, OFTEN).when(n >= 3, DAILY).when(n >= 1, SELDOM).otherwise(NEVER)


def duration(days: Column) -> Column:
    return F.when(days > 30, F.concat(F.floor(days / 30).cast("string"), F.lit("个月"), (days % 30).cast("string"), F.lit("天"))).otherwise(F.concat(days.cast("string"), F.lit("天")))


def ladder(value: Column, steps: list[tuple[int, int]], default: int) -> Column:
    """The score of the first step (least value, score) that value reaches."""
    out = F.lit(default)
    for least, score in sorted(steps):
        out = F.when(value >= least, score).otherwise(out)
    return out


def grade(total: Column) -> Column:
    return F.when(total >= 85, "A").when(total >= 70, "B").when(total >= 55, "C").otherwise("D")


def usage_scores(rows: DataFrame) -> DataFrame:
    """rows (dialogues, frequency, tools, run_duration, cron_rate, ongoing) with the four scores, total, rating, overall."""
    f, d, tools = F.coalesce("frequency", F.lit("")), F.coalesce("dialogues", F.lit(0)), F.coalesce("tools", F.lit(0))
    activity = F.when(f.contains("多次") | (d > 50), 23).when(f.contains("每天1次") | (d > 20), 17).when(f.contains("每周几次") | (d > 5), 12).otherwise(7)
    run = F.coalesce("run_duration", F.lit(""))
    first = F.coalesce(F.regexp_extract(run, r"(\d+)", 1).try_cast("int"), F.lit(0))
    continuity = F.when(run.contains("月"), 23).when(run.contains("周"), F.when(first >= 2, 17).otherwise(12)).when(first >= 5, 15).otherwise(10)
    cron = F.coalesce(F.regexp_extract(F.coalesce("cron_rate", F.lit("0%")), r"(\d+)", 1).try_cast("int"), F.lit(0))
    innovation = F.when((cron > 80) | F.coalesce("ongoing", F.lit("")).contains("有"), 23).when((cron > 50) | (tools >= 4), 17).when(tools >= 2, 12).otherwise(8)
    scored = rows.withColumns({"activity_score": activity, "depth_score": ladder(tools, [(2, 12), (3, 17), (5, 23)], 8), "continuity_score": continuity, "innovation_score": innovation})
    total = F.col("activity_score") + F.col("depth_score") + F.col("continuity_score") + F.col("innovation_score")
    scored = scored.withColumn("total_score", total)
    return scored.withColumns({"rating": grade(F.col("total_score")), "overall_eval": overall()})


def overall() -> Column:
    """A short verdict from the scores, cut to 50 characters."""
    t, a, d, i = (F.col(c) for c in ("total_score", "activity_score", "depth_score", "innovation_score"))
    text = F.concat(
        F.when(t >= 85, "使用优秀，").when(t >= 70, "使用良好，").when(t >= 55, "使用一般，").otherwise("使用待提升，"),
        F.when(a >= 20, "活跃度很高，").when(a >= 15, "活跃度较好，").otherwise(""),
        F.when(d >= 20, "工具运用多样，").when(d >= 15, "工具运用适中，").otherwise(""),
        F.when(i >= 20, "善于使用高级功能。").when(i >= 15, "能使用进阶功能。").otherwise("建议多尝试高级功能。"),
    )
    return F.when(F.char_length(text) > 50, F.concat(F.left(text, F.lit(47)), F.lit("..."))).otherwise(text)


def objective_scores(rows: DataFrame) -> DataFrame:
    """rows (user_messages, bot_messages, tools, days, cron, long_term, custom_skill) with the objective scores."""
    rounds = F.least("user_messages", "bot_messages")
    bonus = 5 * F.col("cron").cast("int") + 5 * F.col("long_term").cast("int") + 5 * F.col("custom_skill").cast("int") + F.when(F.col("tools") >= 3, 3).otherwise(0) + F.when(F.col("tools") >= 5, 2).otherwise(0)
    scored = rows.withColumns({
        "activity_score": ladder(rounds, [(3, 12), (6, 16), (10, 20), (15, 23)], 8),
        "depth_score": ladder(F.col("tools"), [(2, 13), (3, 16), (4, 19), (5, 22)], 10),
        "continuity_score": ladder(F.col("days"), [(7, 16), (14, 19), (30, 23)], 13),
        "innovation_score": F.least(F.lit(10) + bonus, F.lit(25)),
    })
    total = F.col("activity_score") + F.col("depth_score") + F.col("continuity_score") + F.col("innovation_score")
    return scored.withColumn("total_score", total).withColumn("rating", grade(F.col("total_score")))


def daily_best(ratings: DataFrame) -> DataFrame:
    """ratings (user_id, day, seq, total): for each user and day the row with the greatest total, the earliest of these."""
    rest = [c for c in ratings.columns if c not in ("user_id", "day")]
    return ratings.groupBy("user_id", "day").agg(F.max_by(F.struct(*rest), F.struct("total", -F.col("seq"))).alias("r")).select("user_id", "day", "r.*")


def consistency(ratings: DataFrame) -> DataFrame:
    """ratings (user_id, day, seq, total) with first_of_day, verdict of the step from the last one, and used.

    A step of 3 or less is normal, of 4 or 5 needs evidence, of more is anomalous, and then the day's first score is used.
    """
    w = Window.partitionBy("user_id", "day").orderBy("seq")
    step = F.abs(F.col("total") - F.lag("total").over(w))
    verdict = F.when(step.isNull() | (step <= 3), "normal").when(step <= 5, "evidence").otherwise("anomalous")
    first = F.first_value("total").over(w)
    return ratings.withColumn("first_of_day", F.row_number().over(w) == 1).withColumn("verdict", verdict).withColumn("used", F.when(F.col("verdict") == "anomalous", first).otherwise(F.col("total")))


def history(daily: DataFrame, last_day: Column, days: int = 30) -> DataFrame:
    """daily (user_id, day, total) -> user_id, n, average, trend over the last days: up, down or flat from first to last."""
    rows = daily.where((F.col("day") > F.date_sub(last_day, days)) & (F.col("day") <= last_day))
    first, last = F.min_by("total", "day"), F.max_by("total", "day")
    trend = F.when(last > first, "up").when(last < first, "down").otherwise("flat")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("total").alias("average"), trend.alias("trend"))


def within_hours(ts: Column, start: str, end: str) -> Column:
    """Whether the time of day is from start to end (HH:MM), both included; no window passes midnight."""
    return F.date_format(ts, "HH:mm").between(start, end)


def valid_name(name: Column, default: str = "用户") -> Column:
    """A name that is set, no default, more than one character, not only digits, without replacement characters."""
    n = F.coalesce(F.trim(name), F.lit(""))
    return ~((n == "") | (n == default) | n.rlike(r"^\d+$") | (F.char_length(n) < 2) | n.contains("�"))
