"""Usage scoring over the event and conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import usage as U
from tessera.plans.common import RATINGS, ratings, table


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and day: total, by outcome, distinct kinds, value."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), F.count_if(kind == "purchase").alias("success"), F.count_if(kind == "error").alias("failed"), F.count_distinct("event_type").alias("kinds"), F.bool_or(kind == "signup").alias("signed_up"), F.round(F.sum("value"), 2).alias("value"))


def message_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation as a user's day: dialogues, outcomes, tools named."""
    c = table(spark, sf_dir, "conversations")
    word = F.when(F.col("turn") % 5 == 0, " cron python").when(F.col("turn") % 7 == 0, " 任务完成").otherwise("")
    rows = c.select(F.col("conv_id").alias("user_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), (F.col("role") == "assistant").alias("is_bot"), F.concat("text", word).alias("content"))
    return U.daily_messages(rows).withColumn("tools", F.array_join("tools", ","))


def peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.peak_hours(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").cast("int").alias("tools"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return rows.select(
        "user_id", "n", (F.col("n") % 60).alias("dialogues"), U.frequency(F.col("n") % 12).alias("frequency"), "tools", U.duration(F.col("days")).alias("run_duration"),
        F.concat((F.floor(100 * F.col("clicks") / F.col("n"))).cast("string"), F.lit("%")).alias("cron_rate"), F.when(F.col("user_id") % 3 == 0, "有").otherwise("无").alias("ongoing"), "days", "clicks")


def score_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.usage_scores(_features(spark, sf_dir)).select("user_id", "activity_score", "depth_score", "continuity_score", "innovation_score", "total_score", "rating", "overall_eval")


def objective_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).select(
        "user_id", (F.col("n") % 20).alias("user_messages"), (F.col("n") % 17).alias("bot_messages"), "tools", "days", (F.col("user_id") % 2 == 0).alias("cron"), (F.col("user_id") % 3 == 0).alias("long_term"), (F.col("user_id") % 5 == 0).alias("custom_skill"))
    return U.objective_scores(rows).select("user_id", "activity_score", "depth_score", "continuity_score", "innovation_score", "total_score", "rating")


def daily_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.daily_best(ratings(spark, sf_dir))


def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = U.daily_best(ratings(spark, sf_dir))
    return U.history(daily, F.lit("2024-02-15").cast("date"), 40).withColumn("average", F.round("average", 3))


def score_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.consistency(ratings(spark, sf_dir))


def summary_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels where there are some, else a default of the documents'."""
    from tessera.operators.search import summary_first

    detail = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return summary_first(table(spark, sf_dir, "labels").select("doc_id", "quality"), detail, "doc_id")


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(U.within_hours(F.col("ts"), "08:30", "17:20")).groupBy("event_type").agg(F.count("*").alias("n"))


def daily_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by days that begin at 08:30."""
    e = table(spark, sf_dir, "events")
    w = F.window("ts", "1 day", "1 day", "8 hours 30 minutes")
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = F.concat(F.lit("v1."), (F.col("p_partkey") % 12).cast("string"), F.lit("."), (F.col("p_size") % 3).cast("string"))
    b = F.when(F.col("p_partkey") % 10 == 0, "1.x").otherwise(F.concat(F.lit("1."), (F.col("p_size") % 12).cast("string")))
    return p.select("p_partkey", T.compare_versions(a, b).alias("order"))


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment with orders, by nation: counts and shares."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (daily_activity, message_activity, peak_hour, score_ladder, objective_score, daily_max, history_trend, score_consistency, summary_detail, time_window, daily_lookback, version_compare, status_report)}

_F = """f AS (SELECT user_id, count(*) AS n, CAST(count(DISTINCT event_type) AS INTEGER) AS tools, CAST(datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS days, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1)"""
_GRADE = "CASE WHEN {t} >= 85 THEN 'A' WHEN {t} >= 70 THEN 'B' WHEN {t} >= 55 THEN 'C' ELSE 'D' END"

SQL = {
    "daily_activity": """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS success, count(*) FILTER (WHERE event_type = 'error') AS failed,
  count(DISTINCT event_type) AS kinds, bool_or(event_type = 'signup') AS signed_up, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""",
    "message_activity": "WITH m AS (SELECT conv_id, role = 'assistant' AS bot, lower(text || CASE WHEN turn % 5 = 0 THEN ' cron python' WHEN turn % 7 = 0 THEN ' 任务完成' ELSE '' END) AS c FROM conversations) SELECT conv_id AS user_id, DATE '2024-01-01' AS day, count(*) FILTER (WHERE NOT bot) AS dialogues, "
    + ", ".join(f"count(*) FILTER (WHERE {' OR '.join(f'contains(c, {w!r})' for w in words)}) AS {name}" for name, words in (("success", U.DONE), ("failed", U.FAILED)))
    + ", " + ", ".join(f"bool_or({' OR '.join(f'contains(c, {w!r})' for w in words)}) AS {name}" for name, words in (("scheduled", U.SCHEDULED), ("lasting", U.LASTING)))
    + ", concat_ws(',', " + ", ".join(f"CASE WHEN bool_or({' OR '.join(f'contains(c, {w!r})' for w in words)}) THEN '{name}' END" for name, words in sorted(U.TOOLS.items())) + ") AS tools FROM m GROUP BY 1",
    "peak_hour": """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, first) AS k FROM h)
SELECT user_id, day, hour, n FROM r WHERE k = 1""",
    "score_ladder": f"""WITH {_F}, g AS (SELECT user_id, tools, n % 60 AS dialogues, n % 12 AS k, days, CAST(floor(100 * clicks / n) AS INTEGER) AS cron, user_id % 3 = 0 AS ongoing FROM f),
s AS (SELECT user_id, CASE WHEN k >= 10 OR dialogues > 50 THEN 23 WHEN k >= 3 OR dialogues > 20 THEN 17 WHEN dialogues > 5 THEN 12 ELSE 7 END AS activity_score, CASE WHEN tools >= 5 THEN 23 WHEN tools >= 3 THEN 17 WHEN tools >= 2 THEN 12 ELSE 8 END AS depth_score,
  CASE WHEN days > 30 THEN 23 WHEN days >= 5 THEN 15 ELSE 10 END AS continuity_score, CASE WHEN cron > 80 OR ongoing THEN 23 WHEN cron > 50 OR tools >= 4 THEN 17 WHEN tools >= 2 THEN 12 ELSE 8 END AS innovation_score FROM g),
t AS (SELECT *, activity_score + depth_score + continuity_score + innovation_score AS total_score FROM s)
SELECT *, {_GRADE.format(t="total_score")} AS rating, CASE WHEN total_score >= 85 THEN '使用优秀，' WHEN total_score >= 70 THEN '使用良好，' WHEN total_score >= 55 THEN '使用一般，' ELSE '使用待提升，' END || CASE WHEN activity_score >= 20 THEN '活跃度很高，' WHEN activity_score >= 15 THEN '活跃度较好，' ELSE '' END
  || CASE WHEN depth_score >= 20 THEN '工具运用多样，' WHEN depth_score >= 15 THEN '工具运用适中，' ELSE '' END || CASE WHEN innovation_score >= 20 THEN '善于使用高级功能。' WHEN innovation_score >= 15 THEN '能使用进阶功能。' ELSE '建议多尝试高级功能。' END AS overall_eval FROM t""",
    "objective_score": f"""WITH {_F}, g AS (SELECT user_id, tools, days, least(n % 20, n % 17) AS rounds FROM f),
s AS (SELECT user_id, CASE WHEN rounds >= 15 THEN 23 WHEN rounds >= 10 THEN 20 WHEN rounds >= 6 THEN 16 WHEN rounds >= 3 THEN 12 ELSE 8 END AS activity_score, CASE WHEN tools >= 5 THEN 22 WHEN tools = 4 THEN 19 WHEN tools = 3 THEN 16 WHEN tools = 2 THEN 13 ELSE 10 END AS depth_score,
  CASE WHEN days >= 30 THEN 23 WHEN days >= 14 THEN 19 WHEN days >= 7 THEN 16 ELSE 13 END AS continuity_score,
  least(25, 10 + CASE WHEN user_id % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN tools >= 3 THEN 3 ELSE 0 END + CASE WHEN tools >= 5 THEN 2 ELSE 0 END) AS innovation_score FROM g),
t AS (SELECT *, activity_score + depth_score + continuity_score + innovation_score AS total_score FROM s) SELECT *, {_GRADE.format(t="total_score")} AS rating FROM t""",
    "daily_max": f"WITH {RATINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY total DESC, seq) AS n FROM r) SELECT user_id, day, seq, total FROM k WHERE n = 1",
    "history_trend": f"""WITH {RATINGS}, m AS (SELECT user_id, day, max(total) AS total FROM r GROUP BY 1, 2), w AS (SELECT * FROM m WHERE day > DATE '2024-02-15' - 40 AND day <= DATE '2024-02-15')
SELECT user_id, count(*) AS n, round(avg(total), 3) AS average, CASE WHEN arg_max(total, day) > arg_min(total, day) THEN 'up' WHEN arg_max(total, day) < arg_min(total, day) THEN 'down' ELSE 'flat' END AS trend FROM w GROUP BY 1""",
    "score_consistency": f"""WITH {RATINGS}, s AS (SELECT *, row_number() OVER w = 1 AS first_of_day, abs(total - lag(total) OVER w) AS step, first_value(total) OVER w AS first FROM r WINDOW w AS (PARTITION BY user_id, day ORDER BY seq))
SELECT user_id, day, seq, total, first_of_day, CASE WHEN step IS NULL OR step <= 3 THEN 'normal' WHEN step <= 5 THEN 'evidence' ELSE 'anomalous' END AS verdict, CASE WHEN step > 5 THEN first ELSE total END AS used FROM s""",
    "summary_detail": "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "time_window": "SELECT event_type, count(*) AS n FROM events WHERE strftime(ts, '%H:%M') BETWEEN '08:30' AND '17:20' GROUP BY 1",
    "daily_lookback": "SELECT strftime(CAST(date_trunc('day', ts - INTERVAL 510 MINUTE) AS TIMESTAMP) + INTERVAL 510 MINUTE, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY 1",
    "version_compare": """WITH p AS (SELECT p_partkey, p_partkey % 12 AS a, p_size % 3 AS c, p_size % 12 AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN -1 WHEN a < b THEN -1 ELSE 1 END AS "order" FROM p""",
    "status_report": "SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
}
