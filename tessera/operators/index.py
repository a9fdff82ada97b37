"""The document index: metadata from file names, new and changed documents, duplicates, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Words of titles that decide kind, category, tags and folder. Later kinds win over earlier ones.
KINDS = (("征求意见稿", "draft", "draft"), ("反馈意见表", "feedback", "reference"), ("征求意见反馈表", "feedback", "reference"), ("起草说明", "explanation", "reference"))
CATEGORIES = (("化学药品", "化学药"), ("化学药物", "化学药"), ("中药", "中药"), ("天然药物", "中药"), ("生物制品", "生物制品"))
DRUG_TYPES = ("注射剂", "原料药", "制剂", "口服")
OLDER_CATEGORIES, OLDER_DRUG_TYPES, TRIAL = (("疫苗", "疫苗"),), ("注射剂", "原料药", "口服", "制剂"), "试行"
TAGS = ("稳定性", "配伍", "注射剂", "原料药", "制剂", "化学药", "中药", "生物制品", "研究技术", "指导原则")
GENERAL, OTHER = "通用", "其他"
FOLDERS = (
    ("稳定性", "稳定性"), ("临床研发", "临床研究"), ("临床试验", "临床研究"), ("以患者为中心", "临床研究"), ("药理学", "药理学"), ("毒理学", "毒理学"), ("质量标准", "质量标准"),
    ("申报", "申报注册"), ("注册", "申报注册"), ("注射剂", "稳定性"), ("配伍", "稳定性"), ("原料药", "稳定性"), ("制剂", "稳定性"),
)


def _first(title: Column, rules: tuple, default: str) -> Column:
    out = F.lit(default)
    for word, value in reversed(rules):
        out = F.when(title.contains(word), value).otherwise(out)
    return out


def folder(title: Column) -> Column:
    """The folder of the first rule whose word the title holds."""
    return _first(title, FOLDERS, OTHER)


def metadata(files: DataFrame, older: bool = False) -> DataFrame:
    """files (filename, others) with id, title, issue_date, doc_type, status, category, drug_types, tags, folder.

    issue_date is the eight digits at the start ('' if none). The id is that of category, date and kind, and so the
    same for two documents that share these; `key` adds the title. older: by the rules of earlier indexes, which know vaccines as a category, hold
    trial editions active whatever they are, list the kinds of drugs in another order, and name undated documents by their title.
    """
    categories, drug_types = (CATEGORIES + OLDER_CATEGORIES, OLDER_DRUG_TYPES) if older else (CATEGORIES, DRUG_TYPES)
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    date = F.regexp_extract(stem, r"^(\d{8})", 1)
    title = F.regexp_replace(stem, r"^\d{8}\s*[-—]\s*", "")
    kind, status = F.lit("main"), F.lit("active")
    for word, k, s in KINDS:
        kind, status = F.when(title.contains(word), k).otherwise(kind), F.when(title.contains(word), s).otherwise(status)
    status = F.when(title.contains(TRIAL), "active").otherwise(status) if older else status
    category = _first(title, categories, GENERAL)

    def held(words: tuple) -> Column:
        return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(title, w))

    types = F.when(F.size(held(drug_types)) > 0, held(drug_types)).otherwise(F.array(F.lit(GENERAL)))
    name = F.concat_ws("_", F.lit("guidance"), category, F.when(date != "", date), kind)
    name = F.when(date != "", name).otherwise(F.concat_ws("_", F.lit("guidance"), T.safe_filename(title), kind)) if older else name
    return files.select(
        "*", name.alias("id"), F.concat_ws("_", name, F.left(F.sha2(title, 256), F.lit(8))).alias("key"), title.alias("title"), date.alias("issue_date"),
        kind.alias("doc_type"), status.alias("status"), category.alias("category"), types.alias("drug_types"), F.array_sort(held(TAGS)).alias("tags"), folder(title).alias("folder"),
    )


def new_rows(found: DataFrame, indexed: DataFrame, key: str = "id", order: str = "filename") -> DataFrame:
    """Rows of found whose key is not indexed; of rows that share a key, the first by order."""
    fresh = found.join(indexed.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy(order)
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(current: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """current with updates: for each key the update that is last by order, else the current row.

    One aggregation over both (a maximum a key, summed up before the shuffle), no join.
    """
    columns = [c for c in current.columns if c != key]
    both = current.withColumns({"__new": F.lit(0), "__at": F.lit(None).cast(updates.schema[order].dataType)}).unionByName(updates.select(key, *columns, F.lit(1).alias("__new"), F.col(order).alias("__at")))
    last = F.max_by(F.struct(*columns), F.struct("__new", "__at", F.xxhash64(*columns)))
    return both.groupBy(key).agg(last.alias("__row")).select(key, "__row.*")


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """files (filename, md5) that state (filename, md5, status) does not hold as completed with this md5."""
    s = state.select("filename", F.col("md5").alias("__md5"), F.col("status").alias("__status"))
    met = files.join(s, "filename", "left")
    fresh = F.coalesce((F.col("__md5") == F.col("md5")) & (F.col("__status") == "completed"), F.lit(False))
    return met.where(~fresh).withColumn("reason", F.when(F.col("__md5").isNull(), "new").when(F.col("__md5") != F.col("md5"), "changed").otherwise("retry")).drop("__md5", "__status")


def validity(rows: DataFrame) -> DataFrame:
    """rows (json, markdown) with ok and reason: whether an extraction can be used."""
    parsed = F.try_parse_json("json")
    items = F.coalesce(F.get_json_object("json", "$.kids"), F.get_json_object("json", "$.elements"), F.get_json_object("json", "$.flat_elements"))
    reason = (
        F.when(F.col("json").isNull(), "no json").when(F.col("json") == "", "empty json").when(parsed.isNull(), "bad json")
        .when(items.isNull() | (items == "[]"), "no elements").when(F.coalesce(F.octet_length("markdown"), F.lit(0)) < 100, "short markdown")
    )
    return rows.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("ok", F.col("reason") == "ok")


def _first_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each of keys those with the two least (o_pos, o_id); groups are cut down before they are shuffled."""
    w = Window.partitionBy(*keys).orderBy("o_pos", "o_id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n <= 2").drop("__n")


def duplicates(new: DataFrame, index: DataFrame) -> DataFrame:
    """new (id, title, issue_date, page1, page2, pdf_byte) -> id, duplicate_of, by: the first match in index (same, pos).

    Both page digests equal (none null) or, where no row matches so, the files' digests equal; in either case titles
    must be identical or differ little and dates must not both be set and differ. A row is no duplicate of one with its own id. Null digests match nothing.
    Rows that agree in digests, title and date are one kind: kinds are what meets by digest and whose titles are
    compared. Of a kind's rows in the index the first two are enough, as one may have the row's own id.
    """

    def matched(keys: list[str], rank: int) -> DataFrame:
        kind = [*keys, "title", "issue_date"]
        listed = index.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*kind, F.col("id").alias("o_id")).agg(F.min("pos").alias("o_pos"))
        other = _first_two(listed, kind).select(*keys, F.col("title").alias("o_title"), F.col("issue_date").alias("o_date"), "o_pos", "o_id")
        met = new.select(*kind).distinct().join(other, keys)
        dates = (F.col("issue_date") == "") | (F.col("o_date") == "") | (F.col("issue_date") == F.col("o_date"))
        close = met.where(dates).where(T.title_similarity(F.col("title"), F.col("o_title")).isin("identical", "small"))
        found = new.select("id", *kind).join(_first_two(close.select(*kind, "o_pos", "o_id"), kind), kind).where(F.col("id") != F.col("o_id"))
        return found.groupBy("id").agg(F.min_by("o_id", F.struct("o_pos", "o_id")).alias("duplicate_of")).withColumn("rank", F.lit(rank))

    both = matched(["page1", "page2"], 0).unionByName(matched(["pdf_byte"], 1))
    return both.groupBy("id").agg(F.min_by("duplicate_of", "rank").alias("duplicate_of"), F.when(F.min("rank") == 0, "pages").otherwise("bytes").alias("by"))


def first_rows(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """For each of keys the first (or last) row by order: an aggregation, so that rows are summed up before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, "__row.*")
