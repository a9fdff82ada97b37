"""Files as rows: recursive listings, texts with a choice of encodings, JSON indexes and element trees, sheets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

DOCUMENTS = ("pdf", "doc", "docx")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = DOCUMENTS, prune: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """path, name, stem, ext, folder, modified, length of files under root; contents are not read.

    Folders named in prune, and those that end in _images, are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("modificationTime").alias("modified"), "length")
    rows = rows.where(F.col("ext").isin(*extensions)) if extensions else rows
    for folder in prune:
        rows = rows.where(~F.col("path").contains(f"/{folder}/"))
    return rows.where(~F.col("path").rlike("_images/"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, else as GBK, else empty. Spark decodes no GBK, so bytes that are no UTF-8 go through pandas."""
    utf8 = F.is_valid_utf8(content.cast("string"))

    @F.pandas_udf("string")
    def gbk(values: pd.Series) -> pd.Series:
        def one(v: bytes | None) -> str:
            try:
                return "" if v is None else bytes(v).decode("gbk")
            except UnicodeDecodeError:
                return ""

        return values.map(one)

    return F.when(utf8, content.cast("string")).otherwise(gbk(F.when(~utf8, content)))


def texts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, name, text of whole files; order by name where it matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), decoded(F.col("content")).alias("text"))


def pairs(files: DataFrame, first: str = "md", second: str = "json") -> DataFrame:
    """Files with extension first that have a sibling of the same stem and folder with extension second."""
    other = files.where(F.col("ext") == second).select("folder", "stem")
    return files.where(F.col("ext") == first).join(other, ["folder", "stem"], "left_semi")


def newest(files: DataFrame, key: str = "stem") -> DataFrame:
    """For each key the file that was modified last."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("modified", "path")).alias("f")).select(key, "f.*")


def fresh(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (stem, modified) without an output of their stem that is as new as they are."""
    o = outputs.groupBy("stem").agg(F.max("modified").alias("made"))
    return sources.join(o, "stem", "left").where(F.col("made").isNull() | (F.col("modified") > F.col("made"))).drop("made")


INDEX = """version string, last_updated string, documents array<struct<id: string, title: string, issue_date: string, status: string, doc_type: string,
  scope: struct<category: string, type: array<string>>, tags: array<string>, content_hash: struct<page1: string, page2: string, pdf_byte: string>,
  paths: struct<raw: string, markdown: string, json: string, graph_url: string>, source_subdir: string>>"""


def index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a JSON index (one object a file), with their place in it."""
    rows = spark.read.schema(INDEX).option("multiLine", True).json(path)
    return rows.select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")


def element_trees(rows: DataFrame) -> DataFrame:
    """rows (doc_id, json) -> doc_id, path (places from the root), type, content, page, level, x0: trees of any depth, flattened.

    Children stand under kids, elements or flat_elements, the first of these that is a list; page and level under any of their spellings.
    The trees are taken apart level by level until none has children; what is carried on, and written between the
    levels, are the children alone. Text that is no JSON, and values of another type than expected, give nothing or null.
    """
    children = lambda v: F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("kids", "elements", "flat_elements")))
    get = lambda kind, *names: F.coalesce(*(F.try_variant_get("v", f"$['{n}']", kind) for n in names))
    own = [get("string", "type").alias("type"), get("string", "content").alias("content"), get("int", "page number", "page", "page_number").alias("page"), get("int", "heading level", "heading_level").alias("level"), F.try_variant_get("v", "$['bounding box'][0]", "double").alias("x0")]
    flat = None
    front = rows.select("doc_id", F.array().cast("array<int>").alias("path"), children(F.try_parse_json("json")).alias("kids"))
    while True:
        level = front.select("doc_id", "path", F.posexplode("kids").alias("at", "v")).select("doc_id", F.concat("path", F.array("at")).alias("path"), "v")
        level = cut(level.select("doc_id", "path", *own, children(F.col("v")).alias("kids")))
        here = level.drop("kids")
        flat = here if flat is None else flat.unionByName(here)
        front = level.where(F.size("kids") > 0).select("doc_id", "path", "kids")
        if front.isEmpty():
            return flat


def session_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs: file, the first line's timestamp, number of lines and of tool calls.

    The first line is the one that the reader meets first in the file's first block; a file without lines has no row.
    """
    rows = spark.read.schema("timestamp timestamp, role string, tool string, content string").json(path).withColumn("file", F.col("_metadata.file_path"))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # ids grow along a block
    rows = rows.withColumn("place", place)
    return rows.groupBy("file").agg(F.min_by("timestamp", "place").alias("started"), F.count("*").alias("lines"), F.count("tool").alias("tool_calls"))


def tool_counts(spark: SparkSession, path: str, top: int = 10) -> DataFrame:
    """tool, calls: the tools that JSON-lines logs name most often."""
    rows = spark.read.schema("tool string").json(path).where("tool IS NOT NULL")
    return rows.groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool").limit(top)


def recovered(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (folder, stem, ext, others) -> id, folder of Markdown files with a JSON sibling whose id (the stem) is not known, the first of each."""
    both = pairs(files).select(F.col("stem").alias("id"), "folder")
    return both.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.min("folder").alias("folder"))
