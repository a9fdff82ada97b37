"""Smaller rules: error marks in logs, project details from names, graph labels, learning notes, shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import degrees

#: Text that marks an error in a tool's output (case matters).
ERRORS = [
    "error:", "Error:", "ERROR:", "failed", "FAILED", "command not found", "No such file", "Permission denied", "fatal:", "Exception", "Traceback", "npm ERR!",
    "ModuleNotFoundError", "SyntaxError", "TypeError", "exit code", "non-zero",
]
#: Dosage forms that end a product's name, and detections a sheet may be about.
FORMS = ("预灌封", "注射液", "片剂", "胶囊")
DETECTIONS = ("有关物质", "含量", "水分", "PH", "澄明度", "细菌内毒素")


def has_error(output: Column) -> Column:
    return T.any_of(output, ERRORS, fold=False)


def project_details(files: DataFrame, code_re: str = r"([A-Z]{2,6}\d{3})") -> DataFrame:
    """files (filename, folder, content) with project_code, product, drug, detection ('' where there is none)."""
    product = F.regexp_extract("filename", rf"([\x{{4E00}}-\x{{9FFF}}]{{2,6}}(?:{'|'.join(FORMS)}))", 1)
    drug = F.lit("")
    for form in reversed(FORMS):
        drug = F.when(product.contains(form), F.substring_index(product, form, 1)).otherwise(drug)
    detection = F.coalesce(*(F.when(F.col("content").contains(d), F.lit(d)) for d in DETECTIONS), F.lit(""))
    code = F.regexp_extract(F.concat_ws("/", "filename", "folder"), code_re, 1)
    return files.withColumns({"project_code": code, "product": product, "drug": drug, "detection": detection})


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 15) -> DataFrame:
    """nodes (node, label, source_file) with most edges, without those that stand for files."""
    base = F.regexp_replace(F.replace(F.element_at(F.split("source_file", "/"), -1), F.lit(".md"), F.lit("")), "_", "")
    is_file = F.col("label").rlike(r"\.(md|py|ts|js|go|java)\)$") | ((base != "") & (F.regexp_replace("label", "[_ ]", "") == F.left(base, F.lit(30))))
    kept = nodes.where(~F.coalesce(is_file, F.lit(False))).join(degrees(edges), "node")
    return kept.select("node", "label", "degree").orderBy(F.desc("degree"), "node").limit(top)


def community_labels(nodes: DataFrame, membership: DataFrame, members: int = 10, words: int = 3) -> DataFrame:
    """community, name: the most frequent words (three characters or more) of its first members' labels, at most 40 characters."""
    first = nodes.join(membership, "node").withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where(F.col("n") <= members)
    each = first.select("community", "n", F.posexplode(F.split("label", r"\s+")).alias("p", "w")).where(F.char_length("w") >= 3)
    counted = each.groupBy("community", "w").agg(F.count("*").alias("c"), F.min(F.struct("n", "p")).alias("first"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "first", "w")))
    names = counted.groupBy("community").agg(F.array_join(F.transform(F.slice(ranked, 1, words), lambda x: x["w"]), " ").alias("name"))
    every = membership.select("community").distinct().join(names, "community", "left")
    return every.select("community", F.left(F.coalesce("name", F.concat(F.lit("Community "), F.col("community").cast("string"))), F.lit(40)).alias("name"))


def recurrences(notes: DataFrame) -> DataFrame:
    """notes (pattern_key, ts, status, priority) -> pattern_key, recurrences, first_seen, last_seen, pending, urgent."""
    return notes.groupBy("pattern_key").agg(
        F.count("*").alias("recurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if((F.col("priority") == "high") & (F.col("status") == "pending")).alias("urgent"))


def names_of(config: Column) -> Column:
    """The names of an `id:name,id:name` setting, sorted."""
    return F.array_sort(F.map_values(F.str_to_map(config, F.lit(","), F.lit(":"))))


def manipulated(text: Column, words: list[str]) -> Column:
    """Whether a message tries to talk the score up: it holds one of the words."""
    return T.any_of(text, words)


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """path (array of nodes) from start to end with the fewest edges, the least of those; no row if there is none.

    Breadth first, however far: each node keeps one path, the least, so the front is never larger than the graph, and
    the rounds end with the front.
    """
    from tessera.operators.graph import _cut, simple

    links = simple(edges).where("a <> b")
    both = _cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    front = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"))
    before = front.select("node")
    while not front.isEmpty():
        found = front.where(F.col("node") == end)
        if not found.isEmpty():
            return found.select("path")
        grown = both.join(front, both["a"] == front["node"]).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        ends = grown.groupBy("node").agg(F.min("path").alias("path")).join(front.select("node"), "node", "left_anti").join(before, "node", "left_anti")
        before, front = front.select("node"), _cut(ends)
    return front.select("path")


def visible(nodes: DataFrame, edges: DataFrame, text: str = "", kind: str | None = None, community: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label, type, community) that the filters leave, and the edges between them."""
    kept = nodes.where(F.lower("label").contains(text.lower()))
    kept = kept.where(F.col("type") == kind) if kind else kept
    kept = kept.where(F.col("community") == community) if community else kept
    ids = kept.select("node")
    return kept, edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
