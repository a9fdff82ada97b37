"""Writers: partitioned tables, JSON indexes, worklists, graph exports and their report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.sources.snapshots import absent, publish


def partitioned(rows: DataFrame, path: str, *columns: str, mode: str = "append") -> None:
    """Parquet in folders column=value, rows of a folder brought together first (large folders split by AQE)."""
    rows.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).parquet(path)


def archived(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    """Adds rows to the folders column=value at path, but those whose key the same folder has already: what is there stays as it is.

    Of new rows that share a key and a folder one is written, the first by a hash. Only the archive's keys and folders are read.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in (key, *columns)]
    new = rows.groupBy(key, *columns).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__row")).select(key, *columns, "__row.*")
    try:
        there = spark.read.schema(rows.schema).parquet(path).select(key, *columns)
    except AnalysisException as error:
        if not absent(error):
            raise
        there = None
    fresh = new if there is None else new.join(there, [F.equal_null(new[c], there[c]) for c in (key, *columns)], "left_anti")
    partitioned(fresh, path, *columns)


def latest_graph(nodes: DataFrame, edges: DataFrame, membership: DataFrame, root: str) -> int:
    """The graph's tables published as a version of root/nodes and one of root/edges; readers of the newest see whole ones alone."""
    full = nodes.join(membership, "node", "left").join(G.degrees(edges), "node", "left").fillna(0, ["degree"])
    publish(edges, f"{root}/edges")
    return publish(full, f"{root}/nodes")


def json_index(rows: DataFrame, path: str, version: int) -> None:
    """One JSON document a row with the version of the write."""
    rows.withColumn("index_version", F.lit(version)).write.mode("overwrite").json(path)


def worklist(rows: DataFrame) -> DataFrame:
    """Index rows without forms, explanations and references."""
    return rows.where(~F.col("doc_type").isin("feedback", "explanation") & (F.col("status") != "reference"))


def graph(nodes: DataFrame, edges: DataFrame, membership: DataFrame, path: str) -> None:
    """nodes (node, others) with community and degree, and edges, as two tables."""
    full = nodes.join(membership, "node", "left").join(G.degrees(edges), "node", "left").fillna(0, ["degree"])
    full.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def report(nodes: DataFrame, edges: DataFrame, membership: DataFrame, top: int = 15) -> DataFrame:
    """The lines of a Markdown report (section, n, line): counts, top nodes, communities, edges between them.

    Each part is an aggregate or a top-k of a few rows.
    """
    def lines(rows: DataFrame, section: int, line: str) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.monotonically_increasing_id().alias("n"), F.expr(line).alias("line"))

    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    parts = [
        lines(counts, 0, "format_string('# Graph: %d nodes, %d edges', nodes, edges)"),
        lines(G.degrees(edges).orderBy(F.desc("degree"), "node").limit(top), 1, "format_string('- %s: %d', node, degree)"),
        lines(G.cohesion(edges, membership).orderBy(F.desc("size"), "community").limit(top), 2, "format_string('- community %s: %d nodes, cohesion %.4f', community, size, cohesion)"),
        lines(G.cross_edges(edges, membership, top), 3, "format_string('- %s - %s (%d)', a, b, score)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_files(rows: DataFrame, path: str, version: int, updated: str, per_file: int = 10_000) -> None:
    """rows (documents of an index) as JSON objects with a header: version, last_updated, documents; about per_file a file.

    A file holds one object, however many of them a task writes: readers of whole files meet no second one.
    """
    files = -(-rows.count() // per_file) or 1
    chunk = F.pmod(F.xxhash64("id"), F.lit(files))
    objects = rows.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct(*rows.columns)).alias("documents"))
    objects.select(F.lit(str(version)).alias("version"), F.lit(updated).alias("last_updated"), "documents").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def outputs(docs: DataFrame, path: str) -> None:
    """docs (doc_id, markdown, json, others): a table of Markdown and a table of JSON, each with the doc_id."""
    docs.select("doc_id", "markdown").write.mode("overwrite").parquet(f"{path}/markdown")
    docs.select("doc_id", "json").write.mode("overwrite").parquet(f"{path}/json")


def append_ratings(ratings: DataFrame, path: str) -> None:
    """Adds ratings to the table at path, in folders by day."""
    ratings.write.mode("append").partitionBy("day").parquet(path)


def status_report(index: DataFrame) -> DataFrame:
    """The lines of a status report (section, n, line): all documents, then by category and by kind, the most first."""
    def by(column: str, section: int) -> DataFrame:
        rows = index.groupBy(column).agg(F.count("*").alias("c"), F.min("id").alias("first"))
        n = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(F.desc("c"), "first"))  # a row for each value
        return rows.select(F.lit(section).alias("section"), n.alias("n"), F.format_string("%s: %d", column, "c").alias("line"))

    total = index.agg(F.count("*").alias("c")).select(F.lit(0).alias("section"), F.lit(1).alias("n"), F.format_string("documents: %d", "c").alias("line"))
    return total.unionByName(by("category", 1)).unionByName(by("doc_type", 2))
