"""Sinks and sources: the driver's tables written as files to a shared folder and read back, as tables and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import elements as E
from tessera.operators import graph as G
from tessera.operators import index as I
from tessera.plans.common import LINES, RATINGS, documents, ratings, table
from tessera.plans.graph_queries import _D, _H, _T, _edges, _membership
from tessera.session import shared_folder
from tessera.sources import buckets, files, sinks, snapshots
from tessera.streaming import incremental as S
from tessera.streaming import stateful


def partition_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in folders by source and language, found again by their folders."""
    path = shared_folder(spark)
    sinks.partitioned(documents(spark, sf_dir).select("doc_id", "n_chars", "source", "lang"), path, "source", "lang")
    return spark.read.parquet(path).groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of those folders by extension and kind of folder, without their contents."""
    path = shared_folder(spark)
    sinks.partitioned(documents(spark, sf_dir).select("doc_id", "source", "lang").repartition(1), path, "source")
    found = files.listing(spark, path, ("parquet",))
    return found.groupBy("folder", "ext").agg((F.count("*") > 0).alias("there"), (F.min("length") > 0).alias("filled"))


def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the documents as JSON with a header, read back as rows."""
    path = shared_folder(spark)
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.lit("20240115").alias("issue_date"), F.lit("active").alias("status"), F.col("source").alias("doc_type"), F.struct(F.col("lang").alias("category"), F.array("lang", "source").alias("type")).alias("scope"), F.array("source").alias("tags"))
    sinks.index_files(d, path, 3, "2024-01-15T00:00:00")
    back = files.index(spark, path)
    return back.select("id", "title", "status", "doc_type", F.col("scope.category").alias("category"), F.array_join("scope.type", ",").alias("types"), F.array_join("tags", ",").alias("tags"))


def disk_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents (Markdown for all, JSON for two thirds) that the index of labelled ones does not know."""
    d = documents(spark, sf_dir)
    exts = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("md"))).otherwise(F.array(F.lit("md"), F.lit("json")))
    found = d.select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("stem"), F.explode(exts).alias("ext"))
    return files.recovered(found, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")))


def fresh_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose outputs are missing or older than they are."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("stem"), F.col("doc_id").alias("n"))
    sources = d.select("stem", F.timestamp_seconds(F.col("n")).alias("modified"))
    made = d.where("n % 4 <> 0").select("stem", F.timestamp_seconds(F.col("n") + F.col("n") % 3 - 1).alias("modified"))
    return files.fresh(made, sources).select("stem")


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the events of a user as versions of a file, the last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stem"), F.col("ts").alias("modified"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"))
    return files.newest(e).select("stem", "path")


def session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON-lines logs, a folder a session: start, lines and tool calls of each."""
    path = shared_folder(spark)
    _logs(spark, sf_dir, path)
    found = files.session_logs(spark, path).select(F.regexp_extract("file", r"session=(\d+)", 1).cast("long").alias("session"), "started", "lines", "tool_calls")
    return found.groupBy("session").agg(F.date_format(F.min("started"), "yyyy-MM-dd").alias("day"), F.sum("lines").alias("lines"), F.sum("tool_calls").alias("tool_calls"))


def tool_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools that those logs name most often."""
    path = shared_folder(spark)
    _logs(spark, sf_dir, path)
    return files.tool_counts(spark, path, 3)


def _logs(spark: SparkSession, sf_dir: str, path: str) -> None:
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 10).alias("session"), F.col("ts").alias("timestamp"), F.lit("user").alias("role"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("tool"), F.col("value").cast("string").alias("content"))
    rows.write.partitionBy("session").json(path)


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without forms, explanations and references."""
    title = F.when(F.col("doc_id") % 3 == 0, "起草说明 甲").when(F.col("doc_id") % 3 == 1, "指导原则（征求意见稿）").otherwise("中药研究")
    found = I.metadata(documents(spark, sf_dir).select("doc_id", F.concat(title, F.lit(".pdf")).alias("filename")))
    return sinks.worklist(found).select("doc_id", "doc_type", "status", "category")


def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status report of an index of all documents."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("doc_type"))
    return sinks.status_report(d.fillna("none"))


def extraction_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown and JSON of documents written, read back and put together."""
    path = shared_folder(spark)
    sinks.outputs(documents(spark, sf_dir).select("doc_id", F.col("text").alias("markdown"), F.to_json(F.struct("source", "n_chars")).alias("json")), path)
    both = spark.read.parquet(f"{path}/markdown").join(spark.read.parquet(f"{path}/json"), "doc_id")
    return both.select("doc_id", F.char_length("markdown").alias("chars"), F.get_json_object("json", "$.source").alias("source"))


def ratings_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings added to a table in two writes, by day."""
    path, rows = shared_folder(spark), ratings(spark, sf_dir)
    for half in (0, 1):
        sinks.append_ratings(rows.where(F.col("seq") % 2 == half), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.max("total").alias("best"))


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the labels written as two tables; its nodes read back."""
    path = shared_folder(spark)
    sinks.graph(_membership(spark).select("node"), _edges(spark, sf_dir), _membership(spark), path)
    return spark.read.parquet(f"{path}/nodes").select("node", "community", "degree")


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of its report."""
    return sinks.report(_membership(spark), _edges(spark, sf_dir), _membership(spark), 5).select("section", "line")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, users' days that are final by the watermark."""
    path, source = shared_folder(spark), table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    days = S.daily(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "1 day")
    query = days.writeStream.format("parquet").option("path", f"{path}/days").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{path}/days").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "n")


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as files that appear three times, the last time some with other contents; half of the first uploads fail."""
    path, key = shared_folder(spark), F.col("r_regionkey")
    regions = table(spark, sf_dir, "region")
    told = regions.select(F.concat(F.lit("name="), "r_name").alias("filename"), F.lit(0).alias("at"), F.when(key % 2 == 0, "completed").otherwise("failed").alias("status"))
    outcomes = [told.select(F.lit("name=unknown").alias("filename"), "at", "status").limit(1), told, told.limit(0)]
    for turn, of_turn in enumerate(outcomes):
        content = F.concat("r_name", F.when((key >= 2) & F.lit(turn == 2), " 1").otherwise(" 0"))
        regions.select(content.alias("value"), F.col("r_name").alias("name")).repartition("name").write.mode("append").partitionBy("name").text(f"{path}/files")
        of_turn.write.mode("append").parquet(f"{path}/outcomes")
        found = stateful.synced(S.new_files(spark, f"{path}/files", "*.txt", by_folder=True), spark.readStream.schema(told.schema).parquet(f"{path}/outcomes"))
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").select("filename", "md5", "reason")


def score_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days of three or more events that have no score; purchases count as scored."""
    e = table(spark, sf_dir, "events")
    days = S.daily(e.select("user_id", "ts"), None)
    scored = e.where("event_type = 'purchase'").select("user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    return S.due_for_score(days, scored, 3).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an index in 256 buckets; the events of users with such keys rewrite the buckets that they fall into."""
    path = f"{shared_folder(spark)}/index"
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("at"))
    buckets.create(orders, path, "id", "at", 256)
    updates = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("value").alias("price"), F.col("event_id").alias("at"))
    buckets.upsert(updates, path, "id", "at", 256)
    return buckets.read(spark, path).select("id", "status", "price", F.col("batch").cast("int").alias("batch"), "place")


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels published twice, more the second time; a later write breaks off; read by way of a root that has nothing."""
    root, labels = shared_folder(spark), table(spark, sf_dir, "labels")
    snapshots.publish(labels.where("quality = 0"), root)
    snapshots.publish(labels, root)
    labels.where("toxic = 1").write.parquet(f"{root}/data/00000003-broken")
    return snapshots.read(spark, f"{root}/none", fallbacks=(f"{root}/other", root)).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers published by region, each version with the regions before it, two of them kept."""
    root = shared_folder(spark)
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")  # 25 nations
    for region in range(4):
        snapshots.publish(rows.where(F.col("n_regionkey") <= region).select("c_custkey"), root, keep=2)
    return snapshots.manifest(spark, root).select("version", "label", "rows", "expired")


def _in_turns(spark: SparkSession, turns: list[DataFrame], path: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of rows that come in turns; it ends after each turn and goes on from its checkpoint."""
    for rows in turns:
        rows.write.mode("append").parquet(f"{path}/in")
        out = made(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def stream_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that are found (with one of two contents) and outcomes of their uploads, in three turns."""
    e = table(spark, sf_dir, "events")
    kind, last = F.col("event_type"), e.agg(F.max("event_id")).head()[0] or 0
    rows = e.select(F.col("user_id").cast("string").alias("filename"), F.col("event_id").alias("at"), F.when(~kind.isin("error", "purchase"), F.md5((F.floor("value") % 2).cast("string"))).alias("md5"), F.when(kind == "error", "failed").when(kind == "purchase", "completed").alias("status"))
    turns = [rows.where(F.floor(F.col("at") * 3 / (last + 1)) == k) for k in range(3)]
    return _in_turns(spark, turns, shared_folder(spark), stateful.tracked).withColumnRenamed("at", "seq")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote three messages before 17:20 and was not scored (by a purchase); rows come up to 90 minutes late, in three turns."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min("ts").cast("long"), F.max("ts").cast("long")).head()
    came = F.col("ts").cast("long") + F.col("event_id") % 90 * 60
    rows = e.select("user_id", "ts", (F.col("event_type") == "purchase").alias("scored"), F.floor((came - first) * 3 / (last - first + 5401)).alias("turn"))
    turns = [rows.where(F.col("turn") == k).drop("turn") for k in range(3)]
    found = _in_turns(spark, turns, shared_folder(spark), lambda m: stateful.scores_due(m, "2 hours", 3))
    return found.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def element_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a tree, every order inside the one before, as deep as there are orders; flattened."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    kid = lambda x: F.concat(F.lit('{"type":"'), x["o_orderstatus"], F.lit('","content":"'), x["o_orderkey"].cast("string"), F.lit('","page number":'), (x["o_orderkey"] % 90).cast("string"))
    nested = F.aggregate(F.reverse(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))), F.lit(""), lambda inner, x: F.concat(F.lit('"kids":['), kid(x), F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(""), F.lit("}]")))
    trees = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("{"), nested, F.lit("}")).alias("json"))
    return files.element_trees(trees).select("doc_id", F.size("path").alias("depth"), "type", "content", "page")


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of documents as pages of ten, some scanned, with digital elements and recognised ones, which some pages lack."""
    c, p = F.col("content"), F.floor(F.col("pos") / 10) + 1
    rows = E.elements(documents(spark, sf_dir)).select("doc_id", p.cast("long").alias("page"), "pos", F.when(c.contains("|"), "table").otherwise("paragraph").alias("type"), F.left("content", F.lit(40)).alias("content"))
    pages = rows.select("doc_id", "page").distinct().withColumn("kind", F.when((F.col("doc_id") + F.col("page")) % 4 == 0, "scanned").otherwise("digital"))
    return pages, rows, rows.where("(doc_id + page) % 3 <> 0").withColumn("content", F.concat(F.lit("~"), "content"))


def pages_to_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, digital, _ = _pages(spark, sf_dir)
    return E.pages_to_recognise(pages, digital)


def united_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages put together from both origins."""
    return E.united(*_pages(spark, sf_dir)).select("doc_id", "place", "page", "part", "origin", "content")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, in UTF-8, in GBK or in neither; read back as texts."""
    n, path = F.col("n_nationkey"), shared_folder(spark)
    lines = F.when(n % 3 == 0, F.concat(F.lit("稳定性 "), "n_name")).when(n % 3 == 1, F.concat(F.unhex(F.lit("CEC8B6A8D0D4")).cast("string"), F.lit(" "), "n_name")).otherwise(F.unhex(F.lit("FFFEFF")).cast("string"))
    table(spark, sf_dir, "nation").select(lines.alias("value"), n.alias("key")).repartition("key").write.partitionBy("key").text(path)
    return files.texts(spark, path, "*.txt").select(F.regexp_extract("path", r"key=(\d+)", 1).cast("long").alias("key"), "text")


def archive_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents archived by source and language, then all documents: what is there stays, the rest is added."""
    path, d = f"{shared_folder(spark)}/archive", documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars")
    labelled = d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    sinks.archived(labelled.withColumn("n_chars", -F.col("n_chars")), path, "doc_id", "source", "lang")
    sinks.archived(d, path, "doc_id", "source", "lang")
    return spark.read.schema(d.schema).parquet(path).select("doc_id", "source", "lang", "n_chars")


def graph_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of strong edges published, then that of all; the newest nodes."""
    root, edges, nodes = shared_folder(spark), _edges(spark, sf_dir), _membership(spark)
    for some in (edges.where("weight > 2"), edges):
        sinks.latest_graph(nodes.select("node"), some, nodes, root)
    return snapshots.read(spark, f"{root}/nodes").select("node", "community", "degree")


QUERIES = {f.__name__: f for f in (partition_folders, file_listing, json_index, disk_recovery, fresh_outputs, newest_files, session_logs, tool_top, worklist, index_report, extraction_outputs, ratings_append, graph_export, graph_report, stream_daily, stream_sync, score_due, upsert_buckets, snapshot_latest, snapshot_versions, stream_tracked, stream_scores, element_forest, pages_to_recognise, united_elements, text_files, archive_once, graph_latest)}

_PAGES = f"""{LINES}, d AS (SELECT doc_id, pos // 10 + 1 AS page, pos, CASE WHEN contains(content, '|') THEN 'table' ELSE 'paragraph' END AS type, left(content, 40) AS content FROM e),
n AS (SELECT doc_id, page, max(CASE WHEN (doc_id + page) % 4 = 0 THEN 2 WHEN type = 'table' THEN 1 ELSE 0 END) AS part FROM d GROUP BY 1, 2)"""

SQL = {
    "partition_folders": "SELECT source, lang, count(*) AS documents, sum(n_chars) AS chars FROM documents GROUP BY 1, 2",
    "file_listing": "SELECT DISTINCT 'source=' || source AS folder, 'parquet' AS ext, true AS there, true AS filled FROM documents",
    "json_index": "SELECT CAST(doc_id AS VARCHAR) AS id, trim(split_part(text, chr(10), 1)) AS title, 'active' AS status, source AS doc_type, lang AS category, concat_ws(',', lang, source) AS types, source AS tags FROM documents",
    "disk_recovery": "SELECT CAST(doc_id AS VARCHAR) AS id, min(source) AS folder FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "fresh_outputs": "SELECT CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0",
    "newest_files": "SELECT user_id AS stem, lpad(CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR), 12, '0') AS path FROM events GROUP BY 1",
    "session_logs": "SELECT user_id % 10 AS session, strftime(min(ts), '%Y-%m-%d') AS day, count(*) AS lines, count(*) FILTER (WHERE event_type <> 'error') AS tool_calls FROM events GROUP BY 1",
    "tool_top": "SELECT event_type AS tool, count(*) AS calls FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY calls DESC, tool LIMIT 3",
    "worklist": "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'draft' ELSE 'main' END AS doc_type, CASE doc_id % 3 WHEN 1 THEN 'draft' ELSE 'active' END AS status, CASE doc_id % 3 WHEN 1 THEN '通用' ELSE '中药' END AS category FROM documents WHERE doc_id % 3 <> 0",
    "index_report": """WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents), a AS (SELECT lang AS k, count(*) AS c, min(doc_id) AS f FROM d GROUP BY 1), b AS (SELECT source AS k, count(*) AS c, min(doc_id) AS f FROM d GROUP BY 1)
SELECT 0 AS section, 1 AS n, 'documents: ' || count(*) AS line FROM d UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY c DESC, f) AS INTEGER), k || ': ' || c FROM a UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY c DESC, f) AS INTEGER), k || ': ' || c FROM b""",
    "extraction_outputs": "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, source FROM documents",
    "ratings_append": f"WITH {RATINGS} SELECT day, count(*) AS n, max(total) AS best FROM r GROUP BY 1",
    "graph_export": f"WITH {_T}, {_H}, {_D} SELECT label AS node, type AS community, coalesce(degree, 0) AS degree FROM v LEFT JOIN d ON node = label",
    "graph_report": f"""WITH {_T}, {_H}, {_D}, n AS (SELECT type AS community, count(*) AS size FROM v GROUP BY 1), i AS (SELECT a.type AS community, count(*) AS e FROM g JOIN v a ON a.label = source JOIN v b ON b.label = target WHERE a.type = b.type GROUP BY 1),
x AS (SELECT source AS a, target AS b, dx.degree + dy.degree AS score FROM g JOIN v x ON x.label = source JOIN v y ON y.label = target JOIN d dx ON dx.node = source JOIN d dy ON dy.node = target WHERE x.type <> y.type ORDER BY score DESC, a, b LIMIT 5)
SELECT 0 AS section, '# Graph: ' || (SELECT count(*) FROM v) || ' nodes, ' || (SELECT count(*) FROM g) || ' edges' AS line UNION ALL (SELECT 1, '- ' || node || ': ' || degree FROM d ORDER BY degree DESC, node LIMIT 5)
UNION ALL SELECT 2, printf('- community %s: %d nodes, cohesion %.4f', community, size, round(2.0::DOUBLE * coalesce(e, 0) / (size * (size - 1)), 4)) FROM n LEFT JOIN i USING (community) UNION ALL SELECT 3, '- ' || a || ' - ' || b || ' (' || score || ')' FROM x""",
    "stream_daily": """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_sync": """SELECT 'name=' || r_name AS filename, md5(r_name || CASE WHEN t = 2 AND r_regionkey >= 2 THEN ' 1' ELSE ' 0' END || chr(10)) AS md5,
  CASE WHEN t = 0 THEN 'new' WHEN t = 2 AND r_regionkey >= 2 THEN 'changed' WHEN r_regionkey % 2 = 0 THEN 'unchanged' WHEN t = 1 THEN 'retry' ELSE 'waiting' END AS reason FROM region, (SELECT unnest([0, 1, 2]) AS t)""",
    "score_due": "WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, bool_or(event_type = 'purchase') AS scored FROM events GROUP BY 1, 2) SELECT user_id, day, n FROM d WHERE n >= 3 AND NOT scored",
    "upsert_buckets": """WITH u AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS price, min(event_id) AS first FROM events GROUP BY 1)
SELECT coalesce(u.id, o.o_orderkey) AS id, CASE WHEN u.id IS NOT NULL THEN u.status ELSE o.o_orderstatus END AS status, CASE WHEN u.id IS NOT NULL THEN u.price ELSE o.o_totalprice END AS price,
  CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END AS batch, coalesce(o.o_orderkey, u.first) AS place FROM orders o FULL JOIN u ON o.o_orderkey = u.id""",
    "snapshot_latest": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    "snapshot_versions": """WITH c AS (SELECT n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey), v AS (SELECT unnest([1, 2, 3, 4]) AS v)
SELECT CAST(v AS BIGINT) AS version, '1.' || (v - 1) AS label, (SELECT count(*) FROM c WHERE r < v) AS rows, v <= 2 AS expired FROM v""",
    "stream_tracked": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS filename, event_id AS seq, event_type IN ('error', 'purchase') AS told, event_type = 'purchase' AS good, md5(CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR)) AS md5 FROM events),
f AS (SELECT filename, seq, md5, lag(md5) OVER w AS before, lag(seq) OVER w AS last_found FROM e WHERE NOT told WINDOW w AS (PARTITION BY filename ORDER BY seq)),
c AS (SELECT *, max(CASE WHEN before IS NULL OR before <> md5 THEN seq END) OVER (PARTITION BY filename ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_change FROM f),
o AS (SELECT c.*, x.seq AS told_at, x.good FROM c ASOF LEFT JOIN (SELECT * FROM e WHERE told) x ON c.filename = x.filename AND c.seq > x.seq)
SELECT filename, seq, md5, CASE WHEN before IS NULL THEN 'new' WHEN before <> md5 THEN 'changed' WHEN told_at IS NULL OR told_at < last_change THEN 'waiting' WHEN good THEN 'unchanged' WHEN last_found < told_at THEN 'retry' ELSE 'waiting' END AS reason FROM o""",
    "stream_scores": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type <> 'purchase') AS n, bool_or(event_type = 'purchase') AS scored FROM events WHERE CAST(ts AS TIME) < TIME '17:20' GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n FROM d WHERE n >= 3 AND NOT scored AND day + INTERVAL '17 hours 20 minutes' <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "element_forest": "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS depth, o_orderstatus AS type, CAST(o_orderkey AS VARCHAR) AS content, CAST(o_orderkey % 90 AS INTEGER) AS page FROM orders",
    "pages_to_recognise": f"WITH {_PAGES} SELECT doc_id, page, CAST(part AS INTEGER) AS part FROM n WHERE part > 0",
    "united_elements": f"""WITH {_PAGES}, u AS (SELECT doc_id, page, part, pos, type, CASE WHEN part > 0 AND (doc_id + page) % 3 <> 0 THEN 'recognised' ELSE 'digital' END AS origin, content FROM d JOIN n USING (doc_id, page))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, page, pos) - 1 AS INTEGER) AS place, page, CAST(part AS INTEGER) AS part, origin, CASE origin WHEN 'recognised' THEN '~' || content ELSE content END AS content FROM u""",
    "text_files": "SELECT CAST(n_nationkey AS BIGINT) AS key, CASE n_nationkey % 3 WHEN 2 THEN '' ELSE '稳定性 ' || n_name || chr(10) END AS text FROM nation",
    "archive_once": "SELECT doc_id, source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -n_chars ELSE n_chars END AS n_chars FROM documents",
    "graph_latest": f"WITH {_T}, {_H}, {_D} SELECT label AS node, type AS community, coalesce(degree, 0) AS degree FROM v LEFT JOIN d ON node = label",
}
