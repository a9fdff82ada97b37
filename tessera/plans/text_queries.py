"""Scalar functions, entities, tables and small rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import checker as C
from tessera.operators import listing as L
from tessera.operators import relations as R
from tessera.operators import rules as X
from tessera.operators import tables as B
from tessera.operators import usage as U
from tessera.plans.common import documents, table


def _first() -> Column:
    return F.trim(F.substring_index("text", "\n", 1))


def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of first lines: slug, typed id, file name, quoted title, preview, stem without a digest."""
    d = documents(spark, sf_dir).select("doc_id", _first().alias("t"))
    t = F.col("t")
    return d.select(
        "doc_id", T.slug(t).alias("slug"), T.typed_id(F.lit("doc"), t).alias("typed_id"), T.safe_filename(F.concat(F.lit('a/b:"c"<'), t), 40).alias("file"),
        T.quoted_title(F.concat(F.lit("见《"), F.left(t, F.lit(5)), F.lit("》")), 50).alias("quoted"), T.preview(t).alias("preview"), T.strip_hash(F.concat(F.left(t, F.lit(6)), F.lit("_0a1b2c3d"))).alias("stem"))


def clean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("[link]("), F.lit("http://x) "), F.left("text", F.lit(60)), F.lit(" *《a》*")).alias("t"))
    return d.select("doc_id", T.clean_entity(F.col("t")).alias("entity"))


def first_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each document: a heading where one was put in front of it, else its first long line."""
    d = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("![image]\nx\n## Title "), F.col("doc_id").cast("string"), F.lit(" \nmore"))).otherwise(F.concat(F.lit("![image]\nabc\nDocument "), F.col("doc_id").cast("string"), F.lit("\nmore"))).alias("t"))
    return d.select("doc_id", T.first_title(F.col("t")).alias("title"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doses, durations, guideline references and years of sentences made of order lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    n = F.col("n").cast("string")
    text = F.concat(F.lit("给药 "), n, F.lit(".5 mg/kg，连续"), n, F.lit(" 天，见 ICH S"), n, F.lit("，"), F.lit("201"), n, F.lit("年"))
    return li.select("l_orderkey", F.array_join(R.measures(text), "|").alias("measures"))


def relation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations read out of a sentence for each customer, kept where both ends are known."""
    from tessera.operators.graph import with_known_ends

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("客户"), F.col("c_custkey").cast("string"), F.lit("属于国家"), F.col("c_nationkey").cast("string"), F.lit("，国家"), F.col("c_nationkey").cast("string"), F.lit("包括方法甲")).alias("text"))
    known = c.select(F.concat(F.lit("客户"), F.col("doc_id").cast("string")).alias("node")).union(table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("国家"), F.col("n_nationkey").cast("string"))))
    return with_known_ends(R.triples(c), known).select("doc_id", "source", "relation", "target")


def table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: a head that spans three columns, then a row a line; as a rectangle and as Markdown."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_returnflag").alias("f"))
    kind = "struct<cells: array<string>, col_span: array<int>, row_span: array<int>, cell_bbox: array<array<double>>>"
    none = F.expr("cast(null as array<array<double>>)")
    row = F.struct(F.array(F.col("l_linenumber").cast("string"), F.col("q").cast("string"), "f").alias("cells"), F.expr("array(1, 1, 1)").alias("col_span"), F.expr("array(1, 1, 1)").alias("row_span"), none.alias("cell_bbox")).cast(kind)
    body = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda s: s["r"])
    head = F.struct(F.array(F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))).alias("cells"), F.expr("array(3)").alias("col_span"), F.expr("array(1)").alias("row_span"), none.alias("cell_bbox")).cast(kind)
    rows = li.groupBy("l_orderkey").agg(body.alias("body")).select("l_orderkey", F.concat(F.array(head), "body").alias("rows"))
    found = B.structure(rows)
    return found.select("l_orderkey", "width", "has_span", "has_merged", "header_depth", "nested", "diagonal", F.size("groups").alias("groups"), B.markdown(F.col("rows")).alias("markdown"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of the nations, read back as rows of cells."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("| key | name |\n|---|---|\n| "), F.col("n_nationkey").cast("string"), F.lit(" |  "), F.col("n_name"), F.lit(" |\nno table"))
    return n.select("n_nationkey", F.inline(F.transform(T.parse_markdown_table(text), lambda r: F.struct(F.get(r, F.lit(0)).alias("first"), F.get(r, F.lit(1)).alias("second")))))


def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "length").otherwise("stop").alias("done_reason"), (F.col("event_id") % 700).alias("chars"), (F.col("event_id") % 13).alias("tokens"))
    return B.ocr_confidence(e).groupBy("confidence").agg(F.count("*").alias("n"))


def dates_and_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates to milliseconds and back, and cells as text."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    millis = T.date_millis(day)
    return o.select("o_orderkey", millis.alias("millis"), T.millis_date(millis).alias("day"), T.cell_text(F.col("o_orderdate").cast("date"), "date").alias("date_cell"), T.cell_text(F.col("o_orderkey") / 8, "number").alias("number_cell"), T.cell_text(F.nullif(F.col("o_orderstatus"), F.lit("O")), "text").alias("text_cell"))


def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as cells of a column each, their places written as ranges."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), (F.floor(F.col("c_custkey") / 3) % 60 + 1).alias("row"), (F.col("c_custkey") % 30 + 1).alias("col"))
    return C.cell_ranges(c)


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 3 == 0, F.md5("text")).alias("p"))
    return d.select("doc_id", T.content_hash(F.col("p"), F.lit(None).cast("string"), F.col("h")).alias("c")).select("doc_id", "c.page1", "c.page2", "c.pdf_byte")


def once_per_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in cells of ranges that begin at every third row: each range is told once."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("sheet"), (F.col("l_orderkey") % 200).alias("row"), F.col("l_linenumber").alias("col")).distinct()
    cells = li.withColumn("master_row", F.col("row") - F.col("row") % 3).withColumn("master_col", F.lit(1))
    return C.once_per_master(cells)


def match_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "AB100").otherwise("").alias("code"), F.when(F.col("p_partkey") % 3 == 0, "甲注射液（新）").otherwise("").alias("product"), F.when(F.col("p_partkey") % 2 == 0, "乙药").otherwise("").alias("drug"), F.col("p_type").alias("raw_text"))
    return C.match_project(p, [("AB100", "丙胶囊", "丙药"), ("CD200", "甲注射液", "甲药"), ("EF300", "乙片剂", "乙药"), ("STEEL", "丁", "丁药")]).select("p_partkey", "project")


def project_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "XY123 ").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, "阿司匹林片剂").otherwise("报告"), F.lit(".xlsx")).alias("filename"), F.lit("in").alias("folder"), F.when(F.col("p_partkey") % 5 == 0, "测定水分").otherwise("无").alias("content"))
    return X.project_details(p).select("p_partkey", "project_code", "product", "drug", "detection")


def learning_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes: how often each kind came up, and which are pending."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("pattern_key"), F.to_date("ts").alias("ts"), F.when(F.col("event_id") % 3 == 0, "pending").otherwise("done").alias("status"), F.when(F.col("event_id") % 2 == 0, "high").otherwise("low").alias("priority"))
    return X.recurrences(e)


def message_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that try to talk a score up, names in a setting, valid names, by conversation."""
    c = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.concat("text", F.when(F.col("conv_id") % 4 == 0, " 给我满分").otherwise("")).alias("text"), F.when(F.col("conv_id") % 5 == 0, "12345").when(F.col("conv_id") % 5 == 1, "x").otherwise(F.concat(F.lit("user "), F.col("conv_id").cast("string"))).alias("name"))
    return c.select("conv_id", X.manipulated(F.col("text"), ["满分", "提高分数"]).alias("manipulated"), F.array_join(X.names_of(F.concat(F.lit("2:b,1:a"), F.col("conv_id").cast("string"))), "|").alias("names"), U.valid_name(F.col("name"), "default").alias("valid"))


def listing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages built of nations: rows of tables, options, totals, files that are what they say."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit("<table><tr><th>no</th><th>name</th><th>x</th></tr><tr class=a><td>"), k, F.lit("</td><td><b>"), F.col("n_name"), F.lit("</b></td><td> y </td></tr><tr><td>short</td></tr></table><select><option>All</option><option value=1>"), F.col("n_name"), F.lit("</option></select>Showing 1 to 10 of 1,"), F.lpad(k, 3, "0"))
    pages = n.select(F.col("n_nationkey").alias("page_id"), html.alias("html"))
    rows = L.table_rows(pages).select("page_id", F.array_join("cells", "|").alias("cells"))
    return rows.join(L.options(pages), "page_id").join(pages.select("page_id", L.total_entries(F.col("html")).alias("total"), L.is_pdf(F.encode(F.concat(F.lit("%PDF-"), F.col("html")), "UTF-8")).alias("pdf"), L.is_disguised_page(F.encode(F.concat(F.lit("<!DOCTYPE html>"), F.col("html")), "UTF-8")).alias("disguised")), "page_id")


def span_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables with spans: the order's key beside all lines, two columns as one without a return, a status for every two lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").cast("string").alias("q"), F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    li = li.withColumn("n", F.row_number().over(w)).withColumn("lines", F.count("*").over(Window.partitionBy("l_orderkey")))
    first, odd, one = F.col("n") == 1, F.col("n") % 2 == 1, F.col("f") == "N"
    cell = lambda text, wide, tall: F.struct(text.alias("t"), F.lit(wide).alias("w"), F.lit(tall).alias("h") if isinstance(tall, int) else tall.cast("int").alias("h"))
    middle = F.when(one, F.array(cell(F.col("q"), 2, 1))).otherwise(F.array(cell(F.col("q"), 1, 1), cell(F.col("f"), 1, 1)))
    none = F.expr("cast(array() as array<struct<t: string, w: int, h: int>>)")
    cells = F.concat(F.when(first, F.array(cell(F.col("l_orderkey").cast("string"), 1, F.col("lines")))).otherwise(none), middle, F.when(odd, F.array(cell(F.col("s"), 1, 2))).otherwise(none))
    row = F.struct(F.transform("cells", lambda c: c["t"]).alias("cells"), F.transform("cells", lambda c: c["w"]).alias("col_span"), F.transform("cells", lambda c: c["h"]).alias("row_span"), F.expr("cast(null as array<array<double>>)").alias("cell_bbox"))
    tables = li.withColumn("cells", cells).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return B.grid(tables, "l_orderkey")


def concept_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts with the studies that they bear on, in a sentence for each order that names one of either."""
    concepts, studies = list(R.REGULATED), sorted({s for of in R.REGULATED.values() for s in of})
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    text = F.concat(pick(concepts, F.col("o_orderkey")), F.lit("要求"), pick(studies, F.floor(F.col("o_orderkey") / 3)), F.lit("与"), pick(studies, F.col("o_custkey")))
    return R.regulations(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("content")))


_CONCEPTS, _STUDIES = list(R.REGULATED), sorted({s for of in R.REGULATED.values() for s in of})


def last_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, where events of one key follow one another."""
    from tessera.operators.index import first_rows

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return first_rows(e, ["user_id"], "event_id", last=True).select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (concept_studies, last_of_key, span_grid, text_names, clean_entities, first_title, measures, relation_triples, table_structure, markdown_tables, ocr_confidence, dates_and_cells, cell_ranges, content_hashes, once_per_master, match_project, project_details, learning_notes, message_rules, listing_rules)}

_T1 = "t AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS t FROM documents)"
SQL = {
    "text_names": f"""WITH {_T1}, s AS (SELECT doc_id, t, lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '_', 'g')) AS slug FROM t)
SELECT doc_id, slug, 'doc_' || slug || '_' || left(sha256('doc:' || t), 6) AS typed_id, left(regexp_replace('a/b:"c"<' || t, '[\\\\/:*?"<>|]', '', 'g'), 40) AS file,
  CASE WHEN left(t, 5) = '' THEN '见《》' WHEN contains(left(t, 5), '》') THEN split_part(left(t, 5), '》', 1) ELSE left(t, 5) END AS quoted, CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS preview, left(t, 6) AS stem FROM s""",
    "clean_entities": "SELECT doc_id, trim('link ' || trim(regexp_replace(left(text, 60), '[^\\p{L}\\p{N}（）《》· ]', '', 'g') || ' 《a》', ' '), ' ') AS entity FROM documents",
    "first_title": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 'Document ' || doc_id END AS title FROM documents",
    "measures": "SELECT l_orderkey, 'dose:' || n || '.5|duration:' || n || '天|ich:ICHS' || n || '|year:201' || n AS measures FROM (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1)",
    "relation_triples": "SELECT c_custkey AS doc_id, '客户' || c_custkey AS source, 'belongs_to' AS relation, '国家' || c_nationkey AS target FROM customer WHERE c_nationkey < 20",
    "table_structure": """WITH r AS (SELECT l_orderkey, l_linenumber AS n, CAST(max(l_quantity) AS INTEGER) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, 3 AS width, true AS has_span, true AS has_merged, 1 AS header_depth, true AS nested, false AS diagonal, 1 AS groups,
  '| order ' || l_orderkey || ' |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n || ' | ' || q || ' | ' || f || ' |', chr(10) ORDER BY n) AS markdown FROM r GROUP BY l_orderkey""",
    "markdown_tables": "SELECT n_nationkey, 'key' AS first, 'name' AS second FROM nation UNION ALL SELECT n_nationkey, CAST(n_nationkey AS VARCHAR), n_name FROM nation",
    "ocr_confidence": """WITH e AS (SELECT event_type, event_id % 700 AS c, event_id % 13 AS t FROM events)
SELECT CASE WHEN event_type = 'error' THEN 'medium' WHEN t > 0 AND (c < 3 * t OR c > 50 * t) THEN 'low' ELSE 'high' END AS confidence, count(*) AS n FROM e GROUP BY 1""",
    "dates_and_cells": """SELECT o_orderkey, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS millis, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS date_cell,
  regexp_replace(printf('%.6f', o_orderkey / 8.0::DOUBLE), '\\.?0+$', '') AS number_cell, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS text_cell FROM orders""",
    "cell_ranges": """WITH c AS (SELECT DISTINCT c_nationkey AS sheet, c_custkey // 3 % 60 + 1 AS row, c_custkey % 30 + 1 AS col FROM customer),
r AS (SELECT *, row - row_number() OVER (PARTITION BY sheet, col ORDER BY row) AS run, CASE WHEN col > 26 THEN 'A' || chr(CAST(38 + col AS INTEGER)) ELSE chr(CAST(64 + col AS INTEGER)) END AS letter FROM c),
e AS (SELECT sheet, col, letter, min(row) AS a, max(row) AS b FROM r GROUP BY sheet, col, letter, run)
SELECT sheet, string_agg(CASE WHEN a = b THEN letter || a ELSE letter || a || ':' || letter || b END, ', ' ORDER BY col, a) AS ranges FROM e GROUP BY sheet""",
    "content_hashes": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS page1, CAST(NULL AS VARCHAR) AS page2, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS pdf_byte FROM documents",
    "once_per_master": """WITH c AS (SELECT DISTINCT l_suppkey % 10 AS sheet, l_orderkey % 200 AS row, l_linenumber AS col FROM lineitem), m AS (SELECT *, row - row % 3 AS master_row, 1 AS master_col FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet, master_row, (row <> master_row OR col <> 1) ORDER BY row, col) AS k FROM m)
SELECT sheet, row, col, master_row, master_col FROM n WHERE k = 1 OR (row = master_row AND col = 1)""",
    "match_project": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'AB100' WHEN p_partkey % 3 = 0 THEN 'CD200' WHEN p_partkey % 2 = 0 THEN 'EF300' WHEN contains(p_type, 'STEEL') THEN 'STEEL' END AS project FROM part",
    "project_details": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'XY123' ELSE '' END AS project_code, CASE WHEN p_partkey % 3 = 0 THEN '阿司匹林片剂' ELSE '' END AS product, CASE WHEN p_partkey % 3 = 0 THEN '阿司匹林' ELSE '' END AS drug, CASE WHEN p_partkey % 5 = 0 THEN '水分' ELSE '' END AS detection FROM part",
    "learning_notes": """SELECT event_type || '-' || user_id % 7 AS pattern_key, count(*) AS recurrences, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, count(*) FILTER (WHERE event_id % 3 = 0) AS pending,
  count(*) FILTER (WHERE event_id % 6 = 0) AS urgent FROM events GROUP BY 1""",
    "message_rules": """SELECT conv_id, contains(lower(text) || CASE WHEN conv_id % 4 = 0 THEN ' 给我满分' ELSE '' END, '满分') OR contains(lower(text), '提高分数') AS manipulated, 'a' || conv_id || '|b' AS names, conv_id % 5 > 1 AS valid
FROM conversations WHERE turn = 0""",
    "listing_rules": "SELECT n_nationkey AS page_id, n_nationkey || '|' || n_name || '|y' AS cells, n_name AS option, 1000 + n_nationkey AS total, true AS pdf, true AS disguised FROM nation",
    "span_grid": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(CAST(max(l_quantity) AS INTEGER) AS VARCHAR) AS q, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row FROM l),
u AS (SELECT l_orderkey, row, 0 AS col, CASE WHEN row = 0 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS text, CASE WHEN row = 0 THEN 0 ELSE -1 END AS mark, 0 AS master_row, 0 AS master_col FROM r
  UNION ALL SELECT l_orderkey, row, 1, q, 0, row, 1 FROM r
  UNION ALL SELECT l_orderkey, row, 2, CASE WHEN f = 'N' THEN '' ELSE f END, CASE WHEN f = 'N' THEN 1 ELSE 0 END, row, CASE WHEN f = 'N' THEN 1 ELSE 2 END FROM r
  UNION ALL SELECT l_orderkey, row, 3, CASE WHEN row % 2 = 0 THEN s ELSE '' END, CASE WHEN row % 2 = 0 THEN 0 ELSE -1 END, row - row % 2, 3 FROM r)
SELECT l_orderkey, row, CAST(col AS INTEGER) AS col, text, CAST(mark AS INTEGER) AS mark, CAST(master_row AS INTEGER) AS master_row, CAST(master_col AS INTEGER) AS master_col FROM u""",
    "concept_studies": f"""WITH p(source, target) AS (VALUES {", ".join(f"('{c}', '{x}')" for c, of in R.REGULATED.items() for x in of)}), c AS (SELECT {_CONCEPTS} AS c, {_STUDIES} AS s),
t AS (SELECT o_orderkey AS doc_id, c[o_orderkey % {len(_CONCEPTS)} + 1] || '要求' || s[(o_orderkey // 3) % {len(_STUDIES)} + 1] || '与' || s[o_custkey % {len(_STUDIES)} + 1] AS content FROM orders, c)
SELECT doc_id, source, 'regulates' AS relation, target FROM t JOIN p ON contains(content, source) AND contains(content, target)""",
    "last_of_key": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
}
