"""Index upkeep, listings and worksheet checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import checker as C
from tessera.operators import index as I
from tessera.operators import listing as L
from tessera.plans.common import LINES, documents, table

_LIMITS = [("BRUSHED TIN", 0.3), ("STEEL", 0.0), ("COPPER", 0.05)]
_TITLES = ("化学药物稳定性研究技术指导原则", "中药新药临床试验指导原则（征求意见稿）", "生物制品注册申报资料起草说明", "注射剂配伍研究（试行）", "反馈意见表 原料药质量标准", "毒理学研究")


def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source (category) and language (kind), with the first document of each."""
    return documents(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    return table(spark, sf_dir, "labels").agg(F.count_if((q == 1) & (F.col("toxic") == 0)).alias("active"), F.count_if(q == 0).alias("draft"), F.count_if((q == 1) & (F.col("toxic") == 1)).alias("other"))


def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata from file names made of a document's date and one of a few titles."""
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES) + 1).cast("int"))
    date = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("15-")))
    files = documents(spark, sf_dir).select("doc_id", F.concat(date, title, F.lit(".pdf")).alias("filename"))
    found = I.metadata(files)
    return found.select("doc_id", "id", "title", "issue_date", "doc_type", "status", "category", F.array_join("drug_types", ",").alias("drug_types"), F.array_join("tags", ",").alias("tags"), "folder")


def anti_join_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is new against the labelled ones, the first of each text."""
    docs = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("id"))
    indexed = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return I.new_rows(docs, indexed, "id", "doc_id")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the index; of the events, those of a user update the order of that key."""
    current = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    updates = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("value").alias("price"), "event_id")
    return I.upsert(current, updates, "id", "event_id")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files against a state that holds two thirds of them, some with another digest or failed."""
    files = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("filename"), F.md5("text").alias("md5"))
    n = F.col("filename").cast("long")
    state = files.where(n % 3 != 0).select("filename", F.when(n % 5 == 0, F.lit("old")).otherwise(F.col("md5")).alias("md5"), F.when(n % 7 == 0, "failed").otherwise("completed").alias("status"))
    return I.changed(files, state)


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once: digest, copies, first document (summed up before the shuffle)."""
    docs = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return docs.where("copies > 1")


def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document that each document repeats: by digests of its first and last 200 characters, which some lack, or of the whole.

    Some titles have an edition mark, some dates differ.
    """
    n, title = F.col("doc_id"), F.trim(F.substring_index("text", "\n", 1))
    page = lambda c: F.when(n % 5 != 0, F.sha2(c, 256))
    docs = documents(spark, sf_dir).select(
        n.alias("id"), n.alias("pos"), F.when(n % 2 == 0, F.concat(title, F.lit("（试行）"))).otherwise(title).alias("title"), F.when(n % 3 == 0, "").when(n % 3 == 1, "20240115").otherwise("20240220").alias("issue_date"),
        page(F.left("text", F.lit(200))).alias("page1"), page(F.right("text", F.lit(200))).alias("page2"), F.sha2("text", 256).alias("pdf_byte"))
    return I.duplicates(docs, docs)


def listing_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages, each address once (the first page's), titles that can be file names."""
    return L.first_links(L.links(table(spark, sf_dir, "pages").select("page_id", "html")))


def listing_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.first_links(L.links(table(spark, sf_dir, "pages").select("page_id", "html")))
    return L.unseen(found, found.where(F.char_length("url") % 2 == 0), "url").select("url")


def listing_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose title holds a word and whose address has not been visited: of the pages before, every third was."""
    found = L.links(table(spark, sf_dir, "pages").select("page_id", "html"))
    return L.drafts(found, found.where("page_id % 3 = 0").select("url").distinct(), "on").select("url", "title", "page_id")


def older_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by the rules of earlier indexes."""
    title = F.element_at(F.array(*map(F.lit, (*_TITLES, "疫苗口服制剂研究（试行）起草说明"))), (F.col("doc_id") % (len(_TITLES) + 1) + 1).cast("int"))
    date = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("15 — ")))
    found = I.metadata(documents(spark, sf_dir).select("doc_id", F.concat(date, title, F.lit(".md")).alias("filename")), older=True)
    return found.select("doc_id", "id", "status", "category", F.array_join("drug_types", ",").alias("drug_types"))


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fields(table(spark, sf_dir, "pages").select("page_id", "html"))


def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy.M.d"))
    return d.select("o_orderkey", T.normalise_date(text).alias("date"))


def threshold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as measurements of parts: discounts that reach the part's limit although they are marked ignored."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(part.select("p_partkey", "p_type"), li["l_partkey"] == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.concat(F.col("l_discount").cast("string"), F.lit("%")).alias("content"), F.when(F.col("l_returnflag") == "N", "忽略不计").otherwise("").alias("report"), F.col("p_type").alias("name"))
    return C.ignored_wrongly(rows, _LIMITS, 0.05).select("l_orderkey", "l_linenumber", "value", "limit")


def range_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells (order by line) of a sheet a supplier, with merged ranges from the customers."""
    li, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    cells = li.groupBy((F.col("l_suppkey") % 10).alias("sheet"), (F.col("l_orderkey") % 500).alias("row"), F.col("l_linenumber").alias("col")).agg(F.count("*").alias("n"))
    merged = c.select((F.col("c_custkey") % 10).alias("sheet"), (F.col("c_custkey") % 500).alias("r1"), F.lit(1).alias("c1"), (F.col("c_custkey") % 500 + F.col("c_nationkey") % 3).alias("r2"), (F.col("c_nationkey") % 4 + 1).alias("c2"))
    return C.masters(cells, merged).select("sheet", "row", "col", "n", "master_row", "master_col")


def batch_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d, n = F.date_format("o_orderdate", "yyMMdd"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    batch = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("LX"), d)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("LX1-"), d, F.lit("-"), n)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("LX2-"), d, n, F.lit("（复测）"))).otherwise(F.concat(F.lit("LX3-"), d, n))
    rows = o.select("o_orderkey", batch.alias("batch"))
    return rows.where(C.batch_like(F.col("batch"), ["合计"])).select("o_orderkey", "batch", C.valid_batch(F.col("batch")).alias("valid"), C.normalised_batch(F.col("batch")).alias("normalised"))


def right_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.lit(1).alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_quantity").alias("value"))
    return C.right_neighbour(cells).select("row", "col", "value", "next_value", C.column_name(F.col("col")).alias("letter"))


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents' first lines compared."""
    d = documents(spark, sf_dir).select("doc_id", F.trim(F.substring_index("text", "\n", 1)).alias("title"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    return d.join(n, "doc_id").select("doc_id", T.title_similarity(F.col("title"), F.col("other")).alias("level"), F.round(T.text_similarity(F.col("title"), F.col("other")), 3).alias("similarity"))


def extraction_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions made up of documents: some without JSON, with broken JSON, without elements, with too little text."""
    d, n = documents(spark, sf_dir), F.col("doc_id") % 5
    made = F.when(n == 1, "").when(n == 2, "{").when(n == 3, '{"kids":[]}').when(n == 4, '{"elements":[{"a":1}]}')
    return I.validity(d.select("doc_id", made.alias("json"), F.left("text", F.lit(150)).alias("markdown"))).select("doc_id", "ok", "reason")


def error_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, some with a tool's output appended, that hold a mark of an error."""
    from tessera.operators.rules import has_error

    c = table(spark, sf_dir, "conversations")
    out = F.concat("text", F.when(F.col("turn") == 2, " npm ERR! code").when(F.col("turn") == 3, " ERR").otherwise(""))
    return c.where(has_error(out)).groupBy("role").agg(F.count("*").alias("n"))


def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's history: the newest fifty events of a kind."""
    e = table(spark, sf_dir, "events").where("user_id = 7 AND event_type <> 'error'")
    return e.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (doc_counts, status_counts, filename_metadata, anti_join_new, upsert_latest, changed_files, exact_dup_groups, duplicate_of, listing_dedup, listing_new, listing_drafts, older_metadata, page_fields, date_normalise, threshold_check, range_join_cells, batch_normalise, right_neighbour, title_similarity, extraction_validity, error_marks, date_filter)}


_LINKS = """k AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS place FROM pages)"""

SQL = {
    "doc_counts": "SELECT source, lang, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2",
    "status_counts": "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS active, count(*) FILTER (WHERE quality = 0) AS draft, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS other FROM labels",
    "filename_metadata": f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2024' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '15' END AS issue_date, [{', '.join(repr(t) for t in _TITLES)}][doc_id % {len(_TITLES)} + 1] AS title FROM documents),
k AS (SELECT *, CASE WHEN contains(title, '起草说明') THEN 'explanation' WHEN contains(title, '反馈意见表') OR contains(title, '征求意见反馈表') THEN 'feedback' WHEN contains(title, '征求意见稿') THEN 'draft' ELSE 'main' END AS doc_type,
  CASE WHEN contains(title, '起草说明') OR contains(title, '反馈意见表') OR contains(title, '征求意见反馈表') THEN 'reference' WHEN contains(title, '征求意见稿') THEN 'draft' ELSE 'active' END AS status,
  CASE WHEN regexp_matches(title, '化学药品|化学药物') THEN '化学药' WHEN regexp_matches(title, '中药|天然药物') THEN '中药' WHEN contains(title, '生物制品') THEN '生物制品' ELSE '通用' END AS category,
  CASE WHEN contains(title, '稳定性') THEN '稳定性' WHEN regexp_matches(title, '临床研发|临床试验|以患者为中心') THEN '临床研究' WHEN contains(title, '药理学') THEN '药理学' WHEN contains(title, '毒理学') THEN '毒理学' WHEN contains(title, '质量标准') THEN '质量标准'
    WHEN regexp_matches(title, '申报|注册') THEN '申报注册' WHEN regexp_matches(title, '注射剂|配伍|原料药|制剂') THEN '稳定性' ELSE '其他' END AS folder,
  list_filter(['注射剂', '原料药', '制剂', '口服'], lambda w: contains(title, w)) AS dt, list_sort(list_filter(['稳定性', '配伍', '注射剂', '原料药', '制剂', '化学药', '中药', '生物制品', '研究技术', '指导原则'], lambda w: contains(title, w))) AS tg FROM n)
SELECT doc_id, 'guidance_' || category || CASE WHEN issue_date <> '' THEN '_' || issue_date ELSE '' END || '_' || doc_type AS id, title, issue_date, doc_type, status, category, CASE WHEN len(dt) > 0 THEN array_to_string(dt, ',') ELSE '通用' END AS drug_types, array_to_string(tg, ',') AS tags, folder FROM k""",
    "anti_join_new": "SELECT sha256(text) AS id, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY 1",
    "upsert_latest": """WITH u AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS price FROM events GROUP BY 1)
SELECT coalesce(u.id, o.o_orderkey) AS id, CASE WHEN u.id IS NOT NULL THEN u.status ELSE o.o_orderstatus END AS status, CASE WHEN u.id IS NOT NULL THEN u.price ELSE o.o_totalprice END AS price FROM orders o FULL JOIN u ON o.o_orderkey = u.id""",
    "changed_files": """WITH f AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS filename, md5(text) AS md5 FROM documents)
SELECT filename, md5, CASE WHEN n % 3 = 0 THEN 'new' WHEN n % 5 = 0 THEN 'changed' ELSE 'retry' END AS reason FROM f WHERE n % 3 = 0 OR n % 5 = 0 OR n % 7 = 0""",
    "exact_dup_groups": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_of": """WITH d AS (SELECT doc_id AS id, trim(split_part(text, chr(10), 1)) || CASE doc_id % 2 WHEN 0 THEN '（试行）' ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '20240115' ELSE '20240220' END AS day,
  CASE WHEN doc_id % 5 <> 0 THEN sha256(left(text, 200)) || sha256(right(text, 200)) END AS pages, sha256(text) AS bytes FROM documents),
s AS (SELECT *, trim(regexp_replace(regexp_replace(trim(title), '[（(【\\[][^)）\\]]{0,8}?(?:试行|征求意见|修订|版|上册|下册|第.{0,4}次)[^)）\\]]{0,8}[）)】\\]]', '', 'g'), '[（(【\\[][^)）\\]]{0,6}[）)】\\]]', '', 'g')) AS bare FROM d),
p AS MATERIALIZED (SELECT a.id, b.id AS other, 0 AS rank, a.title AS t, b.title AS u, a.bare AS p, b.bare AS q, a.day AS x, b.day AS y FROM s a JOIN s b ON a.pages = b.pages
  UNION ALL SELECT a.id, b.id, 1, a.title, b.title, a.bare, b.bare, a.day, b.day FROM s a JOIN s b ON a.bytes = b.bytes),
k AS MATERIALIZED (SELECT *, left(p, 100) AS a, left(q, 100) AS b FROM p WHERE id <> other AND t <> '' AND u <> '' AND (x = '' OR y = '' OR x = y)),
l AS (SELECT *, CASE WHEN t = u OR (p <> '' AND p = q) THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: CASE WHEN contains(b, substring(a, i, n)) THEN n ELSE 0 END)))) / greatest(length(a), length(b)) END AS near FROM k)
SELECT id, arg_min(other, (rank, other)) AS duplicate_of, CASE min(rank) WHEN 0 THEN 'pages' ELSE 'bytes' END AS by FROM l WHERE near >= 0.75 GROUP BY id""",
    "listing_dedup": f"WITH {_LINKS} SELECT url, arg_min(title, page_id * 100000 + place) AS title, min(page_id) AS page_id FROM k WHERE url <> '' GROUP BY url",
    "listing_new": f"WITH {_LINKS} SELECT DISTINCT url FROM k WHERE url <> '' AND length(url) % 2 = 1",
    "listing_drafts": f"WITH {_LINKS}, f AS (SELECT url, arg_min(title, page_id * 100000 + place) AS title, min(page_id) AS page_id FROM k WHERE url <> '' AND contains(title, 'on') GROUP BY url) SELECT * FROM f WHERE url NOT IN (SELECT url FROM k WHERE page_id % 3 = 0)",
    "older_metadata": f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2024' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '15' END AS day, [{', '.join(repr(t) for t in _TITLES)}, '疫苗口服制剂研究（试行）起草说明'][doc_id % {len(_TITLES) + 1} + 1] AS t FROM documents),
k AS (SELECT *, CASE WHEN contains(t, '起草说明') THEN 'explanation' WHEN contains(t, '反馈意见表') THEN 'feedback' WHEN contains(t, '征求意见稿') THEN 'draft' ELSE 'main' END AS kind,
  CASE WHEN regexp_matches(t, '化学药品|化学药物') THEN '化学药' WHEN regexp_matches(t, '中药|天然药物') THEN '中药' WHEN contains(t, '生物制品') THEN '生物制品' WHEN contains(t, '疫苗') THEN '疫苗' ELSE '通用' END AS category,
  list_filter(['注射剂', '原料药', '口服', '制剂'], lambda w: contains(t, w)) AS dt FROM n)
SELECT doc_id, 'guidance_' || CASE WHEN day <> '' THEN category || '_' || day ELSE t END || '_' || kind AS id, CASE WHEN contains(t, '试行') THEN 'active' WHEN kind IN ('explanation', 'feedback') THEN 'reference' WHEN kind = 'draft' THEN 'draft' ELSE 'active' END AS status,
  category, CASE WHEN len(dt) > 0 THEN array_to_string(dt, ',') ELSE '通用' END AS drug_types FROM k""",
    "page_fields": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs, starts_with(lower(html), '<!doctype') AS is_html FROM pages",
    "date_normalise": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS date FROM orders",
    "threshold_check": """SELECT l_orderkey, l_linenumber, l_discount AS value, CASE WHEN contains(p_type, 'BRUSHED TIN') THEN 0.3::DOUBLE WHEN contains(p_type, 'STEEL') THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS "limit"
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' AND l_discount >= CASE WHEN contains(p_type, 'BRUSHED TIN') THEN 0.3 WHEN contains(p_type, 'STEEL') THEN 0.0 ELSE 0.05 END""",
    "range_join_cells": """WITH c AS (SELECT l_suppkey % 10 AS sheet, l_orderkey % 500 AS row, l_linenumber AS col, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT c_custkey % 10 AS sheet, c_custkey % 500 AS r1, 1 AS c1, c_custkey % 500 + c_nationkey % 3 AS r2, c_nationkey % 4 + 1 AS c2 FROM customer),
j AS (SELECT c.sheet, c.row, c.col, min(m.r1) AS r1 FROM c JOIN m ON c.sheet = m.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN c1 AND c2 GROUP BY 1, 2, 3)
SELECT c.sheet, c.row, c.col, c.n, coalesce(j.r1, c.row) AS master_row, CASE WHEN j.r1 IS NULL THEN c.col ELSE 1 END AS master_col FROM c LEFT JOIN j ON c.sheet = j.sheet AND c.row = j.row AND c.col = j.col""",
    "batch_normalise": """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS d, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS n FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LX' || d WHEN 1 THEN 'LX1-' || d || '-' || n WHEN 2 THEN 'LX2-' || d || n || '（复测）' ELSE 'LX3-' || d || n END AS batch, o_orderkey % 4 = 1 AS valid,
  CASE o_orderkey % 4 WHEN 2 THEN 'LX2-' || d || '-' || n || '（复测）' WHEN 3 THEN 'LX3-' || d || '-' || n END AS normalised FROM o""",
    "extraction_validity": """WITH d AS (SELECT doc_id, doc_id % 5 AS n, octet_length(encode(left(text, 150))) AS b FROM documents)
SELECT doc_id, n = 4 AND b >= 100 AS ok, CASE n WHEN 0 THEN 'no json' WHEN 1 THEN 'empty json' WHEN 2 THEN 'bad json' WHEN 3 THEN 'no elements' ELSE CASE WHEN b < 100 THEN 'short markdown' ELSE 'ok' END END AS reason FROM d""",
    "title_similarity": """WITH d AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS t FROM documents), j AS (SELECT a.doc_id, a.t AS a, b.t AS b, left(a.t, 100) AS x, left(b.t, 100) AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
k AS (SELECT *, lower(regexp_replace(a, '[\\s\\-‐‑–—·]', '', 'g')) AS p, lower(regexp_replace(b, '[\\s\\-‐‑–—·]', '', 'g')) AS q,
  coalesce(list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda l: CASE WHEN contains(y, substring(x, i, l)) THEN l ELSE 0 END)))), 0) AS best FROM j)
SELECT doc_id, CASE WHEN a = '' OR b = '' THEN 'none' WHEN a = b THEN 'identical' WHEN best / greatest(length(x), length(y)) >= 0.75 THEN 'small' ELSE 'large' END AS level,
  round(CASE WHEN p = '' OR q = '' THEN 0 WHEN p = q THEN 1 WHEN contains(p, q) OR contains(q, p) THEN 0.8 ELSE len(list_intersect(list_distinct(string_split(p, '')), list_distinct(string_split(q, '')))) / len(list_distinct(list_concat(string_split(p, ''), string_split(q, '')))) END, 3) AS similarity FROM k""",
    "error_marks": """WITH o AS (SELECT role, text || CASE turn WHEN 2 THEN ' npm ERR! code' WHEN 3 THEN ' ERR' ELSE '' END AS t FROM conversations)
SELECT role, count(*) AS n FROM o WHERE regexp_matches(t, 'error:|Error:|ERROR:|failed|FAILED|command not found|No such file|Permission denied|fatal:|Exception|Traceback|npm ERR!|ModuleNotFoundError|SyntaxError|TypeError|exit code|non-zero') GROUP BY role""",
    "date_filter": "SELECT event_id, event_type, value FROM events WHERE user_id = 7 AND event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 50",
    "right_neighbour": """WITH c AS (SELECT l_orderkey AS row, l_linenumber AS col, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
SELECT row, col, value, CASE WHEN lead(col) OVER w = col + 1 THEN lead(value) OVER w END AS next_value, chr(64 + col) AS letter FROM c WINDOW w AS (PARTITION BY row ORDER BY col)""",
}
