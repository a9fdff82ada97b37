"""Search, elements and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import elements as E
from tessera.operators import postings as P
from tessera.operators import search as S
from tessera.plans.common import LINES, TITLED, documents, table, titled
from tessera.session import shared_folder

FULLTEXT = "the and attion to"
_BIGRAMS = ", ".join(f"'{b}'" for b in T.bigram_list(FULLTEXT))
_KEYWORDS = ["thanedble", "ción", "euxai"]


def fulltext_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fulltext(E.elements(documents(spark, sf_dir)), FULLTEXT)


def fulltext_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumnsRenamed({"source": "category", "lang": "doc_type"})
    return S.fulltext(E.elements(S.narrowed(docs, "src1", "en")), FULLTEXT, top_k=25, max_chars=40)


def fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from a persistent index of the documents."""
    root = shared_folder(spark)
    P.append(E.elements(documents(spark, sf_dir)), root)
    return P.search(spark, root, FULLTEXT)


def fulltext_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language added to an index one after another; a search within one kind of source."""
    root, docs = shared_folder(spark), documents(spark, sf_dir)
    elements = E.elements(docs, "lang")
    for lang in sorted(r["lang"] for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()):
        P.append(elements.where(F.col("lang") == lang), root)
    P.append(elements.where("lang IS NULL"), root)
    return P.search(spark, root, FULLTEXT, 25, 40, docs.where(F.col("source").contains("src1")).select("doc_id"))


def bigram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines hold each bigram, from the index."""
    root = shared_folder(spark)
    P.append(E.elements(documents(spark, sf_dir)), root)
    return P.frequencies(spark, root)


def search_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the search by rank."""
    found = S.fulltext(E.elements(documents(spark, sf_dir)), FULLTEXT, 25, 40)
    return S.ranked(found, F.desc("relevance"), F.col("doc_id"), F.col("pos")).select("rank", "doc_id", "pos")


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten lines that have something on them."""
    return E.page_totals(E.elements(documents(spark, sf_dir)).select("doc_id", (F.floor(F.col("pos") / 10) + 1).alias("page")))


def _fulltext_sql(where: str, top_k: int, chars: int) -> str:
    return f"""
WITH {LINES}, q AS (SELECT unnest([{_BIGRAMS}]) AS b),
s AS (SELECT doc_id, pos, content, regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM e WHERE {where}),
n AS (SELECT doc_id, pos, content, (SELECT count(*) FROM q WHERE contains(k, b)) AS n FROM s)
SELECT doc_id, pos, CASE WHEN length(content) > {chars} THEN left(content, {chars}) || '…' ELSE content END AS snippet,
  round(n / {len(T.bigram_list(FULLTEXT))}.0, 3) AS relevance FROM n WHERE n > 0 ORDER BY relevance DESC, doc_id, pos LIMIT {top_k}"""


def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.metadata(titled(spark, sf_dir), " The ", 20).select("id", "title", "score")


def retrieval_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.retrieval(titled(spark, sf_dir), "en")
    return found.orderBy(F.desc("score"), F.desc("priority"), "id").limit(50).select("id", "score", "priority", F.array_join("matched_fields", ",").alias("matched_fields"))


def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_context(E.lines(documents(spark, sf_dir)), _KEYWORDS)


def keyword_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each keyword."""
    held = F.array_compact(F.array(*(F.when(F.lower("text").contains(k), F.lit(k)) for k in _KEYWORDS)))
    return documents(spark, sf_dir).select(F.explode(held).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("documents"))


def element_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of elements told by their form: table rows, images, headings (short lines), paragraphs."""
    return E.counters(_typed(spark, sf_dir))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    kind = F.when(c.contains("|"), "table").when(c.contains("&&&"), "image").when(F.char_length(c) < 25, "heading").otherwise("paragraph")
    return E.elements(documents(spark, sf_dir)).withColumn("type", kind).withColumn("has_merged", c.contains("||"))


_TYPED = "y AS (SELECT doc_id, pos, content, CASE WHEN contains(content, '|') THEN 'table' WHEN contains(content, '&&&') THEN 'image' WHEN length(content) < 25 THEN 'heading' ELSE 'paragraph' END AS type, contains(content, '||') AS has_merged FROM e)"


def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_index(_typed(spark, sf_dir).select("doc_id", "pos", "type"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: headings and paragraphs on lines of their own, every third paragraph numbered as a heading."""
    html = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<b>", "\n### "), "<p>", "\n1.2 ")
    return html.select(F.col("page_id").alias("doc_id"), F.regexp_replace(body, "<[^>]*>", "").alias("text"))


_MARKDOWN = """m AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '<b>', chr(10) || '### ', 'g'), '<p>', chr(10) || '1.2 ', 'g'), '<[^>]*>', '', 'g') AS text FROM pages)"""


def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sections(_markdown(spark, sf_dir))


def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.section_paths(E.sections(_markdown(spark, sf_dir)))


def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sections, sections in all, and the first twenty of level 3 or less kept for the index."""
    from pyspark.sql import Window

    rows = E.sections(_markdown(spark, sf_dir))
    top = rows.where("level <= 3").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).where("n <= 20")
    a = rows.agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("sections"))
    return a.crossJoin(top.agg(F.count("*").alias("indexed"), F.coalesce(F.max("line"), F.lit(0)).alias("last_line")))  # one row each


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.language(F.col("text")).alias("language"))


def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (ten lines each) with over 50 characters are digital; a document with any other sampled page is mixed or scanned."""
    from pyspark.sql import Window

    rows = E.lines(documents(spark, sf_dir)).withColumn("page", F.floor(F.col("pos") / 10) + 1)
    pages = rows.groupBy("doc_id", "page").agg(F.sum(F.char_length(F.trim("content"))).alias("chars"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    middle = F.floor(F.col("n") / 2) + 1
    sampled = pages.withColumn("n", n).where((F.col("page") <= 3) | (F.col("page") > F.col("n") - 3) | F.col("page").isin(middle, middle + 1))
    digital, scanned = F.count_if(F.col("chars") > 50), F.count_if(F.col("chars") <= 50)
    return sampled.groupBy("doc_id").agg(digital.alias("digital"), scanned.alias("scanned"), F.when(scanned == 0, "digital").when(digital == 0, "scanned").otherwise("mixed").alias("kind"))


def page_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.lines(documents(spark, sf_dir)).select("doc_id", (F.floor(F.col("pos") / 10) + 1).alias("page"), (F.col("pos") % 3).alias("x0"), "pos", "content")
    return E.page_hashes(rows)


def paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where long lines of pages, without their markup, stand in the page's Markdown."""
    md = E.elements(_markdown(spark, sf_dir))
    paragraphs = md.where(F.char_length("content") >= 20).select("doc_id", (F.col("pos") + 1).cast("long").alias("page"), F.col("content").alias("text"))
    return E.page_lines(paragraphs, md)


def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tables of a document each: consecutive lines of one order on consecutive pages."""
    li = table(spark, sf_dir, "lineitem")
    tables = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(
        F.max("l_linenumber").alias("page"), F.max(F.floor("l_quantity") % 6).cast("int").alias("columns"), F.max(F.lit(1)).alias("n_rows"), F.max("l_returnflag").alias("head"), F.max("l_linestatus").alias("s"))
    return E.merge_across_pages(tables.withColumn("confident", F.col("s") == "O")).select("doc_id", "pos", "merge_into")


QUERIES = {f.__name__: f for f in (search_ranks, page_totals, fulltext_bigram, fulltext_scoped, fulltext_index, fulltext_append, bigram_frequencies, metadata_score, retrieval_rank, keyword_context, keyword_df, element_counters, running_index, section_index, section_path, section_totals, language_detect, page_classify, page_hash, paragraph_lines, table_merge)}

_SECTIONS = f"""{_MARKDOWN}, ml AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM m),
mk AS (SELECT *, length(regexp_extract(content, '^(#{{1,4}})\\s+(.+)$', 1)) AS mark, trim(regexp_extract(content, '^(#{{1,4}})\\s+(.+)$', 2)) AS title FROM ml),
sn AS (SELECT *, coalesce(max(CASE WHEN mark > 0 AND length(content) < 120 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM mk),
fl AS (SELECT *, mark > 0 AND length(content) < 120 AND NOT regexp_matches(title, '[·…．]{{3,}}$') AND length(title) >= 2 AS is_full FROM sn),
sec AS (SELECT doc_id, pos + 1 AS line, CASE WHEN is_full THEN mark ELSE 4 END AS level, CASE WHEN is_full THEN title ELSE content END AS title FROM fl
  WHERE is_full OR (mark = 0 AND seen = 1 AND regexp_matches(content, '^(\\d+\\.\\d+)\\s+(.{{2,40}})$')))"""

SQL = {
    "fulltext_bigram": _fulltext_sql("true", 10, 300),
    "search_ranks": f"SELECT CAST(row_number() OVER (ORDER BY relevance DESC, doc_id, pos) AS INTEGER) AS rank, doc_id, CAST(pos AS INTEGER) AS pos FROM ({_fulltext_sql('true', 25, 40)})",
    "page_totals": f"WITH {LINES} SELECT doc_id, count(DISTINCT pos // 10 + 1) AS pages, max(pos // 10 + 1) AS last_page FROM e GROUP BY 1",
    "fulltext_index": _fulltext_sql("true", 10, 300),
    "fulltext_append": _fulltext_sql("contains(source, 'src1')", 25, 40),
    "bigram_frequencies": f"""WITH {LINES}, s AS (SELECT row_number() OVER () AS r, regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM e), i AS (SELECT r, k, unnest(generate_series(1, length(k) - 1)) AS i FROM s),
b AS (SELECT DISTINCT r, substring(k, i, 2) AS bigram FROM i) SELECT bigram, count(*) AS elements FROM b GROUP BY 1""",
    "fulltext_scoped": _fulltext_sql("contains(source, 'src1') AND lang = 'en'", 25, 40),
    "metadata_score": f"""WITH {TITLED}, s AS (SELECT id, title, CASE WHEN starts_with(lower(title), 'the') THEN 4 WHEN contains(lower(title), 'the') THEN 3 ELSE 0 END
  + 2 * len(list_filter(tags, lambda x: contains(lower(x), 'the'))) + CASE WHEN contains(lower(subdir), 'the') THEN 1 ELSE 0 END AS score FROM t)
SELECT id, title, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""",
    "retrieval_rank": f"""WITH {TITLED}, s AS (SELECT *, contains(lower(category), 'en') AS ic, contains(lower(title), 'en') AS it, list_filter(types, lambda x: contains(lower(x), 'en')) AS ty, list_filter(tags, lambda x: contains(lower(x), 'en')) AS tg FROM t),
r AS (SELECT id, 10 * CAST(ic AS INTEGER) + 5 * len(ty) + 3 * len(tg) + 8 * CAST(it AS INTEGER) AS score, CASE status WHEN 'active' THEN 3 WHEN 'draft' THEN 2 ELSE 1 END AS priority,
  array_to_string(list_concat(CASE WHEN ic THEN ['category=' || category] ELSE [] END, list_transform(ty, lambda x: 'type=' || x), list_transform(tg, lambda x: 'tag=' || x), CASE WHEN it THEN ['title'] ELSE [] END), ',') AS matched_fields FROM s)
SELECT id, CAST(score AS INTEGER) AS score, priority, matched_fields FROM r WHERE score > 0 ORDER BY score DESC, priority DESC, id LIMIT 50""",
    "keyword_context": f"""WITH {LINES}, c AS (SELECT doc_id, pos, raw, string_agg(raw, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l)
SELECT doc_id, CAST(pos + 1 AS INTEGER) AS line_number, CASE {" ".join(f"WHEN contains(lower(raw), '{k}') THEN '{k}'" for k in _KEYWORDS)} END AS keyword, context FROM c
WHERE {" OR ".join(f"contains(lower(raw), '{k}')" for k in _KEYWORDS)}""",
    "keyword_df": " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS keyword, count(*) AS documents FROM documents WHERE contains(lower(text), '{k}')) WHERE documents > 0" for k in _KEYWORDS),
    "element_counters": f"""WITH {LINES}, {_TYPED} SELECT doc_id, count(*) FILTER (WHERE type = 'table') AS tables, count(*) FILTER (WHERE type = 'paragraph') AS paragraphs, count(*) FILTER (WHERE type = 'image') AS images,
  count(*) FILTER (WHERE type = 'heading') AS headings, count(*) FILTER (WHERE type = 'table' AND has_merged) AS merged_tables, CAST(max(pos) AS INTEGER) AS last_pos FROM y GROUP BY doc_id""",
    "running_index": f"WITH {LINES}, {_TYPED} SELECT doc_id, CAST(pos AS INTEGER) AS pos, type, CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY pos) - 1 AS INTEGER) AS type_index FROM y",
    "section_index": f"WITH {_SECTIONS} SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(level AS INTEGER) AS level, title FROM sec",
    "section_path": f"""WITH {_SECTIONS}, up AS (SELECT b.doc_id, b.line, b.level, b.title, a.line AS place, a.title AS part FROM sec b JOIN sec a ON a.doc_id = b.doc_id AND a.line <= b.line
  WHERE NOT EXISTS (SELECT 1 FROM sec c WHERE c.doc_id = b.doc_id AND c.line > a.line AND c.line <= b.line AND c.level <= a.level))
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(level AS INTEGER) AS level, any_value(title) AS title, string_agg(part, ' > ' ORDER BY place) AS path FROM up GROUP BY doc_id, line, level""",
    "section_totals": f"""WITH {_SECTIONS}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM sec WHERE level <= 3)
SELECT (SELECT count(DISTINCT doc_id) FROM sec) AS docs, (SELECT count(*) FROM sec) AS sections, count(*) AS indexed, CAST(coalesce(max(line), 0) AS INTEGER) AS last_line FROM top WHERE n <= 20""",
    "language_detect": """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)
SELECT doc_id, CASE WHEN cjk > 0.3 * latin AND cjk > 20 THEN 'zh' WHEN latin > 50 THEN 'en' ELSE 'auto' END AS language FROM c""",
    "page_classify": f"""WITH {LINES}, p AS (SELECT doc_id, pos // 10 + 1 AS page, sum(length(trim(raw))) AS chars FROM l GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
s AS (SELECT * FROM n WHERE page <= 3 OR page > n - 3 OR page IN (n // 2 + 1, n // 2 + 2))
SELECT doc_id, count(*) FILTER (WHERE chars > 50) AS digital, count(*) FILTER (WHERE chars <= 50) AS scanned, CASE WHEN count(*) FILTER (WHERE chars <= 50) = 0 THEN 'digital' WHEN count(*) FILTER (WHERE chars > 50) = 0 THEN 'scanned' ELSE 'mixed' END AS kind FROM s GROUP BY doc_id""",
    "page_hash": f"""WITH {LINES}, p AS (SELECT doc_id, pos // 10 + 1 AS page, sha256(string_agg(trim(raw), chr(10) ORDER BY pos % 3, pos)) AS h FROM l WHERE trim(raw) <> '' AND pos < 20 GROUP BY 1, 2)
SELECT doc_id, max(CASE WHEN page = 1 THEN h END) AS page1, max(CASE WHEN page = 2 THEN h END) AS page2 FROM p GROUP BY doc_id""",
    "paragraph_lines": f"""WITH {_MARKDOWN}, ml AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM m),
md AS (SELECT doc_id, pos, content, regexp_replace(content, '[\\s·…．,，.]', '', 'g') AS k FROM ml WHERE content <> ''), pg AS (SELECT doc_id, pos + 1 AS page, content AS text, regexp_replace(content, '[\\s·…．,，.]', '', 'g') AS k FROM md WHERE length(content) >= 20),
j AS (SELECT pg.doc_id, pg.page, pg.text, md.pos, row_number() OVER (PARTITION BY pg.doc_id, pg.page, pg.text ORDER BY length(md.k) DESC, md.pos) AS n FROM pg JOIN md ON pg.doc_id = md.doc_id AND md.k <> '' AND (contains(pg.k, md.k) OR contains(md.k, pg.k)) WHERE length(pg.k) >= 10)
SELECT doc_id, page, text, CAST(pos + 1 AS INTEGER) AS md_line FROM j WHERE n = 1""",
    "table_merge": """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(max(floor(l_quantity) % 6) AS INTEGER) AS columns, max(l_returnflag) AS head, max(l_linestatus) = 'O' AS ok FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN pos = lag(pos) OVER w + 1 AND ok AND lag(ok) OVER w AND (abs(columns - lag(columns) OVER w) <= 2 OR head = lag(head) OVER w) THEN 1 ELSE 0 END AS fits, lag(pos) OVER w AS before FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(1 - fits) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1 AS place FROM r)
SELECT doc_id, pos, CASE WHEN place % 2 = 1 THEN before END AS merge_into FROM q""",
}
