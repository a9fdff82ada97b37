"""Documents as rows of elements: lines with their places, and what is counted and carried along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import shared_folder, stored


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of keep, pos (from 0), content: every line of every text, blank lines included."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "content"))


def elements(docs: DataFrame, *keep: str) -> DataFrame:
    """The lines with something on them, trimmed."""
    return lines(docs, *keep).withColumn("content", F.trim("content")).where("content <> ''")


def counters(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """items (key, type, has_merged) -> tables, paragraphs, images, headings, merged tables of each key."""

    def many(kind: str) -> Column:
        return F.count_if(F.col("type") == kind)

    return items.groupBy(key).agg(
        many("table").alias("tables"), many("paragraph").alias("paragraphs"), many("image").alias("images"), many("heading").alias("headings"),
        F.count_if((F.col("type") == "table") & F.col("has_merged")).alias("merged_tables"), F.max("pos").alias("last_pos"),
    )


def running_index(items: DataFrame) -> DataFrame:
    """items with type_index: the element's place among those of its type in its document, from 0."""
    w = Window.partitionBy("doc_id", "type").orderBy("pos")
    return items.withColumn("type_index", F.row_number().over(w) - 1)


def sections(docs: DataFrame) -> DataFrame:
    """Headings of Markdown texts: doc_id, line (from 1), level, title.

    `#` headings up to level 4 under 120 characters and over 1, no dotted contents entries; once any `#` heading has
    been seen (such entries count), a numbered line `1.1 title` is a heading of level 4.
    """
    rows = lines(docs).withColumn("content", F.trim("content"))
    mark = F.regexp_extract("content", r"^(#{1,4})\s+(.+)$", 1)
    title = F.trim(F.regexp_extract("content", r"^(#{1,4})\s+(.+)$", 2))
    marked = rows.withColumn("mark", F.char_length(mark)).withColumn("title", title)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumn("seen", F.coalesce(F.max((F.col("mark") > 0) & (F.char_length("content") < 120)).over(before), F.lit(False)))
    full = (F.col("mark") > 0) & (F.char_length("content") < 120) & ~F.col("title").rlike("[·…．]{3,}$") & (F.char_length("title") >= 2)
    number = r"^(\d+\.\d+)\s+(.{2,40})$"
    numbered = (F.col("mark") == 0) & F.col("seen") & F.col("content").rlike(number)
    kept = seen.where(full | numbered)
    return kept.select("doc_id", (F.col("pos") + 1).alias("line"), F.when(full, F.col("mark")).otherwise(4).alias("level"), F.when(full, F.col("title")).otherwise(F.col("content")).alias("title"))


def section_paths(headings: DataFrame) -> DataFrame:
    """headings (doc_id, line, level, title) with path "A > B > C": the open headings above and the heading itself.

    A fold over each document's headings: those of the same or a deeper level close when one opens.
    """
    kind = "struct<line: int, level: int, title: string>"
    start = F.expr(f"named_struct('open', cast(array() as array<{kind}>), 'out', cast(array() as array<struct<line: int, level: int, title: string, path: string>>))")

    def step(acc: Column, h: Column) -> Column:
        open_ = F.concat(F.filter(acc["open"], lambda o: o["level"] < h["level"]), F.array(h))
        path = F.array_join(F.transform(open_, lambda o: o["title"]), " > ")
        made = F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), path.alias("path"))
        return F.struct(open_.alias("open"), F.concat(acc["out"], F.array(made)).alias("out"))

    rows = headings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), F.col("level").cast("int").alias("level"), "title"))).alias("hs"))
    return rows.select("doc_id", F.inline(F.aggregate("hs", start, step, lambda acc: acc["out"])))


def merge_across_pages(tables: DataFrame) -> DataFrame:
    """tables (doc_id, pos, page, columns, n_rows, head, confident) with merge_into: the pos of the table it continues.

    A table continues the one just before it if that is on the page before, both are confident, their column counts
    differ by two or less or their heads agree, and it has rows. Pairs do not chain: every second of a run merges.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    fits = (
        (F.col("page") == F.lag("page").over(w) + 1) & (F.col("pos") == F.lag("pos").over(w) + 1) & F.col("confident") & F.lag("confident").over(w)
        & ((F.abs(F.col("columns") - F.lag("columns").over(w)) <= 2) | (F.left("head", F.lit(20)) == F.left(F.lag("head").over(w), F.lit(20)))) & (F.col("n_rows") > 0)
    )
    marked = tables.withColumn("__fits", F.coalesce(fits, F.lit(False))).withColumn("__before", F.lag("pos").over(w))
    runs = marked.withColumn("__run", F.sum((~F.col("__fits")).cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "__run").orderBy("pos")) - 1
    return runs.withColumn("merge_into", F.when(place % 2 == 1, F.col("__before"))).drop("__fits", "__run", "__before")


def _grams(text: Column, size: int, step: int = 1) -> Column:
    """Pieces of so many characters that begin at every step-th character; none for shorter texts."""
    return F.when(F.char_length(text) >= size, F.transform(F.sequence(F.lit(1), F.char_length(text) - (size - 1), F.lit(step)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame, scope: str, size: int = 5, most: int = 1 << 26) -> DataFrame:
    """short (scope, s) and long (scope, t), each row once -> scope, s, t wherever t contains s within a scope.

    A scope whose texts are few, so that looking for each s in each t passes at most `most` characters, is paired as it is: its
    texts meet in the join, and only those that fit leave it. In larger ones pieces of t are listed, with a number in
    place of the text. Pieces of s side by side must all be among its scope's, or no t can hold it; of these the one that the fewest
    t hold is the key that s is joined by, and what meets there is verified. An s of fewer than `size` characters is
    itself such a piece of t. Texts without characters match nothing.
    """
    short, long = short.where("s <> ''"), long.where("t <> ''")
    chars = long.groupBy(scope).agg(F.sum(F.char_length("t").cast("long")).alias("chars"))
    cost = short.groupBy(scope).agg(F.count("*").alias("n")).join(chars, scope).select(scope, (F.col("n") * F.col("chars") > most).alias("large"))
    large, fits = cost.where("large").select(scope), cost.where(~F.col("large")).select(scope)
    paired = short.join(fits, scope, "left_semi").join(long, scope).where(F.contains("t", "s")).select(scope, "s", "t")
    short, long = short.join(large, scope, "left_semi"), long.join(large, scope, "left_semi")
    named = long.withColumn("id", F.struct(F.xxhash64("t"), F.sha2("t", 256)))
    t = named.select(scope, "id", F.explode(F.array_distinct(_grams(F.col("t"), size))).alias("gram"))
    held = t.groupBy(scope, "gram").agg(F.count("*").alias("n"))
    parts = short.where(F.char_length("s") >= size).select(scope, "s", F.explode(F.array_distinct(_grams(F.col("s"), size, size))).alias("gram"))
    rare = parts.join(held, [scope, "gram"], "left").groupBy(scope, "s").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing"))
    met = rare.where("missing = 0").select(scope, "s", "gram").join(t, [scope, "gram"]).join(named, [scope, "id"]).where(F.contains("t", "s")).select(scope, "s", "t")
    few = short.where(F.char_length("s") < size).select(scope, "s")
    lengths = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda n: F.when(F.char_length("t") >= n, F.transform(F.sequence(F.lit(1), F.char_length("t") - n + 1), lambda i: F.substring("t", i, n))).otherwise(F.array().cast("array<string>"))))
    pieces = named.join(few.select(scope).distinct(), scope, "left_semi").select(scope, "id", F.explode(F.array_distinct(lengths)).alias("s"))
    held_few = pieces.join(few, [scope, "s"]).join(named, [scope, "id"]).select(scope, "s", "t")
    return paired.unionByName(met).unionByName(held_few)


def page_lines(paragraphs: DataFrame, markdown: DataFrame, most_lines: int | None = None, most: int = 1 << 26) -> DataFrame:
    """Where paragraphs (doc_id, page, text) stand in markdown (doc_id, pos, content): doc_id, page, text, md_line.

    A line fits if, without white space and dots, one contains the other; the longest such line wins, then the first.
    Paragraphs under ten characters after that are not looked at; with most_lines, no lines from that place on either.
    Equal lines of a document are one line, equal paragraphs one paragraph. A line that holds the paragraph is as long at least as any
    that the paragraph holds, so these are looked for where there is none of the first kind. Pairs of a document come
    from contained(), with its bound `most`: a document of many lines does not meet itself whole.
    """
    p = paragraphs.select("doc_id", "page", "text", T.page_text(F.col("text")).alias("p")).where(F.char_length("p") >= 10).distinct()
    within = markdown if most_lines is None else markdown.where(F.col("pos") < most_lines)
    m = within.select("doc_id", "pos", T.page_text(F.col("content")).alias("m")).where("m <> ''").groupBy("doc_id", "m").agg(F.min("pos").alias("pos"))
    longest = F.max_by("pos", F.struct(F.char_length("m"), -F.col("pos"))).alias("pos")
    texts = p.select("doc_id", "p").distinct()
    around = contained(texts.withColumnRenamed("p", "s"), m.select("doc_id", F.col("m").alias("t")), "doc_id", most=most).select("doc_id", F.col("s").alias("p"), F.col("t").alias("m"))
    root = shared_folder(paragraphs.sparkSession)
    held = stored(around.join(m, ["doc_id", "m"]).groupBy("doc_id", "p").agg(longest), f"{root}/held")
    rest = stored(texts.join(held, ["doc_id", "p"], "left_anti"), f"{root}/rest")
    inside = contained(m.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("m").alias("s")), rest.withColumnRenamed("p", "t"), "doc_id", most=most).select("doc_id", F.col("t").alias("p"), F.col("s").alias("m"))
    best = held.unionByName(inside.join(m, ["doc_id", "m"]).groupBy("doc_id", "p").agg(longest))
    return p.join(best, ["doc_id", "p"]).select("doc_id", "page", "text", (F.col("pos") + 1).alias("md_line"))


def page_totals(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, others) -> doc_id, pages (distinct page numbers), last_page."""
    return rows.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.max("page").alias("last_page"))


def pages_to_recognise(pages: DataFrame, digital: DataFrame) -> DataFrame:
    """pages (doc_id, page, kind) and their digital elements (doc_id, page, type) -> doc_id, page, part.

    part 1: digital pages with a table, part 2: scanned pages. Digital pages of text alone are not among them.
    """
    tables = digital.where("type = 'table'").select("doc_id", "page").distinct()
    with_table = pages.where("kind = 'digital'").join(tables, ["doc_id", "page"], "left_semi").select("doc_id", "page", F.lit(1).alias("part"))
    return with_table.unionByName(pages.where("kind = 'scanned'").select("doc_id", "page", F.lit(2).alias("part"))).distinct()


def united(pages: DataFrame, digital: DataFrame, recognised: DataFrame) -> DataFrame:
    """The elements (doc_id, page, pos, type, content) of both origins -> the same with part, origin, place.

    A page that is to be recognised has its recognised elements, or, where recognition gave none, the digital ones;
    others have the digital ones. place numbers a document's elements: pages of text, then those with tables, then scanned ones, each by page.
    Elements of pages that are not listed are left out.
    """
    columns = ["doc_id", "page", "pos", "type", "content"]
    need = pages_to_recognise(pages, digital)
    read = recognised.select(*columns, F.lit("recognised").alias("origin")).join(need.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    plain = digital.select(*columns, F.lit("digital").alias("origin")).join(read.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    listed = pages.select("doc_id", "page").distinct().join(need, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("part", F.lit(0)).alias("part"))
    order = Window.partitionBy("doc_id").orderBy("part", "page", "pos", "type", "content")
    return plain.unionByName(read).join(listed, ["doc_id", "page"]).withColumn("place", F.row_number().over(order) - 1)


def page_hashes(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, x0, pos, content) -> doc_id, page1, page2: digests of the first two pages' texts.

    A page's text is its trimmed contents by x0, then place, joined by new lines; a page without text has no digest.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "pos", F.trim("content").alias("c")))), lambda s: s["c"]), "\n")
    pages = rows.where((F.col("page") <= 2) & (F.trim("content") != "")).groupBy("doc_id", "page").agg(F.sha2(text, 256).alias("h"))
    return pages.groupBy("doc_id").agg(F.max(F.when(F.col("page") == 1, F.col("h"))).alias("page1"), F.max(F.when(F.col("page") == 2, F.col("h"))).alias("page2"))
