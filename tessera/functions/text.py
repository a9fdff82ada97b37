"""Scalar text functions as Spark columns (built-in expressions, but for nfkc)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def searchable(text: Column) -> Column:
    """Lower case; letters and digits of any script only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def bigram_list(text: str) -> list[str]:
    """Distinct two-character pieces of a query, in order (a query is a driver-side value)."""
    kept = "".join(c for c in text.lower() if c.isalnum())
    return list(dict.fromkeys(kept[i : i + 2] for i in range(len(kept) - 1)))


def bigrams(text: Column) -> Column:
    """Distinct two-character pieces of the searchable text; fewer than two characters give none."""
    return F.array_distinct(F.regexp_extract_all(searchable(text), F.lit(r"(?s)(?=(..))"), F.lit(1)))


#: Words (the last a pattern) that make a bracketed remark an edition mark.
EDITIONS = ("试行", "征求意见", "修订", "版", "上册", "下册", "第.{0,4}次")


def strip_annotations(title: Column) -> Column:
    """The title without bracketed remarks: edition marks of any kind, then any remark of six characters or fewer."""
    edition = rf"[（(【\[][^)）\]]{{0,8}}?(?:{'|'.join(EDITIONS)})[^)）\]]{{0,8}}[）)】\]]"
    short = r"[（(【\[][^)）\]]{0,6}[）)】\]]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(title), edition, ""), short, ""))


def common_substring_share(a: Column, b: Column, most: int = 100) -> Column:
    """Length of the longest common substring of the first `most` characters over the longer length (0 if one is empty).

    Folds over the places where a piece of a can end: the longest match that ends at one is at most one longer than the
    longest that ends before it, so one look-up a place is enough.
    """
    x, y = F.left(a, F.lit(most)), F.left(b, F.lit(most))

    def step(best: Column, end: Column) -> Column:
        return F.when((end > best) & (F.instr(y, F.substring(x, end - best, best + 1)) > 0), best + 1).otherwise(best)

    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), F.lit(0), step)
    size = F.greatest(F.char_length(x), F.char_length(y))
    return F.when((F.char_length(x) == 0) | (F.char_length(y) == 0), 0.0).otherwise(best / size)


def title_similarity(a: Column, b: Column, least: float = 0.75) -> Column:
    """identical, small, large, or none (one is empty or null)."""
    p, q = strip_annotations(a), strip_annotations(b)
    empty = F.coalesce(a, F.lit("")) == ""
    return (
        F.when(empty | (F.coalesce(b, F.lit("")) == ""), "none")
        .when(a == b, "identical")
        .when((p != "") & (p == q), "small")
        .when(common_substring_share(p, q) >= least, "small")
        .otherwise("large")
    )


def page_text(text: Column) -> Column:
    """Text for matching lines to pages: without white space, dots and commas."""
    return F.regexp_replace(text, r"[\s·…．,，.]", "")


def nfkc(text: Column) -> Column:
    """The text in Unicode's compatibility form. Spark has none: texts that are not in ASCII go through pandas."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(normal(F.when(~plain, text)))


def folded(text: Column) -> Column:
    """Compatibility form without white space, hyphens or middle dots, lower case."""
    return F.lower(F.regexp_replace(nfkc(text), r"[\s\-‐‑–—·]", ""))


def text_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one contains the other, else the Jaccard similarity of their characters; 0 if one is empty."""
    x, y = folded(a), folded(b)
    p, q = F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.8)
        .otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))
    )


def slug(text: Column) -> Column:
    """Runs of anything but letters and digits as one underscore, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_"))


def typed_id(kind: Column, label: Column) -> Column:
    """A stable id of a typed label: kind, slug, six hexadecimal digits of a digest."""
    return F.concat_ws("_", kind, slug(label), F.left(F.sha2(F.concat_ws(":", kind, label), 256), F.lit(6)))


def strip_hash(stem: Column) -> Column:
    """A file stem without a trailing underscore and seven or eight hexadecimal digits."""
    return F.regexp_replace(stem, "_[0-9a-f]{7,8}$", "")


def first_title(markdown: Column) -> Column:
    """The first Markdown heading, else the first line over five characters that is no image; at most 80 characters."""
    heading = F.regexp_extract(markdown, r"(?m)^#{1,6}\s+(.+)$", 1)
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: (F.char_length(x) > 5) & ~x.startswith("!["))
    return F.left(F.trim(F.when(heading != "", heading).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))), F.lit(80))


def clean_entity(text: Column) -> Column:
    """Markdown links as their text; letters, digits and a few marks of titles stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[^\p{L}\p{N}（）《》· ]", ""))


def safe_filename(text: Column, most: int = 100) -> Column:
    return F.left(F.regexp_replace(text, r'[\\/:*?"<>|]', ""), F.lit(most))


def normalise_date(text: Column) -> Column:
    """Y-M-D or Y.M.D as YYYYMMDD; anything else without its separators."""
    form = r"^(\d{4})[-.](\d{1,2})[-.](\d{1,2})$"
    parts = [F.lpad(F.regexp_extract(text, form, i), 2 if i > 1 else 4, "0") for i in (1, 2, 3)]
    return F.when(text.rlike(form), F.concat(*parts)).otherwise(F.regexp_replace(text, "[-.]", ""))


def quoted_title(text: Column, most: int = 50) -> Column:
    """The title inside 《》, else the text's first characters."""
    inner = F.regexp_extract(text, "《([^》]+)》", 1)
    return F.when(inner != "", inner).otherwise(F.left(text, F.lit(most)))


def preview(text: Column, most: int = 100, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def any_of(text: Column, words: list[str], fold: bool = True) -> Column:
    """Whether the text holds one of the words."""
    t = F.lower(text) if fold else text
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w.lower() if fold else w)
    return out


def first_of(text: Column, words: list[str], fold: bool = True) -> Column:
    """The first of the words, in their order, that the text holds."""
    t = F.lower(text) if fold else text
    return F.coalesce(*(F.when(t.contains(w.lower() if fold else w), F.lit(w)) for w in words)) if words else F.lit(None).cast("string")


def language(text: Column) -> Column:
    """zh, en or auto by counts of CJK and Latin characters."""
    cjk, latin = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cjk > 0.3 * latin) & (cjk > 20), "zh").when(latin > 50, "en").otherwise("auto")


def version_parts(text: Column) -> Column:
    """The numbers of a dotted version; null if one is no number."""
    parts = F.transform(F.split(F.regexp_replace(text, "^[vV]", ""), r"\."), lambda p: p.try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), F.lit(None)).otherwise(parts)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; -1 if one does not parse."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x.isNull() | y.isNull(), -1).when(x < y, -1).when(x > y, 1).otherwise(0)


def span_row(cells: Column, spans: Column, width: Column) -> Column:
    """Cells of a table row with each column span filled up by empty cells, padded to width."""
    wide = F.flatten(F.zip_with(cells, spans, lambda c, s: F.concat(F.array(F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(F.coalesce(s, F.lit(1)) - 1, F.lit(0))))))
    return F.concat(wide, F.array_repeat(F.lit(""), F.greatest(width - F.size(wide), F.lit(0))))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def parse_markdown_table(text: Column) -> Column:
    """A pipe table as an array of rows; rule lines are left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.contains("|") & ~x.rlike(r"^[|\s:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def millis_date(millis: Column) -> Column:
    """Milliseconds since 1970 as YYYY-MM-DD in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


def date_millis(day: Column) -> Column:
    """The milliseconds at which a YYYY-MM-DD begins; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def cell_text(value: Column, kind: str) -> Column:
    """A cell's value as text: dates in ISO form, numbers to six places without needless zeros, nothing as empty."""
    if kind in ("date", "timestamp"):
        out = F.date_format(value, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss")
    elif kind == "number":
        out = F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit(""))


def content_hash(page1: Column, page2: Column, file_digest: Column) -> Column:
    """The digests of two pages, and the file's where neither page has one."""
    return F.struct(page1.alias("page1"), page2.alias("page2"), F.when(page1.isNull() & page2.isNull(), file_digest).alias("pdf_byte"))
