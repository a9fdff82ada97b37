"""Listings from web pages: links and fields from HTML, each address once, dates and names normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK_RE = '<a href="([^"]*)">([^<]*)</a>'


def links(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> page_id, place, url, title of every link."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK_RE), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(LINK_RE), F.lit(2)).alias("title"))
    return pages.select("page_id", F.posexplode(both).alias("place", "l")).select("page_id", "place", "l.url", "l.title")


def first_links(found: DataFrame) -> DataFrame:
    """Of links (page_id, place, url, title), the first of each address; empty addresses are left out."""
    first = F.min_by(F.struct("title", "page_id"), F.struct("page_id", "place"))
    return found.where("url <> ''").groupBy("url").agg(first.alias("l")).select("url", "l.title", "l.page_id")


def unseen(found: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    return found.join(visited.select(key), key, "left_anti")


#: Fixed value: what the title of a draft for comment holds.
DRAFT = "征求意见稿"


def drafts(found: DataFrame, visited: DataFrame, word: str = DRAFT) -> DataFrame:
    """Of links (page_id, place, url, title) those whose title holds word and whose address is not visited, each address once.

    An address counts by its first link whose title holds word; null titles and empty addresses are left out.
    """
    return unseen(first_links(found.where(F.contains("title", F.lit(word)))), visited, "url")


def fields(pages: DataFrame) -> DataFrame:
    """Title, language, number of paragraphs, and whether the content is HTML."""
    return pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count("html", F.lit("<p>")).alias("paragraphs"), F.lower(F.left("html", F.lit(9))).startswith("<!doctype").alias("is_html"),
    )


def table_rows(pages: DataFrame, least: int = 3) -> DataFrame:
    """page_id, row, cells of table rows with at least so many cells (header rows have none: they hold th)."""
    rows = F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return pages.select("page_id", F.posexplode(rows).alias("row", "tr")).select("page_id", "row", cells.alias("cells")).where(F.size("cells") >= least)


def total_entries(html: Column) -> Column:
    """N of "Showing a to b of N"."""
    return F.regexp_replace(F.regexp_extract(html, r"Showing\s+\d+\s+to\s+\d+\s+of\s+([\d,]+)", 1), ",", "").try_cast("long")


def options(pages: DataFrame) -> DataFrame:
    """page_id, option of all select boxes but All."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<option[^>]*>([^<]*)</option>"), F.lit(1))).alias("option")).where("trim(option) NOT IN ('', 'All')")


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "25504446"


def is_disguised_page(content: Column) -> Column:
    """HTML saved as a document: small, and it begins with a doctype."""
    return (F.octet_length(content) < 10_000) & F.lower(F.decode(F.substring(content, 1, 100), "ISO-8859-1")).contains("<!doctype")
