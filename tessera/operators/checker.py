"""Checks of measured values in worksheets: batch numbers, thresholds, merged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

BATCH_RE = r"^(.+)-(\d{2})(\d{2})(\d{2})-(\d{2})$"
#: Marks of retests, and of values left out of a report.
RETEST = ("（复测）", "(复测)", "（再测）", "(再测)")
IGNORED = ["忽略不计", "忽略", "不及"]


def batch_like(value: Column, stop: list[str]) -> Column:
    """Text that may be a batch number: no stop word, a letter, no address, no slash unless a hyphen."""
    v = F.trim(value)
    return ~T.any_of(v, stop, fold=False) & v.rlike(r"\p{L}") & ~v.contains("://") & ~(v.contains("/") & ~v.contains("-"))


def without_retest(value: Column) -> Column:
    out = F.trim(value)
    for mark in RETEST:
        out = F.when(value.contains(mark), F.trim(F.substring_index(value, mark, 1))).otherwise(out)
    return out


def valid_batch(value: Column) -> Column:
    return F.trim(value).rlike(BATCH_RE)


def normalised_batch(value: Column) -> Column:
    """The standard form of a batch number whose date and number run together, its retest mark kept; null if none is needed."""
    body = without_retest(value)
    form = r"^(.+)-(\d{6})(\d{2})$"
    fixed = F.concat(F.regexp_replace(body, form, "$1-$2-$3"), F.substring(F.trim(value), F.char_length(body) + 1, F.char_length(value)))
    return F.when(~valid_batch(body) & body.rlike(form), fixed)


def first_number(value: Column) -> Column:
    """The first run of digits and points as a number; null if it is none."""
    return F.regexp_extract(value, r"([\d.]+)", 1).try_cast("double")


def threshold(name: Column, limits: list[tuple[str, float]], default: float) -> Column:
    """The limit of the key equal to name, else of the first key that name holds, else the default. Zero is a limit."""
    out = F.lit(float(default))
    for key, value in reversed(limits):
        out = F.when(name.contains(key), float(value)).otherwise(out)
    for key, value in reversed(limits):
        out = F.when(name == key, float(value)).otherwise(out)
    return F.when(F.coalesce(name, F.lit("")) == "", float(default)).otherwise(out)


def ignored_wrongly(rows: DataFrame, limits: list[tuple[str, float]], default: float) -> DataFrame:
    """rows (content, report, name, others) reported as ignored although content reaches the limit: with value, limit."""
    found = rows.where(T.any_of(F.col("report"), IGNORED, fold=False)).withColumn("value", first_number(F.col("content"))).withColumn("limit", threshold(F.col("name"), limits, default))
    return found.where(F.col("value") >= F.col("limit"))


def masters(cells: DataFrame, merged: DataFrame, width: int = 64) -> DataFrame:
    """cells (sheet, row, col) with master_row, master_col: the first cell of the merged range (sheet, r1, c1, r2, c2) they are in.

    Ranges meet cells in tiles of width by width, so the join has keys and a range meets only cells near it.
    """
    def tiles(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))

    ranges = merged.withColumn("__tr", tiles("r1", "r2")).withColumn("__tc", tiles("c1", "c2"))
    keyed = cells.withColumn("__tr", F.floor(F.col("row") / width)).withColumn("__tc", F.floor(F.col("col") / width))
    inside = F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2"))
    met = keyed.join(ranges, ["sheet", "__tr", "__tc"]).where(inside).groupBy("sheet", "row", "col").agg(F.min(F.struct("r1", "c1")).alias("m"))
    out = cells.join(met, ["sheet", "row", "col"], "left")
    return out.withColumn("master_row", F.coalesce("m.r1", "row")).withColumn("master_col", F.coalesce("m.c1", "col")).drop("m")


def once_per_master(findings: DataFrame) -> DataFrame:
    """Of findings in merged cells other than the master, one a range; all others stay."""
    merged = (F.col("row") != F.col("master_row")) | (F.col("col") != F.col("master_col"))
    n = F.row_number().over(Window.partitionBy("sheet", "master_row", "master_col", merged).orderBy("row", "col"))
    return findings.withColumn("__n", n).where(~merged | (F.col("__n") == 1)).drop("__n")


def right_neighbour(cells: DataFrame) -> DataFrame:
    """cells (sheet, row, col, value) with the value of the next column in the row (null if that cell is missing)."""
    w = Window.partitionBy("sheet", "row").orderBy("col")
    return cells.withColumn("next_value", F.when(F.lead("col").over(w) == F.col("col") + 1, F.lead("value").over(w)))


def column_name(n: Column) -> Column:
    """The letters of a column number (from 1, three letters at most)."""
    def letter(x: Column) -> Column:
        return F.char(F.pmod(x, F.lit(26)) + 65)

    a = n - 1
    b = F.floor(a / 26) - 1
    c = F.floor(b / 26) - 1
    return F.concat(F.when(c >= 0, letter(c)).otherwise(""), F.when(b >= 0, letter(b)).otherwise(""), letter(a))


def match_project(rows: DataFrame, projects: list[tuple[str, str, str]]) -> DataFrame:
    """rows (code, product, drug, raw_text) with project: by code, then product (either holds the other), drug, text."""
    out = F.lit(None).cast("string")
    for name, product, drug in reversed(projects):
        out = F.when(F.col("raw_text").contains(name), name).otherwise(out)
    for name, product, drug in reversed(projects):
        out = F.when(F.col("drug").contains(drug), name).otherwise(out)
    for name, product, drug in reversed(projects):
        out = F.when((F.col("product") != "") & (F.col("product").contains(product) | F.contains(F.lit(product), "product")), name).otherwise(out)
    for name, product, drug in reversed(projects):
        out = F.when(F.col("code") == name, name).otherwise(out)
    return rows.withColumn("project", out)


def cell_ranges(cells: DataFrame) -> DataFrame:
    """cells (sheet, row, col) -> sheet, ranges: A1 references, cells that follow each other down a column as A1:A3, by column.

    A sheet's runs meet in one row, as they are one text.
    """
    w = Window.partitionBy("sheet", "col").orderBy("row")
    runs = cells.select("sheet", "row", "col").distinct().withColumn("run", F.col("row") - F.row_number().over(w))
    ends = runs.groupBy("sheet", "col", "run").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    name = column_name(F.col("col"))
    first = F.concat(name, F.col("a").cast("string"))
    text = F.when(F.col("a") == F.col("b"), first).otherwise(F.concat(first, F.lit(":"), name, F.col("b").cast("string")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "a", text.alias("t")))), lambda s: s["t"]), ", ")
    return ends.groupBy("sheet").agg(listed.alias("ranges"))
