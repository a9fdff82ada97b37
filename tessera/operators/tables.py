"""Tables of cells with spans: width, spans, nested and diagonal heads, column groups, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: A row: its cells, their column and row spans, and their boxes (left, bottom, right, top).
ROW = "struct<cells: array<string>, col_span: array<int>, row_span: array<int>, cell_bbox: array<array<double>>>"


def _spans(row: Column) -> Column:
    """Column spans, one a missing or ill-fitting list has."""
    ones = F.transform(row["cells"], lambda _: F.lit(1))
    return F.when(F.size(F.coalesce(row["col_span"], F.expr("cast(array() as array<int>)"))) == F.size(row["cells"]), row["col_span"]).otherwise(ones)


def _width(row: Column) -> Column:
    return F.aggregate(_spans(row), F.lit(0), lambda a, s: a + s)


def _starts(row: Column) -> Column:
    """For each cell, its first column and its span."""
    spans = _spans(row)
    return F.transform(spans, lambda s, i: F.struct(F.aggregate(F.slice(spans, F.lit(1), i), F.lit(0), lambda a, x: a + x).alias("start"), s.alias("span")))


def widths(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, _width)), F.lit(0))


def filled(rows: Column) -> Column:
    """The table as a rectangle: spans filled by empty cells, rows padded."""
    return F.transform(rows, lambda r: T.span_row(r["cells"], _spans(r), widths(rows)))


def has_span(rows: Column) -> Column:
    return F.exists(rows, lambda r: F.exists(_spans(r), lambda s: s > 1))


def ragged(rows: Column) -> Column:
    """Whether some row has fewer cells than another."""
    most = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
    return F.exists(rows, lambda r: F.size(r["cells"]) < most)


def header_depth(rows: Column) -> Column:
    """The last row whose cells all span rows, from 1; at least 1."""
    deep = F.transform(rows, lambda r, i: F.when((F.size(r["cells"]) > 0) & (F.size(F.coalesce(r["row_span"], F.expr("cast(array() as array<int>)"))) > 0) & F.forall(r["row_span"], lambda s: s > 1), i + 1).otherwise(1))
    return F.greatest(F.coalesce(F.array_max(deep), F.lit(1)), F.lit(1))


def diagonal(rows: Column) -> Column:
    """Whether two neighbouring filled cells of a row share their top but not their bottom."""
    def of(row: Column) -> Column:
        boxes = F.filter(F.zip_with(row["cells"], row["cell_bbox"], lambda c, b: F.when((F.coalesce(c, F.lit("")) != "") & (F.size(b) >= 4), b)), lambda b: b.isNotNull())
        after = F.slice(boxes, F.lit(2), F.greatest(F.size(boxes) - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(boxes, F.lit(1), F.greatest(F.size(boxes) - 1, F.lit(0))), after, lambda a, b: (F.abs(F.get(a, F.lit(1)) - F.get(b, F.lit(1))) > 5) & (F.abs(F.get(a, F.lit(3)) - F.get(b, F.lit(3))) < 10))
        return F.exists(pairs, lambda p: p)

    return F.exists(rows, lambda r: F.coalesce(F.when(r["cell_bbox"].isNotNull(), of(r)), F.lit(False)))


def column_groups(rows: Column) -> Column:
    """For each cell that spans columns: its first column, and the columns under it that hold single cells."""
    tops = F.flatten(F.transform(rows, lambda r, i: F.transform(F.filter(_starts(r), lambda s: s["span"] > 1), lambda s: F.struct(i.alias("row"), s["start"].alias("start"), s["span"].alias("span")))))

    def under(t: Column) -> Column:
        below = F.slice(rows, t["row"] + 2, F.size(rows))
        cells = F.flatten(F.transform(below, lambda r: F.filter(F.zip_with(r["cells"], _starts(r), lambda c, s: F.when((s["span"] == 1) & (F.coalesce(c, F.lit("")) != ""), s["start"])), lambda s: s.isNotNull())))
        return F.array_sort(F.array_distinct(F.filter(cells, lambda s: (s >= t["start"]) & (s < t["start"] + t["span"]))))

    return F.transform(tops, lambda t: F.struct(t["start"].alias("start"), under(t).alias("children")))


def structure(tables: DataFrame) -> DataFrame:
    """tables (rows: array of ROW, others) with width, has_span, has_merged, header_depth, nested, diagonal, groups."""
    rows = F.col("rows")
    return tables.withColumns({
        "width": widths(rows), "has_span": has_span(rows), "has_merged": ragged(rows), "header_depth": header_depth(rows), "diagonal": diagonal(rows), "groups": column_groups(rows),
    }).withColumn("nested", (F.col("header_depth") > 1) | (F.size("groups") > 0))


def markdown(rows: Column) -> Column:
    """The table as Markdown, a rule under its first row."""
    lines = F.transform(filled(rows), T.markdown_row)
    rule = T.markdown_row(F.array_repeat(F.lit("---"), widths(rows)))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(1)), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")).otherwise("")


#: What a place of the grid holds: a cell's first place, one that it spans to the right, one that it spans down.
OWN, ACROSS, DOWN = 0, 1, -1


def placed(rows: list) -> Iterator[tuple[int, int, str, int, int, int]]:
    """row, col, text, mark, and the row and col of the cell that each place of a table belongs to.

    A fold over the rows that carries what still spans down. A cell goes to the first column that is free, and over as
    many free columns as it spans; a row span of -1 continues the cell above in its column, or begins one where none is.
    Spans end with the table, and at places that are taken from above.
    """
    open_: dict[int, tuple[int, int, int]] = {}  # column -> rows left, row and column of the cell
    above: dict[int, tuple[int, int]] = {}
    for r, row in enumerate(rows):
        cells = list(row["cells"]) if row["cells"] is not None else []
        wide, tall = ([1] * len(cells) if row[k] is None or len(row[k]) != len(cells) else [1 if v is None else v for v in row[k]] for k in ("col_span", "row_span"))
        here = {c: at for c, (_, *at) in open_.items()}
        made = [(r, c, "", DOWN, *at) for c, at in here.items()]
        open_ = {c: (left - 1, *at) for c, (left, *at) in open_.items() if left > 1}
        col = 0
        for text, w, t in zip(cells, wide, tall):
            while col in here:
                col += 1
            own = tuple(above[col]) if t == -1 and col in above else (r, col)
            first = col
            while col < first + max(w, 1) and col not in here:
                here[col] = own
                made.append((r, col, (text or "") if own == (r, col) else "", OWN if own == (r, col) else DOWN if own[0] < r else ACROSS, *own))
                if t > 1:
                    open_[col] = (t - 1, *own)
                col += 1
        above = {c: tuple(at) for c, at in here.items()}
        yield from sorted(made)


def grid(tables: DataFrame, *keys: str) -> DataFrame:
    """tables (keys, rows: array of ROW) -> keys, row, col, text, mark, master_row, master_col: every place that a cell covers.

    Each table is folded by itself, in batches of rows that Arrow bounds; a null or empty table, and empty rows, give nothing.
    """
    kept = [f for f in tables.schema.fields if f.name in keys]
    names = [f.name for f in kept] + ["row", "col", "text", "mark", "master_row", "master_col"]
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["row int, col int, text string, mark int, master_row int, master_col int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*key, *place) for *key, rows in batch.itertuples(index=False) if rows is not None for place in placed(rows)]
            yield pd.DataFrame(found, columns=names)

    return tables.select(*(f.name for f in kept), "rows").mapInPandas(run, shape)


def ocr_confidence(rows: DataFrame) -> DataFrame:
    """rows (done_reason, chars, tokens) with confidence: medium if cut off, low if characters a token are odd, else high."""
    rate = F.col("chars") / F.nullif("tokens", F.lit(0))
    return rows.withColumn("confidence", F.when(F.col("done_reason") != "stop", "medium").when((rate < 3) | (rate > 50), "low").otherwise("high"))
