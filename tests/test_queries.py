"""Every core query against its DuckDB counterpart, and those without one for what must hold."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_page_rank_sums_to_one(spark):
    rows = QUERIES["page_rank"](spark, SMALL).collect()
    assert abs(sum(r["rank"] for r in rows) - 1) < 1e-6


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_paragraph_lines(spark):
    from tessera.functions import text as T
    from tessera.operators import elements as E
    from tessera.plans.search_queries import _markdown
    from pyspark.sql import functions as F

    lines = {}
    for r in E.elements(_markdown(spark, SMALL)).select("doc_id", "pos", "content", T.page_text(F.col("content")).alias("k")).collect():
        lines.setdefault(r.doc_id, []).append(r)
    want = set()
    for doc, rows in lines.items():
        for p in rows:
            fits = [m for m in rows if m.k and (m.k in p.k or p.k in m.k)]
            if len(p.content) >= 20 and len(p.k) >= 10 and fits:
                want.add((doc, p.pos + 1, p.content, max(fits, key=lambda m: (len(m.k), -m.pos)).pos + 1))
    got = QUERIES["paragraph_lines"](spark, SMALL).collect()
    assert {(r.doc_id, r.page, r.text, r.md_line) for r in got} == want and len(got) == len(want)
    assert any((page - 1) % 4 != 1 for _, page, _, _ in want)


def test_containment_of_long_texts(spark):
    """Both ways of pairing find the same lines, and no list of pieces carries the texts along."""
    import random

    from tessera.operators import elements as E

    draw = random.Random(4)
    words = ["".join(draw.choice("abé漢") for _ in range(draw.randint(1, 9))) for _ in range(40)]
    lines = [(d, "".join(draw.choices(words, k=draw.choice((1, 2, 3, 4, 300))))) for d in range(3) for _ in range(40)]
    paragraphs = [(d, i, t[1 : draw.randint(8, 30)] + draw.choice(("", "z"))) for i, (d, t) in enumerate(lines)]
    p = spark.createDataFrame(paragraphs, "doc_id int, page long, text string")
    m = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(lines)], "doc_id int, pos int, content string")
    want = set()
    for d, page, text in paragraphs:
        fits = [(len(t), -i) for i, (e, t) in enumerate(lines) if e == d and (t in text or text in t)]
        if len(text) >= 10 and fits:
            want.add((d, page, text, 1 - max(fits)[1]))
    assert {x[3] for x in want} and all({tuple(r) for r in E.page_lines(p, m, most=most).collect()} == want for most in (0, 1 << 26))
    short, long = (m.select("doc_id", F.col("content").alias(c)).distinct() for c in "st")
    plan = E.contained(short, long, "doc_id", most=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and not [x for x in plan.splitlines() if "Generate explode" in x and "t#" in x.split("[", 2)[-1]]


def test_range_join_cells(spark):
    ranges = {}
    for c in spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey", "c_nationkey").collect():
        r1 = c.c_custkey % 500
        ranges.setdefault(c.c_custkey % 10, []).append((r1, r1 + c.c_nationkey % 3, c.c_nationkey % 4 + 1))
    for x in QUERIES["range_join_cells"](spark, SMALL).collect():
        firsts = [a for a, b, c2 in ranges.get(x.sheet, []) if a <= x.row <= b and 1 <= x.col <= c2]
        assert (x.master_row, x.master_col) == ((min(firsts), 1) if firsts else (x.row, x.col))
