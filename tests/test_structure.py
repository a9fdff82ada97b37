"""Relations, tables with spans, and greedy matching on hand-made cases."""

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import matching as M
from tessera.operators import relations as R
from tessera.operators import tables as B


def test_measures_and_triples(spark):
    df = spark.createDataFrame([(1, "剂量 5 mg/kg 给药 28 天，ICH S6 于 2011 年，大鼠毒性试验适用于生物制品 本指南包括稳定性研究"), (2, None)], "doc_id long, text string")
    rows = df.select("doc_id", R.measures(F.col("text")).alias("m")).orderBy("doc_id").collect()
    assert rows[0].m == ["dose:5", "duration:28天", "ich:ICHS6", "year:2011"] and rows[1].m is None
    assert {(r.source, r.relation, r.target) for r in R.triples(df).collect()} == {("大鼠毒性试验适", "used_for", "生物制品"), ("大鼠毒性试验", "applies_to", "生物制品"), ("本指南", "includes", "稳定性研究")}


def test_pairs_and_confidence(spark):
    tags = spark.createDataFrame([(1, "s", "x"), (1, "s", "y"), (1, "t", "z"), (2, "s", "x")], "doc_id long, type string, label string")
    assert sorted((r.source, r.target) for r in R.typed_pairs(tags, "s", "t", "in").collect()) == [("x", "z"), ("y", "z")]
    edges = spark.createDataFrame([("a", "b", "INFERRED", 0.5), ("b", "c", "EXTRACTED", 1.0), ("a", "c", "INFERRED", 0.7), ("d", "e", "AMBIGUOUS", 0.1)], "source string, target string, confidence string, confidence_score double")
    r = R.confidence_report(edges).first()
    assert (r.edges, r.extracted, r.inferred, r.ambiguous, r.inferred_score) == (4, 0.25, 0.5, 0.25, 0.6)
    assert {r.node: r.inferred for r in R.weak_nodes(edges).collect()} == {"a": 2, "b": 1, "c": 1}


def test_table_structure(spark):
    nested = [(["A", "B"], [1, 2], [2, 2], None), (["x", "y"], [1, 1], None, None), (["1", "2", "3"], None, None, None)]
    slanted = [(["a", "b"], None, None, [[0.0, 0.0, 5.0, 20.0], [5.0, 10.0, 9.0, 21.0]])]
    df = spark.createDataFrame([(1, nested), (2, slanted), (3, [])], f"id int, rows array<{B.ROW}>")
    one, two, three = B.structure(df).orderBy("id").collect()
    assert (one.width, one.has_span, one.has_merged, one.header_depth, one.nested, one.diagonal) == (3, True, True, 1, True, False)
    assert [(g.start, g.children) for g in one.groups] == [(1, [1, 2])]
    assert two.diagonal and not two.nested and three.width == 0
    md = df.select(B.markdown(F.col("rows")).alias("m"), "id").orderBy("id").collect()
    assert md[0].m.split("\n")[:3] == ["| A | B |  |", "| --- | --- | --- |", "| x | y |  |"] and md[2].m == ""
    ocr = spark.createDataFrame([("stop", 100, 10), ("length", 100, 10), ("stop", 10, 10)], "done_reason string, chars int, tokens int")
    assert [r.confidence for r in B.ocr_confidence(ocr).collect()] == ["high", "medium", "low"]


def brute_grid(rows):
    """A table of places filled cell by cell, each cell over the rectangle that it spans but for what is taken."""
    taken, out = {}, {}
    for r, (cells, wide, tall) in enumerate(rows):
        col = 0
        for text, w, t in zip(cells, wide, tall):
            while (r, col) in taken:
                col += 1
            first = col
            own = taken[r - 1, first] if t == -1 and (r - 1, first) in taken else (r, first)
            while col < first + max(w, 1) and (r, col) not in taken:
                for down in range(max(t, 1)):
                    if r + down < len(rows) and ((r + down, col) not in taken):
                        taken[r + down, col] = own
                        here = (r + down, col)
                        out[here] = (text if here == own else "", 0 if here == own else -1 if own[0] < r + down else 1, *own)
                col += 1
    return {(r, c, *v) for (r, c), v in out.items()}


def test_grid_of_random_tables(spark):
    import random

    draw = random.Random(4)
    tables = []
    for k in range(150):
        rows = []
        for _ in range(draw.randrange(6)):
            n = draw.randrange(5)
            rows.append(([f"c{draw.randrange(99)}" for _ in range(n)], [draw.choice([1, 1, 2, 3]) for _ in range(n)], [draw.choice([1, 1, 1, 2, 3, -1]) for _ in range(n)]))
        tables.append((k, rows))
    df = spark.createDataFrame([(k, [(*row, None) for row in rows]) for k, rows in tables] + [(-1, None)], f"id int, rows array<{B.ROW}>").withColumn("other", F.lit(1))
    got = {}
    for r in B.grid(df, "id").collect():
        got.setdefault(r.id, []).append((r.row, r.col, r.text, r.mark, r.master_row, r.master_col))
    for k, rows in tables:
        assert set(got.get(k, [])) == brute_grid(rows) and len(got.get(k, [])) == len(brute_grid(rows)), rows
    assert -1 not in got
    ill = spark.createDataFrame([(1, [(["a", None], [1], None, None), (None, None, None, None)])], f"id int, rows array<{B.ROW}>")
    assert [tuple(r) for r in B.grid(ill, "id").collect()] == [(1, 0, 0, "a", 0, 0, 0), (1, 0, 1, "", 0, 0, 1)]


def test_united_pages(spark):
    from tessera.operators import elements as E

    pages = spark.createDataFrame([(1, p, k) for p, k in ((1, "scanned"), (2, "digital"), (3, "digital"), (4, "digital"), (5, "scanned"))], "doc_id long, page long, kind string")
    shape = "doc_id long, page long, pos int, type string, content string"
    digital = spark.createDataFrame([(1, 1, 0, "paragraph", "d1"), (1, 2, 0, "paragraph", "d2"), (1, 3, 0, "table", "d3"), (1, 4, 0, "table", "d4"), (1, 5, 0, "paragraph", "d5"), (1, 9, 0, "table", "unlisted")], shape)
    recognised = spark.createDataFrame([(1, 1, 1, "paragraph", "r1b"), (1, 1, 0, "paragraph", "r1a"), (1, 2, 0, "paragraph", "not asked for"), (1, 4, 0, "table", "r4")], shape)
    assert sorted((r.page, r.part) for r in E.pages_to_recognise(pages, digital).collect()) == [(1, 2), (3, 1), (4, 1), (5, 2)]
    got = E.united(pages, digital, recognised).orderBy("place").collect()
    assert [(r.place, r.content, r.origin[0]) for r in got] == [(0, "d2", "d"), (1, "d3", "d"), (2, "r4", "r"), (3, "r1a", "r"), (4, "r1b", "r"), (5, "d5", "d")]


def test_positions(spark):
    e = spark.createDataFrame([(1, 0, "heading", "１ Scope"), (1, 1, "paragraph", "same words here"), (1, 2, "paragraph", "same words here"), (1, 3, "table", "h1 h2\n1 2"), (1, 4, "table", "zz"), (2, 0, "paragraph", "alone")], "doc_id long, pos int, type string, content string")
    t = spark.createDataFrame([(1, 0, "heading", "1 scope", 3, "1 scope"), (1, 1, "paragraph", "same words here", 4, None), (1, 2, "paragraph", "same words here", 5, None), (1, 3, "table", "other", 6, None), (1, 4, "table", "h1 h2\n9 9", 7, None)], "doc_id long, tpos int, type string, content string, page int, section_path string")
    got = {(r.doc_id, r.pos): (r.page, r.section_path) for r in M.enriched(e, t).collect()}
    assert got == {(1, 0): (3, "1 scope"), (1, 1): (4, None), (1, 2): (5, None), (1, 3): (7, None), (1, 4): (6, None), (2, 0): (None, None)}
    s = spark.createDataFrame([("f", "Stability", ["a", "b"]), ("f", "Other", ["c", "d"]), ("f", "None", ["q"])], "file string, sheet string, tokens array<string>")
    p = spark.createDataFrame([("f", 1, "nothing", ["c"]), ("f", 2, "on Stability", ["x"]), ("f", 3, "Stability", ["c", "d"])], "file string, page int, text string, tokens array<string>")
    assert {r.sheet: r.page for r in M.sheet_pages(s, p).collect()} == {"Stability": 2, "Other": 3}


def test_louvain_finds_cliques(spark):
    """Ten cliques in a ring come apart as cliques, and the state's modularity is what the definition says."""
    edges, n = [], 10
    for c in range(n):
        edges += [(f"n{c}_{a}", f"n{c}_{b}", 1) for a in range(5) for b in range(a)]
        edges.append((f"n{c}_0", f"n{(c + 1) % n}_1", 1))
    df = spark.createDataFrame(edges, "source string, target string, weight int")
    found = G.louvain(df)
    member = {r.node: r.community for r in found.collect()}
    groups = {}
    for node, community in member.items():
        groups.setdefault(community, set()).add(node)
    m = len(edges)
    degree = {}
    for a, b, _ in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    want = sum(member[a] == member[b] for a, b, _ in edges) / m - sum((sum(degree[x] for x in g) / (2 * m)) ** 2 for g in groups.values())
    got = G.modularity(df, found).first()[0]
    assert len(member) == 50 and abs(got - want) < 1e-9 and got > 0.75
    assert all(len({member[f"n{c}_{k}"] for k in range(5)}) == 1 for c in range(n))
    assert G.louvain(df.limit(0)).count() == 0


def test_compatibility_form(spark):
    import unicodedata


    from tessera.functions import text as T

    rows = ["ＡＢＣ　１２", "ﬁne", "①②", "plain", "é", None, ""]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", T.nfkc(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in got)


def test_greedy_modularity(spark):
    """Cliques in a ring come apart, and planted groups are found as well as they were planted, and no merger of two communities would gain."""
    import random

    draw = random.Random(8)
    ring = [(f"n{c}_{a}", f"n{c}_{b}", 1.0) for c in range(4) for a in range(5) for b in range(a)] + [(f"n{c}_0", f"n{(c + 1) % 4}_1", 1.0) for c in range(4)] + [("leaf", "n0_2", 1.0), ("n0_0", "n0_0", 9.0), (None, "n0_0", 1.0), ("p", "q", 1.0)]
    found = {r.node: r.community for r in G.greedy_modularity(spark.createDataFrame(ring, "source string, target string, weight double")).collect()}
    groups = {}
    for node, community in found.items():
        groups.setdefault(community, set()).add(node)
    want = [{f"n{c}_{a}" for a in range(5)} for c in range(4)]
    want[0].add("leaf")
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [*want, {"p", "q"}]))
    planted = [(f"{a:03}", f"{b:03}", 1.0) for a in range(40) for b in range(a) if draw.random() < (0.8 if a % 4 == b % 4 else 0.03)]
    df = spark.createDataFrame(planted, "source string, target string, weight double")
    greedy = G.greedy_modularity(df)
    truth = spark.createDataFrame([(f"{a:03}", str(a % 4)) for a in range(40)], "node string, community string")
    q = [G.modularity(df, m).first()[0] for m in (greedy, truth)]
    assert q[0] >= 0.98 * q[1] > 0.4
    member = {r.node: r.community for r in greedy.collect()}
    degree, between = {}, {}
    for a, b, w in planted:
        for x in (a, b):
            degree[member[x]] = degree.get(member[x], 0) + w
        between[frozenset((member[a], member[b]))] = between.get(frozenset((member[a], member[b])), 0) + w
    total = sum(degree.values())
    assert all(w - degree[min(p)] * degree[max(p)] / total <= 1e-6 for p, w in between.items() if len(p) == 2)
    assert G.greedy_modularity(df.limit(0)).count() == 0


def test_greedy_modularity_size_guess(spark):
    """Rounds do not multiply the size that the optimizer guesses for the state: it would outgrow the driver."""
    path = [(f"{a:03}", f"{a + 1:03}", 1.0 + a % 7) for a in range(60)]
    found = G.greedy_modularity(spark.createDataFrame(path, "source string, target string, weight double"))
    assert found.count() == 61
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64


def test_greedy_modularity_rounds(spark, monkeypatch):
    """A community that many name takes them in one round: the rounds are not as many as its members."""
    import random

    draw, write, written = random.Random(5), G.stored, []
    apart = [(f"{c}-{a:02}", f"{c}-{b:02}", float(draw.randint(5, 15))) for c in range(6) for a in range(40) for b in range(a)]
    monkeypatch.setattr(G, "stored", lambda df, path: written.append(path.split("/")[-1]) or write(df, path))
    found = G.greedy_modularity(spark.createDataFrame(apart, "source string, target string, weight double")).collect()
    assert {r.node: r.community[0] for r in found} == {f"{c}-{a:02}": str(c) for c in range(6) for a in range(40)}
    assert len({r.community for r in found}) == 6
    assert sum(name.startswith("links") for name in written) <= 10


def test_greedy_modularity_together(spark):
    """Those that join a pair in one round still gain by it: the next best is better for some once others have joined."""
    named = [("h", "p", 30.0, 20.0, 0.0, 40.0), ("p", "h", 30.0, 20.0, 0.0, 40.0)]
    named += [("x", "h", 20.0, 15.0, 1.0, 10.0), ("y", "h", 20.0, 15.0, 14.0, 10.0), ("z", "p", 20.0, 15.0, 9.0, 30.0), ("far", "x", 5.0, 4.0, 0.0, 6.0)]
    df = spark.createDataFrame(named, "a string, b string, w double, gain double, second double, degree double")
    # room by hand at a total of 200: x 19 * 200 / 10 - 80 = 300, y 6 * 200 / 10 - 80 = 40, z 11 * 200 / 30 - 80 < 0
    assert {(r["from"], r["to"]) for r in G._joining(df, 200.0, 1.0).collect()} == {("h", "h"), ("p", "h"), ("x", "h"), ("y", "h")}
    # at 180 y has room for 28, at 140 for 4: less than x brings
    assert {r["from"] for r in G._joining(df, 180.0, 1.0).collect()} == {"h", "p", "x", "y"}
    assert {r["from"] for r in G._joining(df, 140.0, 1.0).collect()} == {"h", "p", "x"}
    assert {r["from"] for r in G._joining(df, 140.0, 0.0).collect()} == {"h", "p", "x", "y", "z"}
