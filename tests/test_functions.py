"""Unit vectors of scalar functions, with CJK text."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import checker as C
from tessera.operators import elements as E
from tessera.operators import graph as G
from tessera.operators import index as I
from tessera.operators import listing as L
from tessera.operators import usage as U


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("稳定性 研究", ["稳定", "定性", "性研", "研究"]), ("a", []), ("", []), ("Ab-ab", ["ab", "ba"])])
def test_bigrams(spark, text, want):
    assert one(spark, T.bigrams(F.col("t")), t=text) == want == T.bigram_list(text)


@pytest.mark.parametrize("a, b, want", [
    ("稳定性研究指导原则", "稳定性研究指导原则", "identical"), ("稳定性研究指导原则（试行）", "稳定性研究指导原则", "small"), ("化学药物稳定性研究", "中药临床评价", "large"),
    ("", "x", "none"), (None, "x", "none"), ("abcdefgh", "abcdefxy", "small"), ("abcdefgh", "abcdexyz", "large"),
])
def test_title_similarity(spark, a, b, want):
    assert one(spark, T.title_similarity(F.col("a").cast("string"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize("a, b", [("abcxyz", "zabcy"), ("aaa", "aa"), ("abc", "def"), ("", "a"), ("xabcabcdy", "abcdabc")])
def test_common_substring(spark, a, b):
    best = max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)
    assert one(spark, T.common_substring_share(F.col("a"), F.col("b")), a=a, b=b) == best / max(len(a), len(b))


def test_text_helpers(spark):
    assert one(spark, T.normalise_date(F.col("d")), d="2024-3-7") == "20240307"
    assert one(spark, T.normalise_date(F.col("d")), d="2024.12.01") == "20241201"
    assert one(spark, T.safe_filename(F.col("d")), d='a/b:c*"d"') == "abcd"
    assert one(spark, T.strip_hash(F.col("d")), d="file_0a1b2c3d") == "file"
    assert one(spark, T.folded(F.col("d")), d="ＡＢ－ｃ １") == "abc1"
    assert one(spark, T.text_similarity(F.col("a"), F.col("b")), a="abc", b="abd") == 0.5
    assert one(spark, T.text_similarity(F.col("a"), F.col("b")), a="abc", b="abcd") == 0.8
    assert one(spark, T.language(F.col("d")), d="药" * 30) == "zh"
    assert one(spark, T.language(F.col("d")), d="word " * 20) == "en"
    assert one(spark, T.first_title(F.col("d")), d="![x](y)\nshort\n# Head line\n") == "Head line"
    assert one(spark, T.quoted_title(F.col("d")), d="关于《指南》的通知") == "指南"
    assert one(spark, T.compare_versions(F.lit("1.10.0"), F.lit("1.9"))) == 1
    assert one(spark, T.parse_markdown_table(F.lit("| a | b |\n|---|---|\n| 1 | 2 |"))) == [["a", "b"], ["1", "2"]]
    assert one(spark, T.span_row(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(2), F.lit(1)), F.lit(4))) == ["a", "", "b", ""]


def test_usage_vectors(spark):
    row = spark.createDataFrame([(15, "每天多次", 4, "5天", "90%", "有")], "dialogues int, frequency string, tools int, run_duration string, cron_rate string, ongoing string")
    r = U.usage_scores(row).first()
    assert (r.activity_score, r.depth_score, r.continuity_score, r.innovation_score, r.total_score, r.rating) == (23, 17, 15, 23, 78, "B")
    row = spark.createDataFrame([(16, 1, 5, 6, False, False, True)], "user_messages int, bot_messages int, tools int, days int, cron boolean, long_term boolean, custom_skill boolean")
    r = U.objective_scores(row).first()
    assert (r.activity_score, r.depth_score, r.continuity_score, r.innovation_score, r.total_score, r.rating) == (8, 22, 13, 20, 63, "C")
    assert one(spark, U.duration(F.lit(45))) == "1个月15天"
    assert [one(spark, U.valid_name(F.lit(n))) for n in ("张三", "12", "x", "", "用户")] == [True, False, False, False, False]


def test_checker(spark):
    assert one(spark, C.normalised_batch(F.lit("LX-24010105（复测）"))) == "LX-240101-05（复测）"
    assert one(spark, C.normalised_batch(F.lit("LX-240101-05"))) is None
    assert one(spark, C.threshold(F.lit("杂质A-1"), [("杂质A", 0.1), ("杂质A-1", 0.0)], 0.05)) == 0.0
    assert one(spark, C.threshold(F.lit("杂质A-2"), [("杂质A", 0.1)], 0.05)) == 0.1
    assert [one(spark, C.column_name(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, C.first_number(F.lit("约 0.12%"))) == 0.12 and one(spark, C.first_number(F.lit("1.2.3"))) is None
    cells = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 5, 5)], "sheet string, row int, col int")
    merged = spark.createDataFrame([("s", 1, 1, 2, 2)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    got = {(r.row, r.col): (r.master_row, r.master_col) for r in C.masters(cells, merged).collect()}
    assert got == {(1, 1): (1, 1), (2, 2): (1, 1), (5, 5): (5, 5)}


def test_sections_and_paths(spark):
    text = "1.1 too early\n# AA\n1.1 before nothing\n## BB\n### CC\n## D······\n## EE\n#### x\ntext\n1.2 numbered one"
    heads = E.sections(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = sorted((r.line, r.level, r.title) for r in heads.collect())
    assert rows == [(2, 1, "AA"), (3, 4, "1.1 before nothing"), (4, 2, "BB"), (5, 3, "CC"), (7, 2, "EE"), (10, 4, "1.2 numbered one")]
    paths = {r.line: r.path for r in E.section_paths(heads).collect()}
    assert paths[5] == "AA > BB > CC" and paths[7] == "AA > EE" and paths[10] == "AA > EE > 1.2 numbered one"


def test_table_merge_pairs(spark):
    rows = [(1, p, p, 3, 2, "h", True) for p in (1, 2, 3, 4)] + [(1, 5, 6, 3, 2, "h", True)]
    t = spark.createDataFrame(rows, "doc_id long, pos int, page int, columns int, n_rows int, head string, confident boolean")
    assert {r.pos: r.merge_into for r in E.merge_across_pages(t).collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_index_rules(spark):
    names = ["20240115-化学药物稳定性研究指导原则（征求意见稿）.pdf", "中药注射剂起草说明.docx"]
    a, b = I.metadata(spark.createDataFrame([(n,) for n in names], "filename string")).orderBy("filename").collect()
    assert (a.issue_date, a.doc_type, a.status, a.category, a.folder) == ("20240115", "draft", "draft", "化学药", "稳定性")
    assert a.id == "guidance_化学药_20240115_draft" and (b.id, b.doc_type, b.drug_types) == ("guidance_中药_explanation", "explanation", ["注射剂"])
    schema = "id long, pos long, title string, issue_date string, page1 string, page2 string, pdf_byte string"
    old = spark.createDataFrame([(1, 1, "指导原则甲", "20240101", "a", "b", None), (2, 2, "指导原则甲", "", "a", "b", None), (3, 3, "另一文件", "", None, None, "z")], schema)
    new = spark.createDataFrame([(9, 9, "指导原则甲（试行）", "20240202", "a", "b", None), (8, 8, "另一文件", "", None, None, "z"), (7, 7, "指导原则甲", "", None, "b", None)], schema)
    assert {r.id: (r.duplicate_of, r.by) for r in I.duplicates(new, old).collect()} == {9: (2, "pages"), 8: (3, "bytes")}
    state = I.validity(spark.createDataFrame([(None, "x"), ("{", "x" * 200), ('{"kids":[{"a":1}]}', "x" * 200), ('{"kids":[]}', "x" * 200), ('{"kids":[1]}', "x")], "json string, markdown string"))
    assert [r.reason for r in state.collect()] == ["no json", "bad json", "ok", "no elements", "short markdown"]


def test_graph_properties(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "x"), ("d", "e")], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in "abcdexz"], "node string")
    assert {r.node: r.degree for r in G.degrees(edges).collect()} == {"a": 1, "b": 2, "c": 1, "x": 2, "d": 1, "e": 1}
    assert {r.node: r.component for r in G.components(edges, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "x": "x", "z": "z"}
    assert {r.node: r.distance for r in G.reach(edges, "a").collect()} == {"a": 0, "b": 1, "c": 2}
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "source string, target string")
    all_ = chain.selectExpr("source as node").union(chain.selectExpr("target")).distinct()
    assert {r.component for r in G.components(chain, all_).collect()} == {"n00"}


def test_listing(spark):
    page = '<select><option>All</option><option>x</option></select><tr><th>n</th></tr><tr><td>1</td><td><a href="u">T</a></td><td>2024-1-2</td></tr>Showing 1 to 10 of 1,234 entries'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert L.table_rows(pages).first()["cells"] == ["1", "T", "2024-1-2"]
    assert pages.select(L.total_entries(F.col("html")).alias("n")).first()["n"] == 1234
    assert [r.option for r in L.options(pages).collect()] == ["x"]
    assert one(spark, L.is_pdf(F.lit(bytearray(b"%PDF-1.7")))) and not one(spark, L.is_pdf(F.lit(bytearray(b"<!doctype"))))
