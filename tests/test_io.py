"""Sources, sinks and streams on small files."""

import json
import os
import time
import zipfile

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.sources import files, sheets, sinks
from tessera.streaming import incremental as inc


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def test_listing_and_pairs(spark, tmp_path):
    root = str(tmp_path / "kb")
    for name in ("a/x.md", "a/x.json", "a/y.md", "a/z.pdf", "raw/w.pdf", "a/p_images/q.pdf", "b/x.json"):
        write(f"{root}/{name}", "t")
    rows = files.listing(spark, root, ("md", "json", "pdf"), prune=("raw",))
    assert sorted(r.name for r in rows.collect()) == ["x.json", "x.json", "x.md", "y.md", "z.pdf"]
    assert [r.name for r in files.pairs(rows).collect()] == ["x.md"]
    time.sleep(1.1)
    write(f"{root}/b/x.json", "later")
    assert files.newest(files.listing(spark, root, ("json",))).first()["folder"] == "b"
    stale = files.fresh(files.listing(spark, root, ("json",)), files.listing(spark, root, ("md",)))
    assert [r.stem for r in stale.collect()] == ["y"]


def test_text_encodings(spark, tmp_path):
    write(f"{tmp_path}/m/u.md", "稳定性".encode())
    write(f"{tmp_path}/m/g.md", "稳定性研究".encode("gbk"))
    assert {r.name: r.text for r in files.texts(spark, f"{tmp_path}/m").collect()} == {"u.md": "稳定性", "g.md": "稳定性研究"}


def test_index_and_trees(spark, tmp_path):
    write(f"{tmp_path}/i.json", json.dumps({"version": "1.0", "documents": [{"id": "a", "title": "T", "scope": {"category": "c", "type": ["x"]}, "tags": ["t"]}, {"id": "b"}]}, indent=1))
    rows = files.index(spark, f"{tmp_path}/i.json").collect()
    assert [(r.pos, r.id) for r in rows] == [(0, "a"), (1, "b")] and rows[0].scope.type == ["x"]
    tree = {"kids": [{"type": "heading", "content": "H", "page number": 1, "heading level": 2, "kids": [{"type": "paragraph", "content": "P", "page": 2}]}, {"type": "table", "content": "", "page_number": 3, "bounding box": [5.0, 1.0]}]}
    got = files.element_trees(spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps({"elements": [{"type": "x"}]}))], "doc_id long, json string")).orderBy("doc_id", "path").collect()
    assert [(r.doc_id, r.path, r.type, r.page, r.level, r.x0) for r in got] == [(1, [0], "heading", 1, 2, None), (1, [0, 0], "paragraph", 2, None, None), (1, [1], "table", 3, None, 5.0), (2, [0], "x", None, None, None)]


def test_deep_trees(spark):
    tree = {"content": "39", "page": 39}
    for k in range(38, -1, -1):
        tree = {"type": "t", "content": str(k), "page_number": "x" if k == 5 else k, "kids" if k % 2 else "elements": [tree, {"content": f"{k}b"}] if k % 7 == 0 else [tree], "flat_elements": [{"content": "not these"}]}
    rows = spark.createDataFrame([(1, json.dumps({"kids": [tree]})), (2, "{"), (3, None), (4, '{"kids": 7, "elements": [{"kids": "no"}]}'), (5, '{"kids": []}'), (6, "[1]")], "doc_id long, json string")
    got = {(r.doc_id, len(r.path)): (r.content, r.page) for r in files.element_trees(rows).where("path[size(path) - 1] = 0").collect()}
    assert got == {(1, k + 1): (str(k), None if k == 5 else k) for k in range(40)} | {(4, 1): (None, None)}
    assert files.element_trees(rows).where("doc_id = 1").count() == 40 + 6 and files.element_trees(rows.limit(0)).count() == 0


def test_session_logs(spark, tmp_path):
    write(f"{tmp_path}/s/a.jsonl", '{"timestamp":"2024-01-01T10:00:00Z","tool":"t"}\n{"timestamp":"2024-01-01T09:00:00Z"}\n')
    r = files.session_logs(spark, f"{tmp_path}/s").first()
    assert (r.lines, r.tool_calls, r.started.hour) == (2, 1, 10)  # the first line's time, not the least


def test_workbook_and_document(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    os.makedirs(tmp_path / "o")
    with zipfile.ZipFile(tmp_path / "o/a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>名称</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>0.12</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    write(f"{tmp_path}/o/broken.xlsx", "no archive")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "o/d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p></w:body></w:document>')
    cells = sheets.cells(spark, f"{tmp_path}/o")
    assert sorted((r.sheet, r.row, r.col, r.value) for r in cells.collect()) == [("S", 1, 1, "名称"), ("S", 1, 2, "0.12"), ("S", 2, 2, "x")]
    assert [tuple(r)[1:] for r in sheets.merged_ranges(spark, f"{tmp_path}/o").collect()] == [("S", 1, 1, 2, 1)]
    assert sheets.sheet_markdown(cells).first()["markdown"] == "| 名称 | 0.12 |\n|  | x |"
    assert [(r.type, r.level, r.content) for r in sheets.word_elements(spark, f"{tmp_path}/o").orderBy("pos").collect()] == [("heading", 2, "Title"), ("table", None, "1")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "main", "active"), ("b", "y", "feedback", "reference")], "id string, category string, doc_type string, status string")
    sinks.partitioned(rows, f"{tmp_path}/p", "category")
    assert spark.read.parquet(f"{tmp_path}/p").where("category = 'x'").count() == 1
    sinks.json_index(rows, f"{tmp_path}/j", 3)
    assert {r.index_version for r in spark.read.json(f"{tmp_path}/j").collect()} == {3}
    assert [r.id for r in sinks.worklist(rows).collect()] == ["a"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "node string")
    m = G.components(edges, nodes).withColumnRenamed("component", "community")
    sinks.graph(nodes, edges, m, f"{tmp_path}/g")
    assert {r.node: r.degree for r in spark.read.parquet(f"{tmp_path}/g/nodes").collect()} == {"a": 1, "b": 2, "c": 1, "z": 0}
    lines = [r.line for r in sinks.report(nodes, edges, m).orderBy("section", "n").collect()]
    assert lines[0] == "# Graph: 4 nodes, 2 edges" and "- b: 2" in lines


def test_index_of_many_files(spark, tmp_path):
    """More objects than tasks that write them: every document comes back."""
    from tessera.sources import files

    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        sinks.index_files(rows, f"{tmp_path}/x", 3, "2024-01-15T00:00:00", per_file=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(int(r.id) for r in files.index(spark, f"{tmp_path}/x").select("id").collect()) == list(range(200))


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SMALL

    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = inc.daily(inc.once(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), ["event_id"], "40 days"), None, "8 hours 30 minutes")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("daily").groupBy("day", "user_id").agg(F.max("n").alias("n"))
    want = inc.daily(inc.once(events, ["event_id"]), start="8 hours 30 minutes").select("day", "user_id", "n")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    due = inc.due_for_score(want, want.limit(0), 2)
    assert due.where("n < 2").isEmpty()
