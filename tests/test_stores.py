"""Snapshots, buckets, the inverted index, containment joins, keyed state: on small cases and against plain loops."""

import os
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import elements as E
from tessera.operators import graph as G
from tessera.operators import postings as P
from tessera.operators import rules as X
from tessera.operators import search as S
from tessera.sources import buckets, snapshots
from tessera.streaming import incremental as inc
from tessera.streaming import stateful


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_snapshots(spark, tmp_path):
    root, rows = f"{tmp_path}/s", spark.range(10).toDF("n")
    with pytest.raises(ValueError):
        snapshots.read(spark, root)
    assert [snapshots.publish(rows.limit(k), root) for k in (1, 2, 3)] == [1, 2, 3]
    rows.write.parquet(f"{root}/data/00000004-broken")  # a write whose manifest row never came
    assert snapshots.read(spark, root).count() == 3 and snapshots.read(spark, root, 1).count() == 1
    assert snapshots.expire(spark, root, 1) == [1, 2] and snapshots.expire(spark, root, 1) == []
    with pytest.raises(ValueError):
        snapshots.read(spark, root, 2)
    assert [(r.version, r.rows, r.expired) for r in snapshots.manifest(spark, root).orderBy("version").collect()] == [(1, 1, True), (2, 2, True), (3, 3, False)]
    assert snapshots.publish(rows, root, keep=1) == 4 and snapshots.read(spark, root).count() == 10
    rows.limit(7).write.parquet(f"{tmp_path}/plain")
    assert snapshots.read(spark, f"{tmp_path}/no", fallbacks=(f"{tmp_path}/nor", root, f"{tmp_path}/plain")).count() == 10
    assert snapshots.read(spark, f"{tmp_path}/no", fallbacks=(f"{tmp_path}/plain", root)).count() == 7
    with pytest.raises(AnalysisException):
        snapshots.read(spark, f"{tmp_path}/no", fallbacks=(f"{tmp_path}/nor",))
    assert [snapshots.next_label(x) for x in (None, "1.0", "1.9", "9.9", "10", "780", "x")] == ["1.0", "1.1", "2.0", "10.0", "11", "781", "1.0"]


def test_buckets_rewrite_what_changes(spark, tmp_path):
    path = f"{tmp_path}/i"
    rows = [(k, k * 3, str(k)) for k in range(500)] + [(7, 1, "early"), (None, 5, "no key")]
    buckets.create(spark.createDataFrame(rows, "k long, at long, v string"), path, "k", "at", 16)
    before, want = files_of(path), {k: v for k, _, v in sorted(rows[:-1], key=lambda r: r[1])}
    updates = [(5, 2, "y"), (5, 1, "x"), (9000, 4, "new"), (None, 9, "q"), (8000, 3, "first"), (8000, 8, "last")]
    touched = buckets.upsert(spark.createDataFrame(updates, "k long, at long, v string"), path, "k", "at", 16)
    after = files_of(path)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) <= 3 and all(after.get(f) == before[f] for f in kept) and not set(after) & (set(before) - kept)
    want |= {5: "y", 9000: "new", 8000: "last"}
    got = buckets.read(spark, path).orderBy("batch", "place").collect()
    assert {r.k: r.v for r in got} == want and len(got) == len(want)
    assert [r.k for r in got][:9] == [0, 7, 1, 2, 3, 4, 5, 6, 8] and [r.k for r in got][-2:] == [8000, 9000]  # in place, new ones behind
    assert buckets.upsert(spark.createDataFrame([], "k long, at long, v string"), path, "k", "at", 16) == []


LINES = ["Quality of medicines", "quality, of; MEDICINES!", "", "??", "日本語の品質", "q", "medicine", "ab", "Of quality"]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    draw = random.Random(5)
    rows = [(d, p, draw.choice(LINES) + " " + draw.choice(LINES)) for d in (3, 1023, 1024, 70_000) for p in range(0, 9000, 450)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, content string")
    root = f"{tmp_path}/x"
    assert P.search(spark, root, "quality").count() == 0 and P.frequencies(spark, root).count() == 0
    assert P.append(df.where("doc_id < 1024"), root) == 1
    first = files_of(root)
    assert {r.doc_id for r in P.search(spark, root, "quality", 500).collect()} == {3, 1023}
    assert P.append(df.limit(0), root) == 1 and P.append(df.where("doc_id >= 1024"), root) == 2
    assert set(first) & set(files_of(root)) >= {f for f in first if "/segments/" in f}  # found without a rebuild
    for query in ("quality of", "日本", "Zz", "q", "", "medicines ab"):
        for top in (3, 500):
            want = [tuple(r) for r in S.fulltext(df, query, top, 12).collect()]
            assert [tuple(r) for r in P.search(spark, root, query, top, 12).collect()] == want
    held = [set(T.bigram_list(c)) for _, _, c in rows]
    assert {r.bigram: r.elements for r in P.frequencies(spark, root).collect()} == {b: sum(b in h for h in held) for h in held for b in h}
    only = P.search(spark, root, "quality", 500, within=spark.createDataFrame([(3,)], "doc_id long"))
    assert {r.doc_id for r in only.collect()} == {3}
    # a folder was left half-written: no search reads it
    os.makedirs(f"{root}/segments/broken/postings")
    assert P.search(spark, root, "quality of", 500).count() == S.fulltext(df, "quality of", 500).count()


def test_index_reads_the_querys_lists_alone(spark, tmp_path):
    df = spark.createDataFrame([(d, 0, " ".join(chr(97 + (d * k) % 26) + chr(97 + k % 26) for k in range(40))) for d in range(60)], "doc_id long, pos int, content string")
    root = f"{tmp_path}/x"
    P.append(df, root)
    found = P.lists(spark, root, ["aa", "ab"])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(bigram" in plan
    read = {r[0] for r in found.select("_metadata.file_path").distinct().collect()}
    assert 0 < len(read) <= 2 and len(read) < len([f for f in files_of(root) if "/postings/" in f]) / 5


def test_containment(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abé😀") for _ in range(draw.choice([1, 2, 4, 5, 6, 9, 14]))) for _ in range(120)]
    texts += [t[2:9] for t in texts if len(t) > 8] + ["", "aaaaaaaaaaaa", "aaaaa"]
    short = {(d, t) for d in (1, 2) for t in texts[d::2]}
    long = {(d, t + u) for d in (1, 2) for t, u in zip(texts[d::3], texts[d::5])} | {(1, "")}
    got = E.contained(spark.createDataFrame(sorted(short), "doc long, s string"), spark.createDataFrame(sorted(long), "doc long, t string"), "doc").collect()
    want = {(d, s, t) for d, s in short for e, t in long if d == e and s and s in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_many_lines_of_one_document(spark):
    """20,000 lines, a fourth of them equal: each paragraph finds the longest line that fits."""
    n = 20_000
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 4 == 0, "the same heading again").otherwise(F.concat(F.lit("section "), F.md5(F.col("id").cast("string")))).alias("content"))
    part = lines.where("pos % 4 <> 0").select("doc_id", (F.col("pos") + 1).alias("page"), F.substring("content", 3, 30).alias("text")).unionByName(lines.where("pos < 9").select("doc_id", F.lit(0).alias("page"), F.col("content").alias("text")))
    got = E.page_lines(part, lines)
    wrong = got.where("page > 0 AND md_line <> page")
    assert got.count() == n * 3 // 4 + 7 and wrong.isEmpty()
    assert got.where("page = 0 AND text = 'the same heading again'").head()["md_line"] == 1


def test_keyword_context(spark):
    rows = spark.createDataFrame([(1, p, c) for p, c in enumerate(["a", "KEY one", "b", "two key", "c", "d", "e"])] + [(2, 0, "none")], "doc_id long, pos int, content string")
    got = {(r.doc_id, r.line_number, r.keyword, r.context) for r in S.keyword_context(rows, ["two", "key"]).collect()}
    assert got == {(1, 2, "key", "a\nKEY one\nb\ntwo key"), (1, 4, "two", "KEY one\nb\ntwo key\nc\nd")}


def test_long_paths(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(50)]
    edges = spark.createDataFrame(chain + [("n03", "n03"), ("x", "y"), (None, "x")], "source string, target string")
    assert X.shortest_path(edges, "n00", "n50").head()[0] == [f"n{i:02}" for i in range(51)]
    short = spark.createDataFrame(chain[:12] + [("n00", "m"), ("m", "n02"), ("x", "y")], "source string, target string")
    assert {r.node: r.distance for r in G.reach(short, "n01").collect()} == {"n01": 0, "n00": 1, "m": 2} | {f"n{i:02}": i - 1 for i in range(2, 13)}
    assert X.shortest_path(short, "n00", "y").isEmpty() and X.shortest_path(short, "x", "x").head()[0] == ["x"]
    assert X.shortest_path(short, "n00", "n03").head()[0] == ["n00", "m", "n02", "n03"]
    assert [tuple(r) for r in G.reach(short, "nowhere").collect()] == [("nowhere", 0)]


def run(out, path):
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_files_are_tracked(spark, tmp_path):
    shape = "filename string, at long, md5 string, status string"
    turns = [
        [("a", 1, "x", None), ("b", 1, "x", None), ("z", 1, None, "completed"), ("a", 2, "x", None)],
        [("a", 3, None, "completed"), ("a", 4, "x", None), ("b", 3, None, "failed"), ("b", 4, "x", None), ("b", 5, "x", None), ("c", 5, "y", None), ("c", 6, "w", None)],
        [("b", 7, None, "completed"), ("b", 8, "x", None), ("a", 7, "q", None), ("c", 8, "w", None), ("z", 9, "x", None)],
    ]
    for rows in turns:
        spark.createDataFrame(rows, shape).write.mode("append").parquet(f"{tmp_path}/in")
        run(stateful.tracked(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), tmp_path)  # a new query goes on from the state
    got = {(r.filename, r.at): r.reason for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 1): "new", ("b", 1): "new", ("a", 2): "waiting", ("a", 4): "unchanged", ("b", 4): "retry", ("b", 5): "waiting", ("c", 5): "new", ("c", 6): "changed", ("b", 8): "unchanged", ("a", 7): "changed", ("c", 8): "waiting", ("z", 9): "new"}


def test_waiting_ends_with_its_time(spark, tmp_path):
    shape = "filename string, at long, md5 string, status string"
    stream = None
    for at in (1, 2):
        spark.createDataFrame([("a", at, "x", None)], shape).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.tracked(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), wait_ms=1000)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        for _ in range(60):  # the clock makes batches without end: wait for the row, and longer than its time
            time.sleep(1.5)
            if os.path.isdir(f"{tmp_path}/out") and spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count() == at:
                break
        time.sleep(1.5)
        q.stop()
    assert {r.at: r.reason for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()} == {1: "new", 2: "retry"}


def test_stream_of_files(spark, tmp_path):
    def write(name, text):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)

    told = "filename string, at long, status string"
    for k, (names, outcome) in enumerate([({"in/a.md": "1", "in/b.md": "1", "in/c.md.tmp": "1"}, ("n", 0, "failed")), ({"in/s/a.md": "2", "in/s/b.md": "1"}, ("b.md", 0, "completed"))]):
        for name, text in names.items():
            write(name, text)
        spark.createDataFrame([outcome], told).write.mode("append").parquet(f"{tmp_path}/told")
        run(stateful.synced(inc.new_files(spark, f"{tmp_path}/in"), spark.readStream.schema(told).parquet(f"{tmp_path}/told")), f"{tmp_path}/o")
    got = sorted((r.filename, r.reason) for r in spark.read.parquet(f"{tmp_path}/o/out").collect())
    assert got == [("a.md", "changed"), ("a.md", "new"), ("b.md", "new"), ("b.md", "unchanged")]


def test_scores_at_the_gate(spark, tmp_path):
    def at(day, clock):
        return f"2024-01-0{day} {clock}"

    turns = [
        [(1, at(1, "09:00"), False), (1, at(1, "17:00"), False), (2, at(1, "10:00"), False), (2, at(1, "17:10"), True), (3, at(1, "17:19:59"), False), (1, at(1, "17:20"), False)],
        [(1, at(1, "16:00"), False), (3, at(1, "17:00"), False), (1, at(2, "08:00"), False)],  # late, and then the gate of day 1 is past
        [(3, at(1, "12:00"), False), (1, at(2, "09:00"), False), (1, at(4, "00:00"), False)],  # a row behind the watermark counts for nothing
    ]
    for rows in turns:
        df = spark.createDataFrame(rows, "user_id long, ts string, scored boolean").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stateful.scores_due(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "2 hours", 2), tmp_path)
    got = sorted((r.user_id, str(r.day), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "2024-01-01", 3), (1, "2024-01-02", 2), (3, "2024-01-01", 2)]
