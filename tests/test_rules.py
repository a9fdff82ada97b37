from pyspark.sql import functions as F

from tessera.operators import rules as R


def test_rules(spark):
    logs = spark.createDataFrame([("ok",), ("npm ERR! x",), ("Failed",), (None,)], "o string")
    assert [r.e for r in logs.select(R.has_error(F.col("o")).alias("e")).collect()] == [False, True, False, None]
    files = spark.createDataFrame([("LMS002阿莫西林注射液.xlsx", "d", "有关物质检测"), ("x", "ABC123", "y")], "filename string, folder string, content string")
    got = [(r.project_code, r.product, r.drug, r.detection) for r in R.project_details(files).collect()]
    assert got == [("LMS002", "阿莫西林注射液", "阿莫西林", "有关物质"), ("ABC123", "", "", "")]
    assert spark.range(1).select(R.names_of(F.lit("1:b,2:a")).alias("n")).first()["n"] == ["a", "b"]
    notes = spark.createDataFrame([("k", 1, "pending", "high"), ("k", 3, "done", "high")], "pattern_key string, ts long, status string, priority string")
    assert tuple(R.recurrences(notes).first()) == ("k", 2, 1, 3, 1, 1)


def test_graph_rules(spark):
    nodes = spark.createDataFrame([("a", "alpha beta", "t", "1"), ("b", "f.md)", "t", "1"), ("c", "alpha gamma", "u", "1"), ("d", "de", "u", "2")], "node string, label string, type string, community string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "source string, target string")
    full = nodes.withColumn("source_file", F.lit("x/other.md"))
    assert [(r.node, r.degree) for r in R.god_nodes(full, edges).collect()] == [("c", 3), ("a", 2), ("d", 1)]
    names = {r.community: r.name for r in R.community_labels(nodes.select("node", "label"), nodes.select("node", "community")).collect()}
    assert names == {"1": "alpha beta f.md)", "2": "Community 2"}
    assert R.shortest_path(edges, "a", "d").first()["path"] == ["a", "c", "d"]
    assert R.shortest_path(edges, "a", "z").count() == 0
    kept, left = R.visible(nodes, edges, "alpha")
    assert kept.count() == 2 and [tuple(r) for r in left.collect()] == [("c", "a")] or [tuple(sorted(r)) for r in left.collect()] == [("a", "c")]
