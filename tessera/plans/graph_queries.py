"""Entity graphs over the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import elements as E
from tessera.operators import graph as G
from tessera.operators import relations as R
from tessera.operators import rules as X
from tessera.plans.common import LINES, documents, table

#: A vocabulary of typed labels that occur in the synthetic texts, and pairs with a relation.
WORDS = [
    ("noun", "thanedble"), ("noun", "attion"), ("noun", "erhast"), ("noun", "ingwh"), ("verb", "ereation"), ("verb", "onthsh"), ("noun", "ciónes"), ("noun", "ciónmi"), ("verb", "arboja"),
    ("noun", "heitß"), ("noun", "keiten"), ("verb", "enbepf"), ("noun", "eauaux"), ("verb", "ellean"), ("noun", "ouelle"), ("noun", "thtion"), ("verb", "zzzzzz"),
]
PAIRS = [("thanedble", "attion", "precedes"), ("attion", "erhast", "meets"), ("ciónes", "ciónmi", "meets"), ("keiten", "heitß", "meets"), ("eauaux", "ouelle", "precedes"), ("thtion", "attion", "holds"), ("erhast", "zzzzzz", "meets")]


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tags(E.elements(documents(spark, sf_dir)), WORDS)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.together(_tags(spark, sf_dir), "doc_id").withColumn("relation", F.lit("related_to"))


def _membership(spark: SparkSession) -> DataFrame:
    """Communities of the labels: one a type (a given partition, so that results can be compared)."""
    return spark.createDataFrame([(w, t) for t, w in WORDS], "node string, community string")


def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir)


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_edges(_tags(spark, sf_dir), PAIRS)


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels by the number of lines of ten characters or more that hold both."""
    lines = E.elements(documents(spark, sf_dir)).where(F.char_length("content") >= 10)
    return G.together(G.tags(lines, WORDS), "doc_id", "pos")


def comention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all documents, for each pair and relation the first document's."""
    from tessera.operators.index import first_rows

    return first_rows(G.pair_edges(_tags(spark, sf_dir), PAIRS), ["source", "target", "relation"], "doc_id")


def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = G.pair_edges(_tags(spark, sf_dir), PAIRS).select("source", "target", "relation", F.lit(1.0).alias("weight"), F.col("doc_id").alias("seq"))
    both = pairs.unionByName(_edges(spark, sf_dir).select("source", "target", "relation", (F.col("weight") / 10).alias("weight"), F.lit(-1).cast("long").alias("seq")))
    return G.merged_edges(both)


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_edges(_tags(spark, sf_dir), PAIRS).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cohesion(_edges(spark, sf_dir), _membership(spark))


def cross_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cross_edges(_edges(spark, sf_dir), _membership(spark))


def community_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_per_community(_edges(spark, sf_dir), _membership(spark), 3)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_edges(spark, sf_dir).where("weight > 2"), _membership(spark))


def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(_edges(spark, sf_dir).where("weight > 2"), "attion")


def _order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes, each linked to its customer's next by key."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select("o_custkey", F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(w).alias("target")).where("target IS NOT NULL")


def _busiest(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last order of the customer with the most orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    row = o.orderBy(F.desc("n"), "o_custkey").head()
    return row["first"], row["last"]


def order_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps the orders of the busiest customer are from the first: a chain, as long as there are orders."""
    return G.reach(_order_chain(spark, sf_dir), _busiest(spark, sf_dir)[0])


def order_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from that customer's first order to the last."""
    first, last = _busiest(spark, sf_dir)
    return X.shortest_path(_order_chain(spark, sf_dir), first, last).select(F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_rank(_edges(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spread_labels(_edges(spark, sf_dir).where("weight > 2"), _membership(spark))


def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gaps(_edges(spark, sf_dir).where("weight > 2"), _membership(spark))


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends are among the nouns."""
    nouns = _membership(spark).where("community = 'noun'")
    return G.with_known_ends(_edges(spark, sf_dir), nouns).select("source", "target", "weight")


def graph_label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _tags(spark, sf_dir).select("type", "label").distinct()
    return G.search_labels(nodes, "TI")


def typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every noun of a document with every verb of it."""
    return R.typed_pairs(_tags(spark, sf_dir), "noun", "verb", "has_action")


def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _membership(spark).select("node", F.col("node").alias("label"), F.when(F.col("node") == "attion", "x/attion.md").otherwise("x/y.md").alias("source_file"))
    return X.god_nodes(nodes, _edges(spark, sf_dir), 5)


def community_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the types of the labels that the documents hold, from their words."""
    nodes = _tags(spark, sf_dir).select(F.col("label").alias("node"), F.col("type").alias("community")).distinct()
    return X.community_labels(nodes.select("node", F.concat_ws(" ", "node", "community").alias("label")), nodes)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.shortest_path(_edges(spark, sf_dir).where("weight > 2"), "attion", "thtion").select(F.array_join("path", ">").alias("path"))


def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by type, and the mean of their degrees."""
    return G.type_summary(_membership(spark).withColumnRenamed("community", "type"), _edges(spark, sf_dir))


def community_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each component of the strong edges by type."""
    nodes = _membership(spark)
    parts = G.components(_edges(spark, sf_dir).where("weight > 2"), nodes).withColumnRenamed("component", "community")
    return G.community_types(nodes.withColumnRenamed("community", "type"), parts)


def thin_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = G.components(_edges(spark, sf_dir).where("weight > 2"), _membership(spark))
    return G.thin_communities(parts.withColumnRenamed("component", "community"))


def degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_summary(_edges(spark, sf_dir))


def entities_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entities_by_file(_tags(spark, sf_dir))


def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.explain(_edges(spark, sf_dir), "attion")


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labels' types as communities, edges by weight."""
    return G.modularity(_edges(spark, sf_dir), _membership(spark)).select(F.round("modularity", 6).alias("modularity"))


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.louvain(_edges(spark, sf_dir))


def greedy_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of suppliers by mergers: two are linked as often as orders have lines of both."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("label"))
    return G.greedy_modularity(G.together(li, "l_orderkey"))


def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of edges by confidence, which here is their weight."""
    return R.confidence_report(_judged(spark, sf_dir))


def weak_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weak_nodes(_judged(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("weight")
    return _edges(spark, sf_dir).withColumn("confidence", F.when(w > 5, "EXTRACTED").when(w > 1, "INFERRED").otherwise("AMBIGUOUS")).withColumn("confidence_score", w / 8)


def bare_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that are not among the nouns."""
    return G.bare_nodes(_edges(spark, sf_dir), _membership(spark).where("community = 'noun'"))


def visible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nouns with an e."""
    nodes = _membership(spark).select("node", F.col("node").alias("label"), F.col("community").alias("type"), "community")
    return X.visible(nodes, _edges(spark, sf_dir), "E", "noun")[1].select("source", "target", "weight")


QUERIES = {f.__name__: f for f in (entity_tags, entity_edges, cooccurrence, comention, edge_dedup, edge_merge, relation_counts, degree, cohesion, cross_community, community_top, connected_components, graph_reach, order_reach, order_path, page_rank, label_communities, knowledge_gaps, dangling_edges, graph_label_search, typed_pairs, god_nodes, community_names, shortest_path, nodes_by_type, community_types, thin_communities, degree_summary, entities_by_file, explain_node, modularity, louvain, greedy_communities, edge_confidence, weak_nodes, bare_nodes, visible_graph)}

_V = "v(type, label) AS (VALUES " + ", ".join(f"('{t}', '{w}')" for t, w in WORDS) + ")"
_P = "p(source, target, relation) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{r}')" for a, b, r in PAIRS) + ")"
_T = f"{LINES}, {_V}, t AS (SELECT doc_id, pos, type, label, content FROM e JOIN v ON contains(content, label))"
_H = "h AS (SELECT DISTINCT doc_id, label FROM t), g AS (SELECT a.label AS source, b.label AS target, count(*) AS weight FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.label < b.label GROUP BY 1, 2)"
_E = f"{_T}, {_P}, {_H}, x AS (SELECT a.doc_id, source, target, relation FROM p JOIN h a ON a.label = source JOIN h b ON b.label = target AND a.doc_id = b.doc_id)"
_D = "d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM g UNION ALL SELECT target FROM g) GROUP BY 1)"
_BUSY = "busy AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 1)"
_STRONG = "s AS (SELECT source AS a, target AS b FROM g WHERE weight > 2 UNION SELECT target, source FROM g WHERE weight > 2)"

SQL = {
    "entity_tags": f"WITH {_T} SELECT doc_id, CAST(pos AS INTEGER) AS pos, type, label FROM t",
    "entity_edges": f"WITH {_E} SELECT * FROM x",
    "cooccurrence": f"WITH {_T} SELECT a.label AS source, b.label AS target, count(*) AS weight FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.label < b.label WHERE length(a.content) >= 10 GROUP BY 1, 2",
    "comention": f"WITH {_T}, {_H} SELECT *, 'related_to' AS relation FROM g",
    "edge_dedup": f"WITH {_E} SELECT source, target, relation, min(doc_id) AS doc_id FROM x GROUP BY 1, 2, 3",
    "edge_merge": f"""WITH {_E}, y AS (SELECT source, target, relation, 1.0::DOUBLE AS weight, doc_id AS seq FROM x UNION ALL SELECT source, target, 'related_to', weight / 10.0::DOUBLE, -1 FROM g),
f AS (SELECT source, target, relation, min(seq) AS seq, max(weight) AS weight FROM y GROUP BY 1, 2, 3) SELECT source, target, string_agg(relation, '|' ORDER BY seq, relation) AS relation, max(weight) AS weight FROM f GROUP BY 1, 2""",
    "relation_counts": f"WITH {_E} SELECT relation, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1",
    "degree": f"WITH {_T}, {_H}, {_D} SELECT * FROM d",
    "cohesion": f"""WITH {_T}, {_H}, n AS (SELECT type AS community, count(*) AS size FROM v GROUP BY 1), i AS (SELECT a.type AS community, count(*) AS edge_count FROM g JOIN v a ON a.label = source JOIN v b ON b.label = target WHERE a.type = b.type GROUP BY 1)
SELECT community, size, coalesce(edge_count, 0) AS edge_count, CASE WHEN size > 1 THEN round(2.0::DOUBLE * coalesce(edge_count, 0) / (size * (size - 1)), 4) ELSE 0.0 END AS cohesion FROM n LEFT JOIN i USING (community)""",
    "cross_community": f"""WITH {_T}, {_H}, {_D} SELECT source AS a, target AS b, x.type AS ca, y.type AS cb, dx.degree + dy.degree AS score FROM g JOIN v x ON x.label = source JOIN v y ON y.label = target JOIN d dx ON dx.node = source JOIN d dy ON dy.node = target
WHERE x.type <> y.type ORDER BY score DESC, a, b LIMIT 20""",
    "community_top": f"WITH {_T}, {_H}, {_D}, r AS (SELECT node, type AS community, degree, CAST(row_number() OVER (PARTITION BY type ORDER BY degree DESC, node) AS INTEGER) AS rank FROM d JOIN v ON label = node) SELECT * FROM r WHERE rank <= 3",
    "connected_components": f"WITH RECURSIVE {_T}, {_H}, {_STRONG}, c(node, other) AS (SELECT label, label FROM v UNION SELECT c.node, s.b FROM c JOIN s ON s.a = c.other) SELECT node, min(other) AS component FROM c GROUP BY 1",
    "graph_reach": f"WITH RECURSIVE {_T}, {_H}, {_STRONG}, c(node, distance) AS (SELECT 'attion', 0 UNION SELECT s.b, c.distance + 1 FROM c JOIN s ON s.a = c.node WHERE c.distance < (SELECT count(*) FROM v)) SELECT node, min(distance) AS distance FROM c GROUP BY 1",
    "order_reach": f"WITH {_BUSY} SELECT o_orderkey AS node, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS distance FROM orders WHERE o_custkey = (SELECT o_custkey FROM busy)",
    "order_path": f"WITH {_BUSY} SELECT string_agg(o_orderkey, '>' ORDER BY o_orderkey) AS path FROM orders WHERE o_custkey = (SELECT o_custkey FROM busy)",
    "knowledge_gaps": f"WITH {_T}, {_H}, {_STRONG}, k AS (SELECT a AS node, count(*) AS degree FROM s GROUP BY 1) SELECT label AS node, coalesce(degree, 0) AS degree FROM v LEFT JOIN k ON node = label WHERE coalesce(degree, 0) <= 1",
    "dangling_edges": f"WITH {_T}, {_H} SELECT g.* FROM g JOIN v a ON a.label = source AND a.type = 'noun' JOIN v b ON b.label = target AND b.type = 'noun'",
    "typed_pairs": f"WITH {_T}, h AS (SELECT DISTINCT doc_id, type, label FROM t) SELECT a.doc_id, a.label AS source, b.label AS target, 'has_action' AS relation FROM h a JOIN h b ON a.doc_id = b.doc_id WHERE a.type = 'noun' AND b.type = 'verb'",
    "god_nodes": f"WITH {_T}, {_H}, {_D} SELECT node, node AS label, degree FROM d WHERE node <> 'attion' ORDER BY degree DESC, node LIMIT 5",
    "graph_label_search": f"WITH {_T}, m AS (SELECT DISTINCT type, label FROM t WHERE contains(lower(label), 'ti')) SELECT type, label, (SELECT count(*) FROM m) AS matches FROM m ORDER BY label LIMIT 10",
    "page_rank": f"""WITH RECURSIVE {_T}, {_H}, b AS (SELECT source AS a, target AS b FROM g UNION SELECT target, source FROM g), o AS (SELECT a, count(*) AS out FROM b GROUP BY 1), k AS (SELECT count(*) AS n FROM o),
r(step, node, rank) AS (SELECT 0, a, 1.0::DOUBLE / n FROM o, k UNION ALL SELECT any_value(r.step) + 1, b.b, 0.15::DOUBLE / any_value(k.n) + 0.85::DOUBLE * sum(r.rank / o.out) FROM r JOIN b ON b.a = r.node JOIN o ON o.a = r.node, k WHERE r.step < 20 GROUP BY b.b)
SELECT node, round(rank, 6) AS rank FROM r WHERE step = 20""",
    "label_communities": f"""WITH RECURSIVE {_T}, {_H}, {_STRONG}, lc(step, node, community) AS (SELECT 0, label, label FROM v UNION ALL
SELECT step + 1, node, community FROM (SELECT step, node, community, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS k FROM (SELECT any_value(step) AS step, node, community, count(*) AS n FROM
  (SELECT lc.step, s.a AS node, lc.community FROM lc JOIN s ON s.b = lc.node UNION ALL SELECT lc.step, lc.node, lc.community FROM lc) WHERE step < 10 GROUP BY node, community)) WHERE k = 1)
SELECT node, community FROM lc WHERE step = 10""",
    "community_names": f"""WITH {_T}, m AS (SELECT label AS node, type AS community, row_number() OVER (PARTITION BY type ORDER BY label) AS n FROM (SELECT DISTINCT type, label FROM t)), w AS (SELECT community, n, 0 AS p, node AS w FROM m WHERE n <= 10 UNION ALL SELECT community, n, 1, community FROM m WHERE n <= 10),
c AS (SELECT community, w, count(*) AS c, min(n * 10 + p) AS f FROM w WHERE length(w) >= 3 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY c DESC, f) AS k FROM c)
SELECT community, left(string_agg(w, ' ' ORDER BY k), 40) AS name FROM k WHERE k <= 3 GROUP BY 1""",
    "shortest_path": f"""WITH RECURSIVE {_T}, {_H}, {_STRONG}, c(node, distance) AS (SELECT 'attion', 0 UNION SELECT s.b, c.distance + 1 FROM c JOIN s ON s.a = c.node WHERE c.distance < (SELECT count(*) FROM v)), d AS (SELECT node, min(distance) AS distance FROM c GROUP BY 1),
p(node, path) AS (SELECT 'attion', ['attion'] UNION ALL SELECT s.b, list_append(p.path, s.b) FROM p JOIN s ON s.a = p.node JOIN d ON d.node = s.b AND d.distance = len(p.path))
SELECT array_to_string(min(path), '>') AS path FROM p WHERE node = 'thtion' HAVING count(*) > 0""",
    "nodes_by_type": f"WITH {_T}, {_H}, {_D} SELECT type, count(*) AS nodes, round(avg(coalesce(degree, 0)), 4) AS mean_degree FROM v LEFT JOIN d ON node = label GROUP BY 1",
    "community_types": f"WITH RECURSIVE {_T}, {_H}, {_STRONG}, c(node, other) AS (SELECT label, label FROM v UNION SELECT c.node, s.b FROM c JOIN s ON s.a = c.other), k AS (SELECT node, min(other) AS community FROM c GROUP BY 1) SELECT community, type, count(*) AS nodes FROM k JOIN v ON label = node GROUP BY 1, 2",
    "thin_communities": f"WITH RECURSIVE {_T}, {_H}, {_STRONG}, c(node, other) AS (SELECT label, label FROM v UNION SELECT c.node, s.b FROM c JOIN s ON s.a = c.other), k AS (SELECT node, min(other) AS community FROM c GROUP BY 1) SELECT community, count(*) AS size FROM k GROUP BY 1 HAVING count(*) <= 2",
    "degree_summary": f"WITH {_T}, {_H}, {_D} SELECT count(*) AS nodes, (SELECT count(*) FROM g) AS edges, round(avg(degree), 4) AS mean_degree, max(degree) AS max_degree FROM d",
    "entities_by_file": f"WITH {_T} SELECT doc_id, count(DISTINCT label) AS entities FROM t GROUP BY 1",
    "explain_node": f"WITH {_T}, {_H}, {_D} SELECT CASE WHEN source = 'attion' THEN target ELSE source END AS neighbour, 'related_to' AS relation, weight, degree FROM g JOIN d ON node = CASE WHEN source = 'attion' THEN target ELSE source END WHERE source = 'attion' OR target = 'attion'",
    "modularity": f"""WITH {_T}, {_H}, s AS (SELECT a.type AS c, CASE WHEN a.type = b.type THEN weight ELSE 0 END AS inner_, weight AS w FROM g JOIN v a ON a.label = source JOIN v b ON b.label = target UNION ALL SELECT b.type, 0, weight FROM g JOIN v b ON b.label = target),
p AS (SELECT c, sum(inner_) AS i, sum(w) AS d FROM s GROUP BY 1), t2 AS (SELECT sum(d) AS t FROM p) SELECT round(2.0::DOUBLE * sum(i) / any_value(t) - sum(CAST(d AS DOUBLE) * d) / (CAST(any_value(t) AS DOUBLE) * any_value(t)), 6) AS modularity FROM p, t2""",
    "edge_confidence": f"""WITH {_T}, {_H} SELECT count(*) AS edges, round(count(*) FILTER (WHERE weight > 5) / count(*), 4) AS extracted, round(count(*) FILTER (WHERE weight BETWEEN 2 AND 5) / count(*), 4) AS inferred, round(count(*) FILTER (WHERE weight = 1) / count(*), 4) AS ambiguous,
  round(avg(weight / 8) FILTER (WHERE weight BETWEEN 2 AND 5), 4) AS inferred_score FROM g""",
    "weak_nodes": f"WITH {_T}, {_H} SELECT node, count(*) AS inferred FROM (SELECT source AS node FROM g WHERE weight BETWEEN 2 AND 5 UNION ALL SELECT target FROM g WHERE weight BETWEEN 2 AND 5) GROUP BY 1",
    "bare_nodes": f"WITH {_T}, {_H}, {_D} SELECT node FROM d WHERE node NOT IN (SELECT label FROM v WHERE type = 'noun')",
    "visible_graph": f"WITH {_T}, {_H} SELECT g.* FROM g JOIN v a ON a.label = source JOIN v b ON b.label = target WHERE a.type = 'noun' AND b.type = 'noun' AND contains(source, 'e') AND contains(target, 'e')",
}
