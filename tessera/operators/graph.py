"""Entity graphs: tagging, edges, degrees, communities, paths. Nodes are labels; edges hold source, target, relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut as _cut
from tessera.session import shared_folder, stored


def tags(rows: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    """rows (doc_id, pos, content) -> doc_id, pos, type, label for each (type, label) of words that a row holds.

    The vocabulary is a short literal: one pass, no join.
    """
    wanted = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(w).alias("label")) for t, w in words))
    held = F.filter(wanted, lambda w: F.contains("content", w["label"]))
    return rows.select("doc_id", "pos", F.explode(held).alias("w")).select("doc_id", "pos", "w.type", "w.label")


def pair_edges(found: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """found (doc_id, label) and pairs (source, target, relation) -> edges of pairs both of whose labels a document has."""
    spark = found.sparkSession
    p = F.broadcast(spark.createDataFrame(pairs, "source string, target string, relation string"))
    have = found.select("doc_id", "label").distinct()
    first = have.join(p, have["label"] == p["source"]).select("doc_id", "source", "target", "relation")
    return first.join(have.withColumnRenamed("label", "target"), ["doc_id", "target"]).select("doc_id", "source", "target", "relation")


def together(found: DataFrame, *scope: str) -> DataFrame:
    """found (scope, label) -> source, target, weight: how many scopes (documents, or lines) hold both; source < target.

    The labels of a scope are gathered into a sorted set, bounded by the vocabulary, and paired there: no self-join.
    """
    sets = found.groupBy(*scope).agg(F.array_sort(F.collect_set("label")).alias("ls"))
    pairs = F.flatten(F.transform("ls", lambda a, i: F.transform(F.slice("ls", i + 2, F.size("ls")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """edges (source, target, relation, weight, seq): one a pair, greatest weight, distinct relations joined by | as they came."""
    first = edges.groupBy("source", "target", "relation").agg(F.min("seq").alias("seq"), F.max("weight").alias("weight"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "relation"))), lambda s: s["relation"]), "|")
    return first.groupBy("source", "target").agg(names.alias("relation"), F.max("weight").alias("weight"))


def simple(edges: DataFrame) -> DataFrame:
    """Undirected edges a <= b, one a pair."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree in the simple graph; a self-loop counts twice."""
    return simple(edges).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges["source"] == n["node"], "left_semi").join(n, F.col("target") == n["node"], "left_semi")


def bare_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """membership (node, community) -> community, size, edge_count, cohesion = 2E / n(n-1), 0 for one node."""
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    m = membership.select("node", "community")
    ends = simple(edges).where("a <> b").join(m.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(m.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("edge_count"))
    n, e = F.col("size"), F.coalesce("edge_count", F.lit(0))
    return sizes.join(inside, "community", "left").select("community", "size", e.alias("edge_count"), F.when(n > 1, F.round(2.0 * e / (n * (n - 1)), 4)).otherwise(0.0).alias("cohesion"))


def cross_edges(edges: DataFrame, membership: DataFrame, top_k: int = 20) -> DataFrame:
    """Edges between communities by the sum of their ends' degrees."""
    d = degrees(edges).join(membership, "node")
    a, b = (d.select(F.col("node").alias(x), F.col("degree").alias(f"d{x}"), F.col("community").alias(f"c{x}")) for x in "ab")
    met = simple(edges).join(a, "a").join(b, "b").where("ca <> cb")
    return met.select("a", "b", "ca", "cb", (F.col("da") + F.col("db")).alias("score")).orderBy(F.desc("score"), "a", "b").limit(top_k)


def top_per_community(edges: DataFrame, membership: DataFrame, k: int = 8) -> DataFrame:
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    return membership.join(degrees(edges), "node").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached. Labels spread, then point to their labels' labels."""
    links = simple(edges).where("a <> b")
    both = _cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = _cut(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(label.withColumnsRenamed({"node": "b", "component": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        spread = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("other", "component")).alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = _cut(spread.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        same = new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty()
        label = new
        if same:
            return label


def reach(edges: DataFrame, start: str) -> DataFrame:
    """node, distance: breadth first from start (distance 0), as far as edges lead; start need not be in the graph.

    Each round meets the front's edges alone, and goes on with the ends that no round has seen: what is written is the
    front, and the rounds end with it. A start of the nodes' own type is compared as it is.
    """
    links = simple(edges).where("a <> b")
    both = _cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    front = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("distance"))
    fronts, step = [front], 0
    while True:
        step += 1
        ends = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        for past in fronts[-2:]:  # in an undirected graph an edge leads from a front to itself, to the one before or to the next
            ends = ends.join(past.select("node"), "node", "left_anti")
        front = _cut(ends.withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        fronts.append(front)
    out = fronts[0]
    for front in fronts[1:]:
        out = out.unionByName(front)
    return out


def page_rank(edges: DataFrame, rounds: int = 20, keep: float = 0.85) -> DataFrame:
    """node, rank over the simple graph; ranks sum to one."""
    links = simple(edges).where("a <> b")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = _cut(both.join(both.groupBy("a").agg(F.count("*").alias("out")), "a"))
    nodes = _cut(both.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for step in range(rounds):
        got = both.join(rank, both["a"] == rank["node"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = nodes.join(got, "node", "left").select("node", ((1 - keep) / n + keep * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if step % 5 == 4:
            rank = _cut(rank)
    return rank


def spread_labels(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation: the label most neighbours have, ties to the least.

    Deterministic; a community is a label that nodes ended with. It ends when no label changes, and after `rounds` in any
    case: labels that move at the same time can swap for ever, so more rounds need not lead to a stable state.
    """
    links = simple(edges).where("a <> b")
    both = _cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = _cut(nodes.select("node", F.col("node").alias("community")).distinct())
    for _ in range(rounds):
        own = label.select(F.col("node").alias("a"), "community")
        votes = both.join(label.withColumnsRenamed({"node": "b"}), "b").select("a", "community").unionByName(own)
        counted = votes.groupBy("a", "community").agg(F.count("*").alias("n"))
        best = counted.groupBy("a").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        new = _cut(best.select(F.col("a").alias("node"), "community"))
        if new.join(label.withColumnRenamed("community", "was"), "node").where("community <> was").isEmpty():
            return new
        label = new
    return label


def search_labels(nodes: DataFrame, text: str, top_k: int = 10) -> DataFrame:
    """The first nodes by label whose label holds text, and matches: how many there are in all."""
    held = nodes.where(F.lower("label").contains(text.lower()))
    return held.orderBy("label").limit(top_k).crossJoin(held.agg(F.count("*").alias("matches")))  # top_k rows and one


def gaps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree of nodes with one edge or none."""
    return nodes.select("node").distinct().join(degrees(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")).where("degree <= 1")


def type_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, type) -> type, nodes, mean_degree; a node without edges has degree 0."""
    d = nodes.join(degrees(edges), "node", "left").select("type", F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.groupBy("type").agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 4).alias("mean_degree"))


def community_types(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """nodes (node, type) -> community, type, nodes."""
    return nodes.join(membership, "node").groupBy("community", "type").agg(F.count("*").alias("nodes"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """nodes, edges, mean_degree, max_degree of the simple graph, one row."""
    e = simple(edges).agg(F.count("*").alias("edges"))
    return degrees(edges).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 4).alias("mean_degree"), F.max("degree").alias("max_degree")).crossJoin(e)  # one row each


def entities_by_file(found: DataFrame) -> DataFrame:
    """found (doc_id, label) -> doc_id, entities: distinct labels of each document."""
    return found.groupBy("doc_id").agg(F.count_distinct("label").alias("entities"))


def thin_communities(membership: DataFrame, most: int = 2) -> DataFrame:
    """community, size of communities with at most so many nodes."""
    return membership.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") <= most)


def explain(edges: DataFrame, node: str) -> DataFrame:
    """neighbour, relation, weight, degree: what a node is linked to, and how well linked that is."""
    at = edges.where((F.col("source") == node) | (F.col("target") == node))
    other = at.select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("neighbour"), "relation", "weight")
    return other.join(degrees(edges).withColumnRenamed("node", "neighbour"), "neighbour")


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity, of membership (node, community) over edges (source, target, weight): parallel edges add up."""
    m = membership.select("node", "community")
    e = edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("w"))
    ends = e.join(m.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(m.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    sides = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0).alias("inner"), "w"), F.struct(F.col("cb").alias("c"), F.lit(0).alias("inner"), "w"))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("w").alias("degree"))
    total = F.sum("degree")  # twice the weight of all edges
    return per.agg(F.coalesce(2 * F.sum("inner") / total - resolution * F.sum(F.col("degree") * F.col("degree")) / (total * total), F.lit(0.0)).alias("modularity"))


def _moved(links: DataFrame, label: DataFrame, total: float, resolution: float, half: int) -> DataFrame:
    """One pass of local moves: the nodes of one half (by hash) go to the neighbouring community with the greatest gain."""
    own = label.select(F.col("node").alias("a"), F.col("community").alias("mine"), "degree")
    weight = label.groupBy("community").agg(F.sum("degree").alias("all"))
    near = links.where("a <> b").join(label.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
    stay = own.select("a", F.col("mine").alias("community"), F.lit(0.0).alias("w"))
    options = near.unionByName(stay).groupBy("a", "community").agg(F.sum("w").alias("w")).join(own, "a").join(weight, "community")
    rest = F.when(F.col("community") == F.col("mine"), F.col("all") - F.col("degree")).otherwise(F.col("all"))
    gain = F.round(F.col("w") - resolution * F.col("degree") * rest / total, 9)
    # ties stay where they are, then go to the community with the least hash
    best = options.withColumn("gain", gain).groupBy("a").agg(F.max_by("community", F.struct("gain", (F.col("community") == F.col("mine")).cast("int"), F.bitwise_not(F.xxhash64("community")))).alias("to"))
    turn = F.pmod(F.xxhash64("node"), F.lit(2)) == half
    return label.join(best, label["node"] == best["a"]).select("node", F.when(turn, F.col("to")).otherwise(F.col("community")).alias("community"), "degree")


def louvain(edges: DataFrame, resolution: float = 1.0, passes: int = 10, levels: int = 6, least: float = 1e-6) -> DataFrame:
    """edges (source, target, weight) -> node, community (a node of it), by Louvain's method, without a random order.

    At each level the nodes move in two alternating halves, drawn by a hash, to the neighbouring community with the
    greatest gain of modularity; the best state of a level is kept, its communities become the nodes of the next. It ends
    when a level gains less than `least`, and after `levels` levels of `passes` passes in any case. Every step is a join and an aggregation over the edges; the state is
    checkpointed after each pass. Nodes without an edge to another node are not in the result.
    """
    base = edges.where("source <> target AND source IS NOT NULL AND target IS NOT NULL").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    links = _cut(base.unionByName(base.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    pairs = base.withColumnsRenamed({"a": "source", "b": "target", "w": "weight"})
    total = links.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    member = _cut(links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    if not total:
        return member
    reached = modularity(pairs, member, resolution).first()[0]
    for _ in range(levels):
        label = _cut(links.groupBy("a").agg(F.sum("w").alias("degree")).select(F.col("a").alias("node"), F.col("a").alias("community"), "degree"))
        best, best_at = None, reached
        for step in range(passes):
            label = _cut(_moved(links, label, total, resolution, step % 2))
            new = _cut(member.join(label.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")))
            at = modularity(pairs, new, resolution).first()[0]
            if at > best_at + least:
                best, best_at, kept = new, at, label
            elif step % 2:
                break
        if best is None:
            return member
        member, reached = best, best_at
        to = kept.select("node", "community")
        links = _cut(links.join(to.withColumnsRenamed({"node": "a", "community": "x"}), "a").join(to.withColumnsRenamed({"node": "b", "community": "y"}), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
    return member


def _joining(named: DataFrame, total: float, resolution: float) -> DataFrame:
    """named (a, b, w, gain, second, degree) -> from, to, degree: the members of each new community, its own node `to` among them.

    These are pairs that name each other, and communities that name one of a pair and would still name it, whatever joins
    the pair along with them. The room of such a one is the degree that the others may bring before its second best
    neighbour is as good. Those with more room come first, in cells of a quarter of an octave, so that sums of degrees
    are made of few rows however many name one pair.
    """
    # a pair is one where both sides name it: b is in one if whom it names, c, names it back
    back = named.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("degree").alias("dc"))
    near = named.join(named.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("degree").alias("db")), "b").join(back, "c").where("d = b")
    near = near.select("a", F.least("b", "c").alias("to"), (F.col("a") == F.col("c")).alias("inside"), "w", "second", "degree", (F.col("db") + F.col("dc")).alias("both"))
    couples = near.where("inside").select(F.col("a").alias("from"), "to", "degree")
    room = F.least((F.col("w") - F.col("second")) * total / (resolution * F.col("degree")) - F.col("both"), F.lit(1e300)) if resolution > 0 else F.lit(1e300)
    near = near.where("NOT inside AND degree > 0 AND w > second").withColumn("room", room).where("room > 0").withColumn("cell", F.floor(4 * F.log2("room")))
    sums = near.groupBy("to", "cell").agg(F.sum("degree").alias("more")).select("to", "cell", F.sum("more").over(Window.partitionBy("to").orderBy(F.desc("cell"))).alias("more"))
    firm = near.join(sums, ["to", "cell"]).where(F.col("more") - F.col("degree") < F.col("room"))
    return couples.unionByName(firm.select(F.col("a").alias("from"), "to", "degree"))


def greedy_modularity(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """edges (source, target, weight) -> node, community (a node of it): communities merge as long as modularity gains.

    In each round every community names the neighbour with which a merger gains most (ties by a hash of the pair, then by name), and those
    that name each other merge. Others that name one of such a pair join it, if it stays the best for each of them with all that join:
    so a community that many name takes them in one round, not in as many rounds. Each merger gains by itself and those of separate
    pairs add up, so no round loses; one always has a pair, the one that gains most of all.
    Nodes with one neighbour join it at the start, which never loses at a resolution of one or less. A round is joins and
    aggregations over the edges between communities, which grow fewer; it ends when no merger gains. Its state is written
    over that of the round before the last. Nodes without an edge to another node are not in the result.
    """
    root = shared_folder(edges.sparkSession)
    base = edges.where("source <> target AND source IS NOT NULL AND target IS NOT NULL").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    base = stored(base, f"{root}/base")
    both = lambda df, *more: df.select(F.inline(F.array(F.struct("a", "b", *more), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *more))))
    ends = stored(both(base, "w").groupBy("a").agg(F.sum("w").alias("degree"), F.count("*").alias("n")), f"{root}/ends")
    total = ends.agg(F.coalesce(F.sum("degree"), F.lit(0.0))).first()[0]
    member = ends.select(F.col("a").alias("node"), F.col("a").alias("community"))
    hubs = ends.select(F.col("a").alias("b"), F.col("degree").alias("db"), F.col("n").alias("m"))
    links = base.join(ends.select("a", F.col("degree").alias("da")), "a").join(hubs.drop("m"), "b")  # each once; what is inside a community counts in degrees alone
    order = Window.partitionBy("a").orderBy(F.desc("gain"), F.desc(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))), F.desc(F.least("a", "b")), F.desc(F.greatest("a", "b")))
    step = 0
    while True:
        if step == 0 and resolution <= 1:
            leaves = both(base).join(ends.where("n = 1"), "a").join(hubs, "b")
            moved = leaves.select(F.col("a").alias("from"), F.when(F.col("m") > 1, F.col("b")).otherwise(F.least("a", "b")).alias("to"), "degree")
            moved = moved.unionByName(leaves.where("m > 1").select(F.col("b").alias("from"), F.col("b").alias("to"), F.col("db").alias("degree")).distinct())
        else:
            met = links.withColumn("gain", F.round(F.col("w") - resolution * F.col("da") * F.col("db") / total, 9) if total else F.lit(0.0)).where("gain > 0")
            met = met.select(F.inline(F.array(F.struct("a", "b", "w", "gain", F.col("da").alias("degree")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w", "gain", F.col("db").alias("degree")))))
            two = met.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
            first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
            named = stored(two.groupBy("a").agg(*map(first, ("b", "w", "gain", "degree")), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("gain"))), F.lit(0.0)).alias("second")), f"{root}/named")
            if named.isEmpty():
                return stored(member, f"{root}/found")
            moved = _joining(named, total, resolution)
        moved = moved.join(moved.groupBy("to").agg(F.sum("degree").alias("all")), "to").select("from", "to", "all")
        moved = stored(moved, f"{root}/moved{step % 4}")  # the last four are read until member is written
        step += 1
        for x in "ab":
            links = links.join(moved.withColumnRenamed("from", x), x, "left").withColumns({x: F.coalesce("to", x), f"d{x}": F.coalesce("all", f"d{x}")}).drop("to", "all")
        turn = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)
        links = links.where("a <> b").select(turn("a", "b"), turn("b", "a"), turn("da", "db"), turn("db", "da"), "w")
        links = stored(links.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("da").alias("da"), F.max("db").alias("db")), f"{root}/links{step % 2}")
        member = member.join(moved.select(F.col("from").alias("community"), "to"), "community", "left").select("node", F.coalesce("to", "community").alias("community"))
        member = stored(member, f"{root}/member{step // 4 % 2}") if step % 4 == 0 else member
