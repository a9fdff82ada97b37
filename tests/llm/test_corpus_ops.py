"""Collocations, the quality classifier and the divergence audit against brute force, and odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_ops import LOWER, ODD, odd  # noqa: F401

from tessera.llm import collocations, divergence, preference


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# 11


def brute_collocations(rows, least=10, longest=3, top=2000, inside=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\t]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, c in f.items():
        total = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        longer = Counter()
        for k, v in found.items():
            for n in range(2, len(k)):
                for i in range(len(k) - n + 1):
                    longer[k[i : i + n]] = max(longer[k[i : i + n]], v)
        kept = []
        for k, a in found.items():
            if not longer[k] or 100 * longer[k] < inside * a:
                score, cut = min((1_000_000 * a * a // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
                kept.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out |= {(lang, r, p.decode(), -a, left, right, total, -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)}
    return out


NASTY = [("en", "a a a a a a a a a a a a. A\ta  a!b b\nb"), (None, "x y z " * 40), ("en", "x\x00y \x85 z\xa0w " * 30), ("fr", "Été d'été, é " * 20), ("de", ""), ("de", None), ("en", ".,;:!?"), ("fr", "日 本 😀 " * 12), ("en", "New York city. new york City; NEW YORK" * 6)]


@pytest.mark.parametrize("most_cells", [1 << 26, 1 << 16])
def test_collocations_against_brute_force(spark, docs, most_cells, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_CELLS", 1 << 10)
    rows = [(r.lang, r.text) for r in docs.collect()] + NASTY
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = {tuple(r) for r in collocations.collocations(df, most_cells=most_cells).collect()}
    assert got == brute_collocations(rows) and len(got) > 100


def test_collocations_of_other_lengths(spark):
    rows = NASTY + [("en", "the quick brown fox jumps over it ok. " * 12)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    for longest, least, top in ((4, 3, 5), (2, 2, None)):
        got = {tuple(r) for r in collocations.collocations(df, least, longest, top).collect()}
        assert got == brute_collocations(rows, least, longest, top)


def test_sketches_never_undercount(spark, docs, monkeypatch):
    """No n-gram that is frequent is ruled out, whatever the size of the sketches, and few others pass large ones."""
    rows = docs.collect()
    df = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    passed = {}
    for most_cells in (1 << 10, 1 << 22):
        monkeypatch.setattr(collocations, "LEAST_CELLS", min(most_cells, 1 << 16))
        bound = collocations.sketches(df, 10, 3, most_cells).value
        assert len(bound) == 2 and all(len(b) <= most_cells for b in bound)
        true, kept = Counter(), Counter()
        for r in rows:
            words, ids, known = collocations.word_ids([r.text or ""])
            for n, starts, _ in collocations.gram_hashes(r.lang or "und", ids, known, 3):
                true.update((r.lang, b" ".join(words[s : s + n])) for s in starts)
            for n, starts, _ in collocations.frequent(r.lang or "und", ids, known, bound, 10, 3):
                kept.update((r.lang, b" ".join(words[s : s + n])) for s in starts)
        assert all(kept[k] == n for k, n in true.items() if n >= 10)
        passed[most_cells] = len(kept)
    assert passed[1 << 22] < 2 * len([n for n in true.values() if n >= 10]) < passed[1 << 10]


def test_matches_overlap():
    assert collocations.matches(" a a a a \n a b a b a ", ["a", "a a", "a b a", "b", "zz"]).tolist() == [7, 3, 2, 2, 0]


@pytest.mark.parametrize("most_cells", [1 << 12, 1 << 20])
def test_sketches_are_shared_as_bits(docs, most_cells, monkeypatch):
    """What workers get of a sketch is which counters reach the threshold, an eighth of the counters' bytes."""
    monkeypatch.setattr(collocations, "LEAST_CELLS", 1 << 10)
    df = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    assert all(len(b) <= most_cells // 8 and b.any() for b in collocations.sketches(df, 10, 3, most_cells).value)


def test_parcels(docs):
    """Counts come back from their parcels, in far fewer bytes and rows than one a phrase; phrases that begin alike share a part."""
    held = {"en": Counter(), "": Counter({"": 0, "x\x00 y": 1 << 40, "\x85": 3}), "日": Counter({"é 😀 z": 12, "é 😀": 13, "é": 1, "é 😀x": 2, "w" * 70_000 + " b": 5})}
    for r in docs.collect():
        words = (r.text or "").split()
        held["en"].update(w for n in (1, 2, 3) for w in map(" ".join, zip(*[words[k:] for k in range(n)])))
    for parts in (1, 7):
        made, got, part_of = list(collocations.parcels(held, parts)), Counter(), {}
        for part, langs, sizes, phrases, n in made:
            for lang, phrase, k in zip(*[c.to_pylist() for c in collocations.unpacked(langs, sizes, memoryview(phrases), memoryview(n)).columns]):
                assert (lang, phrase) not in got
                got[lang, phrase] = k
                assert part_of.setdefault((lang, *phrase.split(" ")[:2]), part) == part
        assert got == {(lang, p): k for lang, own in held.items() for p, k in own.items()} and len(made) == len({m[0] for m in made}) == parts
        # half of the phrases' bytes alone, without their counts and a row's fixed part
        assert sum(len(m[3]) + len(m[4]) for m in made) < sum(len(p.encode()) for own in held.values() for p in own) / 2


def test_collocations_odd(odd):  # noqa: F811
    got = collocations.collocations(odd).collect()
    assert {(r.lang, r.phrase) for r in got if r["rank"] == 1} == {tuple(x[:1] + x[2:3]) for x in brute_collocations([(g, t) for _, t, g, _ in ODD]) if x[1] == 1}
    assert collocations.collocations(odd.limit(0)).count() == 0


# 12


def test_quality_rank_on_held_out(spark, docs):
    rows = preference.op12_quality_rank(spark, SMALL).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in preference.op12_quality_rank(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    good, bad = [r.score for r in held if label[r.doc_id]], [r.score for r in held if not label[r.doc_id]]
    assert sum(x > y for x in good for y in bad) >= 0.97 * len(good) * len(bad)


def brute_shares(text):
    kinds = [int(preference._class_of()[ord(c)]) for c in text]
    single, double = Counter(kinds), Counter(zip(kinds, kinds[1:]))
    n = max(len(text), 1)
    return [single[k] / n for k in range(14)], [double[a, b] / n for a in range(14) for b in range(14)]


def test_quality_features():
    texts = ["", "Hello, World! 12 é", "a a a b\na a a b\n\nc", "日本語 😀 x", "  \n\t ", "x" * 50_000]
    got = preference.features(texts)
    assert got.shape == (6, preference.DIM) and not got[0].any()
    for row, text in zip(got, texts):
        single, double = brute_shares(text)
        assert np.allclose(row[:14], single, atol=1e-6) and np.allclose(row[14 : 14 + 196], double, atol=1e-6)
        alone = preference.features([text])[0]
        assert (alone == row).all()  # no other text matters
    shape = got[2, -9:]
    assert np.allclose(shape, [np.log1p(18), np.log1p(9), 1, 3 / 9, 6 / 9, 4 / 9, 2 / 3, np.log1p(3), np.log1p(3)], atol=1e-5)


def test_bradley_terry_recovers_an_order():
    draw = np.random.default_rng(3)
    x, truth = draw.normal(size=(300, 6)), np.array([2.0, -1.0, 0.5, 0, 0, 0])
    good, bad = x[x @ truth > 0], x[x @ truth <= 0]
    for pairs in (10**6, 4000):
        w = preference.bradley_terry(good, bad, pairs)
        assert np.corrcoef(w, truth)[0, 1] > 0.97
    # at the minimum the loss is no greater than a little aside, by the plain sum over all pairs
    w = preference.bradley_terry(good, bad, 10**6, decay=0.05, rounds=2000)

    def loss(v):
        return np.log1p(np.exp(-((good @ v)[:, None] - (bad @ v)[None, :]))).mean() + 0.025 * v @ v

    assert all(loss(w) <= loss(w + step) + 1e-9 for step in 0.05 * np.vstack([np.eye(6), -np.eye(6)]))


def test_quality_threshold_is_a_quantile():
    raw = np.arange(10.0)
    assert preference.threshold(raw, np.ones(10), 0.3) == 2.5
    assert preference.threshold(raw, np.where(raw < 5, 1.0, 3.0), 0.25) == 4.5
    assert preference.threshold(np.array([1.0, 1.0]), np.ones(2), 0.5) == 1.0


def test_quality_odd(spark, docs, odd):  # noqa: F811
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = preference.fit(docs, labels.withColumn("x", F.lit(1)).union(labels.limit(1).select(F.lit(None), "quality", "toxic", F.lit(1))))
    rows = preference.rank(odd.withColumn("predicted", F.lit("clash")), model).collect()
    assert len(rows) == len(ODD) and rows[0].score == rows[1].score and 0 <= rows[0].score <= 1  # null as empty
    assert preference.rank(odd.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        nothing = preference.fit(docs, few)
        assert {(r.score, r.predicted) for r in preference.rank(odd, nothing).collect()} == {(0.5, 0)}
    again = preference.fit(docs.union(docs), labels.union(labels), per_label=50)
    assert preference.rank(odd, again).count() == len(ODD)


# 13


def brute_divergence(rows, least):
    n, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        n[lang, source].update(words)
        seen[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in seen[lang].items() if d >= least]
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}

        def chances(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: chances(n[lang, s]) for s in sources}, chances(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(sorted(term)[:50], 1)}
    return out


@pytest.mark.parametrize("block", [48, 1])
def test_divergence_against_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(divergence, "_BLOCK", block)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()] + [(None, "s", None), ("en", None, "The the THE É"), ("xx", "a", "alone"), ("xx", "b", ""), ("yy", "ß", "é e"), ("en", "src1", "x1y_z’w")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).repartition(4)
    for least in (5, 30):
        got = [tuple(r) for r in divergence.divergence(df, least).collect()]
        want = brute_divergence(rows, least)
        assert len(got) == len(want) and set(got) == want


def test_divergence_odd(spark, odd):  # noqa: F811
    got = {tuple(r) for r in divergence.divergence(odd, 1).collect()}
    assert got == brute_divergence([(g, s, t) for _, t, g, s in ODD], 1)
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_chance_is_exact(spark):
    n, total, terms = 9 * 10**17 + 7, 3 * 10**18 + 1, 10**6 + 3
    row = spark.range(1).select(divergence.chance(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_quality_learns_from_all_rows(spark):
    """Rows beyond per_label teach: what tells good from bad in all rows is learned from groups of twenty rows a label."""
    from pyspark.sql import functions as F

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("calm words "), F.col("id"))).otherwise(F.concat(F.lit("### $$$ "), F.col("id"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    once = preference.fit(docs, labels, per_label=20)
    # all labels turned but those of the 60 first by hash, among which a sample of 20 a label would lie
    first = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(first), F.col("quality")).otherwise(1 - F.col("quality")))
    other = preference.fit(docs, turned, per_label=20)
    good, bad = preference.features(["calm words 7", "### $$$ 7"])
    assert (good - bad) @ once.weight > 0 > (good - bad) @ other.weight
    rows = preference.rank(docs, once).join(labels, "doc_id")
    assert rows.where("predicted <> quality").count() <= 4
    assert rows.where("predicted = 1").count() in range(196, 205)


def test_quality_features_meet_labels_without_texts(spark, docs, monkeypatch):
    """Features come straight from the texts: no join, and so no shuffle of texts, lies below them; duplicates pair as before."""
    plans, real = [], preference.mapped

    def spy(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(preference, "mapped", spy)
    model = preference.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert len(model.weight) == preference.DIM and plans and not any("Join" in p for p in plans)
