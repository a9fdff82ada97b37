"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code.

The 64 bits are three blocks: two of 23 bits, whose anchors are the perfect Golay code (covering radius 3), and one of 18
bits, whose anchors are a perfect Hamming code of 15 bits beside a repetition code of 3 (covering radius 1 each). Two
fingerprints that differ in 4 bits or fewer differ in 2 or fewer on some two of the blocks. Half way between them, on
these blocks, lies a point 1 bit from either; its anchor is within the covering radius plus 1 of both. So each
fingerprint goes, for each two blocks, to every anchor within the covering radius plus 1 (33 to 35 copies), and
fingerprints are compared where they meet: no link is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import mapped, mix, small_batches, tidy
from tessera.llm.common import cut, table
from tessera.llm.components import components

THRESHOLD = 4
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SHINGLE = 4
#: Bytes of text that get fingerprints at a time: the hashes of their shingles take some hundred times as much.
SLICE = 250_000


def fingerprints(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints (unsigned) of whole texts."""
    hashes: list[int] = []
    count = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z alone
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) < _SHINGLE:
            hashes.append(digest(joined, 42))
            count[k] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: 1 - _SHINGLE - 1].tolist()] if len(words) > _SHINGLE else [0]
        hashes += [digest(joined[a:b], 42) for a, b in zip(starts, (ends[_SHINGLE - 1 :] - 1).tolist())]
        count[k] = len(starts)
    h = np.array(hashes, dtype="<u8")
    out = np.zeros(len(texts), dtype=np.uint64)
    ends = np.cumsum(count)
    at = 0
    while at < len(texts):  # a bounded number of shingles at a time, or one text
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, side="right")))
        base = int(ends[at - 1]) if at else 0
        mine, n = h[base : ends[to - 1]], count[at:to]
        if len(mine):
            ones = np.zeros((to - at, 64), dtype=np.int64)
            filled = np.flatnonzero(n)
            bits = np.unpackbits(mine.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[filled] = np.add.reduceat(bits, (np.cumsum(n) - n)[filled], axis=0, dtype=np.int64)
            majority = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
            out[at:to] = majority.copy().view("<u8").ravel()
        at = to
    return out


def _syndromes(units: list[int]) -> np.ndarray:
    table_ = np.zeros(1 << len(units), dtype=np.int64)
    for i, unit in enumerate(units):
        table_[1 << i : 2 << i] = table_[: 1 << i] ^ unit
    return table_


class _Code:
    """A perfect code of n bits: for each syndrome, the errors that lead to anchors within the covering radius plus 1.

    near[s][0] is the one error within the radius; the rest (-1: none) have one bit more.
    """

    def __init__(self, n: int, radius: int, units: list[int]) -> None:
        self.syndrome = _syndromes(units)
        found: dict[int, list[int]] = {s: [] for s in range(int(self.syndrome.max()) + 1)}
        for weight in range(radius + 2):
            for bits in combinations(range(n), weight):
                error = sum(1 << b for b in bits)
                found[int(self.syndrome[error])].append(error)
        widest = max(map(len, found.values()))
        self.near = np.array([v + [-1] * (widest - len(v)) for v in found.values()], dtype=np.int64)

    def anchors(self, x: np.ndarray) -> np.ndarray:
        """A row of anchors for each x: the nearest, then those just outside the radius (-1: none)."""
        errors = self.near[self.syndrome[x]]
        return np.where(errors < 0, -1, errors ^ x[:, None])


def _golay_units() -> list[int]:
    out, value = [], 1
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value >> 11:
            value ^= 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    return out


_CODES: dict[str, _Code] = {}


def _codes() -> dict[str, _Code]:
    if not _CODES:
        _CODES.update(golay=_Code(23, 3, _golay_units()), hamming=_Code(15, 1, list(range(1, 16))), triple=_Code(3, 1, [1, 2, 3]))
    return _CODES


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, fingerprint) of unsigned fingerprints; an anchor is a 64-bit integer that names its two blocks."""
    codes = _codes()
    x = fps.astype(np.uint64)
    low = [(x & np.uint64((1 << 23) - 1)), (x >> np.uint64(23)) & np.uint64((1 << 23) - 1), x >> np.uint64(46)]
    a, b, c = (v.astype(np.int64) for v in low)
    one, two = codes["golay"].anchors(a), codes["golay"].anchors(b)
    three, four = codes["hamming"].anchors(c >> 3), codes["triple"].anchors(c & 7)
    keys, owners = [], []
    for name, parts in enumerate((((one, 23), (two, 23)), ((one, 23), (three, 15), (four, 3)), ((two, 23), (three, 15), (four, 3)))):
        def put(chosen: int, column: int, name: int = name, parts: tuple = parts) -> None:
            key, good = np.full(len(x), name, dtype=np.int64), np.ones(len(x), dtype=bool)
            for k, (part, width) in enumerate(parts):
                own = part[:, column if k == chosen else 0]
                good &= own >= 0
                key = (key << width) | (own & ((1 << width) - 1))
            keys.append(key[good])
            owners.append(x[good])

        put(0, 0)
        for chosen, (part, _) in enumerate(parts):
            for column in range(1, part.shape[1]):
                put(chosen, column)
    return np.concatenate(keys), np.concatenate(owners)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component; nodes 0 to n-1, links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _grow(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one long run: each fingerprint taken up meets those not yet reached."""
    a, b, left = [], [], np.arange(len(run))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(run[left] ^ run[at]) <= THRESHOLD
            fresh = left[near]
            a.append(np.full(len(fresh), at))
            b.append(fresh)
            queue.extend(fresh.tolist())
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def links_of(keys: np.ndarray, fps: np.ndarray, most: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint) that span the components of fingerprints sharing a key; keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(starts, len(keys)))
    short = np.repeat(size <= most, size)
    a, b = [], []
    for step in range(1, int(min(size.max(initial=0), most))):
        same = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
        near = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= THRESHOLD]
        a.append(near)
        b.append(near + step)
    for k in np.flatnonzero(size > most):
        x, y = _grow(fps[starts[k] : starts[k] + size[k]])
        a.append(x + starts[k])
        b.append(y + starts[k])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first, second = np.concatenate(a), np.concatenate(b)
    known, place = np.unique(np.concatenate([fps[first], fps[second]]), return_inverse=True)
    label = roots(len(known), place[: len(first)], place[len(first) :])
    moved = np.flatnonzero(label != np.arange(len(known)))
    return known[moved], known[label[moved]]


def link(distinct: DataFrame, split_over: int = 65_536, listed: int = 10_000) -> DataFrame:
    """distinct fingerprints (fp: long, none null) -> links (u, v: long) whose components are those of all links.

    Fingerprints that meet at one anchor are compared by one task; an anchor with more than about split_over of them
    (estimated from one fingerprint in 64) is split into blocks and its pairs of blocks into tasks of their own. Up to
    `listed` such anchors are sent to the tasks, more are joined in as a table. The estimate bears on the division of
    work alone, never on the links.
    """
    spark = distinct.sparkSession
    small_batches(spark)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = dict(hot.value)
        marked = np.array(sorted(split), dtype=np.int64)
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 50_000):
                keys, fps = anchors(whole[at : at + 50_000])
                hit = np.isin(keys, marked) if len(marked) else np.zeros(len(keys), dtype=bool)
                out = [(keys[~hit], fps[~hit])]
                for key in np.unique(keys[hit]):
                    mine, blocks = fps[keys == key], split[int(key)]
                    own = (mix(mine) % np.uint64(blocks)).astype(np.int64)
                    for other in range(blocks):
                        pair = np.minimum(own, other) * blocks + np.maximum(own, other)
                        out.append((mix(mix(pair) ^ np.uint64(key)).view(np.int64), mine))
                for k, f in out:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f.view(np.int64))], names=["key", "fp"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            keys, _ = anchors(x[mix(x) % np.uint64(64) == 0])
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    counted = distinct.mapInArrow(sampled, "key long").groupBy("key").count().where(F.col("count") >= max(split_over // 64, 2))
    crowded = cut(counted.select("key", (F.ceil(F.col("count") * 64 / split_over) + 1).cast("long").alias("blocks")))
    some = crowded.count() <= listed
    hot = spark.sparkContext.broadcast([(r["key"], r["blocks"]) for r in crowded.collect()] if some else [])

    def by_table(met: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
        both = met.join(crowded, "key", "left")
        return both.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            u, v = links_of(keys, fps)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= 500_000:
                keys, fps = (np.concatenate(x) for x in zip(*held))
                ready = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if ready:
                    yield done(keys[:ready], fps[:ready])
                held, rows = [(keys[ready:], fps[ready:])], len(keys) - ready
        if rows:
            yield done(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        tidy()

    spread_out = distinct.mapInArrow(spread, "key long, fp long")
    met = (spread_out if some else by_table(spread_out)).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(compare, "u long, v long").distinct()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs (text, any other columns) with fp (long: the fingerprint's bits), which replaces a column of that name."""

    def work(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        return {"fp": pa.array(fingerprints(texts).view(np.int64))}

    return mapped(docs, "text", work, "fp long", SLICE)


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp) -> fp, root, component_id, one row a fingerprint: its component's least fingerprint and least doc_id."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(link(nodes.select("fp")))
    linked = joined.join(nodes, joined["node"] == nodes["fp"]).select("node", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("named")), "root").select(F.col("node").alias("fp"), "root", "named")
    # written, so that Spark can split the partition of a fingerprint that very many documents share
    found = nodes.join(named, "fp", "left")
    return cut(found.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id: a row for each row of docs.

    Equal fingerprints are one node, found before anything else; nodes within THRESHOLD bits are linked. component_id
    is the least doc_id of the component. A null or empty text, or one without words, has fingerprint zero and is linked
    like any other. A null doc_id is no candidate for component_id (null if the component has no other); repeated
    rows stay repeated. Only fingerprints are shuffled, never texts.
    """
    rows = cut(fingerprinted(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return rows.join(_grouped(rows), "fp").select("doc_id", "fp", "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: of the rows with the least doc_id (a null one comes last), one.

    Rows are told apart by 128 bits of hashes of all their columns, not by doc_id, so rows that share a doc_id but not a
    text are judged by their texts, and of rows that are equal throughout one stays. Columns stay as they are.
    """
    hashes = {"__one": F.xxhash64(*docs.columns), "__two": F.xxhash64(F.lit(1), *docs.columns)}
    marked = docs.withColumns(hashes)
    rows = cut(fingerprinted(marked.select("doc_id", "text", *hashes)).select("doc_id", "fp", *hashes))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *hashes)
    stay = rows.join(_grouped(rows).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("first")).select("first.__one", "first.__two")
    kept = marked.join(stay, list(hashes), "left_semi").dropDuplicates(list(hashes))
    return kept.select(*docs.columns)
