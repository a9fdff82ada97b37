"""Language-model scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

log P(word | history) = log P(group | history) + log P(class | group, history) + log P(word | class). The first two
factors are softmaxes over WIDTH groups and over the WIDTH classes of a group, with weights of hashed features of the
history (and the group); the third is the word's share of its class in the training texts. Frequent words have a class
each, so history tells them apart. Weights are learned by distributed gradient updates: in each round every shard of
the texts moves a copy of the weights along its gradients, and the copies' moves are averaged by their numbers of tokens.
Shards are drawn by a hash of doc_id and hold about SHARD tokens, however the texts are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import Numbers, mix, slices, small_batches, sums
from tessera.llm.common import BETWEEN, crc_bucket, cut, table, text_of

#: Groups, and classes of a group.
WIDTH = 24
CLASSES = WIDTH * WIDTH
#: The end, OWN frequent words with a class each, and ENDINGS classes of words by their last two characters.
ENDINGS = CLASSES // 2
OWN = CLASSES - 1 - ENDINGS
#: Rows of the weight table (features are hashed into it) at least and at most; distinct training words a row in between.
LEAST_ROWS, MOST_ROWS, WORDS_A_ROW = 1 << 14, 1 << 16, 8
#: Features of a history, rows of a block of weights.
FEATURES, BLOCK = 4, 256
ROUNDS, RATE, BATCH = 3, 0.15, 8192
#: Rows that are updated or scored at a time, and rows of a run that are added up at once; no result depends on them.
FEW, FOLD = 1024, 32
#: Scores below this in size need no shift before exp() in single precision.
LARGE = 60
_ONES = np.ones(WIDTH, dtype=np.float32)
_SLICE = 1_000_000
#: Words that a task remembers from slice to slice; no result depends on it.
MOST_MET = 1 << 17
#: Training tokens of a shard, and shards whose moves are summed up in one step.
SHARD, STEP = 1_000_000, 64
_END, _BEFORE = 0x51ED270B1B0E25A1, 0x2545F4914F6CDD1D


def table_rows(distinct: int) -> int:
    """Rows of the weight table for so many distinct training words: a power of two. Every worker holds the table, so it has a bound."""
    return min(max(1 << (-(-distinct // WORDS_A_ROW) - 1).bit_length() if distinct else 0, LEAST_ROWS), MOST_ROWS)


def ending_class(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.right(word, F.lit(2))), F.lit(ENDINGS)).cast("int") + 1 + OWN


class _Endings(dict):
    """The class of each ending, worked out when it is first asked for."""

    def __missing__(self, end: str) -> int:
        h = xxhash.xxh64_intdigest(end.encode("utf-8", "surrogatepass"), 42)
        self[end] = kind = ((h - (1 << 64)) if h >> 63 else h) % ENDINGS + 1 + OWN
        return kind


@dataclass
class Counts:
    """What the base score and the second factor need: totals, class totals, and the most frequent words' counts."""

    total: int
    distinct: int
    ends: int
    own: dict[str, int]
    class_total: np.ndarray
    class_distinct: np.ndarray
    hashes: np.ndarray
    words: pa.Array
    count: np.ndarray
    endings: _Endings = field(default_factory=_Endings)

    def look_up(self, words: list[str], hashes: np.ndarray) -> np.ndarray:
        """Each word's count, or -1 where it is not among the most frequent. Hashes find, texts decide."""
        out = np.full(len(words), -1, dtype=np.int64)
        if len(self.hashes) and words:
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            same = pc.equal(self.words.take(pa.array(at[hit])), pa.array([words[i] for i in hit], type=pa.string()))
            hit = hit[same.to_numpy(zero_copy_only=False)]
            out[hit] = self.count[at[hit]]
        return out

    def classes(self, words: list[str]) -> np.ndarray:
        if len(self.endings) > MOST_MET:
            self.endings.clear()
        out = np.fromiter(map(self.endings.__getitem__, [w[-2:] for w in words]), dtype=np.int64, count=len(words))
        for k in [k for k, w in enumerate(words) if w in self.own]:
            out[k] = self.own[words[k]]
        return out


def _hash(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def count(training: DataFrame, most: int) -> tuple[Counts, DataFrame]:
    """Counts of all training texts, and the whole table word, count (written to the shared folder).

    At most `most` words, the most frequent, come to the driver and are broadcast; the table serves the rest.
    """
    spark = training.sparkSession
    text = text_of()
    # lower() is the faster one, and changes A-Z alone where there is nothing but ASCII
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = training.select(F.explode(F.split(lower, BETWEEN)).alias("word")).where("word <> ''")
    counted = cut(words.groupBy("word").count())
    ends = training.count()
    own = {r["word"]: k + 1 for k, r in enumerate(counted.orderBy(F.desc("count"), "word").limit(OWN).collect())}
    listed = spark.createDataFrame(list(own.items()), "word string, own int")
    of = F.coalesce("own", ending_class(F.col("word")))
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    class_total[0], class_distinct[0] = ends, bool(ends)
    for r in counted.join(F.broadcast(listed), "word", "left").groupBy(of.alias("k")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect():
        class_total[r["k"]], class_distinct[r["k"]] = r["n"], r["v"]
    level = F.floor(F.log2("count") * 16).cast("int")
    room, least = most, 1 << 30
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    common = counted.where(level >= least).toArrow()
    listed = common.column("word").to_pylist()
    hashes = _hash(listed)
    order = np.argsort(hashes, kind="stable")
    known = pa.array(listed, type=pa.string()).take(pa.array(order))
    n = common.column("count").to_numpy().astype(np.int64)[order]
    return Counts(int(class_total.sum()), int(class_distinct.sum()), ends, own, class_total, class_distinct, hashes[order], known, n), counted


class Met:
    """The words of a task's slices so far, each with its hash, class and (with_counts) count; number 0 is the end.

    Most words of a slice were in the slices before it. Beyond MOST_MET words the next slice begins anew.
    """

    def __init__(self, counts: Counts, with_counts: bool = False) -> None:
        self.counts, self.with_counts = counts, with_counts
        self.begin()

    def begin(self) -> None:
        self.numbers, self.words = Numbers({b"": 0}), [""]
        self.hashes, self.kind = np.array([_END], dtype=np.uint64), np.zeros(1, dtype=np.int64)
        self.count = np.array([self.counts.ends], dtype=np.int64)

    def numbered(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's words."""
        if len(self.words) > MOST_MET:
            self.begin()
        number = self.numbers.__getitem__
        # bytes.lower() changes A-Z alone, and bytes.split() cuts at the white space of WORD
        each = [list(map(number, t.encode("utf-8", "surrogatepass").lower().split())) for t in texts]
        new = list(islice(reversed(self.numbers), len(self.numbers) - len(self.words)))[::-1]
        words = b"\n".join(new).decode("utf-8", "surrogatepass").split("\n") if new else []  # no word holds a line feed
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64, count=len(new))
        self.words += words
        self.hashes = np.concatenate([self.hashes, hashes])
        self.kind = np.concatenate([self.kind, self.counts.classes(words)])
        if self.with_counts:
            self.count = np.concatenate([self.count, self.counts.look_up(words, hashes)])
        return each


@dataclass
class Tokens:
    """A slice's tokens in sequence, each text's followed by its end (code 0); codes are numbers of words met."""

    words: list[str]
    hashes: np.ndarray
    kind: np.ndarray
    count: np.ndarray
    code: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str], met: Met) -> "Tokens":
        each = met.numbered(texts)
        length = np.array([len(x) + 1 for x in each], dtype=np.int64)
        code = np.zeros(int(length.sum()), dtype=np.int64)
        inside = np.ones(len(code), dtype=bool)
        inside[np.cumsum(length) - 1] = False
        code[inside] = np.fromiter(chain.from_iterable(each), dtype=np.int64, count=int(inside.sum()))
        return cls(met.words, met.hashes, met.kind, met.count, code, length)

    def features(self, dim: int) -> np.ndarray:
        """Rows of the weight table (of dim rows) for each token's history: last word, last two, the one before (skip), last two classes."""
        h, k = self.hashes[self.code], self.kind[self.code].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(self.length) - self.length
        one, two = np.empty_like(h), np.empty_like(h)
        c1, c2 = np.zeros_like(k), np.zeros_like(k)
        one[1:], two[2:], c1[1:], c2[2:] = h[:-1], h[:-2], k[:-1], k[:-2]
        one[first], c1[first] = _BEFORE, 0
        second = first[self.length > 1] + 1
        two[first], two[second], c2[first], c2[second] = _BEFORE, _BEFORE, 0, 0
        hashed = (mix(one), mix(mix(two) * np.uint64(3) + one), mix(two ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix(c1 * np.uint64(CLASSES + 1) + c2 + np.uint64(7)))
        return np.stack([r & np.uint64(dim - 1) for r in hashed], axis=1).astype(np.uint16)


def in_group(rows: np.ndarray, group: np.ndarray, dim: int) -> np.ndarray:
    """Rows (of a table of dim rows, a power of two) of the same features within a group."""
    return ((rows.astype(np.uint32) + group.astype(np.uint32)[:, None] * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B) >> np.uint32(33 - dim.bit_length())).astype(np.uint16)


def row_sums(values: np.ndarray, take: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of take (from one of starts to its end, not empty): the sum of the rows of values that it names.

    Whole rows are added, one of each run at a time; runs longer than FOLD are summed up in pieces, then the pieces.
    """
    out = values.take(take.take(starts), axis=0)
    longer = np.flatnonzero(ends - starts > 1)
    if not len(longer):
        return out
    starts, ends = starts.take(longer), ends.take(longer)
    pieces = -(-(ends - starts) // FOLD)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(starts - FOLD * first, pieces) + FOLD * np.arange(pieces.sum())
    length = np.minimum(FOLD, np.repeat(ends, pieces) - begin).astype(np.uint8)
    order = np.argsort(FOLD - length, kind="stable")  # the longest first
    begin = begin.take(order)
    left = len(length) - np.cumsum(np.bincount(length, minlength=FOLD + 1))
    part = values.take(take.take(begin), axis=0)
    for k in range(1, FOLD):
        if not left[k]:
            break
        part[: left[k]] += values.take(take.take(begin[: left[k]] + k), axis=0)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    # a row as one item, which is put in its place whole
    row = np.dtype((np.void, out.itemsize * out.shape[1]))
    np.put(out.view(row), longer, row_sums(part, place, first, first + pieces).view(row))
    return out


class Model:
    """For groups, and for classes inside them: weights (table_rows by WIDTH each) and biases."""

    def __init__(self, counts: Counts | None = None) -> None:
        rows = table_rows(counts.distinct if counts else 0)
        self.weights = np.zeros((2 * rows, WIDTH), dtype=np.float32)
        share = ((counts.class_total + 1) if counts else np.ones(CLASSES)).reshape(WIDTH, WIDTH)
        self.group_bias = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        self.class_bias = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)

    @property
    def rows(self) -> int:
        """Rows of each half of the table: that of the groups, then that of the classes."""
        return len(self.weights) // 2

    def halves(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of a table shaped as the weights, as views."""
        return table[: self.rows], table[self.rows :]

    def parts(self, rows: np.ndarray, kind: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
        """Of groups and of classes: rows of that half of the table, biases, and the place of the true one."""
        group = kind // WIDTH
        return (rows, self.group_bias, group), (in_group(rows, group, self.rows), self.class_bias.take(group, axis=0), kind % WIDTH)

    @staticmethod
    def scores(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """All scores, a row for each history; weights is one half of the table."""
        z = weights.take(rows[:, 0], axis=0)
        for k in range(1, FEATURES):
            z += weights.take(rows[:, k], axis=0)
        z += bias
        return z

    def log_chance(self, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The natural logarithm of the chance of each history's class kind."""
        out = np.zeros(len(kind), dtype=np.float64)
        for weights, (r, bias, k) in zip(self.halves(self.weights), self.parts(rows, kind)):
            # numpy goes along long rows many times faster than along many rows of WIDTH, and sums do not depend on the place
            z = np.ascontiguousarray(self.scores(weights, r, bias).T)
            z -= z.max(axis=0)
            out += z[k, np.arange(len(k))]
            out -= np.log(np.exp(z, out=z).sum(axis=0))
        return out

    def learn(self, rows: np.ndarray, kind: np.ndarray, seen: np.ndarray) -> None:
        """One pass of gradient steps (scaled by the squares seen so far) over tokens in batches."""
        for at in range(0, len(kind), BATCH):
            parts = self.parts(rows[at : at + BATCH], kind[at : at + BATCH])
            for weights, part, squares in zip(self.halves(self.weights), parts, self.halves(seen)):
                self._step(weights, *part, squares)

    def _step(self, weights: np.ndarray, r: np.ndarray, bias: np.ndarray, k: np.ndarray, seen: np.ndarray) -> None:
        """A step of one half of the table."""
        gradients = np.empty((len(k), WIDTH), dtype=np.float32)
        for at in range(0, len(k), FEW):
            to = min(at + FEW, len(k))
            z = self.scores(weights, r[at:to], bias if bias.ndim == 1 else bias[at:to])
            if not -LARGE < z.min() <= z.max() < LARGE:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            # a product with ones adds up short rows many times faster than sum() does
            np.multiply(z, (1 / (z @ _ONES))[:, None], out=gradients[at:to])
        gradients[np.arange(len(k)), k] -= 1
        flat = r.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat.take(order)
        edges = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
        own = flat.take(edges[:-1]).astype(np.int64)
        total = row_sums(gradients, order // FEATURES, edges[:-1], edges[1:])
        # a row as one item, which is put in its place whole
        row = np.dtype((np.void, weights.itemsize * WIDTH))
        seen_rows, weight_rows = seen.view(row).ravel(), weights.view(row).ravel()
        for at in range(0, len(own), FEW):  # few rows at a time stay in the processor's cache
            some, step = own[at : at + FEW], total[at : at + FEW]
            squares = step * step
            squares += seen.take(some, axis=0)
            seen_rows[some] = squares.view(row).ravel()
            squares += np.float32(1e-4)
            np.sqrt(squares, out=squares)
            step /= squares
            step *= np.float32(RATE)
            new = weights.take(some, axis=0)
            new -= step
            weight_rows[some] = new.view(row).ravel()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where the shard changes."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            yield batch.slice(a, b - a)


def train(training: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """rounds distributed updates; each training row (doc_id, text) is used in one of them, by a hash of doc_id.

    A shard's texts are taken in order of doc_id from the round's first weights, so the result does not depend on how
    the texts are partitioned (but for the order of the last sums), and a shard's move not on how many shards there are.
    """
    spark, model = training.sparkSession, Model(counts)
    small_batches(spark)
    # shards follow the tokens, not the files or their partitions
    shards = -(-counts.total // (SHARD * rounds)) or 1
    parts = -(-shards // STEP)
    shared_counts = spark.sparkContext.broadcast(counts)

    def added(part: pa.Table, keep: tuple[str, ...]) -> pa.Table:
        total, some = np.zeros((BLOCK, WIDTH), dtype=np.float64), np.zeros(BLOCK, dtype=bool)
        for at, x in zip(part.column("at"), part.column("moved")):
            own = np.frombuffer(at.as_buffer(), dtype=np.uint8)
            total[own] += np.frombuffer(x.as_buffer(), dtype=np.float32).reshape(-1, WIDTH)
            some[own] = True
        at, moved = np.flatnonzero(some).astype(np.uint8).tobytes(), total[some].astype(np.float32).tobytes()
        columns = {k: [part.column(k)[0].as_py()] for k in keep} | {"tokens": [pc.sum(part.column("tokens")).as_py()], "at": [at], "moved": [moved]}
        return pa.table(columns, schema=pa.schema([(k, pa.int32()) for k in keep] + [("tokens", pa.int64()), ("at", pa.binary()), ("moved", pa.binary())]))

    for step in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def move(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, seen, tokens, now, all_tokens, met = Model(), None, 0, None, 0, Met(shared_counts.value)
            moved = np.zeros_like(start.value.weights)

            def add() -> int:
                own.weights -= start.value.weights
                own.weights *= np.float32(tokens)
                np.add(moved, own.weights, out=moved)
                return all_tokens + tokens

            def moves() -> pa.RecordBatch:
                # a task sums up its shards' moves; only rows that moved are written, a block's places among them in at
                delta = moved.reshape(-1, BLOCK, WIDTH)
                n, places = len(delta), [np.flatnonzero(d.any(axis=1)).astype(np.uint8) for d in delta]
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(n), type=pa.int32()), pa.array([now % parts] * n, type=pa.int32()), pa.array([all_tokens] * n, type=pa.int64()), pa.array([p.tobytes() for p in places], type=pa.binary()), pa.array([d[p].tobytes() for d, p in zip(delta, places)], type=pa.binary())],
                    names=["block", "part", "tokens", "at", "moved"],
                )

            for part, texts in slices(_by_shard(batches), "text", _SLICE):
                if part.column("shard")[0].as_py() != now:
                    if tokens:
                        all_tokens = add()
                    now, tokens = part.column("shard")[0].as_py(), 0
                    own.weights, own.group_bias, own.class_bias = start.value.weights.copy(), start.value.group_bias, start.value.class_bias
                    seen = np.zeros_like(own.weights)
                t = Tokens.of(texts, met)
                own.learn(t.features(own.rows), t.kind[t.code], seen)
                tokens += len(t.code)
            if tokens:
                all_tokens = add()
                yield moves()

        mine = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == step).select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "doc_id", "text")
        dealt = mine.repartition("shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("text")).select("shard", "text")
        moved = dealt.mapInArrow(move, "block int, part int, tokens long, at binary, moved binary")
        if parts > 1:  # two steps, so that no task holds the moves of all tasks
            moved = moved.groupBy("block", "part").applyInArrow(lambda t: added(t, ("block", "part")), "block int, part int, tokens long, at binary, moved binary")
        full = moved.groupBy("block").applyInArrow(lambda t: added(t, ("block",)), "block int, tokens long, at binary, moved binary")
        new = Model(counts)
        new.weights = model.weights.copy()
        for r in full.collect():
            at = r["block"] * BLOCK + np.frombuffer(r["at"], dtype=np.uint8).astype(np.int64)
            new.weights[at] += (np.frombuffer(r["moved"], dtype=np.float32).reshape(-1, WIDTH) / r["tokens"]).astype(np.float32)
        model = new
        start.destroy()
    return model


SCORED = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, counts: Counts, counted: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and SCORED: a row for each row.

    base_score: the unigram score; score: the model's log10 probability of the text and its end. A null or empty text
    is its end alone. With nothing learned every chance is that of an empty table. Words that are not among the most
    frequent meet their counts in a join; each row has a number of its own there, so repeated rows and null ids stay
    apart. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, counts))
    room = math.log10(counts.total + counts.distinct + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, have = shared.value
        met = Met(have, with_counts=True)
        class_room = np.log10(have.class_total + have.class_distinct + 1)
        for part, texts in slices(batches, "text", _SLICE):
            t = Tokens.of(texts, met)
            of = t.count[t.code]
            ready = np.log10(np.maximum(of, 0) + 1.0)
            kind = t.kind[t.code]
            rows = t.features(own.rows)
            chance = np.empty(len(kind), dtype=np.float64)
            for at in range(0, len(kind), FEW):
                chance[at : at + FEW] = own.log_chance(rows[at : at + FEW], kind[at : at + FEW])
            by_class = chance / math.log(10) + ready - class_room[kind]
            base, model_score = sums(ready - room, t.length), sums(by_class, t.length)
            missing = np.flatnonzero(of < 0)
            at = np.searchsorted(np.cumsum(t.length), missing, side="right")
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(texts)))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.array([t.words[c] for c in t.code[missing]], type=pa.string()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(t.length), pa.array(sums((of > 0).astype(np.int64), t.length)), pa.array(base), pa.array(model_score), rest],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rest"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {SCORED}, rest array<string>")
    made = cut(made.withColumn("row", F.monotonically_increasing_id()))
    asked = made.select("row", F.explode("rest").alias("word"))
    met = asked.join(counted, "word", "left").select("row", F.coalesce("count", F.lit(0)).alias("n"))
    rest = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("known"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return made.join(rest, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op5_lm_score(spark: SparkSession, sf_dir: str, most: int = 1 << 20) -> DataFrame:
    """Every document's scores, by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(crc_bucket("doc_id", 7) != 2)
    counts, counted = count(training, most)
    scored = score(docs, train(training, counts), counts, counted)
    held_out = F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")
