"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded at a quantile of the scores.

A labelled good document is preferred to a labelled bad one. The chance of that is a logistic function of the difference
of their scores, and scores are linear in features of the text alone, so the loss is a logistic loss on differences of
features. The threshold is the quantile of the training scores that leaves as many above it as are labelled good.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import Numbers, mapped, sums, tidy
from tessera.llm.common import crc_bucket, table, text_of
from tessera.session import shared_folder, stored

#: Classes of characters: other, lower-case, upper-case and other letters, digits, marks, blanks, line ends, sentence ends, commas, further punctuation, symbols, bars and hashes, brackets and quotes.
_CLASSES = 14
#: Hashed words, and the measures of shape beside shares of classes and of pairs of classes.
WORDS, _SHAPES = 256, 9
DIM = _CLASSES + _CLASSES * _CLASSES + WORDS + _SHAPES
#: The score at the threshold.
CUT = 0.7
_BLANK = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))


@cache
def _class_of() -> np.ndarray:
    """The class of each code point."""
    general = {"Ll": 1, "Lu": 2, "Lt": 2, "Lo": 3, "Lm": 3, "Nd": 4, "Nl": 4, "No": 4, "Mn": 5, "Mc": 5, "Me": 5, "Zs": 6, "Zl": 7, "Zp": 7, "Po": 10, "Pd": 10, "Pc": 10, "Sm": 11, "Sc": 11, "Sk": 11, "So": 11, "Ps": 13, "Pe": 13, "Pi": 13, "Pf": 13}
    out = np.fromiter((general.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for chars, k in (("\n\r", 7), ("\t", 6), (".!?", 8), (",;:", 9), ("|#*$%&<>@~^", 12), ("\"'", 13)):
        out[[ord(c) for c in chars]] = k
    return out


def features(texts: list[str]) -> np.ndarray:
    """A row of DIM for each text: shares of character classes and of neighbouring pairs of them, of hashed words, and measures of length and repetition.

    A text without characters is all zero but for nothing at all; one without words has no shares of words.
    """
    rows = len(texts)
    coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    length = np.fromiter(map(len, coded), dtype=np.int64, count=rows)
    kind = _class_of()[np.concatenate(coded)].astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(rows), length)
    single = np.bincount(doc * _CLASSES + kind, minlength=rows * _CLASSES).reshape(rows, -1)
    same = doc[1:] == doc[:-1]
    pairs = _CLASSES * _CLASSES
    double = np.bincount((doc[1:] * pairs + kind[:-1] * _CLASSES + kind[1:])[same], minlength=rows * pairs).reshape(rows, -1)
    numbers = Numbers()
    words = [t.encode("utf-8", "surrogatepass").translate(_BLANK).split() for t in texts]
    count = np.fromiter(map(len, words), dtype=np.int64, count=rows)
    ids = np.fromiter((numbers[w] for own in words for w in own), dtype=np.int64, count=int(count.sum()))
    bucket = np.fromiter((xxhash.xxh64_intdigest(w.lower(), 5) % WORDS for w in numbers), dtype=np.int64, count=len(numbers))
    of = np.repeat(np.arange(rows), count)
    hashed = np.bincount(of * WORDS + bucket[ids], minlength=rows * WORDS).reshape(rows, -1)
    key, often = np.unique(of * max(len(numbers), 1) + ids, return_counts=True)
    owner = key // max(len(numbers), 1)
    most = np.zeros(rows)
    np.maximum.at(most, owner, often)
    again = np.bincount(of[1:][(of[1:] == of[:-1]) & (ids[1:] == ids[:-1])], minlength=rows)
    lines = [[x for x in t.split("\n") if x] for t in texts]
    n_lines = np.fromiter(map(len, lines), dtype=np.int64, count=rows)
    distinct_lines = np.fromiter((len(set(x)) for x in lines), dtype=np.int64, count=rows)
    size = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))
    word_bytes = sums(size[ids], count)
    per = lambda x, n: x / np.maximum(n, 1)
    shape = [np.log1p(length), np.log1p(count), per(word_bytes, count), per(np.bincount(owner, minlength=rows), count), per(most, count), per(again, count), per(distinct_lines, n_lines), np.log1p(n_lines), np.log1p(per(count, n_lines))]
    return np.hstack([per(single, length[:, None]), per(double, length[:, None]), per(hashed, count[:, None]), np.stack(shape, axis=1)]).astype(np.float32)


@dataclass
class Model:
    """Scores are weight times the features less start, in units of scale; least is the score at the threshold. No weights: nothing learned."""

    weight: np.ndarray
    start: float = 0.0
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, CUT at the threshold; a half for all where nothing was learned."""
        if not len(self.weight):
            return np.full(len(x), 0.5)
        raw = (x.astype(np.float64) * self.weight).sum(axis=1) - self.start  # row by row: no other text changes a sum's order
        return 1 / (1 + np.exp(-np.clip(raw / self.scale + math.log(CUT / (1 - CUT)), -36, 36)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int, decay: float = 1e-3, rounds: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights that make the chance that a good row is preferred to a bad one, over `pairs` drawn pairs (all, if they are fewer).

    The logistic loss on differences of features with an L2 penalty is lowered by moment-corrected gradient steps. A
    pair's gradient goes to its two rows first, so that differences of features are never stored.
    """
    draw = np.random.default_rng(11)
    if len(good) * len(bad) <= pairs:
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(good)), np.arange(len(bad)), indexing="ij"))
    else:  # every row in about as many pairs as any other of its side
        i, j = (np.concatenate([draw.permutation(n) for _ in range(-(-pairs // n))])[:pairs] for n in (len(good), len(bad)))
    w, first, second = np.zeros(good.shape[1]), np.zeros(good.shape[1]), np.zeros(good.shape[1])
    for k in range(1, rounds + 1):
        ahead = (good @ w)[i] - (bad @ w)[j]
        pull = 1 / (1 + np.exp(np.clip(ahead, -500, 500))) / len(i)
        gradient = np.bincount(j, weights=pull, minlength=len(bad)) @ bad - np.bincount(i, weights=pull, minlength=len(good)) @ good + decay * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w


def threshold(raw: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The weighted quantile of raw below which the given share lies: midway between the two scores beside it."""
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    k = min(int(np.searchsorted(below, share - 1e-9)), len(raw) - 1)
    return float(raw[order[k]] + raw[order[min(k + 1, len(raw) - 1)]]) / 2


def _drawn(good: int, bad: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of `pairs` pairs (all, if they are fewer), every row in about as many as any other of its side."""
    if good * bad <= pairs:
        return np.repeat(np.arange(good), bad), np.tile(np.arange(bad), good)
    draw, pairs = np.random.default_rng(11), max(pairs, good, bad)
    return tuple(np.concatenate([draw.permutation(n) for _ in range(-(-pairs // n))])[:pairs] for n in (good, bad))


def _rows(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.float16).reshape(-1, DIM).astype(np.float64)


def _groups(stored_rows: DataFrame, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """v: what function gives for the good and the bad rows of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for good, bad in zip(batch.column("good"), batch.column("bad")):
                yield pa.RecordBatch.from_arrays([pa.array([function(_rows(good.as_py()), _rows(bad.as_py()))], type=pa.list_(pa.float64()))], names=["v"])
        tidy()

    return stored_rows.select("good", "bad").mapInArrow(run, "v array<double>")


def _total(parts: DataFrame) -> np.ndarray:
    """The sum of v: a vector for each group of thousands of rows reaches the driver."""
    got = parts.toArrow().column("v").to_pylist()
    return np.sum(got, axis=0) if got else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, pairs: int = 200_000, passes: int = 30, decay: float = 1e-3) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality 0 or 1; other values and nulls teach nothing).

    All labelled rows teach. They are dealt by a hash into groups of about per_label rows of either label; in each group every
    row is in pairs, of which `pairs` bounds the number (a group that has one label alone has none). Each of the passes, until the
    steps are small, adds up the gradient over all groups; the curvature by which it is scaled is one group's, which
    changes the way to the optimum and not the optimum. Features are kept in the shared folder, two bytes each.
    They meet the labels instead of the texts: they are worked out for rows of docs without a label too, and a row of them
    is shuffled as a fraction of a text. That join is by sorted rows at any size, so that no label is broadcast.
    """
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    of_label = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    if len(of_label) < 2:
        return Model(np.zeros(0))
    groups = -(-sum(of_label.values()) // (2 * per_label))

    def work(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        return {"x": pa.array([r.astype(np.float16).tobytes() for r in features(texts)], type=pa.binary())}

    def pack(group: pa.Table) -> pa.Table:
        label, x = group.column("label").to_pylist(), group.column("x").to_pylist()
        sides = [b"".join(sorted(v for k, v in zip(label, x) if k == side)) for side in (1, 0)]
        return pa.table({"g": pa.array([group.column("g")[0].as_py()], type=pa.int64()), "good": pa.array(sides[:1], type=pa.binary()), "bad": pa.array(sides[1:], type=pa.binary())})

    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("text"))
    found = mapped(texts, "text", work, "x binary", keep_text=False).join(named.hint("merge"), "doc_id")
    dealt = found.select("label", "x", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"))
    kept = stored(dealt.groupBy("g").applyInArrow(pack, "g long, good binary, bad binary"), f"{shared_folder(docs.sparkSession)}/features")

    def moments(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        n = len(_drawn(len(good), len(bad), pairs)[0]) if len(good) and len(bad) else 0
        return np.concatenate([[len(good), len(bad), n], good.sum(axis=0) + bad.sum(axis=0), (good**2).sum(axis=0) + (bad**2).sum(axis=0)])

    first = kept.where((F.octet_length("good") > 0) & (F.octet_length("bad") > 0)).orderBy("g").limit(1).toArrow()
    if not first.num_rows:
        return Model(np.zeros(0))
    total = _total(_groups(kept, moments))
    n, drawn = total[:2].sum(), total[2]
    mean = total[3 : 3 + DIM] / n
    spread = np.sqrt(np.maximum(total[3 + DIM :] / n - mean**2, 0))
    spread = np.where(spread > 1e-6, spread, np.inf)  # what never varies says nothing
    scaled = lambda x: np.clip((x - mean) / spread, -8, 8)
    good, bad = (scaled(_rows(first.column(k)[0].as_py())) for k in ("good", "bad"))
    between = good.mean(axis=0) - bad.mean(axis=0)
    # no logistic loss curves more than a quarter; twice that, and a share of plain steps for few rows, leaves room for groups that differ
    plain = DIM / (DIM + len(good) + len(bad))
    curve = np.linalg.inv((1 - plain) * (np.cov(good.T, bias=True) + np.cov(bad.T, bias=True) + np.outer(between, between)) / 2 + (decay + plain + 1e-2) * np.eye(DIM))
    w = ahead = np.zeros(DIM)
    speed = rate = 1.0
    best = (math.inf, w, w)
    for _ in range(passes):

        def slope(good: np.ndarray, bad: np.ndarray, at: np.ndarray = ahead) -> np.ndarray:
            if not len(good) or not len(bad):
                return np.zeros(1 + DIM)
            good, bad = scaled(good), scaled(bad)
            i, j = _drawn(len(good), len(bad), pairs)
            lead = np.clip((good @ at)[i] - (bad @ at)[j], -500, 500)
            pull = 1 / (1 + np.exp(lead))
            return np.concatenate([[np.logaddexp(0, -lead).sum()], np.bincount(j, weights=pull, minlength=len(bad)) @ bad - np.bincount(i, weights=pull, minlength=len(good)) @ good])

        got = _total(_groups(kept, slope)) / drawn
        loss, gradient = got[0] + decay / 2 * ahead @ ahead, got[1:] + decay * ahead
        if loss > best[0]:  # too far: shorter steps from the best place so far
            rate, speed, w = rate / 4, 1.0, best[1]
            ahead = w - rate * curve @ best[2]
            continue
        best = (loss, ahead, gradient)
        new = ahead - rate * curve @ gradient
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, moved = new + (speed - 1) / faster * (new - w), float(np.abs(new - w).max())
        w, speed = new, faster
        if moved < 1e-3:
            break
    weight = best[1] / spread
    raw = _groups(kept, lambda good, bad: np.concatenate([(good * weight).sum(axis=1), (bad * weight).sum(axis=1)])).select(F.explode("v").alias("raw"))
    raw = stored(raw, f"{shared_folder(docs.sparkSession)}/raw")
    at = raw.agg(F.percentile_approx("raw", total[1] / n, 100_000).alias("at"), F.stddev_pop("raw").alias("spread")).first()
    above = raw.where(F.col("raw") > at["at"]).agg(F.min("raw")).first()[0]
    tidy()
    return Model(weight, at["at"] if above is None else (at["at"] + above) / 2, max(at["spread"] / 2, 1e-9))


def rank(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, any other columns) with score and predicted (1 from CUT on), which replace columns of the same names.

    Each row is scored by its own whole text; null is empty. Repeated rows and ties score alike. Where nothing was
    learned every score is a half. No shuffle takes place; memory is bounded by the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        score = shared.value.score(features(texts))
        return {"score": pa.array(score), "predicted": pa.array(score >= CUT).cast(pa.int32())}

    return mapped(docs, "text", work, "score double, predicted int")


def op12_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; learned from the labels of three quarters of the documents (held_out: the rest)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = crc_bucket("doc_id", 4) != 2
    model = fit(docs.where(learnt), table(spark, sf_dir, "labels").where(learnt))
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return rank(docs, model).select("doc_id", held, "score", "predicted")
