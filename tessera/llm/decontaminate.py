"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a run of LEAST tokens (the seeds). For each such pair the longest
matches that do not overlap are marked again and again, found by running Karp-Rabin hashes; the item's share of marked
tokens is the verdict. Passages count wherever and in whatever order they stand.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.arrow import mix, slices, small_batches, tidy
from tessera.llm.common import table
from tessera.llm.quality import rolling

_TOKEN = re.compile(r"[^\W_]+")
#: Tokens of the shortest tile, and the least share of an item's tokens in tiles.
LEAST, COVERAGE = 4, 0.6
#: Pairs of equal seeds of a text and an item up to which they are made and joined into runs; beyond, tile_lengths.
MOST_PAIRS = 1_000_000
PAIRS = "n_tiles int, matched_tokens int, item_tokens int, coverage double"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Items:
    """One block of benchmark items: token numbers, and which items hold each seed in how many places."""

    def __init__(self, rows: list[tuple[object, str]], least: int) -> None:
        self.least, self.vocabulary = least, {}
        self.ids, self.words = [], []
        hashes, owner = [], []
        for item, text in rows:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text)], dtype=np.int64)
            if len(words) < least:
                continue
            seeds = rolling(mix(words), least)
            hashes.append(seeds)
            owner.append(np.full(len(seeds), len(self.ids)))
            self.ids.append(item)
            self.words.append(words)
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        who = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        # a row for each seed and item, and where the rows of each seed begin
        fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
        self.owner, self.places = who[fresh], np.diff(np.append(fresh, len(h)))
        self.hashes, self.starts = np.unique(h[fresh], return_index=True)
        self.starts = np.append(self.starts, len(fresh))

    def candidates(self, texts: list[str], coverage: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, item, pairs of equal seeds, the text's token numbers) of all that may reach the coverage.

        Pairs are counted, not made: even apart, the item's places whose seeds the text holds must be enough.
        """
        words = [tokens(t) for t in texts]
        count = np.array([len(w) for w in words], dtype=np.int64)
        known = self.vocabulary.get
        code = np.fromiter((known(w, -1) for ws in words for w in ws), dtype=np.int64, count=int(count.sum()))
        if len(code) < self.least or not len(self.hashes):
            return
        doc = np.repeat(np.arange(len(texts)), count)
        size = len(code) - self.least + 1
        unknown = np.concatenate([[0], np.cumsum(code < 0)])
        whole = np.flatnonzero((doc[:size] == doc[self.least - 1 :]) & (unknown[self.least :] == unknown[:size]))
        h = rolling(mix(code), self.least)[whole]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        seed, times = np.unique(np.stack([doc[whole[hit]], at[hit]]), axis=1, return_counts=True)
        n = self.starts[seed[1] + 1] - self.starts[seed[1]]
        row = np.repeat(self.starts[seed[1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        met, group = np.unique(np.stack([np.repeat(seed[0], n), self.owner[row]]), axis=1, return_inverse=True)
        group = group.ravel()
        places = np.bincount(group, weights=self.places[row], minlength=met.shape[1])
        pairs = np.bincount(group, weights=self.places[row] * np.repeat(times, n), minlength=met.shape[1])
        begin = np.cumsum(count) - count
        for k in range(met.shape[1]):
            t, item = int(met[0, k]), int(met[1, k])
            if self.least * places[k] >= coverage * len(self.words[item]):
                yield t, item, int(pairs[k]), code[begin[t] : begin[t] + count[t]]

    def tiles(self, item: int, text: np.ndarray, pairs: int) -> list[tuple[int, int, int]]:
        """Greedy tiles of the item and a text."""
        if pairs > MOST_PAIRS:
            return tile_lengths(self.words[item], text, self.least)
        a, b = rolling(mix(self.words[item]), self.least), rolling(mix(text), self.least)
        order = np.argsort(b, kind="stable")
        low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
        n = high - low
        i = np.repeat(np.arange(len(a)), n)
        j = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return tile(self.words[item], text, i, j, self.least)


def tile(item: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length), longest first; i, j: places of equal seeds of `least` tokens."""
    same = np.ones(len(i), dtype=bool)
    for k in range(least):
        same &= item[i + k] == text[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        return []
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)]))
    length = np.diff(np.append(fresh, len(i))) + least - 1
    heap = [(-int(n), int(i[f]), int(j[f])) for f, n in zip(fresh, length)]
    heapq.heapify(heap)
    used_item, used_text = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        used = used_item[a : a + n] | used_text[b : b + n]
        if not used.any():
            used_item[a : a + n] = used_text[b : b + n] = True
            out.append((a, b, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for begin, end in zip(edge[::2], edge[1::2]):
            if end - begin >= least:
                heapq.heappush(heap, (-int(end - begin), a + int(begin), b + int(begin)))
    return out


class _Prefix:
    """Hashes of all windows of any length of tokens, from running sums."""

    _FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, tokens_: np.ndarray) -> None:
        n = len(tokens_)
        self.power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, self._FACTOR, dtype=np.uint64)]))
        self.sum = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(tokens_) * self.power[:n], dtype=np.uint64)])
        self.used = np.zeros(n, dtype=bool)

    def windows(self, length: int, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows without used tokens; top: powers up to the longer sequence's length."""
        marked = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(marked[length:] == marked[:-length]) if length <= len(self.used) else np.zeros(0, dtype=np.int64)
        # brought to one power, so that equal windows have equal hashes wherever they stand
        return at, (self.sum[at + length] - self.sum[at]) * top[len(top) - 1 - at]


def tile_lengths(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles as tile, by running hashes of falling lengths, in memory that grows with the sum of the lengths.

    For texts that repeat themselves, whose equal seeds are as many as the product of their lengths.
    """
    one, two = _Prefix(item), _Prefix(text)
    top = (one if len(item) > len(text) else two).power
    longest, out = min(len(item), len(text)), []
    while longest >= least:
        low, high = least - 1, longest  # the greatest length of a common window lies between
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if np.isin(one.windows(middle, top)[1], two.windows(middle, top)[1]).any() else (low, middle - 1)
        if low < least:
            break
        (a, ha), (b, hb) = one.windows(low, top), two.windows(low, top)
        order = np.argsort(hb, kind="stable")
        first, last = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
        next_of: dict[int, int] = {}
        free_from = 0
        for place in np.flatnonzero(last > first).tolist():
            i = int(a[place])
            if i < free_from:
                continue
            k = next_of.get(int(first[place]), int(first[place]))
            while k < last[place]:
                j = int(b[order[k]])
                if not (two.used[j] or two.used[j + low - 1]) and (item[i : i + low] == text[j : j + low]).all():
                    one.used[i : i + low] = two.used[j : j + low] = True
                    out.append((i, j, low))
                    free_from = i + low
                    break
                k += 1
            next_of[int(first[place])] = k
        longest = low - 1
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about `most` characters, by a hash of the id; one block at a time is on the driver."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / most))
    for k in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(mine.collect())


def _passes(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float, block_chars: int) -> Iterator[Callable]:
    for block in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in block], least))

        def found(texts: list[str], shared=shared) -> Iterator[tuple[int, object, int, int, int]]:
            items = shared.value
            for t, k, pairs, code in items.candidates(texts, coverage):
                tiles = items.tiles(k, code, pairs)
                matched = sum(n for _, _, n in tiles)
                if matched >= coverage * len(items.words[k]):
                    yield t, items.ids[k], len(tiles), matched, len(items.words[k])

        yield found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_chars: int = 16_000_000) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id and PAIRS, a row for each document and item it leaks.

    An item leaks where tiles of `least` tokens or more cover the share `coverage` of its tokens. Tokens are
    lower-cased runs of letters and digits. Texts are read once for each block of block_chars characters of items, the
    most that is broadcast; nothing is shuffled. A null or empty text, and an item under `least` tokens or with a null
    id or text, match nothing; repeated items count once, repeated documents each. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows, out = docs.select("doc_id", "text"), None
    of_item = to_arrow_type(benchmark.schema["item_id"].dataType)
    for found in _passes(rows, benchmark, least, coverage, block_chars):

        def work(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches, "text"):
                hits = sorted(found(texts))
                t, item, n, matched, total = (list(x) for x in zip(*hits)) if hits else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(t, type=pa.int64())), pa.array(item, type=of_item), pa.array(n, type=pa.int32()), pa.array(matched, type=pa.int32()), pa.array(total, type=pa.int32()), pa.array([m / s for m, s in zip(matched, total)], type=pa.float64())],
                    names=["doc_id", "item_id", "n_tiles", "matched_tokens", "item_tokens", "coverage"],
                )

        made = rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, {PAIRS}")
        out = made if out is None else out.unionAll(made)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_chars: int = 16_000_000) -> DataFrame:
    """docs without the rows that leak an item (see contaminated); columns stay as they are."""
    small_batches(docs.sparkSession)
    out = docs
    for found in _passes(docs, benchmark, least, coverage, block_chars):

        def work(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches, "text"):
                leaking = {t for t, *_ in found(texts)}
                yield part.filter(pa.array([i not in leaking for i in range(len(texts))]))
            tidy()

        out = out.mapInArrow(work, docs.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
