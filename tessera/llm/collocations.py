"""Phrase collocations: a sketch bounds every phrase's count, automata count the candidates exactly, thresholds come last.

First passes add hashed n-grams up in arrays of counters (never less than an n-gram's count): words and pairs, then longer
ones whose parts may be frequent. In the last pass each slice of a shard compiles its own n-grams whose counters reach
the threshold into Aho-Corasick automata and counts all their matches in it, overlapping ones included. A phrase that is frequent enough in the corpus passes the sketch in every slice it occurs in, so the
sums over slices are its exact count. Words are between blanks and pieces between line feeds, in the patterns and in the
text, so no match begins or ends inside a word or spans two pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import Numbers, mix, slices, small_batches, tidy
from tessera.llm.common import cut, table, text_of

#: A-Z become lower case, tabs blanks; what ends a piece becomes a byte that no UTF-8 text has.
_END = 0xFF
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else _END if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b for b in range(256))
#: Counters of a sketch (a byte each) at least and at most, bytes of text that there is one for, counters of a block.
LEAST_CELLS, MOST_CELLS, BYTES_A_CELL, _CELLS = 1 << 16, 1 << 26, 8, 1 << 16
#: Bytes of text of a slice, phrases of an automaton, phrases that a worker holds before it passes counts on.
_SLICE, _PHRASES, _HELD = 1_000_000, 60_000, 1_000_000
#: Bytes of text that there is a part of the phrases for: what a task adds up at a time follows from it.
_BYTES_A_PART = 8_000_000
#: Parts of a language's candidates that are ranked by themselves first.
_SALTS = 32
LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50


def word_ids(texts: list[str]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """The words of all texts in sequence with an end mark between pieces, their numbers, and the word of each number (0: the mark)."""
    mark = bytes([_END])
    joined = mark.join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_TABLE)
    words = joined.replace(mark, b" " + mark + b" ").split()
    numbers = Numbers()
    numbers[mark]
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    return words, ids, list(numbers)


def gram_hashes(lang: str, ids: np.ndarray, known: list[bytes], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, the starts of the n-grams inside pieces, and their hashes, for n up to longest."""
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))[ids]
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 11))
    inside = ids != 0
    whole, h = inside, mix(of_word ^ seed)
    for n in range(1, longest + 1):
        if n > 1:
            whole = whole[:-1] & inside[n - 1 :]
            h = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + of_word[n - 1 :])
        starts = np.flatnonzero(whole)
        yield n, starts, h[starts]


def _by_lang(part: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[str, list[str]]]:
    langs = part.column("lang").to_pylist()
    for lang in dict.fromkeys(langs):
        yield lang, [t for t, of in zip(texts, langs) if of == lang]


def cells_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of each hash, one in either half of the sketch."""
    half = np.int64(1) << np.int64(bits - 1)
    shift = np.uint64(65 - bits)
    return (h >> shift).astype(np.int64), half + (mix(h) >> shift).astype(np.int64)


def _packed(raw: bytes | memoryview) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: memoryview) -> pa.Buffer:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd")


def _planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes of the numbers, then all next ones, and so on: the high ones are nearly all zero."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _from_planes(raw: pa.Buffer, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def frequent(lang: str, ids: np.ndarray, known: list[bytes], sketches: list[np.ndarray], least: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, starts, hashes of the n-grams whose parts of n - 1 words may all be frequent, and with a sketch they themselves.

    sketches: one of words and pairs, then one of each greater length; without one of its own an n-gram counts by its parts.
    They were made for the same least.
    """
    before = None
    for n, starts, h in gram_hashes(lang, ids, known, longest):
        if before is not None:
            keep = before[starts] & before[starts + 1]
            starts, h = starts[keep], h[keep]
        if max(n - 2, 0) < len(sketches):
            enough = sketches[max(n - 2, 0)]
            one, two = cells_of(h, (8 * len(enough)).bit_length() - 1)
            keep = _is_set(enough, one)
            keep[keep] = _is_set(enough, two[keep])
            starts, h = starts[keep], h[keep]
        yield n, starts, h
        before = np.zeros(len(ids) + 1, dtype=bool)
        before[starts] = True


def sketch(docs: DataFrame, lower: Broadcast | None, least: int, longest: int, bits: int) -> np.ndarray:
    """Which of 2^bits counters reach least, a bit each: in either half one counts each n-gram, never less than its count.

    Without lower they count words and pairs; with it (the sketches of all shorter n-grams) those of length `longest`
    whose parts may be frequent. A worker adds up its shard and passes on the blocks that it touched (the distances of the
    counters that are not zero, and those counters), no counter above `least`; blocks are added up where the shuffle puts
    them, one after another. A sum reaches `least` where the count does; counters and least end at 255.
    """
    enough = min(least, 255)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for part, texts in slices(batches, "text", _SLICE):
            cells = np.zeros(1 << bits, dtype=np.uint8) if cells is None else cells
            for lang, own in _by_lang(part, texts):
                _, ids, known = word_ids(own)
                grams = gram_hashes(lang, ids, known, longest) if lower is None else frequent(lang, ids, known, lower.value, least, longest)
                for n, _, h in grams:
                    if lower is None or n == longest:
                        for at in cells_of(h, bits):
                            at, times = np.unique(at.astype(np.uint32), return_counts=True)
                            cells[at] = np.minimum(cells[at] + times, 255)
        if cells is not None:
            blocks = cells.reshape(-1, min(_CELLS, len(cells)))
            for k in np.flatnonzero(blocks.any(axis=1)):  # a shard's counts matter up to the threshold alone
                at = np.flatnonzero(blocks[k])
                packed = _packed(_planes(np.diff(at, prepend=0).astype(np.uint16)) + np.minimum(blocks[k][at], enough).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], type=pa.int32()), pa.array([packed], type=pa.binary())], names=["block", "cells"])
        tidy()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("block").to_pylist(), batch.column("cells")):
                raw = _unpacked(memoryview(packed.as_buffer()))
                n = len(raw) // 3
                at = np.cumsum(_from_planes(raw[: 2 * n], np.uint16), dtype=np.int64)
                cells = total.setdefault(k, np.zeros(min(_CELLS, 1 << bits), dtype=np.uint8))
                cells[at] = np.minimum(cells[at].astype(np.uint16) + np.frombuffer(raw[2 * n :], dtype=np.uint8), 255)
        for k, cells in total.items():
            bit = np.packbits(cells >= enough, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), pa.array([bit], type=pa.binary())], names=["block", "cells"])
        tidy()

    kind = "block int, cells binary"
    found = docs.mapInArrow(shard, kind).repartition("block").mapInArrow(add, kind).toArrow()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = min(_CELLS // 8, len(out))
    for k, cells in zip(found.column("block").to_pylist(), found.column("cells")):
        out[k * width : (k + 1) * width] = np.frombuffer(cells.as_buffer(), dtype=np.uint8)
    return out


def _bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def sketches(docs: DataFrame, least: int, longest: int, most_cells: int = MOST_CELLS, size: int | None = None) -> Broadcast:
    """A sketch of words and pairs, and one of each greater length up to longest: each pass leaves out what the last ruled out.

    A sketch's size follows the texts' size (in bytes; None: worked out here) up to most_cells. Where the corpus outgrows that, more n-grams pass than are
    frequent: that costs time and shuffle, up to those of a plain count, not truth.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = _bytes_of(docs) if size is None else size
    bits = min(max((size // BYTES_A_CELL).bit_length(), LEAST_CELLS.bit_length() - 1), most_cells.bit_length() - 1)
    shared = spark.sparkContext.broadcast([sketch(docs, None, least, min(longest, 2), bits)])
    for n in range(3, longest + 1):
        made = [*shared.value, sketch(docs, shared, least, n, bits)]
        shared.destroy()
        shared = spark.sparkContext.broadcast(made)
    return shared


def candidates(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One start of each distinct n-gram among those that begin at starts (told apart by their words, not by hashes)."""
    code = np.zeros(len(starts), dtype=np.int64)
    for k in range(n):
        code = np.unique(code * (int(ids.max()) + 1) + ids[starts + k], return_inverse=True)[1]
    return starts[np.unique(code, return_index=True)[1]]


def matches(text: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs in text, overlaps included; both hold a blank at either side of each word."""
    out = np.zeros(len(phrases), dtype=np.int64)
    for at in range(0, len(phrases), _PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        part = phrases[at : at + _PHRASES]
        for k, phrase in enumerate(part):
            automaton.add_word(f" {phrase} ", k)
        automaton.make_automaton()
        out[at : at + len(part)] = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), dtype=np.int64), minlength=len(part))
    return out


def _heads(lines: pa.Array) -> np.ndarray:
    """A hash of each line's first two words (or of the one that it has); lines end with a line feed."""
    starts, data = np.frombuffer(lines.buffers()[1], dtype=np.int32)[: len(lines) + 1].astype(np.int64), np.frombuffer(lines.buffers()[2], dtype=np.uint8)
    ends = starts[1:] - 1
    blanks = np.append(np.flatnonzero(data == 0x20), [len(data)] * 2)
    ends = np.minimum(ends, blanks[np.searchsorted(blanks, starts[:-1]) + 1])
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    total = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(mix(np.arange(int(np.diff(starts).max())))[place] * data[: len(place)], out=total[1:])
    return total[ends] - total[starts[:-1]]


def parcels(held: dict[str, dict[str, int]], parts: int) -> Iterator[tuple[int, list[str], list[int], bytes, bytes]]:
    """Part, its languages, how many phrases each has, the phrases of one after another (packed) and their counts (packed).

    The part follows from the language and the first two words; phrases of a part are in order, which their packing makes use of.
    """
    langs, lang = list(held), np.repeat(np.arange(len(held)), [len(own) for own in held.values()])
    lines = pc.binary_join_element_wise(pa.array(list(chain.from_iterable(held.values())), type=pa.string()), "", "\n")
    counts = np.fromiter(chain.from_iterable(own.values() for own in held.values()), dtype=np.int64, count=len(lang))
    seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 3) for x in langs], dtype=np.uint64)
    part = (mix(_heads(lines) ^ seeds[lang]) % np.uint64(parts)).astype(np.int64) * len(langs) + lang
    order = pc.sort_indices(lines).to_numpy()
    order = order[np.argsort(part[order], kind="stable")]
    part, counts, lines = part[order], counts[order], lines.take(pa.array(order))
    ends, text = np.frombuffer(lines.buffers()[1], dtype=np.int32), memoryview(lines.buffers()[2])
    edges = np.flatnonzero(np.diff(part // len(langs), prepend=-1, append=-1)).tolist()
    for begin, end in zip(edges[:-1], edges[1:]):
        some, n = np.unique(part[begin:end] % len(langs), return_counts=True)
        yield int(part[begin] // len(langs)), [langs[k] for k in some], n.tolist(), _packed(text[ends[begin] : ends[end]]), _packed(_planes(counts[begin:end]))


def unpacked(langs: list[str], sizes: list[int], phrases: memoryview, counts: memoryview) -> pa.Table:
    """lang, phrase, n of a parcel."""
    text, n = np.frombuffer(_unpacked(phrases), dtype=np.uint8), _from_planes(_unpacked(counts), np.int64)
    breaks = np.flatnonzero(text == 0x0A)
    ends = np.concatenate([[0], breaks - np.arange(len(breaks))]).astype(np.int32)
    phrase = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(np.delete(text, breaks)))
    return pa.table({"lang": pa.array(langs, type=pa.string()).take(pa.array(np.repeat(np.arange(len(langs)), sizes))), "phrase": phrase, "n": n})


def counted(docs: DataFrame, bound: Broadcast, least: int, longest: int, size: int | None = None) -> DataFrame:
    """lang, phrase, n: exact counts of the phrases of up to longest words that occur `least` times, and of all words ("").

    What a worker has counted goes to the shuffle in parcels, one a part; the phrases of a part are added up together.
    size: bytes of all texts, which the number of parts follows (None: worked out here).
    """
    parts = (_bytes_of(docs) if size is None else size) // _BYTES_A_PART + 1
    kind = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("phrases", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for parcel in parcels(held, parts) if held else ():
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(parcel, kind)], schema=kind)
            held.clear()

        for part, texts in slices(batches, "text", _SLICE):
            for lang, own in _by_lang(part, texts):
                words, ids, known = word_ids(own)
                phrases: list[str] = []
                for n, starts, _ in frequent(lang, ids, known, bound.value, least, longest):
                    if len(starts):
                        phrases += [b" ".join(words[s : s + n]).decode("utf-8", "surrogatepass") for s in candidates(ids, starts, n)]
                counts = held.setdefault(lang, Counter())
                counts[""] += int(np.count_nonzero(ids))
                if phrases:
                    text = (b" " + b" ".join(words) + b" ").replace(bytes([_END]), b"\n").decode("utf-8", "surrogatepass")
                    counts.update(dict(zip(phrases, matches(text, phrases).tolist())))
            if sum(map(len, held.values())) >= _HELD:
                yield from flush()
        yield from flush()
        tidy()

    def add(group: pa.Table) -> pa.Table:
        columns = [group.column(c) for c in ("langs", "sizes", "phrases", "counts")]
        each = [unpacked(x.as_py(), k.as_py(), memoryview(p.as_buffer()), memoryview(n.as_buffer())) for x, k, p, n in zip(*columns)]
        total = pa.concat_tables(each).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        keep = pc.or_(pc.greater_equal(total.column("n_sum"), least), pc.equal(total.column("phrase"), ""))
        return total.filter(keep).rename_columns(["lang", "phrase", "n"])

    made = docs.mapInArrow(run, "part int, langs array<string>, sizes array<long>, phrases binary, counts binary")
    return made.groupBy("part").applyInArrow(add, "lang string, phrase string, n long")


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates (two words or more), by the cut with the least score, then the first."""
    words = F.split("phrase", " ")
    some = counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = some.select("lang", "phrase", "a", "words", k).select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.size("words")).alias("right"))
    with_left = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    both = with_left.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  a product of two such and 10^6 fits in 38 digits
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def longest_inside(counts: DataFrame) -> DataFrame:
    """lang, phrase, longer: the greatest count of a longer candidate in which the phrase (two words or more) lies."""
    words = F.split("phrase", " ")
    some = counts.where(F.instr("phrase", " ") > 0).select("lang", "n", words.alias("words")).where(F.size("words") > 2)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda s: _joined(F.col("words"), s, m))))
    return some.select("lang", "n", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, inside: int = INSIDE, most_cells: int = MOST_CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to longest words by how strongly their parts cling.

    docs has text (null: empty) and lang (null: und), any other columns are not read. Phrases with `least` occurrences
    are candidates; one that lies in a longer candidate with `inside` per cent of its count goes. Ties of the score go to the greater
    count, then to the phrase in byte order. Repeated rows count each. A language without candidates, or an empty table,
    has no rows. top None: all candidates. Counts may have up to 15 digits.
    """
    docs = docs.select(text_of().alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    size = _bytes_of(docs)
    bound = sketches(docs, least, longest, most_cells, size)
    counts = cut(counted(docs, bound, least, longest, size))
    bound.destroy()
    kept = scored(counts).join(longest_inside(counts), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    total = counts.where(F.col("phrase") == "").select("lang", F.col("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # the best of each part of a language first, so that no task ranks a language whole
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
        kept = kept.withColumn("part", F.row_number().over(part)).where(F.col("part") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS size, {" || ' ' || ".join(f"ws[i + {k}]" for k in range(n))} AS phrase FROM q WHERE i + {n - 1} <= len(ws)" for n in range(1, LONGEST + 1))
OP11_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM t),
q AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM p),
g AS ({_GRAMS}),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
w AS (SELECT lang, sum(n)::BIGINT AS total FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE size > 1 AND n >= {LEAST}),
k AS MATERIALIZED (SELECT lang, phrase, a, ws, unnest(generate_series(1, size - 1)) AS k FROM c),
h AS MATERIALIZED (SELECT k.*, x.n AS l FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ')),
s AS (SELECT h.lang, h.phrase, a, k, l, y.n AS r, (1000000 * a * a) // (l * y.n) AS score FROM h JOIN f y ON y.lang = h.lang AND y.phrase = array_to_string(ws[h.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, total, score
  FROM b LEFT JOIN m USING (lang, phrase) JOIN w USING (lang) WHERE m.longer IS NULL OR 100 * m.longer < {INSIDE} * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total AS n, score::BIGINT AS score FROM r WHERE rank <= {TOP}
"""
