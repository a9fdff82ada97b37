"""Byte-level BPE with given ranks: merges folded by higher-order functions over the bytes of distinct words.

The ranks are a row that a scalar subquery reads: pair (left id, right id) -> id of the merged token, packed as a table
with displaced rows, so that a look-up is two array reads. Words common in the corpus are encoded once for all; what they
leave over is encoded where it stands, once for a slice of texts. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import contextlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tessera.llm.arrow import Numbers, mapped, sums, tidy
from tessera.llm.common import cut, table

#: Words with more bytes are merged with a heap: the fold's time grows with the square of a word's length.
LONGEST_FOLD = 256
_WIDTH = 20
_NONE = 1 << _WIDTH
#: Bytes of text that are split into words at a time.
_SLICE = 1_200_000


@dataclass(frozen=True)
class Ranks:
    """Token bytes by id, and the packed table of merges.

    base[left] + right is the only place in table where the pair can be; the entry (left + 1) << 20 | merged says that it is
    there; a free place holds 0. apart: texts that are tokens although their merges do not lead there; a word equal to
    one is that token.
    """

    tokens: tuple[bytes, ...]
    base: np.ndarray
    table: np.ndarray
    byte_ids: tuple[int, ...]
    apart: dict[str, int]

    def merged(self, left: int, right: int) -> int:
        """The id of the two tokens' concatenation, or _NONE."""
        entry = int(self.table[self.base[left] + right])
        return entry & ((1 << _WIDTH) - 1) if entry >> _WIDTH == left + 1 else _NONE


def pack(rows: dict[int, list[tuple[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places rows (left -> [(right, merged)]) into one array, each shifted so that no two entries meet; size: ids.

    Longer rows go first, each to its least fitting shift; a window of shifts is tried at once, entry by entry.
    """
    base, window = np.zeros(size, dtype=np.int64), 1 << 14
    taken = np.zeros(window + 4 * size + 4 * sum(map(len, rows.values())), dtype=bool)
    out = np.zeros(len(taken), dtype=np.int64)
    begin, length = 0, 0
    for left, pairs in sorted(rows.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        rights = [r for r, _ in pairs]
        if len(pairs) != length:
            begin, length = 0, len(pairs)
        while True:
            blocked = taken[begin + rights[0] : begin + rights[0] + window].copy()
            for r in rights[1:]:
                blocked |= taken[begin + r : begin + r + window]
            at = int(blocked.argmin())
            if not blocked[at]:
                break
            begin += window
        base[left] = begin + at
        spots = base[left] + np.array(rights)
        taken[spots] = True
        out[spots] = [((left + 1) << _WIDTH) | m for _, m in pairs]
    # any base plus any id is a place
    return base, out[: int(base.max(initial=0)) + size + 1]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    """Ranks of a .tiktoken file (base64 bytes and rank a line). Read on the driver; ids must be under 2^20."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return make_ranks(ranks)


def make_ranks(ranks: dict[bytes, int]) -> Ranks:
    """ranks: bytes -> id, all 256 single bytes among them."""
    size = max(ranks.values()) + 1
    tokens, apart = [b""] * size, {}
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        tokens[rank] = token
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
        if not _reached(token, ranks):
            with contextlib.suppress(UnicodeDecodeError):  # a word is made of whole characters
                apart[token.decode()] = rank
    base, packed = pack(rows, size)
    return Ranks(tuple(tokens), base, packed, tuple(ranks[bytes([b])] for b in range(256)), apart)


def _reached(token: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether the token's own merges end in it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        found = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least == _NONE:
            return False
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def _longs(values) -> Column:
    """A literal array: one string, split and cast when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _let(value: Column, body) -> Column:
    """body of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_word(word: Column, ranks: Ranks) -> Column:
    """The ids (array<bigint>) of a word (string, not empty), by folding merges: the pair of least rank, leftmost first.

    The state has an entry for each part of the word: rank of merging it with the next, its place, its id. The least
    entry is the next merge; the fold ends when no pair has a rank.
    """
    # one copy of each literal, however often the expressions below name it
    literals = F.struct(_longs(ranks.base).alias("base"), _longs(ranks.table).alias("packed"), _longs(ranks.byte_ids).alias("first"))
    return _encoded(word, literals)


def _encoded(word: Column, arrays: Column) -> Column:
    return _let(arrays, lambda t: _fold_word(word, t["base"], t["packed"], t["first"]))


def with_arrays(df: DataFrame, ranks: Ranks, name: str = "__ranks") -> DataFrame:
    """df with the arrays of ranks as a column, for one use of it in a projection that drops it: a scalar subquery.

    Spark's optimizer puts the subquery where the column is used, so no row carries it. A plan describes a literal by
    all its values, and the driver keeps the descriptions of past plans; of a subquery it names the columns.
    """
    arrays = {"base": ranks.base, "packed": ranks.table, "first": ranks.byte_ids}
    row = pa.table({k: pa.array([v], type=pa.list_(pa.int64())) for k, v in arrays.items()})
    return df.select("*", df.sparkSession.createDataFrame(row).select(F.struct(*arrays)).scalar().alias(name))


def _fold_word(word: Column, base: Column, packed: Column, first: Column) -> Column:
    low = (1 << _WIDTH) - 1
    none = F.lit(_NONE).cast("bigint")

    def lookup(left: Column, right: Column) -> Column:
        spot = (F.get(base, left.cast("int")) + right).cast("int")
        # another row's entry keeps high bits, and so counts as no rank
        return F.least(F.get(packed, spot).bitwiseXOR(F.shiftleft(left + 1, _WIDTH)), none)

    def entry(rank: Column, rest: Column) -> Column:
        return F.shiftleft(rank, 2 * _WIDTH).bitwiseOR(rest)

    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    ids = F.transform(F.split(latin, ""), lambda c: F.get(first, F.ascii(c)))

    def start(x: Column) -> Column:
        places = F.transform(x, lambda e, i: F.shiftleft(i.cast("bigint"), _WIDTH).bitwiseOR(e))
        following = F.concat(F.slice(x, F.lit(2), F.size(x)), F.array(F.lit(-1).cast("bigint")))
        return F.zip_with(places, following, lambda e, r: F.when(r < 0, entry(none, e)).otherwise(entry(lookup(e.bitwiseAND(low), r), e)))

    def merge(acc: Column, least: Column) -> Column:
        rank = F.shiftright(least, 2 * _WIDTH)

        def at(p: Column) -> Column:
            p = p.cast("int")
            before, after = F.get(acc, p - 2), F.get(acc, p + 1)
            kept = F.shiftleft(F.shiftright(least, _WIDTH).bitwiseAND(low), _WIDTH).bitwiseOR(rank)
            own = F.when(after.isNull(), entry(none, kept)).otherwise(entry(lookup(rank, after.bitwiseAND(low)), kept))
            left = entry(lookup(before.bitwiseAND(low), rank), before.bitwiseAND((1 << 2 * _WIDTH) - 1))
            rest = F.size(acc) - p - 1
            tail = F.slice(acc, p + 2, rest)
            # one concatenation a step, of no more pieces than there are
            first = F.when(rest > 0, F.concat(F.array(own), tail)).otherwise(F.array(own))
            second = F.when(rest > 0, F.concat(F.array(left, own), tail)).otherwise(F.array(left, own))
            head = F.slice(acc, F.lit(1), p - 2)
            later = F.when(rest > 0, F.concat(head, F.array(left, own), tail)).otherwise(F.concat(head, F.array(left, own)))
            return F.when(p > 2, later).when(p > 1, second).otherwise(first)

        return _let(F.array_position(acc, least), at)

    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc), lambda least: F.when(least < _NONE << 2 * _WIDTH, merge(acc, least)).otherwise(acc))

    def fold(x: Column) -> Column:
        return F.aggregate(F.slice(x, F.lit(2), F.size(x)), start(x), step, lambda acc: F.transform(acc, lambda e: e.bitwiseAND(low)))

    return _let(ids, fold)


def heap_encode(word: bytes, ranks: Ranks) -> list[int]:
    """The same ids in time n log n: for words over LONGEST_FOLD bytes."""
    ids: list[int] = [ranks.byte_ids[b] for b in word]
    after = [*range(1, len(ids)), -1]
    before = [*range(-1, len(ids) - 1)]
    heap = [(m, i) for i in range(len(ids) - 1) if (m := ranks.merged(ids[i], ids[i + 1])) < _NONE]
    heapq.heapify(heap)
    while heap:
        m, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or ranks.merged(ids[i], ids[j]) != m:
            continue
        ids[i], ids[j], after[i] = m, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (n := ranks.merged(m, ids[after[i]])) < _NONE:
                heapq.heappush(heap, (n, i))
        if before[i] >= 0 and (n := ranks.merged(ids[before[i]], m)) < _NONE:
            heapq.heappush(heap, (n, before[i]))
    return [i for i in ids if i >= 0]


def _java(pattern: str) -> str:
    """The pattern with Unicode's white space, as the tokenizer's own engine reads \\s."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def _python(pattern: str) -> str:
    """The same for Python's regex module."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def common_words(docs: DataFrame, pattern: str, ranks: Ranks, most: int) -> list[pa.RecordBatch]:
    """word, ids: at most `most` words that occur twice or more in docs' texts, the most frequent first, encoded.

    Counts cover all texts. A histogram of counts (powers of 2^(1/16)) gives the least count of which all words fit, so
    nothing is sorted; at most `most` rows reach the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_java(pattern)), F.lit(0))).alias("word"))
    words = words.where((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST_FOLD))
    level = F.floor(F.log2("count") * 16).cast("int")
    counted = cut(words.groupBy("word").count().where("count > 1").select("word", level.alias("level")))
    room, least = most, 1 << 30
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    coded = with_arrays(counted.where(F.col("level") >= least), ranks).select("word", _encoded(F.col("word"), F.col("__ranks")).cast("array<int>").alias("ids"))
    return coded.toArrow().to_batches(max_chunksize=1 << 16)


class Known:
    """The common words in a few flat arrays, found by hash and then compared as text."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(_hashes(b.column("word").to_pylist()) for b in batches)])
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[order]
        place = pa.array(order)
        self.words = pa.concat_arrays([pa.array([], type=pa.string()), *(b.column("word").cast(pa.string()) for b in batches)]).take(place)
        ids = pa.concat_arrays([pa.array([], type=pa.list_(pa.int32())), *(b.column("ids").cast(pa.list_(pa.int32())) for b in batches)])
        batches.clear()  # what follows needs room
        ids = ids.take(place)
        self.flat = np.array(ids.flatten(), dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(_lengths(ids), dtype=np.int64)]).astype(np.int32)

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word, or -1."""
        out = np.full(len(words), -1, dtype=np.int64)
        if len(self.hashes) and words:
            h = _hashes(words)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            same = pc.equal(self.words.take(pa.array(at[hit])), pa.array([words[i] for i in hit], type=pa.string()))
            hit = hit[same.to_numpy(zero_copy_only=False)]
            out[hit] = at[hit]
        return out


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern; texts in Latin-1 alone go through Python's faster re, with the classes written out."""
    full = regex.compile(_python(pattern)).findall
    try:
        quick = re.compile(_latin(pattern)).findall
    except (re.error, ValueError):
        return full

    def find(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return full(text)
        return quick(text)

    return find


def _latin(pattern: str) -> str:
    """The pattern with \\p{...} and \\s as lists of Latin-1 characters; ValueError for classes it can't write out."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        if found := re.match(r"\\(p\{\w+\}|[sS])", pattern[at:]):
            name = found[0].replace("s", "p{White_Space}").replace("S", "p{White_Space}") if found[1] in "sS" else found[0]
            listed = "".join(re.escape(chr(c)) for c in range(256) if regex.match(name, chr(c)))
            if inside and found[1] == "S":
                raise ValueError(found[0])
            out.append(listed if inside else f"[{'^' * (found[1] == 'S')}{listed}]")
            at += len(found[0])
            continue
        if pattern[at] == "\\":
            if pattern[at + 1].isalnum():
                raise ValueError(pattern[at : at + 2])
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(docs: DataFrame, ranks: Ranks, pattern: str, most: int = 1 << 20, packed: bool = False) -> DataFrame:
    """docs (text, any other columns) with ids array<int>, which replaces a column of that name.

    Each match of pattern is encoded separately, without special tokens; a null or empty text has no ids. Words common
    to the corpus (at most `most`, a bound on what is broadcast) are folded once; each other word is folded where it
    occurs, once for a slice of a few MB of texts, so nothing but word counts is shuffled. Every row keeps its place
    and its other columns; repeated rows are encoded alike. Words over LONGEST_FOLD bytes go through a heap.
    With packed, text gives way to ids_le (little-endian unsigned 32-bit integers) and decoded (the bytes that the ids
    decode to, the tokens' bytes concatenated) in place of ids.
    """
    spark = docs.sparkSession
    table_of = spark.sparkContext.broadcast(ranks)
    known = Known(common_words(docs, pattern, ranks, most))
    shared = spark.sparkContext.broadcast(known)
    del known  # the tasks read it from the broadcast's file
    tidy()

    def split(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        """__refs: for each piece its place among the common words, or -1 - its place in the slice's own words."""
        find, known, codes = splitter(pattern), shared.value, Numbers()
        number = codes.__getitem__
        pieces = [list(map(number, find(t))) for t in texts]
        distinct, apart = list(codes), table_of.value.apart
        place = known.places(distinct)
        if apart:
            place[[k for k, w in enumerate(distinct) if w in apart]] = -1
        other = np.flatnonzero(place < 0)
        short = np.array([len(distinct[i].encode("utf-8", "surrogatepass")) <= LONGEST_FOLD and distinct[i] not in apart for i in other], dtype=bool)
        ready = [[apart[distinct[i]]] if distinct[i] in apart else heap_encode(distinct[i].encode("utf-8", "surrogatepass"), table_of.value) for i in other[~short]]
        order = np.concatenate([other[short], other[~short]]) if len(other) else other
        place[order] = -1 - np.arange(len(order))
        count = np.array([len(p) for p in pieces], dtype=np.int64)
        code = np.fromiter(chain.from_iterable(pieces), dtype=np.int64, count=int(count.sum()))
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        none = [[]] * (len(texts) - 1)
        return {
            "__refs": pa.ListArray.from_arrays(pa.array(ends), pa.array(place[code].astype(np.int32))),
            "__rest": pa.array([[distinct[i] for i in other[short]]] + none, type=pa.list_(pa.string())),
            "__long": pa.array([ready] + none, type=pa.list_(pa.list_(pa.int32()))),
        }

    rows = docs.drop("ids", "ids_le", "decoded") if packed else docs.drop("ids")
    kept = [f for f in rows.schema.fields if not packed or f.name != "text"]
    listed = mapped(rows, "text", split, "__refs array<int>, __rest array<string>, __long array<array<int>>", _SLICE, keep_text=not packed)
    own = F.concat(F.transform("__rest", lambda w: _encoded(w, F.col("__ranks")).cast("array<int>")), "__long")
    folded = with_arrays(listed, ranks).withColumn("__own", own).drop("__rest", "__long", "__ranks")
    names = [f.name for f in kept]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = shared.value, table_of.value.tokens
        last, last_sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        for batch in batches:
            ends = np.cumsum(_lengths(batch.column("__refs")))
            begin = 0
            while begin < batch.num_rows:
                done = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + 250_000, side="right")))
                part = batch.slice(begin, end - begin)
                begin = end
                # a row's own words serve it and the rows after it, up to the next row that carries some
                own, carried = part.column("__own").flatten(), _lengths(part.column("__own"))
                sizes, values = _lengths(own), own.flatten().to_numpy(zero_copy_only=False)
                carries = np.flatnonzero(carried)
                base = np.concatenate([[0], len(last_sizes) + np.cumsum(carried[carries]) - carried[carries]])
                mine, mine_sizes = np.concatenate([last, values]), np.concatenate([last_sizes, sizes])
                if len(carries):
                    last_sizes = sizes[len(sizes) - carried[carries[-1]] :]
                    last = values[len(values) - last_sizes.sum() :]
                count = _lengths(part.column("__refs"))
                refs = part.column("__refs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                common, at = refs >= 0, np.repeat(base[np.cumsum(carried > 0)], count) - 1 - refs
                at[common] = refs[common]
                n, start = np.empty_like(at), np.empty_like(at)
                start[common] = known.starts[at[common]]
                n[common] = known.starts[at[common] + 1] - start[common]
                n[~common] = mine_sizes[at[~common]]
                start[~common] = len(known.flat) + (np.cumsum(mine_sizes) - mine_sizes)[at[~common]]
                total = sums(n, count)
                spot = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                inside = spot < len(known.flat)
                ids = np.empty(len(spot), dtype=np.int32)
                ids[inside] = known.flat[spot[inside]]
                ids[~inside] = mine[spot[~inside] - len(known.flat)]
                stops = np.concatenate([[0], np.cumsum(total)])
                columns = [part.column(k) for k in names]
                if packed:
                    raw, listed_ids = ids.astype("<i4").tobytes(), ids.tolist()
                    columns.append(pa.array([raw[4 * a : 4 * b] for a, b in zip(stops, stops[1:])], type=pa.binary()))
                    columns.append(pa.array([b"".join(map(tokens.__getitem__, listed_ids[a:b])) for a, b in zip(stops, stops[1:])], type=pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids_le", "decoded"])
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids)))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"])
        tidy()

    made = [StructField("ids_le", BinaryType()), StructField("decoded", BinaryType())] if packed else [StructField("ids", ArrayType(IntegerType()))]
    return folded.mapInArrow(join, StructType([*kept, *made]))


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of ids (array<int>): the concatenation of the tokens' bytes."""
    literal = F.split(F.lit(",".join(p.hex() for p in ranks.tokens)), ",")
    return _let(literal, lambda hexes: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")))


def public_ranks() -> tuple[Ranks, str]:
    """Ranks and pattern of the public vocabulary that the query and the pipeline use (read on the driver)."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


#: Columns that digests adds.
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Of encode's packed columns: the columns of keep, n_tokens, and the digests of the ids and of the decoded bytes."""
    return encoded.select(
        *keep,
        F.floor(F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded again."""
    ranks, pattern = public_ranks()
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, packed=True)
    return digests(encoded, "doc_id")
