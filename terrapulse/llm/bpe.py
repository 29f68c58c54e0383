"""Byte-level BPE in Spark expressions.

Texts are cut into words by the tokenizer's pattern in groups of neighbouring rows, of about ``GROUP`` bytes each. A group is one row: its distinct
words as arrays of their bytes, and each text as places among those words. Higher-order functions fold ranked merges over
every distinct word once: the state is an array of packed integers (rank of the merge with the next piece, byte offset, id), so that its
least element is the leftmost pair of least rank, and each step replaces two pieces and the ranks beside them, until no pair has a rank.
The ranks of pairs are a literal: a perfect hash in two integer arrays, so that a look-up is two reads. Words that stand several times in a sample
of the texts are folded ahead by the same expressions, about ``STORE_WORDS`` at most, so that each group needn't fold them again; what the store holds
changes no result, and every other word is folded in its group. The store is a file of bounded size that each executor fetches once and maps. Texts are put together from their words' ids in the group; no text or word is shuffled, and
a group is all that a task holds. Decoding looks the ids up in a literal array of pieces and concatenates them.

Null texts count as empty: no tokens, and the digests of the empty string. Special tokens are ordinary text. Repeated rows are encoded one by one,
and rows with a null id too. An empty table gives an empty result, and columns other than the id and the text aren't read. Folding costs the square of
a word's length, so words over ``LONG`` bytes are merged with a heap while the group is made; a text is never cut, and one beyond ``GROUP`` is a group of
its own. The vocabulary must have every single byte.
"""

from __future__ import annotations

import base64
import heapq
import json
import mmap
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import discard, lean, materialize, shipped, slices, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text in a group, and of a word that is still folded by expressions.
GROUP, LONG = 8 << 20, 96
#: Bytes of the texts whose words may go into the store of words that are folded ahead, and the words of the store (about 40 bytes each).
SAMPLE, STORE_WORDS = 96 << 20, 500_000
PLAN_TEXT = 1 << 16
#: A packed piece is rank << RANK | byte offset << PLACE | id; NONE is no rank, and what an empty cell of the table gives is above it.
RANK, PLACE, NONE, GONE = 42, 18, 1 << 20, -1
ID, LOW, EMPTY = (1 << PLACE) - 1, (1 << RANK) - 1, 1 << 60


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}


@lru_cache(4)
def table(path: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A perfect hash of pairs of ids: displacements, cells (pair << 20 | rank), and the two primes.

    A pair is first << 18 | second; its cell is at pair % large + displacements[pair % small].
    """
    known = ranks(path)
    if max(known.values(), default=0) > ID:
        raise ValueError(f"ids go up to {max(known.values())}; the packed form holds {ID}")
    pairs, of = [], []
    for token, rank in known.items():
        for i in range(1, len(token)):
            a, b = known.get(token[:i]), known.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a << PLACE | b)
                of.append(rank)
    pair, rank = np.array(pairs, np.int64), np.array(of, np.int64)
    small, large = _prime(len(pair) // 2), _prime(len(pair) * 21 // 20)
    while len(np.unique(pair % small * large + pair % large)) < len(pair):
        large = _prime(large + 1)
    bucket, home = pair % small, pair % large
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(pair) else []
    cells, moves, free = np.full(large, EMPTY, np.int64), np.zeros(small, np.int64), None
    for g in sorted(groups, key=lambda g: -len(g)):
        move = 0
        if len(g) == 1:  # those come last and take the cells that are left
            if free is None:
                free = np.flatnonzero(cells == EMPTY).tolist()
            at = bisect_left(free, int(home[g[0]]))
            if at == len(free):
                free.append(len(cells))
                cells = np.append(cells, EMPTY)
            move = free.pop(at) - int(home[g[0]])
        while len(g) > 1:
            if move + home[g].max() >= len(cells):
                cells = np.concatenate([cells, np.full(64, EMPTY, np.int64)])
            if (cells[home[g] + move] == EMPTY).all():
                break
            move += 1
        moves[bucket[g[0]]] = move
        cells[home[g] + move] = pair[g] << 20 | rank[g]
    return moves, cells, small, large


def _prime(least: int) -> int:
    """The first prime from ``least`` on."""
    n = max(least, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@lru_cache(4)
def exceptions(path: str) -> dict[bytes, int]:
    """Tokens that merging doesn't lead to; a word that is one of them is still that token."""
    known = ranks(path)
    return {t: r for t, r in known.items() if len(t) > 1 and merged(t, known) != [r]}


def merged(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length, by a heap of pairs over a linked list of pieces."""
    end = list(range(1, len(word) + 1))  # of the piece that starts at each place
    before = list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := known.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(len(word) + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= len(word) or gone[j] or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < len(word):
            before[stop] = i
            if (r := known.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := known.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [known[word[i : end[i]]] for i in range(len(word)) if not gone[i]]


def literal(values: np.ndarray) -> Column:
    """A literal array<bigint>, folded to a constant by the optimizer."""
    return F.from_json(F.lit(json.dumps(values.tolist(), separators=(",", ":"))), "array<bigint>")


def short_plans(spark: SparkSession) -> None:
    """Have Spark keep the beginning of plans' texts only: with the literals in full, each is megabytes that the driver holds for every query."""
    key = "spark.sql.maxPlanStringLength"
    now = spark.conf.get(key).lower().rstrip("b")  # with a larger unit it is above the bound
    if not now.isdigit() or int(now) > PLAN_TEXT:
        spark.conf.set(key, str(PLAN_TEXT))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def packed_bytes(words: list[bytes], path: str) -> pa.ListArray:
    """The bytes of each word as packed pieces, each with the rank of its pair with the next byte."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([0, *map(len, words)])
    ids, pairs = byte_tables(path)
    rank = np.full(len(data), NONE, np.int64)
    rank[:-1] = pairs[data[:-1], data[1:]]
    rank[ends[1:] - 1] = NONE
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rank << RANK | place << PLACE | ids[data]))


@lru_cache(4)
def byte_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte, and the rank of each pair of bytes."""
    known = ranks(path)
    one = [bytes([b]) for b in range(256)]
    return np.array([known[b] for b in one], np.int64), np.array([[known.get(a + b, NONE) for b in one] for a in one], np.int64)


def fold_word(word: Column, moves: Column, cells: Column, small: int, large: int) -> Column:
    """The ids of one word, an array<bigint> of packed bytes, by ranked merges."""

    def rank(a: Column, b: Column) -> Column:
        """Of the pair; at least NONE where it has none, and null where one of them is missing."""
        pair = F.shiftleft(a, PLACE).bitwiseOR(b)
        cell = F.get(cells, (pair % large + F.get(moves, (pair % small).cast("int"))).cast("int"))
        return F.least(cell.bitwiseXOR(F.shiftleft(pair, 20)), F.lit(NONE).cast("bigint"))

    def packed(r: Column, rest: Column) -> Column:
        return F.shiftleft(F.coalesce(r, F.lit(NONE).cast("bigint")), RANK).bitwiseOR(rest)

    def merge(state: Column, _: Column) -> Column:
        def joined(least: Column) -> Column:
            new = F.shiftright(least, RANK)

            def at(k: Column) -> Column:  # zero-based place of the right piece, which goes
                def piece(x: Column, i: Column) -> Column:
                    both = packed(rank(new, F.get(state, k + 1).bitwiseAND(ID)), least.bitwiseAND(LOW - ID).bitwiseOR(new))
                    before = packed(rank(x.bitwiseAND(ID), new), x.bitwiseAND(LOW))
                    return F.when(i > k, x).when(i < k - 2, x).when(i == k, F.lit(GONE).cast("bigint")).when(i == k - 1, both).otherwise(before)

                return F.array_remove(F.transform(state, piece), F.lit(GONE).cast("bigint"))

            return F.when(least >= NONE << RANK, state).otherwise(let(F.array_position(state, least).cast("int"), at))

        return let(F.array_min(state), joined)

    # One piece is never merged, and no step is left once one piece is.
    folded = F.aggregate(F.slice(word, F.lit(2), F.lit(LONG)), word, merge)
    return F.transform(folded, lambda x: x.bitwiseAND(ID).cast("int"))


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def cut(texts: list[str | None], find) -> tuple[Places, np.ndarray, np.ndarray]:
    """Distinct words (``find`` gives a text's words), the places among them of all words of all texts, and the ends of each text's words."""
    words, parts = Places(), []
    for t in texts:
        own = find(t) if t else []
        parts.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
    return words, np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([0, *map(len, parts)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges of a start and a size, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def groups(docs: DataFrame, id_col: str, text_col: str, path: str, store: str | None = None) -> DataFrame:
    """Rows of (ids, codes, words, given, sizes), one a group: codes are the places of each text's words, as bytes of int32.

    The group's distinct words that are to be folded come first, as arrays of packed bytes; then those whose ids are given (bytes of int32, with
    their numbers): words in the store of that name, long ones and exceptions.
    """
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = one.schema["id"].dataType.simpleString()
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, special, find = ranks(path), exceptions(path), regex.compile(pattern).findall
        known = mapped(store) if store else Store(bytes(24))

        def own(word: str) -> list[int] | None:
            data = word.encode("utf-8", "surrogatepass")
            return [special[data]] if data in special else merged(data, rank) if len(data) > LONG else None

        for batch in batches:
            for i, j in slices(batch["text"], GROUP):
                words, places, ends = cut(batch["text"].slice(i, j - i).to_pylist(), find)
                at, given = known.find(words), {}
                for k, w in enumerate(words):
                    if (special or len(w) > LONG // 4) and (ids := own(w)) is not None:
                        given[k], at[k] = ids, -2
                # Words to fold come first, then those of the store, then the other given ones.
                order = np.empty(len(at), np.int64)
                order[np.argsort(np.select([at == -1, at >= 0], [0, 1], 2), kind="stable")] = np.arange(len(at))
                folding = packed_bytes([w.encode("utf-8", "surrogatepass") for w, x in zip(words, at.tolist()) if x == -1], path)
                starts, sizes = known.ends[at[at >= 0]], np.diff(known.ends)[at[at >= 0]]
                flat = [np.concatenate([known.ids[spread(starts, sizes)], *given.values()]).astype(np.int32), np.concatenate([sizes, [len(x) for x in given.values()]]).astype(np.int32)]
                codes = order.astype(np.int32)[places] if len(order) else places
                blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(codes)])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch["id"].slice(i, j - i), blobs, folding)]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in flat)], ["ids", "codes", "words", "given", "sizes"])

    return one.mapInArrow(lean(run), f"ids array<{kind}>, codes array<binary>, words array<array<bigint>>, given binary, sizes binary")


def rank_map(path: str) -> Column:
    """The literal of ``table``."""
    moves, cells, _, _ = table(path)
    return F.struct(literal(moves).alias("moves"), literal(cells).alias("cells"))


def folded(rows: DataFrame, path: str, known: Column | None = None) -> DataFrame:
    """``groups`` with the ids of each word in place of its bytes; ``known`` is the rank map where it has been made before."""
    short_plans(rows.sparkSession)
    _, _, small, large = table(path)
    known = rank_map(path) if known is None else known
    words = let(known, lambda k: F.transform("words", lambda w: fold_word(w, k["moves"], k["cells"], small, large)))
    return rows.withColumn("words", words)


class Store:
    """Words that were folded ahead, by their 128-bit hashes: the number of words and of ids, hashes in order (both halves), ends of the ids, ids."""

    def __init__(self, data):
        n, size = np.frombuffer(data, np.int64, 2).tolist()
        self.keys = np.frombuffer(data, np.uint64, n, 16)
        self.checks = np.frombuffer(data, np.uint64, n, 16 + 8 * n)
        self.ends = np.frombuffer(data, np.int64, n + 1, 16 + 16 * n)
        self.ids = np.frombuffer(data, np.int32, size, 24 + 24 * n)

    @staticmethod
    def hashes(words) -> np.ndarray:
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64).reshape(-1, 2)

    @staticmethod
    def build(hashes: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
        _, first = np.unique(hashes[:, 0], return_index=True)
        starts, sizes = ends[:-1][first], np.diff(ends)[first]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        parts = [np.array([len(first), ends[-1]], np.int64), hashes[first, 0], hashes[first, 1], ends, ids[spread(starts, sizes)].astype(np.int32)]
        return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    def find(self, words) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        hashes = self.hashes(words)
        at = np.minimum(np.searchsorted(self.keys, hashes[:, 0]), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes[:, 0]) & (self.checks[at] == hashes[:, 1]), at, -1)


@lru_cache(4)
def mapped(name: str) -> Store:
    """The store in a file that every executor has fetched; the process maps it once."""
    with open(SparkFiles.get(name), "rb") as f:
        return Store(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def frequent(docs: DataFrame, text_col: str, path: str, known: Column | None = None) -> str:
    """The name of a store of words that stand several times in a sample of bounded bytes, folded: this spares folding them in each group again, and changes no result."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    pattern, most = public_tokenizers.PATTERN, max(SAMPLE // max(texts.rdd.getNumPartitions(), 1), 1 << 12)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for b in batches:
            own, held = [], 0
            for t in b["text"]:
                if held >= left:
                    break
                own.append(t.as_py())
                held += len(own[-1])
            words, places, _ = cut(own, regex.compile(pattern).findall)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(np.bincount(places, minlength=len(words)))], ["word", "n"])
            left -= held
            if left <= 0:
                return

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["word"]
            own = own.to_pylist()
            rows = [pa.array([Store.hashes(own).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), packed_bytes([w.encode() for w in own], path))]
            yield pa.RecordBatch.from_arrays(rows, ["hashes", "words"])

    counts = texts.mapInArrow(lean(count), "word string, n long").where(F.octet_length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(spark, counts, "bpe-words")
    least, kept = 2, {r["level"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()}
    while sum(n for level, n in kept.items() if 2 ** (level + 1) > least) > STORE_WORDS:
        least *= 2
    chosen = counts.where(F.col("n") >= least).select("word").repartition(32)
    got = folded(chosen.mapInArrow(lean(lists), "hashes binary, words array<array<bigint>>"), path, known).toArrow()
    discard(spark, counts)
    hashes = np.frombuffer(b"".join(x.as_buffer() for x in got["hashes"]), np.uint64).reshape(-1, 2)
    ids = got["words"].combine_chunks().flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]) if len(ids) else np.zeros(1, np.int64)
    return shipped(spark, "bpe-store", Store.build(hashes, ends, ids.flatten().to_numpy()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids array<int> for every row of ``docs``."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)
    known = rank_map(path)
    rows = folded(groups(docs, id_col, text_col, path, frequent(docs, text_col, path, known)), path, known)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, blobs, words = (b[c].slice(k, 1).flatten() for c in ("ids", "codes", "words"))
                values = np.concatenate([words.flatten().to_numpy(), np.frombuffer(b["given"][k].as_buffer(), np.int32)])
                sizes = np.concatenate([np.diff(words.offsets.to_numpy()), np.frombuffer(b["sizes"][k].as_buffer(), np.int32)]).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                _, where, data = blobs.buffers()
                ends = np.frombuffer(where, np.int32, len(blobs) + 1, 4 * blobs.offset) // 4
                codes = np.frombuffer(data, np.int32)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.int32)
                ends = ends - ends[0]
                at = 0
                while at < len(ids):  # texts of about half a million tokens at a time
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 19), "right")) - 1)
                    own = codes[ends[at] : ends[to]]
                    n = np.concatenate([[0], np.cumsum(sizes[own])])
                    flat = values[spread(starts[own], sizes[own])].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(n[ends[at : to + 1] - ends[at]], pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), lists], ["id", "ids"])
                    at = to

    return rows.mapInArrow(lean(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of an array of ids."""
    known = ranks(path or public_tokenizers.path(VOCABULARY))
    pieces = [""] * (max(known.values(), default=-1) + 1)
    for token, rank in known.items():
        pieces[rank] = token.hex().upper()
    return F.unhex(let(F.from_json(F.lit(json.dumps(pieces)), "array<string>"), lambda known: F.array_join(F.transform(ids, lambda i: F.get(known, i)), "")))


def round_trip(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table with doc_id and text."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256"))
