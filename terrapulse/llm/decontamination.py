"""Benchmark decontamination by the q-gram lemma, with verification by banded alignment.

Texts are lower-cased, and runs of anything but letters (with their marks) and digits become one space. An item of m bytes that occurs with at most k edits shares
m - q + 1 - kq of its q-grams with the place, on diagonals at most k apart. So a document is looked at closely only where a
stretch holds that many q-grams of items of about that length; there, q-grams are counted by item in overlapping diagonal bands, and
bands that reach the bound are aligned. q is 8, so a q-gram is its own 64-bit key and nothing is lost or made up by hashing.
Null texts count as empty and hold nothing. Items that normalise to fewer than ``MIN_CHARS`` bytes are
looked for as whole words without edits, by a hash of all their bytes; those that normalise to nothing are in no text. Repeated rows of
documents are judged one by one; every distinct text of an item_id is looked for,
and the id is found once with the least edits of its texts. Items without an id are looked for as well; their id is null and comes last. An empty benchmark
is in no document, and an empty table gives an empty result. Whole texts are searched, a very long one in a slice of its own.

Items are indexed in blocks of bounded bytes: the driver makes and broadcasts one block after another, and a task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import lean, slices, small_batches, splitmix, utf8

Q, EDIT_RATE, MIN_CHARS, CLASS_RATIO, TABLE_BITS = 8, 0.08, 24, 1.25, 20
#: Bytes of items that one index may hold and broadcast; more items are looked for in further blocks.
MAX_BLOCK = 16 << 20
SLICE = 2 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _a in (48, 65, 97):
    _n = 10 if _a == 48 else 26
    _FOLD[_a : _a + _n] = np.arange(_n) + (48 if _a == 48 else 97)


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with single spaces, each row between two spaces, and the n + 1 offsets."""
    # Bytes fold what is ASCII; other punctuation is several bytes, so it goes before.
    lower = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, at = utf8(lower)
    if data.max(initial=0) > 127:
        data, at = utf8(pc.replace_substring_regex(lower, r"[^\p{L}\p{N}\p{M}\x00-\x7f]+", " "))
    n = len(at) - 1
    # A space before each row and one after the last keep q-grams and words of neighbours apart.
    framed = np.full(len(data) + n + 1, 32, np.uint8)
    keep = np.ones(len(framed), bool)
    starts = at[:-1] + np.arange(n)
    keep[starts] = False
    keep[-1] = False
    framed[keep] = _FOLD[data]
    space = framed == 32
    stay = ~space
    stay[:-1] |= ~space[1:]
    stay[starts] = True
    stay[-1] = True
    where = np.concatenate([[0], np.cumsum(stay)])
    return framed[stay], np.concatenate([where[starts], [where[-1]]])


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    return x


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def windows(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes from each place as one integer, a hash where they are more than eight; ``keys`` are ``packed``."""
    if n < Q:
        return keys[at] & np.uint64((1 << 8 * n) - 1)
    out = keys[at]
    for k in sorted({*range(Q, n - Q + 1, Q), n - Q} - {0}):
        out = splitmix(out) ^ keys[at + k]
    return out


def aligned(item: np.ndarray, text: np.ndarray, offset: int, width: int) -> int:
    """Least edits of the whole item against any stretch of ``text``, over diagonals offset..offset + width."""
    lo = offset
    j = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)  # column lo + j: free start
    big = 1 << 30
    row[(lo + j < 0) | (lo + j > len(text))] = big
    for i, c in enumerate(item):
        at = lo + i + j  # text position of each cell before this item byte
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(width + 1, bool)
        same[ok] = text[at[ok]] == c
        new = np.where(ok, row + ~same, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(at + 1 < 0) | (at + 1 > len(text))] = big
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


@dataclass
class Index:
    ids: list[int | None]
    items: list[np.ndarray]
    budgets: np.ndarray
    needs: np.ndarray
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each length class: sorted q-grams, their items and places
    table: np.ndarray
    spans: list[tuple[int, int]]  # of each length class: reach of a stretch, q-grams needed
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length of short items between spaces: sorted keys, and items
    whole: list[bytes]  # short items between spaces; they are numbered after the others

    @staticmethod
    def build(rows: list[tuple[int, str | None]]) -> Index:
        rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        data, at = normalise(pa.array([t for _, t in rows], pa.string()))
        ids, items, budgets, needs, short_ids, whole = [], [], [], [], [], []
        for (i, _), a, b in zip(rows, at[:-1], at[1:]):
            body = data[a:b].tobytes().strip()
            if 0 < len(body) < MIN_CHARS:
                short_ids.append(i)
                whole.append(b" " + body + b" ")
            elif body:
                own = np.frombuffer(body, np.uint8)
                m = len(own)
                k = min(int(EDIT_RATE * m), (m - Q) // Q)
                ids.append(i)
                items.append(own)
                budgets.append(k)
                needs.append(m - Q + 1 - k * Q)
        lengths = np.array([len(x) for x in items], float)
        classes = np.floor(np.log(lengths / max(lengths.min(initial=1e18), 1)) / np.log(CLASS_RATIO)).astype(int) if items else np.zeros(0, int)
        classes = np.minimum(classes, 15)
        keys = np.concatenate([packed(x) for x in items]) if items else np.zeros(0, np.uint64)
        sizes = np.array([len(x) - Q + 1 for x in items], np.int64)
        item_of = np.repeat(np.arange(len(items)), sizes)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = np.zeros(1 << TABLE_BITS, np.uint16)
        np.bitwise_or.at(table, slot(keys).astype(np.int64), (1 << classes[item_of]).astype(np.uint16))
        spans = []
        for c in range(16):
            own = np.flatnonzero(classes == c)
            spans.append((max((len(items[i]) + budgets[i] for i in own), default=0), min((needs[i] for i in own), default=0)))
        parts = {}
        for c in set(classes.tolist()):
            own = np.flatnonzero(classes[item_of] == c)
            own = own[np.argsort(keys[own], kind="stable")]
            parts[c] = keys[own], item_of[own], place[own]
        short = {}
        for n in {len(x) for x in whole}:
            own = np.array([i for i, x in enumerate(whole) if len(x) == n])
            data = np.frombuffer(b"".join(whole[i] for i in own) + bytes(Q), np.uint8)
            keys = windows(packed(data), np.arange(len(own)) * n, n)
            order = np.argsort(keys, kind="stable")
            short[n] = keys[order], own[order] + len(items)
        return Index(ids + short_ids, items, np.array(budgets, np.int64), np.array(needs, np.int64), parts, table, spans, short, whole)

    def stretches(self, bits: np.ndarray, row: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(class, row, first, last) of stretches where some class of items has the q-grams it needs."""
        found = []
        for c, (reach, need) in enumerate(self.spans):
            if reach:
                own = np.flatnonzero(bits >> c & 1)
                p, r = pos[own], row[own]
                if len(p) >= need:
                    a = np.flatnonzero((p[need - 1 :] - p[: len(p) - need + 1] < reach) & (r[need - 1 :] == r[: len(r) - need + 1]))
                    if len(a):
                        cut = np.flatnonzero((np.diff(p[a]) > reach) | (np.diff(r[a]) != 0)) + 1
                        found += [(c, int(r[g[0]]), int(p[g[0]]) - reach, int(p[g[-1]]) + 2 * reach) for g in np.split(a, cut)]
        return found

    def search(self, column: pa.Array) -> dict[int, dict[int, int]]:
        """Row -> item index -> least edits, for rows that hold an item within its budget."""
        data, at = normalise(column)
        keys = packed(data)
        bits = self.table[slot(keys).astype(np.int64)] if len(keys) else np.zeros(0, np.uint16)
        hits = np.flatnonzero(bits)
        row = np.searchsorted(at, hits, "right") - 1
        inside = (row >= 0) & (hits + Q <= at[np.minimum(row + 1, len(at) - 1)] + 1)
        hits, row = hits[inside], row[inside]
        out: dict[int, dict[int, int]] = {}
        for c, r, first, last in self.stretches(bits[hits], row, hits):
            first, last = max(first, int(at[r])), min(last, int(at[r + 1]))
            self.confirm(c, data[int(at[r]) : int(at[r + 1])], keys[first : max(first, min(last, len(keys)))], first - int(at[r]), out.setdefault(r, {}))
        self.words(data, at, out)
        return {r: x for r, x in out.items() if x}

    def words(self, data: np.ndarray, at: np.ndarray, out: dict[int, dict[int, int]]) -> None:
        """Short items as whole words of a row."""
        if not self.short:
            return
        keys = packed(np.concatenate([data, np.zeros(MIN_CHARS + Q, np.uint8)]))
        spaces = np.flatnonzero(data == 32)
        rows = np.searchsorted(at, spaces, "right") - 1
        for n, (own, items) in self.short.items():
            inside = (rows < len(at) - 1) & (spaces + n <= at[np.minimum(rows + 1, len(at) - 1)] + 1)
            place, row = spaces[inside], rows[inside]
            here = windows(keys, place, n)
            lo, hi = np.searchsorted(own, here, "left"), np.searchsorted(own, here, "right")
            some = np.flatnonzero(hi > lo)
            # One place for each row and key will do.
            _, first = np.unique(np.stack([row[some], lo[some]]), axis=1, return_index=True)
            for k in some[first]:
                for i in items[lo[k] : hi[k]]:
                    if data[place[k] : place[k] + n].tobytes() == self.whole[i - len(self.items)]:
                        out.setdefault(int(row[k]), {})[int(i)] = 0

    def confirm(self, c: int, text: np.ndarray, keys: np.ndarray, first: int, out: dict[int, int]) -> None:
        """Count the q-grams of a stretch by item of class ``c`` and diagonal band, and align where the count is enough."""
        own_keys, own_item, own_place = self.parts[c]
        lo, hi = np.searchsorted(own_keys, keys, "left"), np.searchsorted(own_keys, keys, "right")
        n = hi - lo
        some = np.flatnonzero(n)
        n, lo = n[some], lo[some]
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = own_item[entry]
        enough = np.bincount(item, minlength=len(self.items)) >= self.needs
        stay = enough[item]
        item, diagonal = item[stay], (np.repeat(some + first, n) - own_place[entry])[stay]
        # Band b of an item covers diagonals b * step .. (b + 2) * step - 1, so that any k + 1 in a row lie in one.
        band = np.floor_divide(diagonal, self.budgets[item] + 1)
        low = int(band.min(initial=0)) - 1
        width = int(band.max(initial=0)) - low + 1
        code, count = np.unique(np.concatenate([item * width + band - low, item * width + band - low - 1]), return_counts=True)
        for x in code[count >= self.needs[code // width]]:
            i, b = int(x // width), int(x % width + low)
            if out.get(i) == 0:
                continue
            k, own = int(self.budgets[i]), self.items[i]
            at = b * (k + 1)
            stretch = text[max(at - k, 0) : max(at + 2 * (k + 1) + len(own) + k, 0)]
            edits = 0 if own.tobytes() in stretch.tobytes() else aligned(own, text, at - k, 2 * (k + 1) + 2 * k)
            if edits <= k:
                out[i] = min(edits, out.get(i, edits))


def blocks(benchmark: DataFrame, most: int = MAX_BLOCK) -> list[Broadcast]:
    """Broadcast indexes over all items, each of about ``most`` bytes at most (but for one long item)."""
    small_batches(benchmark.sparkSession)
    one = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most) or 1
    own = (one.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n))
    return [benchmark.sparkSession.sparkContext.broadcast(Index.build([tuple(r) for r in x.distinct().collect()])) for x in own]


def searched(indexes: list[Broadcast], texts: pa.Array) -> Iterator[tuple[Index, int, dict[int, int]]]:
    """Index, row and its items' edits for every row of ``texts`` that holds an item; of several indexes one is held at a time."""
    for shared in indexes:
        index = shared.value
        for i, j in slices(texts, SLICE):
            for r, got in index.search(texts.slice(i, j - i)).items():
                yield index, i + r, got
        if len(indexes) > 1:
            vars(shared).pop("_value", None)  # it is read again from the executor's store


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BLOCK) -> DataFrame:
    """id, contaminated, items (item ids in order), edits (least edits of each) for every row."""
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    indexes = blocks(benchmark, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items: list[dict] = [{} for _ in range(b.num_rows)]
            for index, r, got in searched(indexes, b["text"]):
                for k, e in got.items():
                    key = index.ids[k]
                    items[r][key] = min(e, items[r].get(key, e))
            sorted_items = [sorted(x.items(), key=lambda p: (p[0] is None, p[0] or 0)) for x in items]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([bool(x) for x in items]), pa.array([[k for k, _ in x] for x in sorted_items], pa.list_(pa.int64())), pa.array([[e for _, e in x] for x in sorted_items], pa.list_(pa.int64()))], ["id", "contaminated", "items", "edits"])

    out = one.mapInArrow(lean(run), f"id {one.schema['id'].dataType.simpleString()}, contaminated boolean, items array<bigint>, edits array<bigint>")
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    indexes = blocks(benchmark)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            texts = b.column(at).cast(pa.string())
            keep[[r for _, r, _ in searched(indexes, texts)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def brute(text: str | None, item: str | None) -> int | None:
    """Least edits of the item anywhere in the text if within its budget, by the full table: for tests."""
    def flat(t):
        data, _ = normalise(pa.array([t or ""], pa.string()))
        return data.tobytes().strip()

    a, t = flat(item), flat(text)
    if len(a) < MIN_CHARS:
        return 0 if a and b" " + a + b" " in b" " + t + b" " else None
    row = [0] * (len(t) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    k = min(int(EDIT_RATE * len(a)), (len(a) - Q) // Q)
    return best if (best := min(row)) <= k else None
