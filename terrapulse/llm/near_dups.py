"""Near copies by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded, then verified.

A text is the multiset of its five-word shingles (lower-cased, split at white space; a shorter text with a word is one
shingle). A shingle of weight w takes part with the points of a Poisson process on (0, w]: one process for each dyadic block
of weights, whose points carry a position in the block and a register, so that a smaller weight sees a subset of a larger weight's points. Each
register keeps its least point; two signatures agree in a register with the probability of their weighted Jaccard similarity.
Generation stops once a process is past every register of its text.

Exact copies are put together first by digest, with sums made before the shuffle, and only one of them goes on. Texts that share a band are compared with the band's first text, its leader. Where
the texts of a leader then still lie in several classes, those of different classes meet by a prefix filter over their differences from
the leader: two texts of the least similarity differ in so few elements that they share most of what sets them apart from it, so
each meets only texts that share one of the rarest such elements. No link between texts that share a leader is lost, and
a large group of copies costs a comparison a text and band. Similarities are computed exactly, on whole texts. Classes are the connected components.
Tables that a large group is joined with are written first, so that each such join stands between two exchanges and its large groups are split.

Null texts count as empty; empty texts, and texts of white space only where equal, are exact copies of each other and have no near copies. Rows with a
null doc_id belong to no class (null class_id, kept). Repeated rows (doc_id and text) appear once. A doc_id that stands on several texts has a row for each, and
these needn't share a class: one of them goes by the doc_id, and the others by a number from 2 ** 62 on, which class_id gives only where no text of the class goes by a
doc_id. A text of any length is a row of its own slice; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import WHITE, discard, lean, materialize, slices, small_batches, splitmix, utf8

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 8 registers: texts of similarity 0.8 share a band with probability 0.997, of 0.5 with 0.12.
BANDS, ROWS = 32, 8
REGISTERS = BANDS * ROWS
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _forget() -> None:
    """The tables go with the task: they are as long as the longest text that it met."""
    _powers.clear()


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count, sorted by row, of the shingle multisets of a slice."""
    data, at = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    word = ~WHITE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    own = word[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[own], ends[own]
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    words = splitmix((sums[ends] - sums[starts]) * down[starts])
    row = np.searchsorted(at, starts, "right") - 1
    sizes = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(sizes) - sizes
    mix = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(len(words), np.uint64)
        part[: max(len(words) - k, 0)] = words[k:]
        # Words beyond the text count as none: only texts shorter than a shingle have such.
        part[np.arange(len(words)) + k >= (first + sizes)[row]] = 0
        mix = splitmix(mix * np.uint64(_BASE) + part + np.uint64(k))
    place = np.arange(len(words)) - first[row]
    valid = place <= np.maximum(sizes - SHINGLE, 0)[row]
    row, mix = row[valid], mix[valid]
    order = np.lexsort((mix, row))
    row, mix = row[order], mix[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mix[1:] != mix[:-1])
    at = np.flatnonzero(new)
    return row[at], mix[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (rows x registers) of weighted sets; infinity for rows without shingles."""
    best = np.full(rows * registers, np.inf)
    # Dyadic blocks of weights: (0, 1], (1, 2], (2, 4], (4, 8] ... as far as each weight goes.
    blocks = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(row)), blocks)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.where(block > 0, 1 << np.maximum(block - 1, 0), 1)
    reach = count[owner] - np.where(block > 0, length, 0)  # leaves of the block that the weight covers
    key = splitmix(shingle[owner] + block.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    owner_row, at, step = row[owner], np.zeros(len(owner)), np.zeros(len(owner), np.uint64)
    while len(owner_row):
        n = int(np.clip(40_000 // len(owner_row), 1, 64))
        t = step[:, None] + np.arange(1, n + 1, dtype=np.uint64)
        r = splitmix(key[:, None] + t * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log1p(-((r >> np.uint64(11)) * 2.0**-53)) / length[:, None]
        x = at[:, None] + (np.cumsum(gap, axis=1) if n > 1 else gap)
        r = splitmix(r ^ np.uint64(0xA0761D6478BD642F))
        register = (r % np.uint64(registers)).astype(np.int64)
        leaf = ((r >> np.uint64(20)) % length[:, None].astype(np.uint64)).astype(np.int64)
        seen = leaf < reach[:, None]
        np.minimum.at(best, (owner_row[:, None] * registers + register)[seen], x[seen])
        most = best.reshape(rows, registers).max(1)
        on = x[:, -1] < most[owner_row]
        owner_row, key, length, reach, at, step = owner_row[on], key[on], length[on], reach[on], x[on, -1], step[on] + np.uint64(n)
    return best.reshape(rows, registers)


def bands(registers: np.ndarray) -> np.ndarray:
    """One int64 key for each row and band."""
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, -1)
    out = np.tile(np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE), (len(registers), 1))
    for k in range(bits.shape[2]):
        out = splitmix(out * np.uint64(0xD1B54A32D192ED03) + bits[:, :, k])
    return out.view(np.int64)


def band_keys(docs: DataFrame) -> DataFrame:
    """key, digest, keys (the bands; none without a word) for each row of (key, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b["text"], SLICE):
                part = b.slice(i, j - i)
                row, shingle, count = shingles(part["text"])
                some = np.bincount(row, minlength=part.num_rows) > 0
                keys = bands(signatures(row, shingle, count, part.num_rows))[some]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(some * BANDS)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part["key"], part["digest"], lists], ["key", "digest", "keys"])

    return docs.mapInArrow(lean(run, _forget), "key long, digest binary, keys array<bigint>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted shingles, counts)."""
    at = np.searchsorted(b[0], a[0])
    at = np.minimum(at, max(len(b[0]) - 1, 0))
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum() if len(b[0]) and len(a[0]) else 0
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    row, shingle, count = shingles(column)
    cuts = np.searchsorted(row, np.arange(len(column) + 1))
    return [(shingle[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of the pairs that reach ``least``; exact, on whole texts."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch["text_b"], SLICE):
                part = batch.slice(i, j - i)
                ids = part["a"].to_numpy()
                firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # rows of one text of the left side mostly follow each other
                group = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
                a, b = bags(part["text_a"].take(pa.array(firsts))), bags(part["text_b"])
                s = np.array([similarity(a[g], y) for g, y in zip(group, b)])
                yes = pa.array(np.flatnonzero(s >= least))
                yield pa.RecordBatch.from_arrays([part["a"].take(yes), part["b"].take(yes), pa.array(s).take(yes)], ["a", "b", "similarity"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(run, _forget), "a long, b long, similarity double")


def differences(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """``placed`` (a leader a, a text b, inside, label) with n and m (shingles of b and a), and the elements that only b (fresh) or only a (lost) has.

    An element is a shingle with its place among equal shingles, so that sets of elements stand for multisets of shingles.
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        shingle, count = bag
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return splitmix(np.repeat(shingle, count) + place.astype(np.uint64) * np.uint64(_BASE))

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch["text_b"], SLICE):
                part = batch.slice(i, j - i)
                ids = part["a"].to_numpy()
                firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                group = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
                a, b = [elements(x) for x in bags(part["text_a"].take(pa.array(firsts)))], [elements(x) for x in bags(part["text_b"])]
                fresh, lost = lists([np.setdiff1d(y, a[g], True) for g, y in zip(group, b)]), lists([np.setdiff1d(a[g], y, True) for g, y in zip(group, b)])
                sizes = [pa.array([len(y) for y in b], pa.int64()), pa.array([len(a[g]) for g in group], pa.int64())]
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], part["inside"], part["label"], *sizes, fresh, lost], ["a", "b", "inside", "label", "n", "m", "fresh", "lost"])

    both = placed.join(right, "b").join(left, "a").select("a", "b", "inside", "label", "text_a", "text_b")
    return both.mapInArrow(lean(run, _forget), "a long, b long, inside boolean, label long, n long, m long, fresh array<bigint>, lost array<bigint>")


def across(star: DataFrame, texts: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of texts that share a leader, lie in different classes and may reach ``least``: none that does is left out.

    Texts of n and n' elements reach ``least`` if at most delta = (n + n') (1 - least) / (1 + least) elements are in one of them only. With d and d' elements
    that are in the text or its leader only, they share at least (d + d' - delta) / 2 of those. In any common order one
    of these is then among the first (d - d' + delta) / 2 + 1 of the one text and the first (d' - d + delta) / 2 + 1 of the other. One text of such a pair isn't of the
    leader's class (inside), so it isn't linked to it and d' > (n' + m) (1 - least) / (1 + least) there, which bounds the first number from above.

    The order of a leader's elements is: those that it lacks, from the rarest on, then those that it has, from the rarest on. What only one text has
    takes a place, but nothing meets there, so such elements are only counted.
    """
    spark, rate = star.sparkSession, (1 - least) / (1 + least)
    of = labels.select(F.col("id").alias("b"), F.col("label"))
    placed = star.join(of, "b", "left").select("a", "b", F.coalesce("label", "b").alias("label"))
    heads = labels.select(F.col("id").alias("a"), F.col("label").alias("head"))
    sides = placed.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).join(heads, "a", "left")
    mixed = materialize(spark, sides.withColumn("head", F.coalesce("head", "a")).where("low <> high or low <> head").select("a", "head"), "mixed-leaders")
    inside = placed.join(mixed, "a").select("a", "b", (F.col("label") == F.col("head")).alias("inside"), "label")
    apart = materialize(spark, differences(inside, texts), "differences")
    d, new = F.size("fresh") + F.size("lost"), F.size("fresh")
    near = F.floor((d + (F.col("n") - F.col("m")) * rate) / 2 + 1e-6) + 1
    far = F.floor(F.col("n") * (1 + 1 / least) * rate + 1e-6) + 1
    upto = F.greatest(F.lit(0), F.when(F.col("inside"), F.least(near, far)).otherwise(far)).cast("int")
    sized = apart.withColumns({"d": d, "near": near, "upto": upto, "new": new})
    of = ("a", "b", "n", "d", "inside", "label", "near", "upto", "new")
    rows = sized.select(*of, F.explode("fresh").alias("e"))
    shared = materialize(spark, rows.groupBy("a", "e").agg(F.count("*").alias("times")).where("times > 1"), "shared-differences")
    ranked = rows.join(shared, ["a", "e"]).groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("order"))
    alone = F.col("new") - F.size("order")
    heads = ranked.select(*of, alone.alias("at"), F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("upto") - alone))["e"].alias("own"))
    beyond = sized.select(*of, "lost").where("upto > new")
    # A leader has no more such elements than shingles. What no text outside lacks comes before the others, as nothing meets there.
    common = beyond.where("not inside").select("a", F.explode("lost").alias("e")).groupBy("a", "e").agg(F.count("*").alias("times"))
    common = materialize(spark, common.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("all")), "lost-differences")
    met = beyond.join(common, "a").select(*of, F.size("lost").alias("lost"), F.array_intersect(F.col("all.e"), "lost").alias("own"))
    met = met.withColumn("at", F.col("new") + F.col("lost") - F.size("own"))
    tails = met.select(*of, "at", F.slice("own", F.lit(1), F.greatest(F.lit(0), F.col("upto") - F.col("at"))).alias("own"))
    # Written before they are spread out: a task of the joins holds as many texts as a leader has, those that read them equally many bytes.
    first = materialize(spark, heads.union(tails), "first-differences")
    kept = first.select(*of, "at", F.posexplode("own").alias("pos", "e")).withColumn("place", F.col("pos") + F.col("at")).drop("pos", "at")
    kept = materialize(spark, kept, "rare-differences")
    left = kept.where("not inside").select("a", "e", *(F.col(c).alias(f"x_{c}") for c in ("b", "n", "d", "label", "near", "place")))
    right = kept.where("place < near").select("a", "e", *(F.col(c).alias(f"y_{c}") for c in ("b", "n", "d", "label", "inside", "place")))
    delta = (F.col("x_n") + F.col("y_n")) * rate + 1e-6
    sizes = F.least("x_n", "y_n") >= least * F.greatest("x_n", "y_n")
    places = (2 * F.col("x_place") <= F.col("x_d") - F.col("y_d") + delta) & (2 * F.col("y_place") <= F.col("y_d") - F.col("x_d") + delta)
    once = F.col("y_inside") | (F.col("x_b") < F.col("y_b")) & (F.col("x_place") < F.col("x_near"))
    met = left.join(right, ["a", "e"]).where((F.col("x_label") != F.col("y_label")) & sizes & places & once)
    met = materialize(spark, met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct(), "cross-pairs")
    for used in (mixed, apart, shared, common, first, kept):
        discard(spark, used)
    return met


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, label (least id of the component) for every id in ``edges`` (a, b): least neighbours with pointer jumping.

    Each round ends in the shared folder, so that no round depends on an executor's disk.
    """
    spark = edges.sparkSession
    both = materialize(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(spark, both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialize(spark, met.join(jump, "label").select("id", "old", F.least("label", "further").alias("label")), name)
        discard(spark, labels)
        labels = new.select("id", "label")
        if not new.where("old <> label").limit(1).count():
            discard(spark, both)
            return labels


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, digest, text of the rows with a doc_id; a key belongs to one text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    rows = rows.withColumns({"digest": F.unhex(F.md5("text")), "hash": F.xxhash64("text")})
    several = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("hash").alias("_own"), F.max("hash").alias("_last")).where("_own <> _last").drop("_last")
    several = materialize(docs.sparkSession, several, "ids-of-several-texts")
    other = F.xxhash64("doc_id", "hash").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    key = F.when(F.col("_own").isNull() | (F.col("_own") == F.col("hash")), F.col("doc_id")).otherwise(other)
    return rows.join(several, rows["doc_id"] == several["_id"], "left").select(key.alias("key"), "doc_id", "digest", "text")


def link(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_id (key of the first of the exact copies), class_id, kept, digest: one row per doc_id and text.

    ``docs`` has doc_id (integer) and text; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs)
    signed = band_keys(rows.select("key", "digest", "text"))
    # Copies have equal bands, so that any of them will do; each task hands on one row a text.
    texts = materialize(spark, signed.groupBy("digest").agg(F.min("key").alias("text_id"), F.count("*").alias("times"), F.first("keys").alias("keys")), "texts")
    banded = texts.select(F.col("text_id").alias("id"), F.explode("keys").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("band", "leader")
    leaders = materialize(spark, leaders, "leaders")
    pairs = materialize(spark, banded.join(leaders, "band").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    discard(spark, leaders)
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # The same plan at every size: a side that grows with the corpus isn't left to be broadcast where it happens to be small.
    bodies = rows.select(F.col("key").alias("id"), "text")
    bodies = materialize(spark, bodies.join(involved.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")
    star = materialize(spark, verified(pairs, bodies, 0.0), "star-links")
    discard(spark, pairs)
    labels = components(star.where(F.col("similarity") >= least).select("a", "b"))
    found = materialize(spark, verified(across(star, bodies, labels, least), bodies, least).select("a", "b"), "cross-links")
    labels = merged(labels, found)
    discard(spark, star)
    discard(spark, bodies)
    classes = texts.join(labels.withColumnRenamed("id", "text_id"), "text_id", "left").where("times > 1 or label is not null")
    classes = materialize(spark, classes.select(F.col("digest").alias("_digest"), "text_id", F.coalesce("label", "text_id").alias("class_id")), "classes")
    discard(spark, texts)
    members = rows.groupBy("key", "doc_id", "digest").count()
    out = members.join(classes, members["digest"] == classes["_digest"], "left")
    out = out.select("doc_id", F.coalesce("text_id", "key").alias("text_id"), F.coalesce("class_id", "key").alias("class_id"), (F.col("key") == F.coalesce("class_id", "key")).alias("kept"), "digest")
    none = F.lit(None).cast("long")
    nulls = docs.where("doc_id is null").select(none.alias("doc_id"), none.alias("text_id"), none.alias("class_id"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("digest"))
    return out.union(nulls)


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after further links (a, b), by the components of the graph whose nodes are the classes."""
    spark = labels.sparkSession
    if not found.limit(1).count():
        return labels
    ends = [labels.select(F.col("id").alias(end), F.col("label").alias(f"label_{end}")) for end in "ab"]
    between = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    above = components(between.where("a <> b").distinct(), "classes-components").select(F.col("id").alias("_old"), F.col("label").alias("_new"))
    moved = labels.join(above, labels["label"] == above["_old"], "left").select("id", F.coalesce("_new", "label").alias("label"))
    lone = above.join(labels, above["_old"] == labels["id"], "left_anti").select(F.col("_old").alias("id"), F.col("_new").alias("label"))
    return materialize(spark, moved.union(lone), "labels")


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of its first key, with all columns; rows with a null doc_id stay. Of repeated rows (doc_id and text) any one stays."""
    spark = docs.sparkSession
    classes = link(docs, least).where("doc_id is not null")
    gone = classes.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest"))
    digest = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    out = docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (digest == gone["_digest"]), "left_anti")
    twice = docs.groupBy(docs["doc_id"].cast("long").alias("_id"), digest.alias("_digest")).count().where("count > 1 and _id is not null").select("_id", "_digest")
    twice = materialize(spark, twice, "repeated-rows")
    if not twice.limit(1).count():
        return out
    same = (out["doc_id"].cast("long") == twice["_id"]) & (digest == twice["_digest"])
    once, more = out.join(twice, same, "left_anti"), out.join(twice, same)
    return once.union(more.dropDuplicates(["_id", "_digest"]).drop("_id", "_digest"))


def brute(texts: dict[int, str], least: float = SIMILARITY) -> dict[int, int]:
    """Class of each doc by comparing all pairs: for tests."""
    ids = sorted(texts)
    own = dict(zip(ids, bags(pa.array([texts[i] or "" for i in ids], pa.string()))))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (texts[i] or "") == (texts[j] or "") or similarity(own[i], own[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}
