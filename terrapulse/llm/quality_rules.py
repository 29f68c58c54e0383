"""Quality rules: counts of a text's words, lines and repeats, judged by fixed bounds and an isolation forest.

The forest is fitted on the rule statistics of every labelled good row that passes the bounds, and its threshold is set on every labelled row that passes them;
documents with short average path lengths are anomalous and are not kept. Cuts are random; a path's length is its mean over all draws of
``LEAF_SAMPLE`` good rows, which follows from how many good rows each node holds, so no draw is made. Null texts count as
empty: no words, so base_failed. Repeated rows count and are judged one by one; rows that share an id share its label. Without labelled rows of both kinds, no document is called
anomalous. Labels only choose the good rows and the threshold; bad rows don't shape the trees. An empty table gives an empty result. Whole texts are read, in linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import discard, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Trees, rows of the draws that path lengths are means over, and bins of the scores that the threshold lies between (a power of two).
TREES, LEAF_SAMPLE, SEED, BINS = 128, 256, 7, 1 << 16
#: Rows that go down the trees at once.
ROWS = 2048
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_word", "exclaims_word", "upper_share", "alpha_share", "mean_word", "dup_lines", "repeats", "distinct", "stops_word", "longest_word")


def repeat_words(words: list[str]) -> int:
    """Words inside five-word windows that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(windows) < 2 or len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the ten statistics of a text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen, dup, filled = set(), 0, 0
    for line in lines:
        if line and WORD.search(line):
            filled += 1
            dup += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    k = max(n, 1)
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    statistics = [
        symbols / k, (text.count("!") + text.count("?")) / k, upper / k, alpha / k, chars / k, dup / max(filled, 1),
        repeats / k, len(set(words)) / max(1.0, n**0.8), (text.count(".") + text.count(",")) / k, min(max(map(len, words), default=0), 100) / 10,
    ]
    return [n, chars, symbols, dup, repeats], statistics


def _c(n: np.ndarray | float):
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: the feature (-1 at a leaf), cut, children, and a leaf's path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / norm): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while (inner := self.feature[t][node] >= 0).any():
                f = np.maximum(self.feature[t][node], 0)
                step = np.where(x[rows, f] < self.cut[t][node], self.left[t][node], self.right[t][node])
                node = np.where(inner, step, node)
            total += self.length[t][node]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.norm)


def plant(low: np.ndarray, high: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and cuts of complete trees of random splits of a box; the children of node i are 2 i + 1 and 2 i + 2.

    Cuts are drawn from a node's part of the box, not from the range of its rows, so that empty parts of the box are cut off early and what falls there has
    a short path. A box without extent isn't split.
    """
    rng = np.random.default_rng(seed)
    wide = np.flatnonzero(high > low)
    levels = depth if len(wide) else 0
    feature, cut = np.zeros((trees, (1 << levels) - 1), np.int8), np.zeros((trees, (1 << levels) - 1))
    for t in range(trees):
        lows, highs = low[None], high[None]
        for d in range(levels):
            own, n = slice((1 << d) - 1, (2 << d) - 1), np.arange(1 << d)
            f = rng.choice(wide, len(n))
            at = rng.uniform(lows[n, f], highs[n, f])
            feature[t, own], cut[t, own] = f, at
            lows, highs = np.repeat(lows, 2, 0), np.repeat(highs, 2, 0)
            highs[2 * n, f] = lows[2 * n + 1, f] = at
    return feature, cut


def places(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The last node, counted from 0 in its level, that each row reaches in each of the complete trees."""
    tree, rows = np.arange(len(feature)), np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(feature)), np.int64)
    inner = feature.shape[1]
    while inner and node[0, 0] < inner:
        node = 2 * node + 1 + (x[rows, feature[tree, node]] >= cut[tree, node])
    return node - inner


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = np.array([math.lgamma(i + 1) for i in range(256)])
    m = np.maximum(n, 256).astype(float)
    return np.where(n < 256, small[np.clip(n, 0, 255)], m * np.log(m) - m + np.log(2 * np.pi * m) / 2 + 1 / (12 * m) - 1 / (360 * m**3))


def drawn(mass: np.ndarray, n: int, psi: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all draws of ``psi`` of ``n`` rows without replacement, for nodes of ``mass`` rows: the share of draws with two of a node's rows or more, and the mean of ``_c`` of their number."""
    values, inverse = np.unique(mass, return_inverse=True)
    k = np.arange(psi + 1)
    c, ways = _c(k), _log_factorial(k) + _log_factorial(psi - k)
    every = _log_factorial(np.array(n)) - _log_factorial(np.array(n - psi)) - _log_factorial(np.array(psi))
    often, mean = np.zeros(len(values)), np.zeros(len(values))
    for i in range(0, len(values), 4096):
        m = values[i : i + 4096, None]
        log = _log_factorial(m) - _log_factorial(m - k) + _log_factorial(n - m) - _log_factorial(n - m - psi + k) - ways - every
        p = np.where((k <= m) & (psi - k <= n - m), np.exp(np.minimum(log, 0)), 0.0)
        often[i : i + 4096], mean[i : i + 4096] = np.minimum(p[:, 2:].sum(1), 1), p @ c
    return often[inverse].reshape(mass.shape), mean[inverse].reshape(mass.shape)


def settle(feature: np.ndarray, cut: np.ndarray, mass: np.ndarray, psi: int = LEAF_SAMPLE) -> Forest:
    """The forest of complete trees whose last nodes hold ``mass`` good rows; a path ends at nodes of one row or none.

    A path goes on below a node in the draws that have two of its rows or more. Its length, the mean over all draws of ``psi`` good rows, is the sum of
    these shares over the nodes above its end, and at the last level the mean correction for the rows drawn there.
    """
    trees, last = mass.shape
    n = int(mass[0].sum())
    psi, held = min(psi, n), [mass]
    while held[0].shape[1] > 1:
        held.insert(0, held[0].reshape(trees, -1, 2).sum(2))
    reached, sums = np.zeros((trees, 1)), []
    for m in held[:-1]:
        sums.append(np.where(m < 2, reached, 0.0))
        reached = np.repeat(reached + drawn(m, n, psi)[0], 2, 1)
    length = np.concatenate([*sums, reached + drawn(mass, n, psi)[1]], 1)
    held = np.concatenate(held, 1)
    inner = (held >= 2) & (np.arange(held.shape[1]) < last - 1)
    there = np.concatenate([np.ones((trees, 1), bool), np.repeat(inner[:, : last - 1], 2, 1)], 1)
    at = there.cumsum(1) - 1
    size = int(at[:, -1].max()) + 1
    out = Forest(np.full((trees, size), -1, np.int8), np.zeros((trees, size)), np.zeros((trees, size), np.int32), np.zeros((trees, size), np.int32), np.zeros((trees, size)), max(float(_c(psi)), 1e-9))
    for t in range(trees):
        node, leaf = np.flatnonzero(inner[t]), np.flatnonzero(there[t] & ~inner[t])
        out.feature[t, at[t, node]], out.cut[t, at[t, node]] = feature[t, node], cut[t, node]
        out.left[t, at[t, node]], out.right[t, at[t, node]] = at[t, 2 * node + 1], at[t, 2 * node + 2]
        out.length[t, at[t, leaf]] = length[t, leaf]
    return out


def calibrate(at: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = 0.995) -> float:
    """The cut with the best balanced accuracy among those that keep ``keep`` of the good rows, of the numbers of rows whose scores times BINS round up to ``at``."""
    order = np.argsort(at)
    at, good, bad = at[order], good[order], bad[order]
    kept, found = good.cumsum() / good.sum(), 1 - bad.cumsum() / bad.sum()
    gain = np.where(kept >= keep, kept + found, -1.0)
    i = int(np.argmax(gain >= gain.max() - 1e-12))
    # Midway between the cut's bin and the next one that holds a score, so that neither side is at the edge.
    return float((at[i] + (at[i + 1] - 1 if i + 1 < len(at) else at[i])) / 2 / BINS)


SCHEMA = "id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five counts and the statistics as array x, one row per row of ``docs``."""
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b["text"]]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            x = pa.array([r[1] for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["id"], *counts, x], ["id", *COUNTS, "x"])

    return one.mapInArrow(run, SCHEMA.format(id=one.schema["id"].dataType.simpleString()))


def failed(n_words, n_repeat_words):
    """The fixed bounds: too few words, or over a fifth of them inside repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, len(FEATURES))


def masses(rows: DataFrame, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many of all rows of (x) reach each last node of the complete trees."""
    shape = (len(feature), feature.shape[1] + 1)
    shared = rows.sparkSession.sparkContext.broadcast((feature, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.zeros(shape[0] * shape[1], np.int64), np.arange(shape[0]) * shape[1]
        for b in batches:
            x = matrix(b["x"])
            for i in range(0, len(x), ROWS):
                held += np.bincount((places(x[i : i + ROWS], *shared.value) + first).ravel(), minlength=len(held))
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(held[slot])], ["slot", "n"])

    got = rows.select("x").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(shape, np.int64)
    out.ravel()[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def histogram(rows: DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores times BINS, rounded up, and the numbers of good and of bad ones among all rows of (x, good)."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BINS + 1), np.int64)
        for b in batches:
            at = np.ceil(shared.value.score(matrix(b["x"])) * BINS).astype(np.int64)
            good = b["good"].to_numpy(zero_copy_only=False)
            held += np.stack([np.bincount(at[k], minlength=BINS + 1) for k in (good, ~good)])
        at = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(h[at]) for h in held)], ["at", "good", "bad"])

    got = rows.mapInArrow(run, "at int, good long, bad long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    shared.unpersist()
    return tuple(got[c].to_numpy() for c in ("at", "good", "bad"))


def learn(measured: DataFrame, labels: DataFrame, psi: int = LEAF_SAMPLE) -> Forest | None:
    """Forest and threshold from every row of ``statistics`` that has a label and passes the bounds; of a repeated id's labels the largest counts."""
    spark = measured.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") > 0).alias("good"))
    rows = measured.where(~failed(F.col("n_words"), F.col("n_repeat_words"))).join(one, F.col("id") == F.col("_id")).select("x", "good")
    rows = materialize(spark, rows, "quality-labelled")
    features = [F.when(F.col("good"), F.col("x")[i]) for i in range(len(FEATURES))]
    n, n_good, *box = rows.agg(F.count("*"), F.count_if("good"), *map(F.min, features), *map(F.max, features)).first()
    forest = None
    if 0 < n_good < n:
        low, high = np.array(box).reshape(2, -1)
        feature, cut = plant(low, high, math.ceil(math.log2(max(min(psi, n_good), 2))) + 4)
        forest = settle(feature, cut, masses(rows.where("good"), feature, cut), psi)
        forest.threshold = calibrate(*histogram(rows, forest))
    discard(spark, rows)
    return forest


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold from every labelled row of ``docs``."""
    measured = materialize(docs.sparkSession, statistics(docs), "quality-statistics")
    forest = learn(measured, labels)
    discard(docs.sparkSession, measured)
    return forest


def decide(measured: DataFrame, forest: Forest | None, id_col: str = "doc_id") -> DataFrame:
    """The counts, base_failed, kept and the anomaly score of every row of ``statistics``."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)
    kind = measured.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n, repeats = (b[c].to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
            x = matrix(b["x"])
            bad = failed(n, repeats)
            score = model.score(x) if model is not None and len(x) else np.zeros(len(x))
            odd = score > (model.threshold if model is not None else 2.0)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", *COUNTS)), pa.array(bad), pa.array(~bad & ~odd), pa.array(score)], ["id", *COUNTS, "base_failed", "kept", "anomaly"])

    fields = f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return measured.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, base_failed, kept and the anomaly score of every row."""
    return decide(statistics(docs, id_col, text_col), forest, id_col)


def identify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with the forest of the labelled rows; texts are measured once."""
    measured = materialize(docs.sparkSession, statistics(docs), "quality-statistics")
    return decide(measured, learn(measured, labels))
