"""Language identification by interpolated Kneser-Ney character models, one per language, kept as sorted arrays.

Counts come from every training row: words of lower-cased letters (Unicode's, so neither numerals nor superscripts), padded, cut into character 4-grams, all of which are kept.
A 4-gram is its context of three characters, packed by 21 bits each, and its last character. Lower orders are continuation counts of the order above. A text gets the language with the lowest cross-entropy a
character; texts whose best cross-entropy lies beyond a calibrated cut are marked as rejected. Null texts and texts
without a letter are ``und`` with score 0 and rejected. Ties go to the first language by name. Rows without a language
aren't trained on; without any training row every text is ``und``. Repeated rows count and are judged one by one. An empty table gives an empty result.
Whole texts are read, in time linear in their length but for the distinct words' look-ups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import discard, fold, lean, materialize, slices, small_batches

WORD = re.compile(r"[^\W\d_]+")
ORDER, START, STOP = 4, "\x02\x02\x02", "\x03"
#: 4-grams that the driver fetches at once; a language that has more comes alone.
FETCHED_GRAMS = 1 << 21
#: Distinct words that a task holds before it turns them into n-gram counts, and bins a nat of the entropies that the rejection cut is set on.
HELD_WORDS, BINS, MARGIN, SHARPNESS = 100_000, 1000, 0.75, 40
#: Bytes of text that are scored at once.
SLICE = 3 << 19
BITS = np.uint64(21)
LETTER = np.uint64((1 << 21) - 1)
MASK = [np.uint64((1 << 21 * n) - 1) for n in range(4)]


def words_of(text: str | None) -> Counter:
    """The words of a text and how often each stands in it. What the pattern takes for word characters but Unicode not for letters parts words."""
    bag = Counter(WORD.findall(text.lower())) if text else Counter()
    for w in [w for w in bag if not w.isalpha()]:
        n = bag.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            bag[part] += n
    return bag


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and last characters of the 4-grams of padded words in order, and how many each word has."""
    codes = np.frombuffer("".join([f"{START}{w}{STOP}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(words), np.int64)
    last = codes[3:]
    inside = last != 2
    context = codes[2:-1] | codes[1:-2] << BITS | codes[:-3] << BITS * np.uint64(2)
    return context[inside], last[inside], np.fromiter(map(len, words), np.int64, len(words)) + 1


def narrow(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """4-grams of the basic plane by 16 bits a character."""
    a, b, c = context >> np.uint64(42), context >> BITS & LETTER, context & LETTER
    return a << np.uint64(48) | b << np.uint64(32) | c << np.uint64(16) | last


def widen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and last characters of what ``narrow`` packed."""
    low = np.uint64(0xFFFF)
    return keys >> np.uint64(48) << np.uint64(42) | (keys >> np.uint64(32) & low) << BITS | keys >> np.uint64(16) & low, keys & low


def distinct(context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and last characters of the distinct 4-grams in order, and the place of each given one among them."""
    if max(int(last.max(initial=0)), *(int((context >> np.uint64(n) & LETTER).max(initial=0)) for n in (0, 21, 42))) <= 0xFFFF:
        unique, inverse = np.unique(narrow(context, last), return_inverse=True)
        return *widen(unique), inverse
    contexts, rank = np.unique(context, return_inverse=True)
    unique, inverse = np.unique(rank.astype(np.uint64) << BITS | last, return_inverse=True)
    return contexts[(unique >> BITS).astype(np.int64)], unique & LETTER, inverse


def tally(context: np.ndarray, last: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context, last, inverse = distinct(context, last)
    return context, last, np.bincount(inverse, weights, len(last)).astype(np.int64)


@dataclass
class Level:
    """One order: sorted n-grams with discounted numerators, sorted contexts with totals and back-off masses.

    The key of an n-gram is the place of its context in ``contexts`` and its last character, so it is exact for any alphabet.
    """

    keys: np.ndarray
    top: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    back: np.ndarray

    @staticmethod
    def of(context: np.ndarray, last: np.ndarray, counts: np.ndarray) -> Level:
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
        contexts, at, types = np.unique(context, return_index=True, return_counts=True)
        keys = np.repeat(np.arange(len(contexts), dtype=np.uint64), types) << BITS | last
        total = np.add.reduceat(counts, at).astype(float) if len(at) else np.zeros(0)
        return Level(keys, counts - discount, contexts, total, discount * types)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Model:
    languages: list[str]
    levels: dict[str, list[Level]]
    symbols: int
    cut: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def build(counts: Iterable[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        """From language, contexts, last characters and counts of each language, one after another."""
        levels, seen = {}, np.zeros(0, np.uint64)
        for lang, context, last, n in counts:
            order = np.lexsort((last, context))
            context, last, n = context[order], last[order], n[order]
            own = [Level.of(context, last, n)]
            for width in (3, 2, 1):
                context, last, n = tally(context & MASK[width - 1], last)
                own.append(Level.of(context, last, n))
            seen = np.union1d(seen, last)
            levels[lang] = own
        return Model(sorted(levels), levels, len(seen) + 1)

    def probabilities(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """``chances`` of 4-grams of the basic plane, packed by 16 bits a character."""
        return self.chances(lang, *widen(keys))

    def chances(self, lang: str, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney probability of the last character of each 4-gram."""
        p = np.full(len(last), 1.0 / self.symbols)
        for level, width in zip(reversed(self.levels[lang]), (1, 2, 3, 4)):
            c, there = find(level.contexts, context & MASK[width - 1])
            at, known = find(level.keys, c.astype(np.uint64) << BITS | last)
            known &= there
            with np.errstate(divide="ignore", invalid="ignore"):
                q = (np.where(known, level.top[at], 0.0) + level.back[c] * p) / level.total[c] if len(level.total) else p
            p = np.where(there, q, p)
        return p

    def entropies(self, bags: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each bag of words under each language, and the characters of each bag."""
        ids: dict[str, int] = {}
        rows, words, times = [], [], []
        for i, bag in enumerate(bags):
            words += [ids.setdefault(w, len(ids)) for w in bag]
            times += bag.values()
            rows.append(len(bag))
        context, last, lengths = grams(list(ids))
        context, last, inverse = distinct(context, last)
        ends = np.cumsum(lengths)
        word, times, row = np.array(words, np.int64), np.array(times, float), np.repeat(np.arange(len(bags)), rows)
        chars = np.bincount(row, lengths[word] * times, len(bags)) if len(word) else np.zeros(len(bags))
        out = np.zeros((len(bags), len(self.languages)))
        for j, lang in enumerate(self.languages):
            cost = np.concatenate([[0.0], np.cumsum(-np.log(self.chances(lang, context, last))[inverse])])
            own = cost[ends] - cost[ends - lengths]
            if len(word):
                out[:, j] = np.bincount(row, own[word] * times, len(bags))
        return out / np.maximum(chars, 1)[:, None], chars

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, rejected and cross-entropy of each text."""
        bags = [words_of(t) for t in texts]
        if not self.languages:
            return ["und"] * len(bags), np.zeros(len(bags)), np.ones(len(bags), bool), np.zeros(len(bags))
        h, chars = self.entropies(bags)
        best = h.argmin(1) if len(h) else np.zeros(0, int)
        low = h[np.arange(len(h)), best]
        share = np.exp(-(h - low[:, None]) * np.minimum(chars, SHARPNESS)[:, None])
        score = 1 / share.sum(1)
        none = chars == 0
        cut = np.array([self.cut.get(x, np.inf) for x in self.languages])
        langs = ["und" if x else self.languages[b] for x, b in zip(none, best)]
        return langs, np.where(none, 0.0, score), none | (low > cut[best]), low


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, context, last, n: 4-gram counts of all rows of (text, lang); summed inside each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, bag in bags.items():
                context, last, lengths = grams(list(bag))
                context, last, n = tally(context, last, np.repeat(np.fromiter(bag.values(), float, len(bag)), lengths))
                for i in range(0, len(n), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[part]), pa.string()), pa.array(context[part].astype(np.int64)), pa.array(last[part].astype(np.int32)), pa.array(n[part])], ["lang", "context", "last", "n"])
            bags.clear()

        for b in batches:
            for i, j in slices(b["text"], SLICE):
                part = b.slice(i, j - i)
                for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist()):
                    if text:
                        bags.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, bags.values())) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(lean(run), "lang string, context long, last int, n long").groupBy("lang", "context", "last").agg(F.sum("n").alias("n"))


def fetched(counts: DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, contexts, last characters and counts of all 4-grams of each language, some languages at once."""
    groups, held = [[]], 0
    for lang, n in sorted(tuple(r) for r in counts.groupBy("lang").count().collect()):
        if groups[-1] and held + n > FETCHED_GRAMS:
            groups.append([])
            held = 0
        groups[-1].append(lang)
        held += n
    for group in filter(None, groups):
        table = counts.where(F.col("lang").isin(group)).toArrow().to_pandas()
        for lang, g in table.groupby("lang"):
            yield str(lang), g["context"].to_numpy().astype(np.uint64), g["last"].to_numpy().astype(np.uint64), g["n"].to_numpy()


def calibrate(rows: DataFrame, model: Model) -> dict[str, float]:
    """The 0.999 quantile, to a bin's upper edge, of the entropies of all rows of (text, lang) that get their own language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Counter = Counter()
        for b in batches:
            for i, j in slices(b["text"], SLICE):
                part = b.slice(i, j - i)
                langs, _, _, low = shared.value.judge(part["text"].to_pylist())
                bins.update((own, int(x * BINS)) for own, lang, x in zip(part["lang"].to_pylist(), langs, low) if own == lang and x > 0)
        keys = list(bins)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int64()), pa.array(list(bins.values()), pa.int64())], ["lang", "bin", "n"])

    histograms: dict[str, list[tuple[int, int]]] = {}
    for lang, at, n in rows.mapInArrow(lean(run), "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n")).collect():
        histograms.setdefault(lang, []).append((at, n))
    shared.unpersist()
    out = {}
    for lang, own in histograms.items():
        at, n = np.array(sorted(own)).T
        upto = np.cumsum(n)
        out[lang] = float(at[np.searchsorted(upto, 0.999 * upto[-1])] + 1) / BINS
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train=None) -> Model:
    """A model from every row of ``docs`` with a language where ``train`` (a condition, all by default) holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs if train is None else docs.where(train)
    rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = materialize(spark, count_grams(rows), "language-grams")
    model = Model.build(fetched(counts))
    discard(spark, counts)
    if model.languages:
        worst = calibrate(rows, model)
        ceiling = float(np.log(model.symbols))
        for lang in model.languages:
            own = worst.get(lang, ceiling)
            model.cut[lang] = own + MARGIN * max(ceiling - own, 0.0)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected, entropy for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b["text"], SLICE):
                part = b.slice(i, j - i)
                langs, score, rejected, low = shared.value.judge(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(langs, pa.string()), pa.array(score), pa.array(rejected), pa.array(low)], ["id", "lang_pred", "score", "rejected", "entropy"])

    out = one.mapInArrow(lean(run), f"id {one.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, entropy double")
    return out.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(at).cast(pa.string()), SLICE):
                part = b.slice(i, j - i)
                _, _, rejected, _ = shared.value.judge(part.column(at).cast(pa.string()).to_pylist())
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(lean(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned where crc32(doc_id) mod 5 isn't 0, predicted for every row."""
    held = fold("doc_id", 5) == 0
    out = predict(docs, fit(docs, train=~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "entropy")
