"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Null texts count as empty; an empty text has no spans and the digest of the empty string. Repeated rows are judged
one by one. Spans are in code points, the end exclusive. Every proposed match is either confirmed or dropped; a dropped
match is not tried again at a later start. An empty table gives an empty result. Whole texts are read in time linear in their length, whatever
runs they hold: addresses are proposed from their at signs, and numbers with dots from maximal runs, which gives the leftmost matches of ``EMAIL`` and ``IP``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import lean, small_batches, utf8

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[^0-9]+")
#: Pieces of EMAIL and IP.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")

#: In the order of the digests.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn", "secret")
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact", "write", "schreiben", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "adresse", "log"},
    "card": {"card", "visa", "credit", "karte", "carte", "tarjeta", "payment"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "telefon", "llame", "appelez"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "tax"},
    "secret": {"token", "secret", "key", "api-key", "password", "passwd", "credential", "auth"},
}
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.2, "secret": 0.2}
#: Code points before and after a span whose words count as its context, and what a context word adds.
REACH, CONTEXT_BONUS, KEEP_FROM = 48, 0.4, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _card(m: str) -> bool:
    return 13 <= len(d := DIGIT.sub("", m)) <= 19 and luhn(d)


VALID = {
    "email": lambda m: True,
    "ip": lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split(".")),
    "card": _card,
    "phone": lambda m: 9 <= len(DIGIT.sub("", m)) <= 15,
    "iban": lambda m: 15 <= len(m.replace(" ", "")) <= 34 and mod97(m),
    "secret": lambda m: any(c.isdigit() for c in m) and any(c.isalpha() for c in m),
    "ssn": lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000",
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SOCIAL, "secret": SECRET}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL: the run of local characters before each at sign, from the last match's end on, and a domain after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        free = at + 1  # what stands before this sign belongs to no later address
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """The matches of IP: four parts at a time of each run of numbers with dots."""
    for m in RUN.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i : i + 4])) + 3
                yield at, end
                at = end + 1


def proposed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind in ("email", "ip"):
        return emails(text) if kind == "email" else dotted(text)
    return (m.span() for m in PATTERNS[kind].finditer(text))


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    near = set(re.findall(r"[a-z-]+", around.lower()))
    return min(1.0, PRIOR[kind] + CONTEXT_BONUS * bool(near & CONTEXT[kind]))


def spans(text: str | None, kinds: tuple[str, ...] = BASE + ADDED) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start. Base kinds stay whatever their score is."""
    text = text or ""
    found = []
    for kind in kinds:
        if kind == "phone" and "+" not in text:
            continue
        for start, end in proposed(kind, text):
            if VALID[kind](text[start:end]):
                score = _score(kind, text, start, end)
                if kind in BASE or score >= KEEP_FROM:
                    found.append((kind, start, end, score))
    return found


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """Each maximal run of overlapping spans becomes the bracketed name of its first kind."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def suspects(column: pa.Array) -> np.ndarray:
    """Rows that hold an at sign or a digit; no other row can have a span."""
    data, at = utf8(column)
    hits = np.concatenate([[0], np.cumsum((data == 64) | (data - np.uint8(48) < 10), dtype=np.int64)])
    return np.flatnonzero(hits[at[1:]] > hits[at[:-1]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, found array<struct<kind, start, end, score>>."""
    small_batches(docs.sparkSession)
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list = [[]] * b.num_rows
            for i in suspects(b["text"]):
                found[i] = [dict(zip(("kind", "start", "end", "score"), s)) for s in spans(b["text"][int(i)].as_py())]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(found, kind)], ["id", "found"])

    fields = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    out = one.mapInArrow(lean(run), f"id {one.schema['id'].dataType.simpleString()}, found {fields}")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span replaced; a count of code points, where there is one, follows the text."""
    small_batches(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for b in batches:
            texts = b.column(at).cast(pa.string())
            new = {int(i): redact(t, f) for i in suspects(texts) if (f := spans(t := texts[int(i)].as_py()))}
            if new:
                arrays, values = list(b.columns), texts.to_pylist()
                for i, t in new.items():
                    values[i] = t
                arrays[at] = pa.array(values, pa.string())
                if count_col in columns:
                    k = columns.index(count_col)
                    counts = b.column(k).to_pylist()
                    for i, t in new.items():
                        counts[i] = len(t)
                    arrays[k] = pa.array(counts, b.column(k).type)
                b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
            yield b

    return docs.mapInArrow(lean(run), docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table with doc_id and text."""
    found = F.col("found")

    def text(kinds: tuple[str, ...] | None):
        own = found if kinds is None else F.filter(found, lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return detect(docs).select("doc_id", *counts, F.sha2(text(BASE), 256).alias("base_sha256"), text(None).alias("spans"), F.size(found).cast("long").alias("n_spans"))


def brute_digest(text: str | None) -> tuple:
    """The contract's values for one text, by plain scanning: for tests."""
    base = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        base += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if VALID[kind](m.group())]
    return (*(sum(b[0] == k for b in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest())
