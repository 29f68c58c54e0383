"""URL filters by a sorted digest array: memory-mapped xxhash keys, binary search, confirmation by the full string.

A rule is (host, path prefix, verdict). It fits its host and all subdomains where the url's path starts with the
rule's; the longest rule wins, then the first listed. Rule strings are host + path. Null urls and urls without ``://`` have an empty
host and path, which no rule fits. Urls that no rule fits get the verdict of the blocklist ((host, path prefix) pairs that fit
as rules do, kept in the same array), which is ``allow`` where it doesn't list them. Repeated rows are judged one by one; an empty table gives an empty result.

The array is one read-only file in the shared folder. Each executor fetches it once, and all its Python workers map the same pages of it, so that a list
of any length costs a machine its file's size once; only the head of the file is read into memory. Of a url, only suffixes of its host and prefixes of its path
that are as long as some entry's are probed, so that very long urls cost time in proportion to their length.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import shipped

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The blocklist of the registered query: hosts of unwanted kinds, bare or numbered, under the reserved example domains.
KINDS, TOP, NUMBERS = ("ads", "casino", "cheap-pills", "free-money", "tracker"), ("com", "net", "org"), 10_000
HEAD = 4


def unwanted() -> list[tuple[str, str]]:
    return [(f"{kind}{n or ''}.example.{top}", "") for kind in KINDS for top in TOP for n in range(NUMBERS)]


class DigestArray:
    """Entries sorted by digest, in one buffer.

    Layout: the numbers of entries, of shapes, and of bytes before the strings, and a zero; n uint64 digests; n + 1 int64 offsets; n int64 values; shapes
    (lengths of host and path of the entries); then the strings.
    """

    def __init__(self, data):
        n, shapes, self.at, _ = np.frombuffer(data, np.int64, HEAD).tolist()
        self.data, self.n = data, n
        self.keys = np.frombuffer(data, np.uint64, n, 8 * HEAD)
        self.offsets = np.frombuffer(data, np.int64, n + 1, 8 * (HEAD + n))
        self.values = np.frombuffer(data, np.int64, n, 8 * (HEAD + 2 * n + 1))
        self.shapes: dict[int, list[int]] = {}
        for host, path in np.frombuffer(data, np.int64, 2 * shapes, 8 * (HEAD + 3 * n + 1)).reshape(-1, 2).tolist():
            self.shapes.setdefault(host, []).append(path)
        self.longest = max(self.shapes, default=0)

    @staticmethod
    def build(entries: list[tuple[str, str]], values: list[int]) -> bytes:
        rows = sorted((xxhash.xxh64_intdigest(key(*e)), i) for i, e in enumerate(entries))
        strings = [key(*entries[i]) for _, i in rows]
        shapes = sorted({(len(h), len(p)) for h, p in entries})
        offsets = np.cumsum([0, *map(len, strings)]).astype(np.int64)
        numbers = [np.array([h for h, _ in rows], np.uint64), offsets, np.array([values[i] for _, i in rows], np.int64), np.array(shapes, np.int64).ravel()]
        body = b"".join(x.tobytes() for x in numbers)
        return np.array([len(rows), len(shapes), 8 * HEAD + len(body), 0], np.int64).tobytes() + body + b"".join(strings)

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """The value of each string, or -1: vectorised binary search, then the stored string is compared."""
        out = np.full(len(strings), -1, np.int64)
        if not self.n or not strings:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, digests, "left")
        for i in np.flatnonzero(self.keys[np.minimum(at, self.n - 1)] == digests):
            j = int(at[i])
            while j < self.n and self.keys[j] == digests[i]:  # equal digests of unlike strings stand side by side
                a, b = (self.offsets[j : j + 2] + self.at).tolist()
                if self.data[a:b] == strings[i]:
                    out[i] = self.values[j]
                    break
                j += 1
        return out

    def candidates(self, host: str, path: str) -> Iterator[tuple[str, str]]:
        """Every (suffix of whole labels, prefix of the path) of a url that is as long as an entry's."""
        start = max(0, len(host) - self.longest)
        if start:
            start = host.find(".", start - 1) + 1 or len(host)
        while start < len(host):
            for n in self.shapes.get(len(host) - start, ()):
                if n <= len(path):
                    yield host[start:], path[:n]
            start = host.find(".", start) + 1 or len(host)


@lru_cache(4)
def mapped(name: str) -> DigestArray:
    """The array in a file that every executor has fetched; the process maps it once."""
    with open(SparkFiles.get(name), "rb") as f:
        return DigestArray(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def key(host: str, path: str) -> bytes:
    """Host and path with a separator that neither has."""
    return f"{host}\0{path}".encode("utf-8", "surrogatepass")


def split(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends, default=len(rest))]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, blocklist: list[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for every row."""
    rules = list(RULES if rules is None else rules)
    first: dict[tuple[str, str], int] = {}
    for i, (h, p, _) in enumerate(rules):
        first.setdefault((h, p), i)
    entries = list(first) + [b for b in dict.fromkeys(map(tuple, blocklist)) if b not in first]
    name = shipped(pages.sparkSession, "url-filter", DigestArray.build(entries, [first.get(e, -2) for e in entries]))
    one = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = mapped(name)
        for b in batches:
            hosts, paths, strings, owner = [], [], [], []
            for i, url in enumerate(b["url"].to_pylist()):
                h, p = split(url)
                hosts.append(h)
                paths.append(p)
                for c in digest.candidates(h, p):
                    strings.append(key(*c))
                    owner.append(i)
            best: dict[int, tuple] = {}
            listed = set()
            for i, v in zip(owner, digest.probe(strings)):
                if v == -2:
                    listed.add(i)
                elif v >= 0:
                    h, p, _ = rules[v]
                    best[i] = max(best.get(i, (-1, 0)), (len(h) + len(p), -int(v)))
            rule = [rules[-best[i][1]] if i in best else None for i in range(len(hosts))]
            verdict = [r[2] if r else "block" if i in listed else "allow" for i, r in enumerate(rule)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([r and r[0] + r[1] for r in rule], pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    out = one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM u
), r(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.])(ads|casino|cheap-pills|free-money|tracker)([1-9][0-9]{0,3})?[.]example[.](com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id
"""
