"""Quality by hierarchical empirical Bayes: a text classifier's evidence with posteriors of its host and path.

A logistic classifier on the rule statistics (fitted on a bounded, hash-ordered sample of labelled rows) gives each
document a likelihood ratio. Labelled counts are summed by host and by path within host over all labels; each level's
strength is set by the spread between its groups (method of moments) and shrinks sparse groups toward the level above. The result
adds both on the log-odds scale. A document's own label is left out of the counts of its host and path, so that its prior rests on other documents alone.
Null hosts and paths are groups of their own. Null texts count as empty. Without labels of both kinds the
evidence is 0 and without labels every prior is one half. Repeated rows are judged one by one and counted once a doc_id, host and path; of repeated labels the
largest counts. An empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import labelled_sample, materialize
from terrapulse.llm.quality_rules import FEATURES, statistics
from terrapulse.llm.toxicity import logistic

#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE, KEEP_FROM = 8192, 0.5
#: Strengths are held between these, in labelled rows.
WEAKEST, STRONGEST = 2.0, 500.0


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float  # log-odds among the rows it was fitted on

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good against bad, held within 8 either way."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.clip(np.column_stack([np.ones(len(z)), z, z * z]) @ self.weights - self.prior, -8, 8)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Classifier | None:
    sample = labelled_sample(labels, "doc_id", "quality", limit)
    one = docs.select("doc_id", "text")
    joined = one.join(F.broadcast(sample), one["doc_id"] == sample["_sample_id"]).select("_sample_id", "text")
    rows = statistics(joined, "_sample_id").join(F.broadcast(sample), F.col("id") == F.col("_sample_id")).select("id", "x", "_label").toPandas()
    rows = rows.drop_duplicates("id").sort_values("id")
    if rows.empty:
        return None
    x, y = np.stack(rows["x"].to_numpy()), (rows["_label"] > 0).to_numpy(float)
    if y.min() == y.max():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    return Classifier(mean, scale, logistic(np.column_stack([np.ones(len(z)), z, z * z]), y, ridge=1.0), float(np.log(y.mean() / (1 - y.mean()))))


def strength(groups: DataFrame, n: str, k: str, center: str) -> float:
    """Beta-binomial strength of a level by moments: one aggregate row over all its groups."""
    d = F.col(k) / F.col(n) - F.col(center)
    r = groups.where(F.col(n) > 0).agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"), F.count("*").alias("g"), F.sum(F.col(n) * d * d).alias("ss"), F.sum(F.col(n) * F.col(center) * (1 - F.col(center))).alias("v")).first()
    if not r["n"] or r["g"] < 2 or not r["v"]:
        return STRONGEST
    v = r["v"] / r["n"]
    spread = (r["ss"] - (r["g"] - 1) * v) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(np.clip(v / spread - 1 if spread > 0 else STRONGEST, WEAKEST, STRONGEST))


def named(column: Column) -> Column:
    """A group's key: null is none of the strings."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def truth(labels: DataFrame) -> DataFrame:
    """_id, _good (0 or 1) of every labelled id."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_good"))
    return one.select("_id", (F.col("_good") > 0).cast("int").alias("_good"))


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> tuple[DataFrame, dict[str, float]]:
    """host, path, n, k, hn, hk (labelled and good documents of each path and host), and the global rate and strengths."""
    keyed = docs.select(F.col("doc_id").alias("_id"), named(host).alias("host"), named(path).alias("path")).distinct()
    paths = keyed.join(truth(labels), "_id", "left").groupBy("host", "path").agg(F.count("_good").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("k"))
    paths = materialize(docs.sparkSession, paths, "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn"), F.sum("hk")).first()
    rate = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    a = strength(hosts.withColumn("center", F.lit(rate)), "hn", "hk", "center")
    # Both sides of later joins are tables or exchanges of their own, so that a large site is split.
    sites = materialize(docs.sparkSession, paths.join(hosts, "host"), "sites")
    b = strength(sites.withColumn("center", (F.col("hk") + a * F.lit(rate)) / (F.col("hn") + a)), "n", "k", "center")
    return sites, {"rate": rate, "host": a, "path": b}


def shrunk(fit: dict[str, float], n: Column, k: Column, hn: Column, hk: Column) -> Column:
    """The path's rate of good documents, shrunk toward its host's, which is shrunk toward the global one."""
    center = (hk + fit["host"] * fit["rate"]) / (hn + fit["host"])
    return (k + fit["path"] * center) / (n + fit["path"])


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, evidence, prior, score, kept for every row; the host is the source and the path its language section."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels)
    sites, sizes = posteriors(docs, labels, host, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = docs.select("doc_id", docs["text"].cast("string").alias("text"), named(host).alias("host"), named(path).alias("path"))
    measured = statistics(one.select(F.struct("doc_id", "host", "path").alias("key"), "text"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].values.to_numpy().reshape(-1, len(FEATURES))[: b.num_rows]
            e = shared.value.evidence(x) if shared.value is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(e)], ["key", "evidence"])

    told = measured.select("id", "x").mapInArrow(run, f"key {measured.schema['id'].dataType.simpleString()}, evidence double")
    told = told.select("key.doc_id", "key.host", "key.path", "evidence")
    told = told.join(truth(labels), told["doc_id"] == F.col("_id"), "left").drop("_id")
    own, good = F.col("_good").isNotNull().cast("int"), F.coalesce("_good", F.lit(0))
    prior = shrunk(sizes, F.col("n") - own, F.col("k") - good, F.col("hn") - own, F.col("hk") - good)
    scored = told.join(sites, ["host", "path"], "left").withColumn("prior", F.coalesce(prior, F.lit(sizes["rate"])))
    logit = F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior")))
    return scored.select("doc_id", "evidence", "prior", (1 / (1 + F.exp(-logit))).alias("score")).withColumn("kept", F.col("score") >= KEEP_FROM)
