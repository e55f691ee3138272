"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts, unlabelled is any text. A text's features are its words
and the first letters of its longer words; those over-represented among positives are kept.
A linear model is trained in numpy on the risk  p * R(positives as toxic) + max(0, R(unlabelled
as clean) - p * R(positives as clean))  with class prior p and the sigmoid loss; where the
bracket is negative its gradient is reversed, so a flexible model can't drive it below zero.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.llm.common import bound_batches, kept_by, texts, trim
from mediaframe.llm.tokens import in_slices, slices

#: Letters of a word's beginning that count as a feature.
HEADS = (4, 5, 6)
#: Positives that must hold a feature.
SUPPORT = 5
_WORD = re.compile(r"[^\W\d_]+")
KEPT_RUNS = 50_000


def of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in HEADS if len(word) > n)]


def features(text: str) -> set[str]:
    """Of a whole text, whatever its length: which words it has, not how often."""
    return {f for w in set(_WORD.findall(text.lower())) for f in of_word(w)}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    @cached_property
    def name(self) -> str:
        """A digest of the features and their weights."""
        return hashlib.sha256(repr(sorted(self.weights.items())).encode()).hexdigest()

    def score(self, text: str | None) -> float:
        """0 to 1; a null text is an empty one."""
        known, own = _kept(self), set()
        for run in set((text or "").lower().split()):
            found = known.get(run)
            if found is None:
                found = known[run] = tuple({f for w in _WORD.findall(run) for f in of_word(w) if f in self.weights})
            if found:
                own.update(found)
        z = self.bias + sum(self.weights[f] for f in sorted(own))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _kept(model: Model) -> dict[str, tuple[str, ...]]:
    """What runs of characters hold, as far as this worker has seen them under these features."""
    name, all_ = model.name, kept_by("toxicity")
    known = all_.get(name)
    if known is None or len(known) > KEPT_RUNS:
        all_.clear()
        known = all_[name] = {}
    return known


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; rows are texts, columns 0/1 features."""
    w, b = np.zeros(positive.shape[1]), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    slope = lambda z: (s := 1 / (1 + np.exp(-np.clip(z, -50, 50)))) * (1 - s)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        rest = sig(zu).mean() - prior * sig(zp).mean()
        dp, du = -prior * slope(zp) / len(zp), np.zeros(len(zu))
        clean_p, clean_u = -prior * slope(zp) / len(zp), slope(zu) / len(zu)
        if rest >= 0:
            dp, du = dp + clean_p, du + clean_u
        else:
            dp, du = -clean_p, -clean_u
        g = np.concatenate([positive.T @ dp + unlabelled.T @ du + decay * w, [dp.sum() + du.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4_000, most_unlabelled: int = 12_000, most_features: int = 512) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that aren't held out count, and of the
    tables' other columns none. The class prior is the share of toxic rows among all labelled ones;
    positives and unlabelled texts are the first most_positive and most_unlabelled in the order of a
    hash of doc_id, which bounds what is fitted on. Feature counts over them are a Spark aggregation;
    the driver gets most_features names and the 0/1 rows. Without labels, texts or positives the
    model scores every text near 0. A doc_id that repeats gives all its texts."""
    docs = texts(docs).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    prior = known.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    if not prior:
        return Model()
    prior = min(0.95, prior)
    first = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = first(known.where("y > 0"), most_positive).withColumn("y", F.lit(1)).union(first(docs, most_unlabelled).withColumn("y", F.lit(0)))
    sample = docs.join(F.broadcast(ids), "doc_id").select("y", "text")  # a bounded number of ids
    sample = sample.persist()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ys, text in in_slices(batch):
                for y, t in zip(ys, text, strict=True):
                    own = list(features(t))
                    yield pa.record_batch([pa.array([y] * len(own), pa.int32()), pa.array(own, pa.string())], names=["y", "feature"])

    sizes = dict(sample.groupBy("y").count().collect())
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_unl:
        return Model()
    p, u = F.sum("y") / n_pos, F.sum(1 - F.col("y")) / n_unl
    top = sample.mapInArrow(explode, "y int, feature string").groupBy("feature").agg(F.sum("y").alias("n"), p.alias("p"), u.alias("u")).where(F.col("n") >= min(SUPPORT, n_pos))
    lift = (F.col("p") - F.col("u")) / F.sqrt(F.col("u") * (1 - F.col("u")) / n_pos + 1.0 / (n_pos * n_pos))
    names = [r[0] for r in top.where(lift > 3).orderBy(lift.desc(), "feature").limit(most_features).select("feature").collect()]
    place = {f: k for k, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ys, text in in_slices(batch):
                own = [sorted(place[f] for f in features(t) if f in place) for t in text]
                yield pa.record_batch([pa.array(ys, pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["y", "own"])

    got = sample.mapInArrow(rows, "y int, own array<int>").groupBy("y", "own").count().collect()
    sample.unpersist()

    def matrix(y: int) -> np.ndarray:
        part = sorted((tuple(r["own"]), r["count"]) for r in got if r["y"] == y)
        out = np.zeros((sum(n for _, n in part), len(names)))
        at = 0
        for own, n in part:
            out[at : at + n, list(own)] = 1
            at += n
        return out

    w, b = fit(matrix(1), matrix(0), prior)
    return Model(dict(zip(names, w.tolist(), strict=True)), b)


def score(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """docs, all rows and columns kept, with out (0 to 1); a column of that name, in any case, is replaced.
    Null and empty texts have the score of a text without features; an empty table gives no rows. A table
    without a column text, or with two of that name in different cases, is an error."""
    bound_batches(docs.sparkSession)
    kept = docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() != out.lower()))
    text = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [model.score(t.as_py()) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, out])
        trim()

    return kept.mapInArrow(run, schema)
