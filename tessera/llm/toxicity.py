"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

A linear model over hashed words and word beginnings is fitted with numpy from confirmed toxic documents and unlabelled
ones. The risk is corrected by the class prior p: p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive)); where the
second part turns negative, its gradient is followed backwards. The fit sees bounded samples (POSITIVES and UNLABELLED
rows with the smallest hash of their id; of rows that share an id the smallest text); the prior comes from all learning labels and every document is scored whole.

Defined results: a null text is an empty text; empty texts get the score of the bias alone; rows that share a doc_id are
scored one by one; without positive labels every score is the prior's; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Memo, bounded_batches, crc_mod, worker_cache

#: Bounds of the samples that the classifier is fitted on.
POSITIVES, UNLABELLED = 3000, 9000
BITS, BEGINNING, STEPS, RATE, RIDGE = 20, 5, 600, 0.05, 1e-5
#: A slot takes part if this many sampled documents have it and its shares among positive and unlabelled ones differ by so
#: many standard errors.
LEAST_DOCS, LEAST_ERRORS = 6, 4.0
THRESHOLD = 0.7
_WORDS = re.compile(r"\w+")
_MASK = (1 << BITS) - 1


def words(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def slots(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and, of longer words, its beginning."""
    own = zlib.crc32(b"w" + word.encode()) & _MASK
    return (own,) if len(word) <= BEGINNING else (own, zlib.crc32(b"b" + word[:BEGINNING].encode()) & _MASK)


def features(text: str) -> np.ndarray:
    found = [s for w in words(text) for s in slots(w)]
    return np.sort(np.array(found, np.int32))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[dict[int, float], float]:
    """Weights by slot and the bias, by Adam over the whole sample on the non-negative risk."""
    if not positive or not unlabelled:
        return {}, math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    positive, unlabelled = ([np.frombuffer(x, np.int32) for x in sorted({x.tobytes() for x in xs})] for xs in (positive, unlabelled))
    p, n = len(positive), len(unlabelled)
    in_p, in_u = (np.bincount(np.concatenate([np.unique(x) for x in xs]), minlength=1 << BITS) for xs in (positive, unlabelled))
    pooled = (in_p + in_u) / (p + n)
    errors = np.abs(in_p / p - in_u / n) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / p + 1 / n))
    kept = (in_p + in_u >= LEAST_DOCS) & (errors >= LEAST_ERRORS)
    rows = [x[kept[x]] for x in (*positive, *unlabelled)]
    slots_kept = np.flatnonzero(kept)
    flat = np.searchsorted(slots_kept, np.concatenate(rows))
    doc = np.repeat(np.arange(p + n), [len(x) for x in rows])
    w = np.zeros(len(slots_kept) + 1)
    w[-1] = math.log(prior / (1 - prior))
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    soft = lambda x: np.logaddexp(0, x).mean()
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, w[flat], p + n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if soft(z[p:]) - prior * soft(z[:p]) >= 0:
            d = np.concatenate([prior * (s[:p] - 1) / p - prior * s[:p] / p, s[p:] / n])
        else:
            d = np.concatenate([prior * s[:p] / p, -s[p:] / n])
        grad = np.append(np.bincount(flat, d[doc], len(slots_kept)), d.sum()) + RIDGE * np.append(w[:-1], 0)
        mean = 0.9 * mean + 0.1 * grad
        spread = 0.999 * spread + 0.001 * grad**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return dict(zip(slots_kept.tolist(), w[:-1].tolist(), strict=True)), float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Fits on documents outside the held-out fold (crc32 of the id as text modulo 3 is 1)."""
    bounded_batches(docs.sparkSession)
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull())
    total, toxic = learn.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    prior = min(0.95, max(0.005, (toxic + 1) / (total + 2)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(crc_mod(F.col("doc_id"), 3) != 1)
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = learn.where("toxic = 1").select("doc_id").distinct().orderBy(*first).limit(POSITIVES).select("doc_id", F.lit(True).alias("is_positive"))
    unlabelled = docs.select("doc_id").distinct().orderBy(*first).limit(UNLABELLED).select("doc_id", F.lit(False).alias("is_positive"))
    picked = docs.join(F.broadcast(positive.unionByName(unlabelled)), "doc_id").groupBy("doc_id", "is_positive").agg(F.min("text").alias("text")).select("is_positive", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["is_positive", "slots"])

    p, u = [], []
    for is_positive, raw in picked.mapInArrow(run, "is_positive boolean, slots binary").collect():
        (p if is_positive else u).append(np.frombuffer(raw, np.int32))
    p.sort(key=bytes)
    u.sort(key=bytes)
    return fit(p, u, prior)


def score(docs: DataFrame, model: tuple[dict[int, float], float]) -> DataFrame:
    """docs with score (double) and predicted (int) as further columns; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place, names, key = len(docs.columns), [*docs.columns, "score", "predicted"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        value = worker_cache(key, lambda: Memo(lambda w: sum([weights.get(s, 0.0) for s in slots(w)]), 200_000, longest=64))
        for b in batches:
            z = np.array([bias + math.fsum(map(value.__getitem__, words(t))) for t in b.column(place).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double, predicted int"])
    return docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")).mapInArrow(run, schema)
