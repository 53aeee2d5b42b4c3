"""Pairs of texts by the Jaccard similarity of their sets of five-word shingles: candidates by minimum hashes and by prefixes, exact verification.

Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words is one shingle of them all, and texts
without words have one empty shingle in common. A signature has BANDS keys, each of ROWS minimum hashes, so two texts of
similarity 0.8 share a key with a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.998, and more alike ones with a higher one. A
bucket of texts with one key gives three links for each member, to the smallest number and to the smallest of two hashes in it,
however many there are; so no bucket makes pairs of all its members. What the bands and their heads leave out is found exactly by
`apart`: two sets of similarity 0.8 or more, in any one order of all shingles, share one of the first n - ceil(0.8 n) + 1 of each
(Chaudhuri et al. 2006). The order is that of the hashes, with shingles that many texts begin with last; it decides how many
candidates there are, not what is found. Pairs that components join already are left out, and pairs that share too few of their
first shingles for the similarity (Xiao et al. 2008); all others are verified, so no similar texts stay apart. Texts that have a
passage in common and little else don't come out of the join: of each set the parities of its hashes' numbers in PARITIES bins
are kept, two sets differ in at least as many shingles as bins of unlike parity (Sandes et al. 2017), and similar ones in
(n + m) / 9 at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, materialize, release

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 5
PARITIES = 1024
#: A shingle is frequent if it is among the first of more texts than this; tasks report those that they see SOME times, MOST are used.
FREQUENT, SOME, MOST = 100, 4, 1 << 18
_TIMES = np.random.default_rng(80).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(81).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """XXH64 of the text's different shingles, ascending."""
    words = text.encode().lower().split()
    raw = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(raw)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-SHINGLE])]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(raw.__getitem__, map(slice, starts, ends[SHINGLE - 1 :])), repeat(0))), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, as signed integers."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for low in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[low : low + 2048, None] * _TIMES).min(0))
    least ^= least >> np.uint64(31)
    return (least.reshape(BANDS, ROWS) * _BAND).sum(1, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits of a set of hashes, as signed integers: whether a bin holds an odd number of them."""
    odd = np.bincount((hashes >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def with_bands(docs: DataFrame, fingerprints: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """docs with fp (a long for each text), bands (its band keys), odd (its parities) and n (its different shingles) in the place of text, in one pass of one worker a core."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]

    def listed(rows: list[np.ndarray]) -> pa.ListArray:
        bounds = np.r_[0, np.cumsum([len(x) for x in rows], dtype=np.int64)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            sets = [shingle_set(t) for t in texts]
            lists = [listed([of(x) for x in sets]) for of in (band_keys, parities)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fingerprints(texts)), *lists, pa.array([len(x) for x in sets], pa.int64())], names=[*names, "fp", "bands", "odd", "n"])
        release()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), "fp long, bands array<long>, odd array<long>, n long"])
    return docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def banded(texts: DataFrame) -> DataFrame:
    """texts (content, bands) -> candidate links (a, b), a < b."""
    keyed, _ = materialize(texts.select("content", F.posexplode("bands").alias("band", "key")), "band-keys")
    lead = keyed.groupBy("band", "key").agg(F.min("content").alias("one"), F.min_by("content", F.xxhash64("content", "band")).alias("two"), F.min_by("content", F.xxhash64("band", "content")).alias("three"), F.max("content").alias("last"))
    lead, _ = materialize(lead.where("one < last").drop("last"), "buckets")  # so that the next join can split a hot bucket
    both = keyed.join(lead, ["band", "key"]).select("content", F.explode(F.array("one", "two", "three")).alias("other"))
    return ordered(both.select(F.col("content").alias("a"), F.col("other").alias("b")))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts (content, text) have this similarity or more, by their sets of shingles."""
    pairs, _ = materialize(ordered(pairs), "pairs")
    nodes, _ = materialize(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct(), "nodes")
    bounded_batches(texts.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shingle_set(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["content", "hashes"])
        release()

    own = texts.join(nodes, "content", "left_semi").select("content", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed, _ = materialize(own.groupBy("content").agg(F.min("text").alias("text")).mapInArrow(sets, "content long, hashes binary"), "shingle-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= similar * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])
        release()

    both = pairs.join(hashed.toDF("a", "of_a"), "a").join(hashed.toDF("b", "of_b"), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def first_shingles(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first of an ascending set of hashes of which a similar set must share one; frequent ones (ascending) come last."""
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: len(hashes) - math.ceil(SIMILAR * len(hashes) - 1e-9) + 1]


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes that are among the first of many texts (text), ascending: the MOST most frequent of those that tasks see SOME times."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([none, *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[n >= SOME].view(np.int64)), pa.array(n[n >= SOME].astype(np.int64))], names=["token", "n"])

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held += [first_shingles(shingle_set(t), none) for t in b.column(0).to_pylist()]
            size += sum(map(len, held[-len(b) :])) if len(b) else 0
            if size >= 1 << 22:
                yield seen()
                size = 0
        yield seen()
        release()

    counted = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "token long, n long")
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "token").limit(MOST).toArrow()
    return np.sort(rows["token"].to_numpy().astype(np.int64).view(np.uint64))


def meetings(known: DataFrame) -> DataFrame:
    """Pairs of known (token, content, root, n, odd) of one token, of different roots, that may be similar by their sizes and parities."""
    x, y = (known.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("content", "root", "n", "odd")]) for k in "xy")
    unlike = " + ".join(f"bit_count(odd_x[{k}] ^ odd_y[{k}])" for k in range(PARITIES // 64))
    return x.join(y, "token").where(f"root_x < root_y and 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y) and 9 * ({unlike}) <= n_x + n_y")


def apart(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b, of named (content, root, n, odd) that have different roots, every similar pair among them.

    texts: content, text; n: number of different shingles; odd: their parities.
    """
    bounded_batches(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [first_shingles(shingle_set(t), sent.value) for t in b.column(1).to_pylist()]
            if own:
                content = np.repeat(b.column(0).to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(content)], names=["token", "content"])
        release()

    tokens = texts.select("content", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(firsts, "token long, content long")
    of_token = Window.partitionBy("token")
    several = lambda df, c: df.withColumn("__least", F.min(c).over(of_token)).withColumn("__most", F.max(c).over(of_token)).where("__least < __most").drop("__least", "__most")
    shared, _ = materialize(several(tokens, "content").distinct(), "shared-firsts")
    known, _ = materialize(several(shared.join(named.select("content", "root", "n", "odd"), "content"), "root"), "firsts-of-several")
    both = meetings(known)
    counted = both.groupBy("content_x", "content_y").agg(F.count("*").alias("c"), F.first("n_x").alias("n"), F.first("n_y").alias("m"))
    # behind the first shingles of either there are ceil(0.8 n) - 1 more, of 4 / 9 (n + m) that a similar pair shares
    enough = counted.where("9 * (c + (4 * greatest(n, m) + 4) div 5 - 1) >= 4 * (n + m)")
    return ordered(enough.select(F.col("content_x").alias("a"), F.col("content_y").alias("b")))
