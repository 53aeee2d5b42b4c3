"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh 2016).

A fingerprint holds one bit for each bit of the shingles' XXH64: 1 if more than half of them have it. For a radius r, each of
the 64 places gets a non-zero vector of r + 1 bits, and each non-zero vector v gives a mask of those places whose vector has
an odd number of bits in common with v. Any r places leave some v that is orthogonal to all of them, so two fingerprints that
differ in at most r places agree under that mask: no pair is missed. Pairs that agree are verified by their distance.

Copies share one fingerprint, so only different fingerprints meet in a bucket. A bucket gives at most one link for each
member: what is near a member is taken out before the next is looked at. Fingerprints of a bucket over `LARGE` are linked by
their neighbourhoods instead: two at most 4 apart have a point at most 2 from both, and all that share such a point are
at most 4 apart, so stars around shared points join exactly the same fingerprints, evenly dealt and without any pairs.

Defined results: null and empty texts have no words and the fingerprint zero, which links like any other; a text of fewer than
four words is one shingle; rows that share a doc_id are fingerprinted one by one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import similar
from .common import bounded_batches, materialize
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members up to which a bucket is handled in one task.
LARGE = 10_000
_LANES = np.uint64(0x0101010101010101)


def masks(radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks that cover every set of `radius` places."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if (1 + i % n & v).bit_count() & 1) for v in range(1, n + 1)]


def shingle_hashes(text: str) -> bytes:
    """Big-endian XXH64 of the text's shingles. bytes.lower() and split() know ASCII only, as the definition asks."""
    words = text.encode().lower().split()
    if not words:
        return b""
    if len(words) <= SHINGLE:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    raw = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[: -SHINGLE])]
    return b"".join(map(xxhash.xxh64_digest, map(raw.__getitem__, map(slice, starts, ends[SHINGLE - 1 :])), repeat(SEED)))


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts as signed 64-bit integers. Counts sit in byte lanes over blocks of 255 hashes."""
    hashed = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(x) // 8 for x in hashed], np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(texts), np.uint64)
    if len(full):
        h = np.frombuffer(b"".join(hashed), ">u8").astype(np.uint64)
        blocks = -(-sizes[full] // 255)
        first = np.cumsum(sizes[full]) - sizes[full]
        at = np.concatenate([np.arange(a, a + n * 255, 255) for a, n in zip(first.tolist(), blocks.tolist(), strict=True)])
        of_doc = np.cumsum(blocks) - blocks
        for k in range(8):
            lanes = np.add.reduceat(h >> np.uint64(k) & _LANES, at)
            counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_doc, axis=0)
            for lane in range(8):
                out[full] |= (counts[:, lane] * 2 > sizes[full]).astype(np.uint64) << np.uint64(8 * lane + k)
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a further column; texts are hashed whole."""
    bounded_batches(docs.sparkSession)
    names, place = [*docs.columns, name], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fingerprints(b.column(place).to_pylist()))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` long"])
    return docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")).mapInArrow(run, schema)


def near(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly those members which links of at most `radius` bits join; at most one for each member."""
    a, b, rest = [], [], members
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = np.bitwise_count(rest ^ x) <= radius
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
    none = np.zeros(0, members.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bucket_links(radius: int):
    """Over rows (t, key, fp) sorted by all three: links (a, b, large false), and members of large buckets (fp, fp, true)."""

    def out(a, b, large: bool) -> pa.RecordBatch:
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

    def whole(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of buckets that lie in these rows wholly."""
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(t)])
        two = starts[sizes == 2]
        hit = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        pairs = [(fp[two][hit], fp[two + 1][hit])]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if n > LARGE:
                yield out(fp[s : s + n], fp[s : s + n], True)
            else:
                pairs.append(near(fp[s : s + n], radius))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if len(a):
            yield out(a, b, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        large = None  # the large bucket whose members go out as they come
        for batch in batches:
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            t, key, fp = rows
            if large is not None:
                n = int(np.argmin(np.r_[(t == large[0]) & (key == large[1]), False]))
                if n:
                    yield out(fp[:n], fp[:n], True)
                rows = [x[n:] for x in rows]
                t, key, fp = rows
                if len(t):
                    large = None
            if not len(t):
                held = None
                continue
            last = int(np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])[-1])
            if last:
                yield from whole(t[:last], key[:last], fp[:last])
            held = [x[last:] for x in rows]
            if len(held[0]) > LARGE:
                large = (held[0][0], held[1][0])
                yield out(held[2], held[2], True)
                held = None
        if held is not None and len(held[0]):
            yield from whole(*held)

    return run


def _neighbourhood(fp: Column) -> Column:
    """The 2081 points at most two bits from fp."""
    one = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    masks2 = [0, *one, *(x ^ y for k, x in enumerate(one) for y in one[:k])]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks2]), lambda m: fp.bitwiseXOR(m))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, that join exactly the distinct fingerprints (column fp) at most `radius` bits apart.

    Smaller radii than RADIUS work up to the first bucket over LARGE, for which there are no neighbourhoods; then it raises.
    """
    if not 0 < radius <= RADIUS:
        raise ValueError(f"radius {radius}")
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)])
    keyed = prints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    placed = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found, _ = materialize(placed.mapInArrow(_bucket_links(radius), "a long, b long, large boolean"), "links")
    large = found.where("large").select(F.col("a").alias("fp")).distinct()
    stars = large.select("fp", F.explode(_neighbourhood(F.col("fp"))).alias("point"))
    centre = stars.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    extra = stars.join(centre, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    few = found.where("not large").select("a", "b")
    if large.isEmpty():
        return few.distinct()
    if radius != RADIUS:
        raise ValueError(f"radius {radius}: a bucket is over {LARGE}")
    return few.unionByName(extra).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id: the smallest doc_id that links between fingerprints reach."""
    hashed, _ = materialize(with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "fingerprints")
    return with_components(hashed)


def with_components(hashed: DataFrame) -> DataFrame:
    """A written table with doc_id and fp, with component_id added."""
    prints = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp")))
    named, _ = materialize(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest, _ = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")  # both written, so that the join can split a giant component
    of_print, _ = materialize(named.join(smallest, "root").select("fp", "component_id"), "components")
    return hashed.join(of_print, "fp")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, content (the text's hash) and component_id of every row; components join texts of similarity similar.SIMILAR or more.

    First candidates are the links between fingerprints and those of minimum hashes of the same shingles, which find what differs
    in more than RADIUS bits. Both leave pairs out, so all similar pairs of texts that they didn't join follow (similar.apart).
    All candidates are verified. component_id is the smallest doc_id, NULL where there is none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    rows, _ = materialize(similar.with_bands(own, fingerprints), "signatures")
    texts, _ = materialize(rows.groupBy("content").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.first("n").alias("n")), "texts")
    prints, _ = materialize(texts.groupBy("fp").agg(F.min("content").alias("lead")), "prints")
    same = texts.join(prints, "fp").select(F.col("content").alias("a"), F.col("lead").alias("b"))
    lead = lambda c: prints.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    across = links(prints.select("fp")).join(lead("a"), "a").join(lead("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    pairs = same.unionByName(across).unionByName(similar.banded(texts))
    roots = components(similar.verified(pairs, own.select("content", "text")))
    joined, _ = materialize(texts.join(roots.withColumnRenamed("node", "content"), "content", "left").select("content", "least", "n", "odd", F.coalesce("root", "content").alias("root")), "joined")
    more, _ = materialize(similar.verified(similar.apart(joined, own.select("content", "text")), own.select("content", "text")), "more-pairs")
    of = lambda c: joined.select(F.col("content").alias(c), F.col("root").alias(f"{c}_root"))
    across = more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    tops = components(similar.ordered(across)).toDF("root", "top")
    named, _ = materialize(joined.join(tops, "root", "left").select("content", "least", F.coalesce("top", "root").alias("root")), "roots")
    smallest, _ = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    of_text, _ = materialize(named.join(smallest, "root").select("content", "component_id"), "components")
    return rows.select("doc_id", "content").join(of_text, "content")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component of near_classes(), with all columns of docs; repeated rows of it go.

    Of rows that have the id and the text in common but differ elsewhere, the one with the smallest hash of all columns stays.
    """
    kept = near_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct()
    at = docs.select("*", F.col("doc_id").cast("long").alias("__own_id"), F.xxhash64("text").alias("__own_content"))
    same = at.join(kept, F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_content") == F.col("__content")), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = same.groupBy("__own_id", "__own_content").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return one.select("row.*")
