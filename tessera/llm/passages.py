"""Repeated passages by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash over the last WINDOW bytes is under one in
MEAN_CHUNK of its range, so boundaries depend on nearby bytes only and come back after an insertion. Chunks are counted by digest; those that
stand in two documents or more are joined to runs of neighbouring chunks, and runs of LEAST_BYTES or more are repeated
passages. Chunks under LEAST_CHUNK bytes say nothing by themselves and are bridged. Who keeps a passage is found by stretches:
from each chunk on, the fewest chunks that make LEAST_BYTES are one stretch, kept by the smallest doc_id that holds just these
bytes. A run is cut where stretches of smaller documents begin and end, and no stretch is marked at its keeper.

Defined results: null and empty texts have no passages; what repeats within one document only is none; rows that share a
doc_id count as one document; a passage stays where its doc_id is smallest and is marked as a repeat elsewhere; offsets count
bytes, ends exclusive. A chunk ends after MOST_CHUNK bytes at the latest. Extra columns are ignored. The first and last bytes of a
passage, before the first boundary that its own bytes make and behind the last, belong to chunks that differ and aren't marked;
up to BRIDGE bytes between two marked chunks are marked with them.

passage_dedup() cuts the marked repeats out of the texts, whole characters only. There all columns pass through; null texts stay
null; rows without doc_id, and rows that share a doc_id but not the text, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize

WINDOW, MEAN_CHUNK, LEAST_CHUNK, MOST_CHUNK, LEAST_BYTES, BRIDGE = 16, 24, 12, 2048, 112, 24
#: The gear: a fixed random 32-bit number for each byte, by a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def gear_hashes(raw: bytes) -> np.ndarray:
    """At each byte the sum of GEAR[b] << age over the last WINDOW bytes, by doubling the span covered."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    span = 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span)
        h = h + older
        span *= 2
    return h


def cuts(raw: bytes) -> np.ndarray:
    """Chunk boundaries, 0 and the length included."""
    if not raw:
        return np.zeros(1, np.int64)
    ends = np.flatnonzero(gear_hashes(raw) < np.uint32(2**32 // MEAN_CHUNK)) + 1
    bounds = np.unique(np.r_[0, ends, len(raw)]).astype(np.int64)
    if (np.diff(bounds) > MOST_CHUNK).any():
        bounds = np.unique(np.concatenate([np.r_[np.arange(a, b, MOST_CHUNK), b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]))
    return bounds


def chunks(docs: DataFrame) -> DataFrame:
    """digest, doc_id, start, stop of every chunk of LEAST_CHUNK bytes or more; digest and stop of its stretch, 0 near the end."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, ids, starts, stops, stretches, ends = [], [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                bounds = cuts(raw)
                own = np.flatnonzero(np.diff(bounds) >= LEAST_CHUNK)
                if len(own):
                    a, z = bounds[own], bounds[own + 1]
                    digests += map(xxhash.xxh64_digest, map(raw.__getitem__, map(slice, a.tolist(), z.tolist())), repeat(0))
                    ids.append(np.full(len(own), doc_id, np.int64))
                    starts.append(a)
                    stops.append(z)
                    at = np.searchsorted(bounds, a + LEAST_BYTES)
                    end = np.where(at < len(bounds), bounds[np.minimum(at, len(bounds) - 1)], 0)
                    stretches += [xxhash.xxh64_digest(raw[x:y], 1) if y else bytes(8) for x, y in zip(a.tolist(), end.tolist(), strict=True)]
                    ends.append(end)
            if ids:
                columns = [np.frombuffer(b"".join(digests), "<i8"), np.concatenate(ids), np.concatenate(starts).astype(np.int32), np.concatenate(stops).astype(np.int32), np.frombuffer(b"".join(stretches), "<i8"), np.concatenate(ends).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc_id", "start", "stop", "stretch", "end"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text <> ''")
    return source.mapInArrow(run, "digest long, doc_id long, start int, stop int, stretch long, end int")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop, first_doc_id (smallest that holds a stretch of it) and is_repeat of every repeated passage."""
    found, _ = materialize(chunks(docs), "chunks")
    spread = found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("digest")
    spread, _ = materialize(spread, "shared-digests")  # so that the next join can split a hot digest
    hits = found.join(spread, "digest").select("doc_id", "start", "stop", "stretch", "end")
    along = Window.partitionBy("doc_id").orderBy("start", "stop")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    fresh = (F.col("start") - F.lag("stop", 1, -(BRIDGE + 1)).over(along) > BRIDGE).cast("int")
    runs = hits.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(so_far)).drop("fresh")
    whole = Window.partitionBy("doc_id", "run")
    long = F.max("stop").over(whole) - F.min("start").over(whole) >= LEAST_BYTES
    runs, _ = materialize(runs.withColumn("long", long).where("long").drop("long"), "runs")
    of_stretch = runs.where("end > 0").groupBy("stretch").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").select("stretch", "keeper")
    of_stretch, _ = materialize(of_stretch, "stretches")  # so that the next join can split a hot passage
    kept = runs.join(of_stretch, "stretch", "left").withColumn("keeper", F.when(F.col("end") > 0, F.col("keeper")))
    before = Window.partitionBy("doc_id", "run").orderBy("start", "stop")
    until = before.rowsBetween(Window.unboundedPreceding, 0)
    reach = lambda which: F.coalesce(F.max(F.when(which, F.col("end"))).over(until) >= F.col("stop"), F.lit(False))
    elsewhere, here = F.col("keeper") < F.col("doc_id"), F.col("keeper") == F.col("doc_id")
    first = F.last(F.when(elsewhere, F.col("keeper")), True).over(until)
    marked = kept.withColumn("first", first).withColumn("mark", reach(elsewhere) & ~reach(here))
    part = lambda df, name: df.withColumn("turn", (F.col("mark") != F.lag("mark").over(before)).cast("int")).withColumn(name, F.coalesce(F.sum("turn").over(until), F.lit(0)))
    piece = Window.partitionBy("doc_id", "run", "piece")
    enough = F.max("stop").over(piece) - F.min("start").over(piece) >= LEAST_BYTES
    cut = part(part(marked, "piece").withColumn("mark", F.col("mark") & enough), "part")
    first_doc_id = F.when(F.first("mark"), F.min("first")).otherwise(F.col("doc_id")).alias("first_doc_id")
    out = cut.groupBy("doc_id", "run", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), first_doc_id, F.first("mark").alias("is_repeat"))
    return out.where(F.col("stop") - F.col("start") >= LEAST_BYTES).select("doc_id", "start", "stop", "first_doc_id", "is_repeat")


def passage_dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages gone from text wherever they are marked; the first document keeps them."""
    names = docs.columns
    texts = docs.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("__id")
    spans = repeated(docs).where("is_repeat").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    spans = spans.withColumnRenamed("doc_id", "__id").join(texts, "__id", "left_anti")
    spans, _ = materialize(spans, "repeats")
    both = docs.withColumn("__id", F.col("doc_id").cast("long")).join(spans, "__id", "left")
    place, of_spans = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not x else cut_out(t, [(y["start"], y["stop"]) for y in x]) for t, x in zip(b.column(place).to_pylist(), b.column(of_spans).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches(docs.sparkSession)
    return both.select(*[F.col(f"`{c}`") for c in names], "__spans").mapInArrow(run, docs.schema)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """text without these spans of its bytes; a character that a span cuts stays."""
    raw, kept, at = text.encode(), [], 0
    inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    for a, z in spans:
        a, z = max(a, at), max(z, at)
        while inside(a):
            a += 1
        while z > a and inside(z):
            z -= 1
        if a < z:
            kept.append(raw[at:a])
            at = z
    return b"".join([*kept, raw[at:]]).decode()
