"""Nearest neighbours by an inverted multi-index (Babenko and Lempitsky 2012), for the largest inner product.

Both halves of the vectors are quantised on their own; a vector lies in the cell of its two centroids. A query goes through
the pairs of centroids by their summed nearness with a heap (the multi-sequence algorithm) until the cells hold enough
entries, and the entries are reranked by exact inner products. How many are enough is measured: for a sample of queries the
true neighbours over all rows are found by brute force, and the number is set so that RECALL of them would be reached.

Cells are taken from the heap in blocks: one first-half centroid and one in BLOCKS of the second-half ones. This holds at every size of
the table: there is no other path for small ones.

Rows with the same vector are one entry with its smallest ids, as many as a result can need, so a vector that a third of the
rows share is no hot cell. Entries and queries meet in tiles of bounded size: entries of neighbouring first-half centroids, a
large centroid split over several tiles, and the queries that go there, also split. The codebooks are fitted on a bounded
sample; every row is indexed and counted.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part; of rows that share a vec_id the one with the smallest vector (component by component) counts; a table
with no other vector gives a query no rows; ties go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize

#: Neighbours, share of them to be found, least entries to rerank, sampled rows for codebooks, sampled queries for measuring.
TOP, RECALL, LEAST_ENTRIES, FIT_ROWS, MEASURED = 20, 0.94, 100, 20_000, 96
MOST_CENTROIDS, ROUNDS, BLOCKS = 512, 12, 16
TILE_ENTRIES, TILE_QUERIES, SLICE = 8192, 4096, 256


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id long, v array<double> of the rows that take part."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    big = float("inf")
    good = own.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)) & F.exists("v", lambda x: x != 0))
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def entries(rows: DataFrame, top: int) -> DataFrame:
    """One row for each vector: rep (its smallest id), members (its top + 1 smallest ids), v."""
    same = Window.partitionBy("h1", "h2")
    keyed = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    few = keyed.withColumn("k", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("k") <= top + 1)
    return few.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("members"), F.min_by("v", "vec_id").alias("v")).select("rep", "members", "v")


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k different rows; a centroid that loses all its rows stays."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        own = closest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """Blocks of cells by falling sum of nearness, until their cells hold `enough` entries: first centroid, second ones, entries so far.

    Along one first centroid the second ones come in the order of their nearness.
    """
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable")
    size = -(-len(b) // BLOCKS)
    starts = np.arange(0, len(b), size)
    held_of = np.add.reduceat(counts[:, b], starts, axis=1).tolist()
    fa, fb, blocks = first[a].tolist(), second[b[starts]].tolist(), [b[x : x + size] for x in starts.tolist()]
    heap, held = [(-(fa[0] + fb[0]), 0, 0)], 0
    while heap and held < enough:
        _, u, k = heapq.heappop(heap)
        held += held_of[a[u]][k]
        yield a[u], blocks[k], held
        if k + 1 < len(fb):
            heapq.heappush(heap, (-(fa[u] + fb[k + 1]), u, k + 1))
        if k == 0 and u + 1 < len(fa):
            heapq.heappush(heap, (-(fa[u + 1] + fb[0]), u + 1, 0))


def depths(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> np.ndarray:
    """For each first centroid the nearness that second ones must have to be gone through; infinite where none is."""
    seen = np.zeros(len(first), np.int64)
    for i, js, _ in traverse(first, second, counts, enough):
        seen[i] += len(js)
    falling = np.r_[np.inf, -np.sort(-second), -np.inf]
    # between the last that counts and the next, so that another order of summing changes nothing
    return np.where(seen == 0, np.inf, np.where(seen == len(second), -np.inf, (falling[seen] + falling[np.minimum(seen + 1, len(falling) - 1)]) / 2))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    s = np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])
    for d in range(x.shape[-1]):
        s = s + q[..., d] * x[..., d]
    return s


def best(q: np.ndarray, x: np.ndarray, reps: np.ndarray, allowed: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the entry, score) of the n best entries of each query."""
    rough = q @ x.T
    if allowed is not None:
        rough[~allowed] = -np.inf
    wide = min(x.shape[0], n + 12)
    if wide < x.shape[0]:
        cut = -np.partition(-rough, wide - 1, axis=1)[:, wide - 1 : wide]
        hit = (rough >= cut) & (rough > -np.inf)
    else:
        hit = rough > -np.inf
    at, of = np.nonzero(hit)
    s = exact(q[at], x[of])
    order = np.lexsort((reps[of], -s, at))
    at, of, s = at[order], of[order], s[order]
    start = np.searchsorted(at, at, side="left")
    keep = np.arange(len(at)) - start < n
    return at[keep], of[keep], s[keep]


class MultiIndex:
    """Codebooks, cells' counts and the written entries (cell of the first half, of the second, rep, members, v)."""

    def __init__(self, rows: DataFrame, top: int = TOP):
        self.spark, self.top = rows.sparkSession, top
        bounded_batches(self.spark)
        found, _ = materialize(entries(rows, top), "vectors")
        n = found.count()
        self.n = n
        k = max(2, min(MOST_CENTROIDS, int(2 * n**0.5)))
        sample = found.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("v").toArrow()
        x = matrix(sample.column(0).combine_chunks()) if n else np.zeros((0, 2))
        self.half = x.shape[1] // 2
        self.books = (kmeans(x[:, : self.half], k, 1), kmeans(x[:, self.half :], k, 2)) if n else (np.zeros((1, 1)), np.zeros((1, 1)))
        books, half = self.books, self.half

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column(2))
                if len(v):
                    cells = [pa.array(closest(part, c).astype(np.int32)) for part, c in zip((v[:, :half], v[:, half:]), books, strict=True)]
                    yield pa.RecordBatch.from_arrays([*cells, *b.columns], names=["i", "j", *names])

        names = ["rep", "members", "v"]
        self.entries, _ = materialize(found.select(*names).mapInArrow(place, "i int, j int, rep long, members array<long>, v array<double>"), "cells")
        self.counts = np.zeros((len(books[0]), len(books[1])), np.int64)
        cells = self.entries.groupBy("i", "j").count().toArrow()  # at most MOST_CENTROIDS ** 2 rows
        self.counts[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["count"].to_numpy()
        self.enough = self._measure()

    def brute(self, queries: list[tuple[int, np.ndarray]]) -> dict[int, list[tuple[float, int, int, int]]]:
        """The best entries (score, rep, i, j) of a few queries, over all entries."""
        n, ids, q = self.top + 1, [i for i, _ in queries], np.array([v for _, v in queries])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, reps = matrix(b.column(3)), b.column(2).to_numpy()
                if len(x):
                    at, of, s = best(q, x, reps, None, n)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s), pa.array(reps[of]), b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of))], names=["q", "score", "rep", "i", "j"])

        found = self.entries.select("i", "j", "rep", "v").mapInArrow(run, "q long, score double, rep long, i int, j int")
        first = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
        out: dict[int, list[tuple[float, int, int, int]]] = {i: [] for i in ids}
        for r in found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= n).orderBy("q", "k").collect():
            out[ids[r["q"]]].append((r["score"], r["rep"], r["i"], r["j"]))
        return out

    def near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.books[0] @ q[: self.half], self.books[1] @ q[self.half :]

    def _measure(self) -> int:
        sample = self.entries.orderBy(F.hash("rep"), "rep").limit(MEASURED).select("rep", "v").collect()
        queries = [(r["rep"], np.array(r["v"])) for r in sample]
        truth, needed = self.brute(queries), []
        for i, q in queries:
            seen = np.zeros(self.counts.shape, np.int64)
            for a, js, held in traverse(*self.near(q), self.counts, self.n + 1):
                seen[a, js] = held
            needed += [int(seen[a, b]) for _, rep, a, b in truth[i] if rep != i][: self.top]
        return max(LEAST_ENTRIES, int(np.quantile(needed, RECALL)) + 1) if needed else self.n + 1

    def _tiles(self) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
        """Of each first centroid (i, its first tile, number of its tiles, first centroid in the tile); of each tile (s, centroids from, to)."""
        rows, last, low, held = [], [], 0, 0
        for i, n in enumerate(self.counts.sum(1).tolist()):
            if held and held + n > TILE_ENTRIES:
                last.append((len(last), low, i))
                low, held = i, 0
            parts = max(1, -(-n // TILE_ENTRIES))
            rows.append((i, len(last), parts, low))
            held += n
            if parts > 1:
                last += [(len(last) + k, i, i + 1) for k in range(parts)]
                low, held = i + 1, 0
        if low < len(self.counts):
            last.append((len(last), low, len(self.counts)))
        return rows, last

    def search(self, queries: DataFrame) -> DataFrame:
        """queries (vec_id, v) -> query_id, rank, vec_id, score: the top nearest found, the query's own id left out."""
        books, half, counts, enough, top = self.books, self.half, self.counts, self.enough, self.top
        tiles, last = self._tiles()

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = {"s": [], "query_id": [], "v": [], "least": []}
                for query_id, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                    least = depths(books[0] @ q[:half], books[1] @ q[half:], counts, enough)
                    for s, low, high in last:
                        if (least[low:high] < np.inf).any():
                            for name, x in zip(rows, (s, query_id, q, least[low:high]), strict=True):
                                rows[name].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows["s"], pa.int32()), pa.array(rows["query_id"], pa.int64()), pa.array(rows["v"], pa.list_(pa.float64())), pa.array(rows["least"], pa.list_(pa.float64()))], names=list(rows))

        asking, _ = materialize(queries.select("vec_id", "v").distinct(), "queries")
        tasks = min(10_000, max(1, -(-asking.count() // 64)))  # by work: few bytes a row, much to go through
        planned, _ = materialize(asking.repartition(tasks).mapInArrow(plan, "s int, query_id long, v array<double>, least array<double>"), "probes")
        asked = {r["s"]: r["count"] for r in planned.groupBy("s").count().collect()}
        parts = F.broadcast(self.spark.createDataFrame([(s, max(1, -(-asked.get(s, 0) // TILE_QUERIES))) for s, _, _ in last], "s int, by_query int"))
        places = F.broadcast(self.spark.createDataFrame(tiles, "i int, first int, by_entry int, low int"))
        key = [F.col("s"), F.col("c")]
        left = planned.join(parts, "s").select("s", F.pmod(F.hash("query_id"), "by_query").cast("int").alias("c"), "query_id", F.col("v").alias("q"), "least")
        placed = self.entries.join(places, "i").withColumn("s", F.col("first") + F.pmod(F.hash("rep"), "by_entry").cast("int")).join(parts, "s")
        right = placed.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("by_query") - 1))).select(*key, (F.col("i") - F.col("low")).alias("i"), "j", "rep", "members", "v")

        def rerank(qs: pa.Table, xs: pa.Table) -> pa.Table:
            out = []
            if qs.num_rows and xs.num_rows:
                xs = xs.combine_chunks()
                x, reps, i, j = matrix(_one(xs["v"])), xs["rep"].to_numpy(), xs["i"].to_numpy(), xs["j"].to_numpy()
                for low in range(0, qs.num_rows, SLICE):
                    part = qs.slice(low, SLICE).combine_chunks()
                    q, ids, least = matrix(_one(part["q"])), part["query_id"].to_numpy(), matrix(_one(part["least"]))
                    allowed = (q[:, half:] @ books[1].T)[:, j] >= least[:, i]
                    at, of, s = best(q, x, reps, allowed, top + 1)
                    out.append(pa.table({"query_id": ids[at], "score": s, "rep": reps[of], "members": _one(xs["members"]).take(pa.array(of))}))
            return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "rep": pa.array([], pa.int64()), "members": pa.array([], pa.list_(pa.int64()))})

        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rerank, "query_id long, score double, rep long, members array<long>")
        entry = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
        few = found.withColumn("k", F.row_number().over(entry)).where(F.col("k") <= top + 1)
        each = few.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one(column):
    """A table's column as one array."""
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
