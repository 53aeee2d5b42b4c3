import numpy as np
import pytest

from tessera.llm import neighbours


def brute(rows, top):
    x = {i: np.array(v) for i, v in rows}
    out = {}
    for q in sorted(i for i in x if i % 20 == 0):
        best = sorted((-float(sum(a * b for a, b in zip(x[q], x[i], strict=True))), i) for i in x if i != q)[:top]
        out[q] = [i for _, i in best]
    return out


def search(spark, rows):
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = neighbours.MultiIndex(df).search(df.where("vec_id % 20 = 0"))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def measured(got, rows):
    """Share of the true neighbours' places that hold an equally near vector."""
    x, found = {i: np.array(v, float) for i, v in rows}, []
    for q, want in brute(rows, 20).items():
        least = x[q] @ x[want[-1]] - 1e-9
        found.append(sum(x[q] @ x[i] >= least for i in got[q]) / len(want))
    return np.mean(found)


@pytest.mark.parametrize("kind", ["clustered", "random", "few"])
def test_recall_against_brute_force(spark, kind):
    """The index works at every size: no table is so small that all rows are gone through without it."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    n = 200 if kind == "few" else 2000
    vectors = rng.normal(size=(n, 16)) if kind == "random" else centres[np.arange(n) % 30] + 0.3 * rng.normal(size=(n, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = neighbours.MultiIndex(df)
    found = index.search(df.where("vec_id % 20 = 0")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == {k for k in range(0, n, 20)} and all(len(set(v)) == 20 for v in got.values())
    assert measured(got, rows) >= 0.9
    assert index.enough < n and (kind != "clustered" or index.enough < n / 4)
    x = dict(rows)
    for r in found:
        want = 0.0
        for a, b in zip(x[r["query_id"]], x[r["vec_id"]], strict=True):
            want += a * b
        assert r["score"] == want
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert all([k for k, *_ in sorted(v)] == list(range(1, 21)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by_query.values())


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert measured(search(spark, rows), rows) >= 0.9


def test_blocks_of_cells_come_by_falling_nearness():
    rng = np.random.default_rng(3)
    first, second, counts = rng.normal(size=20), rng.normal(size=37), rng.integers(0, 4, (20, 37))
    order = [(i, js.tolist(), held) for i, js, held in neighbours.traverse(first, second, counts, np.inf)]
    best = [first[i] + second[js].max() for i, js, _ in order]
    assert best == sorted(best, reverse=True) and order[-1][2] == counts.sum()
    assert sorted((i, j) for i, js, _ in order for j in js) == [(i, j) for i in range(20) for j in range(37)]
    some = list(neighbours.traverse(first, second, counts, 300))
    least = neighbours.depths(first, second, counts, 300)
    assert {(i, j) for i, js, _ in some for j in js} == {(i, j) for i in range(20) for j in range(37) if second[j] >= least[i]}


def test_ties_copies_and_unusable_vectors(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.5, 0.5, 0.0, 0.0]
    rows = [(k, one) for k in range(300)] + [(300 + k, two) for k in range(5)] + [(400, None), (420, [0.0] * 4), (440, [1.0, float("nan"), 0.0, 0.0]), (460, [1.0, None, 0.0, 0.0]), (480, []), (500, [1.0]), (0, one)]
    got = search(spark, rows)
    assert got.keys() == {k for k in range(305) if k % 20 == 0}
    assert got[0] == list(range(1, 21))
    assert got[40] == list(range(20))
    assert got[20] == [*range(20)]
    assert got[300] == list(range(20))


def test_repeated_ids_and_clashing_columns(spark):
    """Of rows that share an id the smallest vector counts; extra columns change nothing."""
    rows = [(0, [2.0, 0.0], "x", 1), (0, [1.0, 0.0], "y", 2), (1, [1.0, 1.0], "x", 3), (1, [3.0, 0.0], "z", 3), (2, [0.0, 1.0], None, None), (2, [0.0, 1.0], None, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int")
    used = neighbours.usable(df)
    found = neighbours.MultiIndex(used).search(used.where("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def test_few_and_no_vectors(spark):
    assert search(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]) == {0: [1]}
    assert search(spark, [(0, [1.0, 2.0])]) == {}
    assert search(spark, [(0, None)]) == {}
