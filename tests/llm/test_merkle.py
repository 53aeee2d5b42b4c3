"""Merkle manifests against a plain recursive tree."""

import hashlib

import pytest
from frames import no_documents, odd_documents
from pyspark.sql import functions as F

from tessera.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(digests):
    """Root, and for each leaf its siblings by level as (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, own in enumerate(paths):
            run = at[i] // 3 * 3
            own.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 3])))
            at[i] //= 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    """(doc_id, leaf) -> (subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows, as sorted rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], sha("".join(field(x) for x in r))))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in sources}
    trees = {s: tree([d for _, d in own[s]]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources]) if sources else (None, [])
    return list((doc_id, leaf, trees[s][0], root, path + upper[k]) for k, s in enumerate(sources) for (doc_id, leaf), path in zip(own[s], trees[s][1], strict=True)) if rows else []


def ours(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(x["left"], x["right"]) for x in r["proof"]]) for r in df.collect()]


def by_text(rows):
    return sorted(rows, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 7])
def test_trees_of_all_sizes(spark, height):
    """Buckets of 3, 9 and 2,187 leaves: up to four rounds; sources of 1, 2, 3, 4, 9, 10, 28 and 100 rows."""
    sizes = {None: 5, "": 1, "a": 2, "b": 3, "ä": 4, "z": 9, "🙂": 10, "c": 28, "hot": 100}
    rows = [(k * 1000 + i, s, "en" if i % 2 else None, i, f"text\n{i}" if i % 5 else None) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_text(ours(merkle.manifest(merkle.leaves(docs), height=height))) == by_text(brute(rows))


def test_folding_finds_what_was_tampered_with(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"line {i}\nmore" if i % 2 else f"line {i}") for i in range(60)] + [(None, "s1", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    without = F.replace("text", F.lit("\n"), F.lit(""))
    out = merkle.manifest(merkle.leaves(docs, without), carry=("changed",))
    seen = {r["doc_id"]: r for r in out.withColumns({"own": merkle.folded(F.col("proof"), F.col("leaf")), "other": merkle.folded(F.col("proof"), F.col("changed"))}).collect()}
    assert len(seen) == 61
    for i, r in seen.items():
        assert r["own"] == r["root"]
        assert (r["other"] == r["root"]) == (i is None or i % 2 == 0)


def test_odd_tables(spark):
    docs = odd_documents(spark).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert by_text(ours(merkle.manifest(merkle.leaves(docs)))) == by_text(brute(rows))
    none = no_documents(spark).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
    assert merkle.manifest(merkle.leaves(none)).count() == 0


def test_one_row(spark):
    rows = [(1, "s", "en", 4, "text")]
    (row,) = ours(merkle.manifest(merkle.leaves(spark.createDataFrame(rows, SCHEMA))))
    assert row == (1, row[1], row[1], row[1], [])
