"""Collocations against brute force: overlaps, guards, delimiters, nulls, ties, many shards and slices."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from frames import no_documents, odd_documents
from pyspark.sql import functions as F

from tessera.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest=3, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    many = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in many.items():
        longer = [b for (other, v), b in many.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked = []
    for lang in n:
        own = sorted(x for x in out if x[0] == lang)[:top]
        ranked += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (_, s, a, p, left, right) in enumerate(own)]
    return sorted(ranked)


def ours(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def some_rows():
    draw = random.Random(4)
    words = ["the", "of", "Big", "apple", "é", "É", "in-a", "x\x1fy", "a", "日本", " ", "b"]
    rows = []
    for k in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(draw.randrange(60)))
        rows.append((draw.choice(["en", "en", "fr", None, "und"]), text if k % 20 else None))
    return [*rows, ("en", "a a a a a a a a a a a a a"), ("en", ""), ("de", "new york city. " * 12 + "new york " * 3), ("de", "new\nyork")]


@pytest.mark.parametrize("sizes", [{}, {"shard": 200, "each_slice": 64}])
def test_equals_brute_force(spark, sizes):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert ours(phrases.collocations(docs, **sizes)) == brute(rows)


def test_other_limits(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert ours(phrases.collocations(docs, longest=4, least=3, top=7)) == brute(rows, 4, 3, 7)


def test_cells_that_phrases_share(spark):
    """A sketch whose cells all collide only makes more candidates."""
    raw = b"a b a b c. a b"
    ids, words, piece = phrases.words_of(raw)
    words = words.cast("string").to_pylist()
    every = np.unique(np.concatenate([c for _, c in phrases.cells(ids, words, piece, "en", 3)]))
    single, found = phrases.candidates(ids, words, piece, every, "en", 3)
    assert [words[i] for i in single] == ["a", "b", "c"] and sorted(found) == ["a b", "a b a", "a b c", "b a", "b a b", "b c"]
    many = [*words, *(f"w{k}" for k in range(3_000_000))]  # too many words for three numbers in 63 bits
    assert sorted(phrases.candidates(ids, many, piece, every, "en", 3)[1]) == sorted(found)
    assert phrases.joined(ids, words, piece) == " a b a b c \n a b "


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        cells = np.unique(rng.integers(0, 2**48, n).astype(np.uint64))
        counts = rng.integers(1, 11, len(cells))
        back, c = phrases.unpack(phrases.pack(cells, counts))
        assert (back == cells).all() and (c == counts).all()


def test_score_past_64_bits(spark):
    rows = [(10**13 - 7, 10**14 + 3, 10**14 - 1), (999999999999, 1000000000001, 999999999999), (10, 30, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("*", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_odd_tables(spark):
    docs = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    rows = [(None, r["text"]) for r in docs.collect()]
    assert ours(phrases.collocations(docs, least=2)) == brute(rows, least=2)
    assert phrases.collocations(no_documents(spark).withColumn("lang", F.lit("en"))).count() == 0


def test_spent_tables_go(spark, monkeypatch):
    """The sketch and the heavy cells leave the shared folder once they are used; what is returned needs neither."""
    from pathlib import Path

    made, fresh = [], phrases.fresh_path
    monkeypatch.setattr(phrases, "fresh_path", lambda *a: made.append(fresh(*a)) or made[-1])
    docs = spark.createDataFrame([(k, "one two three", "en") for k in range(12)], "doc_id long, text string, lang string")
    summed, n = phrases.counts(docs, shard=64, each_slice=64)
    folder = Path(made[0].removeprefix("file:"))
    assert any((folder / "kind=text").iterdir()) and not (folder / "kind=cells").exists()
    assert summed.count() == 6 and {tuple(r) for r in n.collect()} == {("en", 36)}


def test_cells_take_the_bits_that_the_corpus_needs():
    """Cells of 64 to 128 a byte, so that a shard's sorted cells take few bytes each; slices are told by the leading bits all the same."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60_000)]
    ids, piece = rng.integers(0, len(words), 300_000), np.zeros(300_000, np.int64)
    size = {wide: len(phrases.pack(np.unique(np.concatenate([c for _, c in phrases.cells(ids, words, piece, "en", 3, wide)])))) for wide in (phrases.cell_bits(1 << 29, 5), phrases.CELL_BITS)}
    assert size[phrases.cell_bits(1 << 29, 5)] < 0.75 * size[phrases.CELL_BITS]
    assert phrases.cell_bits(0, 0) == 0 and phrases.cell_bits(1 << 60, 44) == phrases.CELL_BITS and phrases.cell_bits(100, 20) == 20
