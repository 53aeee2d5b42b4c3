"""Exact dedup against brute force: nulls, ties, repeated rows, digests that different texts share."""

import hashlib
import re
from collections import Counter, defaultdict

from frames import no_documents, odd_documents
from pyspark.sql import functions as F

from tessera.llm import exact


def brute(rows):
    """Counter of (doc_id, keep_id, group_size, kept, sha256) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = False
        for i in ids:
            first = i == keep and not kept
            kept |= first
            out[(i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def result(df):
    return Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "digest")) for r in df.collect())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert result(exact.groups(docs)) == brute((r["doc_id"], r["text"]) for r in docs.collect())
    assert exact.groups(no_documents(spark)).count() == 0


def test_white_space_and_ties(spark):
    rows = [(5, "a  b"), (3, "a\t\n b"), (3, "a b"), (4, "a\u00a0b"), (None, "a\x0bb"), (9, " a b"), (8, None), (7, ""), (6, " "), (2, "\n"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(exact.groups(docs)) == brute(rows)
    kept = sorted(((r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in exact.exact_dedup(docs).collect()), key=str)
    assert kept == sorted([(3, "a b"), (4, "a\u00a0b"), (9, " a b"), (7, ""), (2, " "), (None, "x")], key=str)


def test_one_text_in_a_third_of_the_rows_and_few_salts(spark):
    rows = [(k, "hot  text" if k % 3 == 0 else f"text {k % 50}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(exact.groups(docs, salts=2)) == brute(rows)


def test_digest_that_many_texts_share(spark):
    """Whatever the digest, texts are compared whole."""
    rows = [(k % 60, f"text {k % 17}") for k in range(200)] + [(1, None), (2, "text 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    poor = exact.groups(docs, digest=lambda c: F.when(c == "text 5", "own").otherwise((F.length(c) % 2).cast("string")))
    want = Counter()
    for (i, keep, size, kept, _), n in brute(rows).items():
        want[(i, keep, size, kept)] += n
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept")) for r in poor.collect()) == want


def test_extra_columns_pass_through(spark):
    docs = odd_documents(spark)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()})


def test_no_python_on_the_path(spark, capsys):
    exact.winners(odd_documents(spark)).explain()
    assert "Python" not in capsys.readouterr().out
