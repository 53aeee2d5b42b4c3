"""Exact dedup that no group of copies can stall, in DataFrame operations only.

Texts are equal when identical after each run of ASCII white space becomes one blank. Copies combine in three stages, each of
which compares whole texts, not digests alone:

1. every task combines its own copies (the partial aggregation by digest, salt and text; the salt is the task's number);
2. rows of one digest, salt and text meet, so a text that a third of all rows hold is spread over SALTS places;
3. the winners of the salts, SALTS a text at most, are combined for the whole table.

A row then finds its group by digest; only the rows of digests that different texts share, of which a good digest has none,
compare their texts once more. That join is between two written tables, so that a hot digest can be split.

Defined results: a null text counts as empty; of equal texts the row with the smallest doc_id stays (a null doc_id comes after
all others); of rows that share doc_id and text one stays, whichever; an empty table gives an empty result; further columns are
ignored by `groups`, and `exact_dedup` passes them through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Places that the copies of one text are spread over.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, whole (the normalised text), digest."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("whole"))
    return own.withColumn("digest", digest(F.col("whole")))


def winners(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """digest, whole, keep_id and group_size, one row for each different text."""
    salted = _keyed(docs, digest).withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "whole").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))
    return merged.groupBy("digest", "whole").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("group_size"))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest."""
    each, _ = materialize(_keyed(docs, digest).drop("whole").groupBy("doc_id", "digest").agg(F.count("*").alias("times")), "exact-rows")
    of_digest = winners(docs, digest, salts).groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    found, _ = materialize(of_digest, "exact-groups")
    shared = found.where("texts > 1").select("digest")
    named = each.join(found.where("texts = 1").drop("texts"), "digest")
    if not shared.isEmpty():
        named = named.unionByName(_apart(docs, digest, salts, shared))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")
    own = named.select("doc_id", "keep_id", "group_size", "digest", copy)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return own.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def _apart(docs: DataFrame, digest: Callable[[Column], Column], salts: int, shared: DataFrame) -> DataFrame:
    """The rows whose digest several texts share, told apart by their texts."""
    rows = _keyed(docs, digest).join(shared, "digest", "left_semi").groupBy("doc_id", "digest", "whole").agg(F.count("*").alias("times"))
    texts = winners(docs, digest, salts).join(shared, "digest", "left_semi")
    rows, _ = materialize(rows, "exact-shared-rows")
    texts, _ = materialize(texts, "exact-shared-texts")
    return rows.join(texts, ["digest", "whole"]).select("digest", "doc_id", "times", "keep_id", "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row for each different text."""
    kept, _ = materialize(groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")), "exact-kept")
    own = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__digest": sha256(normalised(F.col("text")))})
    same = own["__id"].eqNullSafe(kept["__id"]) & (own["__digest"] == kept["__digest"])
    return own.join(kept, same, "left_semi").dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")


SQL = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents),
    g AS (SELECT whole, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY whole)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.whole) AS text_sha256 FROM n JOIN g USING (whole)
"""
