"""Benchmark decontamination by MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of distinct shingles q, in classes by powers of two. An item's MinHash signature is its k
smallest shingle hashes (a bottom-k sketch), k = 2 * floor((1 - CONTAINED) * u) + SPARE with u the largest q of its class, so k is
the same rate of the size for all of a class. A document, however long, is sketched at that rate: of its shingle hashes those up
to the largest of any signature. The containment asked for becomes a threshold on the signature: a document that contains
CONTAINED of an item misses floor((1 - CONTAINED) * q) of its shingles at most, so it has all but as many of the signature's
hashes, one at least. A pair with fewer is no candidate; none with the containment is missed, whatever the hashes are. Candidates,
and no others, are verified by the exact share of the item's shingles, as strings, that the document contains.

Words are runs of anything but ASCII white space, lower-cased; shingles have five words. Defined results: an item of fewer words
is one shingle of all its words, looked up among the documents' runs of as many words; items and documents without words are
found nowhere; item rows that share an item_id are one item of all their shingles; rows that share a doc_id are one document;
extra columns are ignored, and decontaminate() passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

SHINGLE, CONTAINED = 5, 0.8
#: Hashes of a signature beyond twice those that a document may miss.
SPARE = 3
#: Bytes up to which sketches, items' shingles or ids of candidate documents are broadcast; more are joined by a shuffle.
FEW_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _runs(w: Column, size: int, make) -> Column:
    """make(words) of every run of `size` words; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(w) - size)
    return F.when(F.size(w) >= size, F.transform(at, lambda i: make([F.get(w, i + k) for k in range(size)]))).otherwise(F.array())


def hashes(w: Column, sizes: list[int]) -> Column:
    return F.concat(*[_runs(w, n, lambda xs: F.xxhash64(*xs)) for n in sizes])


def shingles(w: Column, sizes: list[int]) -> Column:
    return F.concat(*[_runs(w, n, lambda xs: F.concat_ws(" ", *xs)) for n in sizes])


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows, at 32 bytes each, and its strings are within FEW_BYTES."""
    strings = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.typeName() == "string"]
    size = df.agg(F.coalesce(F.sum(sum(strings, F.lit(32))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= FEW_BYTES else df


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle (string), h of every distinct shingle of the items."""
    own = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    sized = own.select("item_id", F.explode(F.concat(*[F.when(F.size("w") == n, shingles(F.col("w"), [n])).otherwise(F.array()) for n in range(1, SHINGLE)], shingles(F.col("w"), [SHINGLE]))).alias("shingle"))
    return sized.distinct().withColumn("h", _hash_of(F.col("shingle")))


def _hash_of(shingle: Column) -> Column:
    """The hash that hashes() gives the same run of words."""
    w = F.split(shingle, " ")
    out = F.xxhash64(*[F.get(w, F.lit(k)) for k in range(SHINGLE)])
    for n in range(1, SHINGLE):
        out = F.when(F.size(w) == n, F.xxhash64(*[F.get(w, F.lit(k)) for k in range(n)])).otherwise(out)
    return out


def sketches(shingled: DataFrame) -> DataFrame:
    """item_id, h, need: each item's signature, k by its size class, and how many of its hashes a document must have."""
    sets = shingled.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"), F.count("*").alias("n"))
    missing = lambda n: F.floor(n * F.lit(1 - CONTAINED) + 1e-9)
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hs"))) + 1) - 1
    k = F.least(F.size("hs"), 2 * missing(top) + SPARE).cast("int")
    need = F.greatest(F.lit(1), k - missing(F.col("n")))
    return sets.select("item_id", need.cast("int").alias("need"), F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item (distinct shingles) and containment, where this is CONTAINED or more."""
    of_items, _ = materialize(item_shingles(items), "items")
    sizes = sorted(r[0] for r in of_items.select(F.least(F.size(F.split("shingle", " ")), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    sketched, _ = materialize(sketches(of_items), "sketches")
    largest = sketched.agg(F.max("h")).first()[0]
    of_docs = own.select("doc_id", F.explode(hashes(F.col("w"), sizes)).alias("h")).where(F.col("h") <= F.lit(largest).cast("long"))
    met = of_docs.join(_small(sketched), "h").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    candidates, _ = materialize(met.where("met >= need").select("doc_id", "item_id"), "candidates")
    holders, _ = materialize(candidates.select("doc_id").distinct(), "holders")
    wanted, _ = materialize(of_items.join(_small(candidates.select("item_id").distinct()), "item_id", "left_semi").select("item_id", "shingle"), "wanted")
    asked, _ = materialize(wanted.select("shingle").distinct(), "asked")
    held = own.join(_small(holders), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), sizes))).alias("shingle"))
    held = held.join(_small(asked), "shingle", "left_semi").distinct()
    shared = candidates.join(_small(wanted), "item_id").join(held, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    whole, _ = materialize(of_items.groupBy("item_id").agg(F.count("*").alias("n_item")), "item-sizes")
    found = shared.join(_small(whole), "item_id")
    return found.where(F.col("n_shared") >= F.col("n_item") * CONTAINED).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that contain an item; rows without doc_id stay."""
    found, _ = materialize(contained(docs, items).select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(_small(found), F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


SQL = f"""
    WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
    i AS (SELECT DISTINCT item_id, array_to_string(w[k : k + least(len(w), {SHINGLE}) - 1], ' ') AS s
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS k FROM iw WHERE len(w) > 0)),
    q AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
    dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
    d AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + size - 1], ' ') AS s
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw,
                (SELECT DISTINCT least(len(w), {SHINGLE}) AS size FROM iw WHERE len(w) > 0) WHERE len(w) >= size))
    SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
    FROM d JOIN i USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= any_value(n_item) * {CONTAINED}
"""
