"""Merkle manifest of a table: one tree a source, one over the sources, and a proof for every row.

A node is the sha256 (lowercase hex) of its children's digests, concatenated as text; every FAN consecutive nodes of a level, the
last run of fewer and even of one, have one parent, until one node is left. Leaves ascend by doc_id within a source.

The trees are cut into aligned buckets of FAN ** HEIGHT leaves, whose subtrees no other bucket shares, so a source of any size is
spread over all tasks. Executors take buckets as Arrow tables and run DuckDB's ordered string_agg and sha256 on them, one query a
level. Spark puts the bucket roots together: they are the leaves of the next round, until one node a source is left, and the
sources' roots are a tree of the same kind. On the way back each bucket meets the proof of its root (a cogroup by blocks of whole
buckets), from which its leaves' proofs follow. A row's place in its source comes from range partitions, sorted and counted.

Defined results: nulls come first among sources and among doc_ids; rows that share source and doc_id are leaves of their own,
in the order of their digests; an empty table gives an empty result; columns that aren't named are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

FAN, HEIGHT = 3, 7
#: Columns that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row: each value as its number of UTF-8 bytes, a colon and itself; '-' for a null."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns.values()]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, tree (the source's key) and leaf of every row; changed, if given: the leaf with this in place of text."""
    cols = {c: F.col(c) for c in COLUMNS}
    tree = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("source")))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(cols).alias("leaf"), *([changed.alias("__changed")] if changed is not None else []), *[c for c in COLUMNS if c != "doc_id"])
    if changed is None:
        return out.select("doc_id", "tree", "leaf")
    same = F.col("text").eqNullSafe(F.col("__changed"))
    return out.select("doc_id", "tree", "leaf", F.when(same, F.col("leaf")).otherwise(leaf({**cols, "text": F.col("__changed")})).alias("changed"))


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes with rank (from 0) within its tree and n, the tree's number of nodes; no task sees a whole tree."""
    parts = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed, _ = materialize(parts.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), name)
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs, _ = materialize(runs.select("tree", "part", "first", before.alias("before"), F.sum("c").over(whole).alias("n")), f"{name}-runs")
    return placed.join(runs, ["tree", "part"]).withColumn("rank", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "first", "before")


def _blocked(nodes: DataFrame, blocks: int) -> DataFrame:
    return nodes.withColumn("block", F.pmod(F.xxhash64("tree", "bucket"), F.lit(blocks)))


_DUCK: list = []


def _connection():
    """One DuckDB connection a worker, of one thread, that never spills: a block holds few buckets."""
    if not _DUCK:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.execute("SET temp_directory = ''")
        _DUCK.append(con)
    return _DUCK[0]


def _levels(con, nodes: pa.Table) -> int:
    """Makes tables n0, n1, ... of a block's levels; their number."""
    con.register("given", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT * FROM given")
    con.unregister("given")
    top = con.execute("SELECT coalesce(max(height), 0) FROM n0").fetchall()[0][0]
    for k in range(top):
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE n{k + 1} AS
            SELECT tree, bucket, n, pos // {FAN} AS pos, height, sha256(string_agg(digest, '' ORDER BY pos)) AS digest
            FROM n{k} WHERE height > {k} GROUP BY tree, bucket, n, pos // {FAN}, height""")
    return top + 1


def _root_block(nodes: pa.Table) -> pa.Table:
    """tree, bucket, n and digest of each bucket's root."""
    con = _connection()
    of_level = [f"SELECT tree, bucket, n, digest FROM n{k} WHERE height = {k}" for k in range(_levels(con, nodes.select(["tree", "bucket", "n", "pos", "height", "digest"])))]
    return con.sql(" UNION ALL ".join(of_level)).to_arrow_table()


def _proof_block(nodes: pa.Table, outer: pa.Table, carry: list[str], size: int) -> pa.Table:
    """The block's nodes with their subroot and their proof: siblings before and behind them, level by level, then the bucket's own."""
    con = _connection()
    top = _levels(con, nodes)
    con.register("outside", outer)
    side = "string_agg(digest, '') OVER (PARTITION BY tree, bucket, pos // {fan} ORDER BY pos ROWS BETWEEN {rows})"
    before, behind = side.format(fan=FAN, rows="UNBOUNDED PRECEDING AND 1 PRECEDING"), side.format(fan=FAN, rows="1 FOLLOWING AND UNBOUNDED FOLLOWING")
    joins, steps = "", []
    for k in range(top - 1):
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE s{k} AS
            SELECT tree, bucket, pos, {{'left': coalesce({before}, ''), 'right': coalesce({behind}, '')}} AS step FROM n{k} WHERE height > {k}""")
        joins += f" LEFT JOIN s{k} ON s{k}.tree = n0.tree AND s{k}.bucket = n0.bucket AND s{k}.pos = n0.pos // {FAN**k}"
        steps.append(f"CASE WHEN s{k}.step IS NULL THEN [] ELSE [s{k}.step] END")
    path = " || ".join([*steps, "o.path"])
    own = "".join(f", n0.{c}" for c in carry)
    out = con.sql(f"""
        SELECT n0.tree, n0.bucket * {size} + n0.pos AS rank, n0.digest, o.subroot, {path} AS path{own}
        FROM n0 JOIN outside o ON o.tree = n0.tree AND o.bucket = n0.bucket{joins}""").to_arrow_table()
    con.unregister("outside")
    return out


def _proofs_with(carry: list[str], size: int):
    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        return _proof_block(left.select(["tree", "bucket", "n", "pos", "height", "digest", *carry]), right.select(["tree", "bucket", "subroot", "path"]), carry, size)

    return make


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def climb(nodes: DataFrame, carry: list[str], name: str, height: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """nodes (tree, rank, n, digest, carry) -> the rounds' bucketed nodes with their numbers of blocks, and tree, digest of the roots."""
    rounds: list[tuple[DataFrame, int]] = []
    size = FAN**height
    while True:
        own_height = sum(((F.col("n") > FAN**k).cast("int") for k in range(1, height)), (F.col("n") > 1).cast("int"))
        own = nodes.select("tree", F.expr(f"rank div {size}").alias("bucket"), (F.col("rank") % size).alias("pos"), F.col("n").cast("long").alias("n"), own_height.alias("height"), "digest", *carry)
        cut, _ = materialize(own, f"{name}-{len(rounds)}")
        rows, most = cut.agg(F.count("*"), F.max("n")).first()
        blocks = 2 * (rows // size) + 1
        rounds.append((cut, blocks))
        blocked = _blocked(cut.select("tree", "bucket", "n", "pos", "height", "digest"), blocks)
        roots, _ = materialize(blocked.groupBy("block").applyInArrow(_root_block, "tree string, bucket long, n long, digest string"), f"{name}-roots-{len(rounds)}")
        if (most or 0) <= size:
            return rounds, roots.select("tree", "digest")
        nodes, carry = roots.select("tree", F.col("bucket").alias("rank"), F.ceil(F.col("n") / size).cast("long").alias("n"), "digest"), []


def descend(rounds: list[tuple[DataFrame, int]], outer: DataFrame, carry: list[str], name: str, height: int) -> DataFrame:
    """outer (tree, subroot, path of the tree's root) -> tree, rank, digest, subroot, path, carry of the lowest round's nodes."""
    outer = outer.select("tree", F.lit(0).cast("long").alias("bucket"), "subroot", "path")
    for k in range(len(rounds) - 1, -1, -1):
        nodes, blocks = rounds[k]
        own = carry if k == 0 else []
        schema = f"tree string, rank long, digest string, subroot string, path {_PATH}" + (", " + _fields(nodes, own) if own else "")
        both = _blocked(nodes, blocks).groupBy("block").cogroup(_blocked(outer, blocks).groupBy("block"))
        found = both.applyInArrow(_proofs_with(own, FAN**height), schema)
        if k == 0:
            return found
        outer, _ = materialize(found.select("tree", F.col("rank").alias("bucket"), "subroot", "path"), f"{name}-outer-{k}")
    raise AssertionError


def manifest(rows: DataFrame, carry: tuple[str, ...] = (), height: int = HEIGHT) -> DataFrame:
    """rows (doc_id, tree, leaf, carry) -> doc_id, leaf, subroot, root, proof and carry; proof: left and right siblings by level."""
    kept, _ = materialize(rows.select("tree", "doc_id", F.col("leaf").alias("digest"), *carry), "leaves")
    rounds, subroots = climb(ranked(kept, ["doc_id", "digest"], "ranked"), ["doc_id", *carry], "buckets", height)
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper, top = climb(ranked(names, ["name"], "trees"), ["name"], "top", height)
    root = top.first()
    none = F.array().cast(_PATH)
    above = descend(upper, top.select("tree", F.col("digest").alias("subroot"), none.alias("path")), ["name"], "top", height)
    outer, _ = materialize(above.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"), "tree-paths")
    found = descend(rounds, outer, ["doc_id", *carry], "paths", height)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("path").alias("proof"), *carry)


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(proof: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


#: crc32 of a doc_id's decimal text, bit by bit, as a DuckDB expression.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
#: Levels that the SQL goes through: sources of up to 3 ** 12 rows, up to 3 ** 6 sources.
_SOURCE_LEVELS, _TOP_LEVELS = 12, 6


def _tree_sql(name: str, start: str, levels: int, by: str) -> str:
    """CTEs {name}0 ... of (by, n, pos, d) by level, and {name}s of each leaf's siblings by level."""
    over = f"PARTITION BY {by}, pos // {FAN} ORDER BY pos ROWS BETWEEN"
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT {by}, CASE WHEN n > 1 THEN (n + {FAN - 1}) // {FAN} ELSE 1 END AS n, CASE WHEN n > 1 THEN pos // {FAN} ELSE pos END AS pos,
            CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY {by}, n, CASE WHEN n > 1 THEN pos // {FAN} ELSE pos END)""")
        out.append(f"""{name}p{k} AS (SELECT {by}, pos, coalesce(string_agg(d, '') OVER ({over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(d, '') OVER ({over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)""")
    return ",\n    ".join(out)


def _fold_sql(name: str, start: str, levels: int, by: str, path: str) -> str:
    """CTEs {name}0 ... that take cur, pos and proof up the levels of the tree `path`."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT f.* EXCLUDE (cur, pos, proof), CASE WHEN p.l IS NULL THEN cur ELSE sha256(p.l || cur || p.r) END AS cur, f.pos // {FAN} AS pos,
            CASE WHEN p.l IS NULL THEN proof ELSE proof || p.l || p.r END AS proof FROM {name}{k} f LEFT JOIN {path}p{k} p ON p.{by} = f.{by} AND p.pos = f.pos)""")
    return ",\n    ".join(out)


def _sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    changed = f"CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    return f"""
    WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS tree, {digest("text")} AS leaf, {digest(f"({changed})")} AS changed FROM documents),
    w AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
    {_tree_sql("t", "SELECT tree, n, pos, leaf AS d FROM w", _SOURCE_LEVELS, "tree")},
    roots AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS m, 1 AS one FROM t{_SOURCE_LEVELS}),
    {_tree_sql("u", "SELECT one, m AS n, spot AS pos, subroot AS d FROM roots", _TOP_LEVELS, "one")},
    {_fold_sql("f", "SELECT doc_id, tree, leaf, changed AS cur, pos, '' AS proof FROM w", _SOURCE_LEVELS, "tree", "t")},
    {_fold_sql("g", f"SELECT f.doc_id, f.leaf, r.subroot, r.one, f.cur, r.spot AS pos, f.proof FROM f{_SOURCE_LEVELS} f JOIN roots r USING (tree)", _TOP_LEVELS, "one", "u")}
    SELECT doc_id, leaf, subroot, u.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.d AS verified FROM g{_TOP_LEVELS} CROSS JOIN u{_TOP_LEVELS} u
"""


SQL = _sql()
