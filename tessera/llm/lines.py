"""Line dedup by a log-template tree, in DataFrame operations only.

Tokens with digits are variable fields. A line goes down a tree of fixed depth: by its number of tokens, then by its first
LEAD tokens. At a leaf a token is fixed if two different lines or more have it at its place, the others are variable fields. A line
most of whose tokens (SIMILAR or more, the leading ones included) are fixed belongs to the template of just these tokens, so a
leaf can hold any number of templates and none of their lines need repeat exactly; any other line is a template of its own, and
so is every line under LEAST_GENERAL tokens. A template that stands in two documents or more recurs: its lines are dropped
everywhere but at its first place (smallest doc_id, then line). Lines of one token, and lines of nothing but variable fields
and blanks, are never dropped.

Defined results: a null text stays null, with no lines; an empty text stays empty; a document all of whose lines go keeps an
empty text and its row; rows that share a doc_id count as one document, but lose only lines that recur in their own text; rows
without doc_id lose none.
Columns other than doc_id and text pass through, but columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

LEAD, SIMILAR, LEAST_TOKENS, LEAST_GENERAL = 3, 0.7, 2, 5
#: Leaves up to which they are broadcast; more are joined by a shuffle.
FEW_LEAVES = 200_000


def masked(line: Column) -> Column:
    """Tokens with a digit become <*>; the pattern looks at each token once, from its start."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(line)


def text_key(text: Column) -> Column:
    """Tells the texts of rows that share a doc_id apart."""
    return F.xxhash64(text)


def _lines(docs: DataFrame) -> DataFrame:
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("own"))
    each = own.select("doc_id", "own", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    size = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    some = (size >= LEAST_TOKENS) & F.col("line").rlike(r"(^|\s)[^\s0-9]+(\s|$)")  # a token without digits
    kept = each.where(some).select("doc_id", "own", "at", size.alias("n"), masked(F.col("line")).alias("m"))
    lead = F.call_function("substring_index", "m", F.lit(" "), F.when(F.col("n") >= LEAST_GENERAL, LEAD).otherwise(F.col("n")))
    return kept.select("doc_id", "own", "at", F.xxhash64("n", lead).alias("leaf"), F.xxhash64("m").alias("pattern"), "m")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, own (the text's key) and drop (array of line numbers from 0) of every text that loses lines."""
    keys, _ = materialize(_lines(docs).drop("m"), "lines")
    first = F.min(F.struct("doc_id", "at", "own")).alias("first")
    patterns, _ = materialize(keys.groupBy("leaf", "pattern").agg(first, F.max("doc_id").alias("last")), "patterns")
    leaves = patterns.groupBy("leaf").agg(F.count("*").alias("kinds"), F.min("first.doc_id").alias("least"), F.max("last").alias("most")).where("kinds > 1 and least < most").select("leaf")
    leaves, _ = materialize(leaves, "leaves")
    few = leaves.count() <= FEW_LEAVES
    texts = _lines(docs).join(F.broadcast(leaves) if few else leaves, "leaf").groupBy("leaf", "pattern").agg(F.min("m").alias("m"))
    own = F.transform(F.split("m", " "), lambda token, place: F.xxhash64(place, token))
    texts, _ = materialize(texts.select("leaf", "pattern", own.alias("tokens")), "leaf-lines")
    tokens = texts.select("leaf", "pattern", F.size("tokens").alias("n"), F.explode(F.slice("tokens", LEAD + 1, F.size("tokens"))).alias("token"))
    shared, _ = materialize(tokens.groupBy("leaf", "token").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "fixed-tokens")  # so that the next join can split a hot token
    general = F.xxhash64(F.bit_xor("token"), F.bit_xor(F.xxhash64("token")), F.count("*"))
    fixed = tokens.join(shared, ["leaf", "token"]).groupBy("leaf", "pattern").agg(F.first("n").alias("n"), F.count("*").alias("fixed"), general.alias("general"))
    alike = fixed.where(F.col("fixed") + LEAD >= F.col("n") * SIMILAR).select("leaf", "pattern", "general")
    alike, _ = materialize(alike, "templates")
    named = lambda df: df.join(alike, ["leaf", "pattern"], "left").withColumn("template", F.coalesce("general", "pattern"))
    recurring = named(patterns).groupBy("leaf", "template").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first.doc_id < last").select("leaf", "template", "first")
    recurring, _ = materialize(recurring, "recurring")  # so that the next join can split a hot template
    gone = named(keys).join(recurring, ["leaf", "template"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")) | (F.col("own") != F.col("first.own")))
    return gone.groupBy("doc_id", "own").agg(F.collect_set("at").alias("drop"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with the recurring lines gone from text, and n_lines and n_dropped as further columns."""
    docs = docs.drop("n_lines", "n_dropped")
    drop, _ = materialize(dropped_lines(docs), "drops")
    drop = drop.select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"), F.col("drop").alias("__drop"))
    both = docs.join(drop.hint("merge"), (F.col("doc_id").cast("long") == F.col("__id")) & (text_key(F.col("text")) == F.col("__own")), "left")
    both = both.withColumn("__parts", F.split("text", "\n"))  # a column: a lambda would split anew for every line
    parts = F.col("__parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__drop")  # in time linear in the lines
    rest = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(rest)
    counts = [F.coalesce(F.size(parts).cast("long"), F.lit(0).cast("long")).alias("n_lines"), F.coalesce(F.size("__drop").cast("long"), F.lit(0).cast("long")).alias("n_dropped")]
    counts[0] = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines")
    counts[1] = F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_dropped")
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *counts)


SQL = rf"""
    WITH l AS (
        SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
        FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id IS NOT NULL)),
    k AS (
        SELECT doc_id, pos, length(line) - length(replace(line, ' ', '')) + 1 AS n, regexp_replace(line, '\S*[0-9]\S*', '<*>', 'g') AS m, line FROM l),
    keyed AS (SELECT doc_id, pos, n, m, CASE WHEN n >= {LEAST_GENERAL} THEN list_slice(string_split(m, ' '), 1, {LEAD}) ELSE string_split(m, ' ') END AS lead
        FROM k WHERE n >= {LEAST_TOKENS} AND regexp_matches(line, '(^|\s)[^\s0-9]+(\s|$)')),
    p AS (SELECT n, lead, m, min((doc_id, pos)) AS first, max(doc_id) AS last FROM keyed GROUP BY n, lead, m),
    tok AS (SELECT n, lead, m, i AS place, string_split(m, ' ')[i] AS token FROM (SELECT n, lead, m, unnest(range({LEAD} + 1, n + 1)) AS i FROM p WHERE n >= {LEAST_GENERAL})),
    f AS (SELECT *, count(*) OVER (PARTITION BY n, lead, place, token) > 1 AS fixed FROM tok),
    g AS (SELECT n, lead, m, list(token ORDER BY place) FILTER (fixed) AS tokens, list(place ORDER BY place) FILTER (fixed) AS places FROM f GROUP BY n, lead, m),
    t AS (
        SELECT p.*, CASE WHEN len(g.tokens) + {LEAD} >= p.n * {SIMILAR} THEN [array_to_string(g.places, ',')] || g.tokens ELSE [p.m] END AS template
        FROM p LEFT JOIN g ON g.n = p.n AND g.lead = p.lead AND g.m = p.m),
    r AS (SELECT n, lead, template, min(first) AS first, max(last) AS last FROM t GROUP BY n, lead, template),
    gone AS (
        SELECT keyed.doc_id, keyed.pos FROM keyed JOIN t ON keyed.n = t.n AND keyed.lead = t.lead AND keyed.m = t.m
        JOIN r ON r.n = t.n AND r.lead = t.lead AND r.template = t.template
        WHERE r.first[1] < r.last AND (keyed.doc_id, keyed.pos) <> r.first),
    kept AS (
        SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY l.doc_id),
    lost AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
"""
