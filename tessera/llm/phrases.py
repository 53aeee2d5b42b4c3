"""Phrases whose words stand together more often than their parts let expect, by language.

Texts, A-Z lower-cased, are split into pieces at delimiters and pieces into words; phrases are runs of words within a piece.

1. Sketch. Each task packs texts of one language into shards of SHARD bytes and counts the phrases of one to `longest` words by
   cells of a hash. The sketch has EACH to 2 * EACH cells for a byte of text, 2 ** CELL_BITS at most, of which those in use are kept, as sorted numbers, in slices by their
   leading bits; counts stop at `least`. Executors add up a slice over all shards: a cell's sum is an upper bound of the
   frequency of every phrase in it, as collisions only add. Each shard gets back its own cells that reach `least`.
2. Count. Words are counted as they are numbered. The longer phrases of a shard in such cells, and no others, are compiled into an Aho-Corasick automaton (pyahocorasick) with a
   blank before and behind them as guards; pieces are parted by a line feed, so a match is one of whole words within a piece.
   The automaton scans its shard, overlapping matches included, and the shards' counts are added up.
3. Thresholds, on the sums: exact from here on. The parts of a frequent phrase are as frequent, so they were counted as well.

No automaton, sketch slice or shard grows with the corpus; their numbers do, the slices' with the bytes of text.

Defined results: a null text is empty, a null lang is `und`; repeated rows count each time; an empty table gives an empty result;
columns other than lang and text are ignored. A text of any length is one document; a piece is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import numbered
from .common import bounded_batches, fresh_path, materialize, release, remove, temporary

LEAST, LONGEST, TOP = 10, 3, 2000
#: A candidate goes if a longer one around it has this share (in hundredths) of its frequency; scores are in millionths.
WITHIN, UNIT = 50, 1_000_000
#: Bytes of text in a shard, and bytes of all texts for each slice of the sketch.
SHARD, SLICE = 8 << 20, 16 << 20
#: Bytes of text that a task keeps for shards of several languages.
PENDING = 24 << 20
#: Cells for each byte of text (more of them take more bits each on disk, fewer bring more phrases that share one), and the most bits of a cell.
EACH, CELL_BITS = 64, 48
UNKNOWN = "und"

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(1, np.int8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word of the text, the words by number, and the number of each word's piece (ascending)."""
    text = _LOWER[np.frombuffer(raw, np.uint8)]
    kind = _CLASS[text]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate((_EDGE, inside.view(np.int8), _EDGE))))
    starts, ends = edges[0::2], edges[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, piece


def joined(ids: np.ndarray, words: list[str], piece: np.ndarray) -> str:
    """The text in normal form: a blank before and behind every word, a line feed as a word between pieces."""
    cuts = np.flatnonzero(np.diff(piece)) + 1
    return " " + " ".join(map([*words, "\n"].__getitem__, np.insert(ids, cuts, len(words)).tolist())) + " "


def cells(ids: np.ndarray, words: list[str], piece: np.ndarray, lang: str, longest: int, wide: int = CELL_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words the places where such phrases begin, and their cells of `wide` bits."""
    import xxhash

    of_word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.full(len(ids), xxhash.xxh64_intdigest(lang), np.uint64)
    at = np.arange(len(ids))
    for k in range(longest):
        if k:
            some = np.flatnonzero(piece[at[at < len(ids) - k]] == piece[at[at < len(ids) - k] + k])
            at, h = at[some], h[some]
        h = (h ^ of_word[ids[at + k]]) * _MIX
        h ^= h >> np.uint64(29)
        yield at, (h * _MIX) >> np.uint64(64 - wide)


def pack(sorted_cells: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    steps = np.diff(sorted_cells, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(sorted_cells).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(steps + (b"" if counts is None else counts.astype(np.uint8).tobytes()))


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(payload[:4], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[4:]), np.uint8)
    return np.cumsum(raw[: 8 * n].reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64), raw[8 * n :]


SHARDS = "shard long, lang string, kind string, slice long, n long, payload binary"


def _shards(longest: int, least: int, bits: int, full: int, wide: int):
    """Texts of a task -> for each shard its text in normal form and its cells by slice."""

    def rows(shard: int, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, words, piece = words_of(b"\n".join(texts))
        words = words.cast(pa.string()).to_pylist()
        texts.clear()
        if not len(ids):
            return
        found, counts = np.unique(np.concatenate([c for _, c in cells(ids, words, piece, lang, longest, wide)]), return_counts=True)
        counts = np.minimum(counts, least)
        of_slice = found >> np.uint64(wide - bits)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(of_slice)) + 1, [len(found)]))
        payload = [zstandard.ZstdCompressor(level=1).compress(joined(ids, words, piece).encode())]
        payload += [pack(found[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        slices = [-1, *of_slice[cuts[:-1]].tolist()]
        m = len(slices)
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard] * m, pa.int64()), "lang": [lang] * m, "kind": ["text", *["cells"] * (m - 1)],
            "slice": pa.array(slices, pa.int64()), "n": pa.array([len(ids), *[0] * (m - 1)], pa.int64()), "payload": pa.array(payload, pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        held = 0
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                pending.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                held += len(text) + 1
                if size[lang] >= full or held >= PENDING:
                    most = max(size, key=size.__getitem__)
                    held -= size.pop(most)
                    yield from rows(shard, most, pending.pop(most))
                    shard += 1
        for lang, texts in pending.items():
            yield from rows(shard, lang, texts)
            shard += 1
        release()

    return run


def _heavy(least: int, bits: int):
    """One slice of all shards -> each shard's cells whose sum reaches `least`."""

    def run(table: pa.Table) -> pa.Table:
        shards, payloads = table["shard"].to_numpy(), table["payload"]
        release()
        own, counts = zip(*(unpack(p.as_py()) for p in payloads), strict=True)
        whole = np.concatenate(own)
        own = np.split(whole, np.cumsum([len(c) for c in own])[:-1])  # so that the cells are in memory once
        order = np.argsort(whole, kind="stable")
        every, of = whole[order], np.concatenate(counts)[order]
        del order, counts
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        heavy = every[first][np.add.reduceat(of, first, dtype=np.int64) >= least]
        del every, of, first
        back = [c[is_in(c, heavy)] for c in own]
        some = [k for k, c in enumerate(back) if len(c)]
        release()
        return pa.table({"shard": pa.array(shards[some], pa.int64()), "payload": pa.array([pack(back[k]) for k in some], pa.binary())})

    return run


def is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


COUNTS = "lang string, phrase string, a long"


def _scan(longest: int, wide: int):
    """A shard's text and its heavy cells -> how often the shard has each phrase of these cells."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        import ahocorasick

        none = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "a": pa.array([], pa.int64())})
        if not texts.num_rows or not replies.num_rows:
            return none
        lang, raw = texts["lang"][0].as_py(), zstandard.ZstdDecompressor().decompress(texts["payload"][0].as_py())
        heavy = np.sort(np.concatenate([unpack(p.as_py())[0] for p in replies["payload"]]))
        ids, words, piece = words_of(raw)
        texts_of = words.cast(pa.string()).to_pylist()
        single, phrases = candidates(ids, texts_of, piece, heavy, lang, longest, wide)
        found = np.bincount(ids, minlength=len(texts_of))[single]
        automaton = ahocorasick.Automaton()
        for k, phrase in enumerate(phrases):
            automaton.add_word(f" {phrase} ", k)
        if phrases:
            automaton.make_automaton()
            matches = np.fromiter(map(itemgetter(1), automaton.iter(raw.decode())), np.int32)
            found = np.concatenate([found, np.bincount(matches, minlength=len(phrases))])
        phrases = [*map(texts_of.__getitem__, single.tolist()), *phrases]
        del automaton, raw, ids, words, texts_of, piece
        release()
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "a": pa.array(found, pa.int64())})

    return run


def candidates(ids: np.ndarray, words: list[str], piece: np.ndarray, heavy: np.ndarray, lang: str, longest: int, wide: int = CELL_BITS) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words in heavy cells, and the different longer phrases in such cells; told apart by their words, not by hashes."""
    single, phrases = np.zeros(0, np.int64), []
    for k, (at, own) in enumerate(cells(ids, words, piece, lang, longest, wide)):
        at = at[is_in(own, heavy)]
        if not k:
            single = np.unique(ids[at])
            continue
        many = max(1, len(words)) ** (k + 1) >= 1 << 63  # then the phrases are numbered word by word
        key = ids[at].astype(np.int64)
        for step in range(1, k + 1):
            key = (np.unique(key, return_inverse=True)[1] if many else key) * len(words) + ids[at + step]
        if many:
            first = at[np.unique(key, return_index=True)[1]]
            columns = [ids[first + step] for step in range(k + 1)]
        else:
            key, columns = np.unique(key), []
            for _ in range(k + 1):
                key, last = np.divmod(key, len(words))
                columns.insert(0, last)
        phrases += map(" ".join, zip(*(map(words.__getitem__, c.tolist()) for c in columns), strict=True))
    return single, phrases


def cell_bits(size: int, bits: int) -> int:
    """Bits of a cell for `size` bytes of text, of which `bits` tell its slice."""
    return max(bits, min(CELL_BITS, (EACH * size).bit_length()))


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard: int = SHARD, each_slice: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of up to `longest` words that stand `least` times or more; (lang, n) of all words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // each_slice).bit_length())
    wide = cell_bits(size, bits)
    path = fresh_path(spark, "shards")
    own.mapInArrow(_shards(longest, least, bits, shard, wide), SHARDS).write.partitionBy("kind").parquet(path)
    temporary(spark, path)
    made = spark.read.schema(SHARDS).parquet(path)
    texts, sketch = made.where("kind = 'text'").select("shard", "lang", "payload"), made.where("kind = 'cells'").select("shard", "slice", "payload")
    heavy, heavy_path = materialize(sketch.groupBy("slice").applyInArrow(_heavy(least, bits), "shard long, payload binary"), "heavy-cells")
    remove(spark, f"{path}/kind=cells")  # the heavy ones are written; texts are read from their own partition
    found = texts.groupBy("shard").cogroup(heavy.groupBy("shard")).applyInArrow(_scan(longest, wide), COUNTS)
    summed, _ = materialize(found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrase-counts")
    remove(spark, heavy_path)
    return summed, made.where("kind = 'text'").groupBy("lang").agg(F.sum("n").alias("n"))


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(UNIT * a * a / (l * r)), in decimals of 38 digits."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(7,0)") * d(a) * d(a), d(l) * d(r))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words; sizes: bytes of a shard, bytes for each slice."""
    summed, n = counts(docs, longest, least, **sizes)
    w = F.split("phrase", " ")
    many = summed.where(F.size(w) > 1).withColumn("w", w)
    part = lambda start, size: F.array_join(F.slice(F.col("w"), start, size), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array(F.struct(k.alias("cut"), F.lit(True).alias("head"), part(F.lit(1), k).alias("part")), F.struct(k.alias("cut"), F.lit(False).alias("head"), part(k + 1, F.size("w") - k).alias("part"))))
    parts, _ = materialize(many.select("lang", "phrase", "a", F.inline(F.flatten(cuts))), "phrase-parts")
    known = parts.join(summed.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    of_cut = known.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    best = of_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: part(i, k))))
    around = many.where(F.size("w") > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * WITHIN))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", (-F.col("best.score")).alias("low"), (-F.col("a")).alias("rare"))
    first = numbered(rows, ["low", "rare", "phrase"], ("lang",)).where(F.col("rank") < top)
    return first.join(n, "lang").select("lang", (F.col("rank") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_ROOM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
    WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_ROOM}', '{_ROOM.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM q, range(1, {LONGEST + 1}) AS s(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {LEAST}),
    cut AS (SELECT lang, phrase, a, i, array_to_string(w[1 : i], ' ') AS head, array_to_string(w[i + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
    s AS (SELECT cut.*, l.a AS l, r.a AS r, (({UNIT}::HUGEINT * cut.a * cut.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.head JOIN f r ON r.lang = cut.lang AND r.phrase = cut.tail),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
    longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
        FROM (SELECT lang, a, k, w, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {LONGEST}) AS z(m) WHERE m < k)) GROUP BY lang, phrase),
    kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < {WITHIN} * b.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
