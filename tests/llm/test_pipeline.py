import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from frames import no_documents  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import lines, simhash, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count() and last.where(~F.col("round_trip")).count() == 0


def test_an_empty_table_goes_through(spark):
    docs = no_documents(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_nulls_and_clashing_names_go_through(spark):
    from frames import odd_documents

    docs = odd_documents(spark).selectExpr("*", "'en' AS lang", "cast(length(text) AS long) AS n_chars", "1 AS n_dropped", "'x' AS score", "k AS predicted", "h AS fp", "0 AS item_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER).cache()
        assert out.count() > 0 and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}, name
        docs = out.select(*[c for c in docs.columns if c in out.columns])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.where("ids is null or n_tokens is null").count() == 0 and last.count() == docs.count()


def brute_lines(rows):
    """Texts by doc_id after line dedup, from the definition."""
    import re
    from collections import Counter

    where, first, last, at_leaf = {}, {}, {}, Counter()
    for d, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            m = re.sub(r"\S*[0-9]\S*", "<*>", line)
            tokens = line.count(" ") + 1
            if tokens >= lines.LEAST_TOKENS and re.search(r"\S", m.replace("<*>", "")):
                key = (tokens, tuple(m.split(" ")[: lines.LEAD if tokens >= lines.LEAST_GENERAL else tokens]), m)
                where[d, at] = key
                first[key] = min(first.get(key, (d, at)), (d, at))
                last[key] = max(last.get(key, d), d)
    for n, lead, m in first:
        at_leaf.update((n, lead, k, x) for k, x in enumerate(m.split(" ")))
    template = {}
    for key in first:
        n, lead, m = key
        fixed = tuple((k, x) for k, x in enumerate(m.split(" ")) if k < lines.LEAD or at_leaf[n, lead, k, x] > 1)
        template[key] = (n, lead, fixed) if n >= lines.LEAST_GENERAL and len(fixed) >= n * lines.SIMILAR else key
    start, end = {}, {}
    for key, t in template.items():
        start[t] = min(start.get(t, first[key]), first[key])
        end[t] = max(end.get(t, last[key]), last[key])
    out = {}
    for d, text in rows:
        kept = []
        for at, line in enumerate((text or "").split("\n")):
            t = template[where[d, at]] if (d, at) in where else None
            if t is None or start[t][0] == end[t] or start[t] == (d, at):
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def shingles_of(text):
    """The text's five-word shingles, as strings; of fewer words, all of them as one."""
    import re

    w = [x for x in re.split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_pairs(rows, least=0.8):
    """All pairs of these (id, text) rows of this similarity, by prefixes of the rarest shingles, which miss none."""
    from collections import Counter, defaultdict

    sets = {d: shingles_of(t) for d, t in rows}
    often = Counter(s for own in sets.values() for s in own)
    holders, out = defaultdict(list), set()
    for d, own in sorted(sets.items()):
        prefix = sorted(own, key=lambda s: (often[s], s))[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]
        for e in {e for s in prefix for e in holders[s]}:
            shared = len(own & sets[e])
            if shared >= least * (len(own) + len(sets[e]) - shared):
                out.add((e, d))
        for s in prefix:
            holders[s].append(d)
    return out


def similar_components(rows):
    """id -> smallest id that links reach."""
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in similar_pairs(rows):
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {d: top(d) for d in root}


def test_near_duplicates_of_the_table(spark):
    """Of all pairs of different texts at 0.8 or more, the stage joins 0.95 or more; it joins nothing that such pairs don't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    least = {}
    for r in sorted(docs.collect()):
        least.setdefault(r["text"], r["doc_id"])
    rows = [(d, t) for t, d in least.items()]
    pairs, ids = similar_pairs(rows), {d for d, _ in rows}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(docs).collect()}
    assert len(pairs) > 40 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    whole = similar_components(rows)
    assert all(whole[d] <= got[d] and whole[got[d]] == whole[d] for d in ids)


def test_pipeline_against_brute_force(spark):
    import re

    import sentencepiece

    from test_text_operators import PIECES

    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    weights, bias = toxicity.train(table, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    chance = lambda t: 1 / (1 + math.exp(-(bias + sum(weights.get(s, 0.0) for w in toxicity.words(t) for s in toxicity.slots(w)))))
    rows = [(d, t) for d, t in rows if chance(t) < toxicity.THRESHOLD]
    text = brute_lines(rows)
    rows = [d for d, c in similar_components([(d, text[d]) for d, _ in rows]).items() if d == c]
    cut = lambda t: [w for w in re.split(r"[ \t-\r]+", t.lower()) if w]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [cut(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    sets = [(min(5, len(w)), runs(w, min(5, len(w)))) for w in items if w]
    rows = [d for d in rows if not any(len(s & runs(cut(text[d]), n)) >= 0.8 * len(s) for n, s in sets)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {d: sp.encode(text[d]) for d in rows}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_no_similar_pair_is_left_out(spark, monkeypatch):
    """pairs at 0.8 that minimum hashes and the heads of their buckets miss are joined, frequent shingles or not."""
    import random

    from tessera.llm import similar

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for k in range(1500):
        common = [word() for _ in range(36)]
        rows += [(2 * k, " ".join([*common, *(word() for _ in range(4))])), (2 * k + 1, " ".join([*common, *(word() for _ in range(4))]))]
    passage = " ".join(word() for _ in range(12))
    rows = [(d, f"{passage} {t}") if d < 400 else (d, t) for d, t in rows]
    monkeypatch.setattr(similar, "FREQUENT", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(docs).collect()}
    assert len(similar.frequent_shingles(docs)) > 0
    assert got == similar_components(rows)


def test_texts_with_only_a_passage_in_common_do_not_meet():
    """Parities leave out no pair of similarity 0.8, and nearly all that share a passage only."""
    import numpy as np

    from tessera.llm import similar

    rng = np.random.default_rng(9)
    unlike = lambda a, b: int(np.bitwise_count((similar.parities(a) ^ similar.parities(b)).view(np.uint64)).sum())
    for n in (1, 9, 40, 500, 3000):
        same = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        own = [np.unique(np.r_[same, rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]) for _ in range(2)]
        assert unlike(*own) <= sum(len(x) for x in own) - 2 * len(np.intersect1d(*own))
    passage = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    others = [np.unique(np.r_[passage, rng.integers(0, 1 << 63, 400, dtype=np.uint64)]) for _ in range(30)]
    assert all(9 * unlike(a, b) > len(a) + len(b) for i, a in enumerate(others) for b in others[:i])


def test_the_join_of_first_shingles_makes_no_rows_of_a_common_passage(spark):
    import numpy as np

    from tessera.llm import similar

    rng = np.random.default_rng(10)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 300)) + " " + passage) for k in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1] + " one more")]
    found = similar.with_bands(spark.createDataFrame(rows, "content long, text string"), simhash.fingerprints)
    known = found.select(F.lit(7).cast("long").alias("token"), "content", F.col("content").alias("root"), "n", "odd")
    got = {(r["content_x"], r["content_y"]) for r in similar.meetings(known).collect()}
    assert got == {(0, 100), (0, 101), (100, 101)}
