import random
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from frames import no_documents, odd_documents  # noqa: E402

from tessera.llm import passages  # noqa: E402


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return passages.repeated(df).collect(), {r["doc_id"]: r["text"] for r in passages.passage_dedup(df).collect()}


def windows(text, n=50):
    own = (text or "").split()
    return {" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}


def test_nothing_is_lost_on_the_table(spark):
    """Marked bytes still stand somewhere after the cut; most runs of 50 words that several documents share are whole somewhere."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, kept = passages.repeated(docs).collect(), passages.passage_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    texts, after = ({r["doc_id"]: (r["text"] or "").encode() for r in df.select("doc_id", "text").collect()} for df in (docs, kept))
    left = {t[i : i + 48] for t in after.values() for i in range(len(t) - 47)}
    marked = [texts[r["doc_id"]][i : i + 48] for r in found if r["is_repeat"] for i in range(r["start"], r["stop"] - 47, 16)]
    lost = [w for w in marked if w not in left]
    assert len(marked) > 5000 and len(lost) <= 0.005 * len(marked)
    holders = defaultdict(set)
    for d, t in texts.items():
        for w in windows(t.decode()):
            holders[w].add(d)
    shared = {w for w, ds in holders.items() if len(ds) > 1}
    cut = shared.difference(*(windows(t.decode()) for t in after.values()))
    assert len(shared) > 1000 and len(cut) <= 0.06 * len(shared)  # their parts stand in different documents
    assert any(r["is_repeat"] for r in found) and all(r["first_doc_id"] < r["doc_id"] if r["is_repeat"] else r["first_doc_id"] == r["doc_id"] for r in found)


def test_adjacent_passages_of_different_origin_stay_somewhere(spark):
    rng, rows, wanted = random.Random(31), [], []
    for k in range(100):
        c, d = words(rng, 60), words(rng, 60)
        wanted += [c, d]
        rows += [(10 * k + 2, f"{words(rng, 20)} {c} {words(rng, 20)}"), (10 * k + 3, f"{words(rng, 20)} {c} {d} {words(rng, 20)}"), (10 * k + 9, f"{words(rng, 20)} {d} {words(rng, 20)}")]
    found, after = run(spark, rows)
    joined = "\n".join(after.values())
    assert all(w in joined for w in wanted)
    marked = {r["doc_id"] for r in found if r["is_repeat"]}
    assert sum(10 * k + 3 in marked for k in range(100)) >= 98 and sum(10 * k + 9 in marked for k in range(100)) >= 98
    covered, by = [], dict(rows)
    for k in range(100):
        raw, at = by[10 * k + 9].encode(), by[10 * k + 9].index(wanted[2 * k + 1])
        spans = [(r["start"], r["stop"]) for r in found if r["doc_id"] == 10 * k + 9 and r["is_repeat"]]
        size = len(wanted[2 * k + 1])
        covered.append(sum(max(0, min(z, at + size) - max(a, at)) for a, z in spans) / size)
        assert all(z <= len(raw) for _, z in spans)
    assert sum(covered) / len(covered) > 0.75


def test_repeated_ids_ties_and_characters(spark):
    rng = random.Random(5)
    shared = "".join(c if rng.random() < 0.7 else "éß日"[rng.randrange(3)] for c in words(rng, 80))
    rows = [(1, f"{words(rng, 30)} {shared}"), (2, f"{shared} {words(rng, 30)}"), (2, f"{shared} {words(rng, 30)}"), (3, shared), (3, shared), (4, None), (5, ""), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in passages.passage_dedup(df).collect()), key=str)
    want = dict(rows[:1])
    assert len(got) == 8 and (1, want[1]) in got and (4, None) in got and (5, "") in got and (0, shared) in got
    assert [t for d, t in got if d == 2] == sorted(t for d, t in rows if d == 2)
    short = [t for d, t in got if d == 3]
    assert len(short) == 2 and short[0] == short[1] and len(short[0]) < 0.5 * len(shared)


def test_odd_and_empty_tables(spark):
    assert passages.passage_dedup(odd_documents(spark)).count() == 11
    assert passages.passage_dedup(no_documents(spark)).count() == 0
    assert passages.cut_out("aéb", [(1, 2)]) == "aéb" and passages.cut_out("aéb", [(0, 3), (3, 4)]) == "" and passages.cut_out("aéb", [(2, 4)]) == "aé"


def brute(rows):
    """The passages of (doc_id, text) rows, chunk by chunk and place by place."""
    texts = [(d, t.encode()) for d, t in rows if d is not None and t]
    holders, places, stretch_holders = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, raw in texts:
        bounds = passages.cuts(raw).tolist()
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z - a >= passages.LEAST_CHUNK:
                end = next((b for b in bounds if b >= a + passages.LEAST_BYTES), 0)
                holders[raw[a:z]].add(d)
                places[d].add((a, z, end, raw[a:z], raw[a:end] if end else None))
    out = []
    runs = {}
    for d, own in places.items():
        run = []
        for x in sorted((x for x in own if len(holders[x[3]]) > 1), key=lambda x: x[:2]):
            if run and x[0] - run[-1][1] > passages.BRIDGE:
                runs.setdefault(d, []).append(run)
                run = []
            run.append(x)
        if run:
            runs.setdefault(d, []).append(run)
    runs = {d: [r for r in rs if max(x[1] for x in r) - r[0][0] >= passages.LEAST_BYTES] for d, rs in runs.items()}
    for d, rs in runs.items():
        for x in (x for r in rs for x in r if x[4] is not None):
            stretch_holders[x[4]].add(d)
    for d, rs in runs.items():
        for r in rs:
            marks, firsts, first = [], [], None
            for i, x in enumerate(r):
                keeper = lambda y: min(stretch_holders[y[4]]) if y[4] is not None and len(stretch_holders[y[4]]) > 1 else None
                if keeper(x) is not None and keeper(x) < d:
                    first = keeper(x)
                firsts.append(first)
                reach = lambda want: any(y[2] >= x[1] for y in r[: i + 1] if keeper(y) is not None and want(keeper(y)))
                marks.append(reach(lambda k: k < d) and not reach(lambda k: k == d))
            pieces = []
            for i, m in enumerate(marks):
                if i and m == marks[i - 1]:
                    pieces[-1].append(i)
                else:
                    pieces.append([i])
            size = lambda piece: max(r[i][1] for i in piece) - r[piece[0]][0]
            kept = [marks[p[0]] and size(p) >= passages.LEAST_BYTES for p in pieces]
            parts = []
            for p, m in zip(pieces, kept, strict=True):
                if parts and parts[-1][1] == m:
                    parts[-1][0].extend(p)
                else:
                    parts.append((list(p), m))
            for p, m in parts:
                if size(p) >= passages.LEAST_BYTES:
                    known = [firsts[i] for i in p if firsts[i] is not None]
                    out.append((d, r[p[0]][0], max(r[i][1] for i in p), min(known) if m else d, m))
    return sorted(out)


def test_repeated_equals_brute_force(spark):
    """Overlapping passages of several origins, edits, repeats within one document; and the whole small table."""
    rng = random.Random(9)
    shared = [words(rng, rng.randint(15, 70)) for _ in range(12)]
    rows = []
    for d in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        text = " ".join(parts)
        if d % 7 == 0:
            text = text[: len(text) // 2] + "!" + text[len(text) // 2 :]
        rows.append((d * 3 % 61, text))
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for case in (rows, table):
        df = spark.createDataFrame(case, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["start"], r["stop"], r["first_doc_id"], r["is_repeat"]) for r in passages.repeated(df).collect())
        want = brute(case)
        assert len(want) > 40 and got == want
