import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from frames import no_documents, odd_documents  # noqa: E402

from tessera.llm import language_model as lm, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
BLOCKS = queries.tokenizer_file("byte_bpe_50k.json")


def cut(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def ids_of(words):
    return [i for w in words for i in np.frombuffer(lm.encoder(BLOCKS).after_blank([w])[0], "<u4").tolist()]


def layout(v=600, seed=3, slots=40, monkeypatch=None):
    """A small layout over v ids, a quarter of which begin words; the last is the end."""
    rng = np.random.default_rng(seed)
    begins = rng.random(v) < 0.25
    begins[-1] = True
    single, last = rng.integers(0, 500, v), rng.integers(0, 100, v)
    counts = lm.Counts(begins, single, np.minimum(single, last), 20)
    inside = np.flatnonzero(~begins)
    keys = np.unique(rng.integers(0, v - 1, 900) * v + rng.choice(inside, 900))
    counts.with_pairs(keys, rng.integers(1, 30, len(keys)))
    return lm.Layout(counts, lm.classes_of(counts, rng.normal(size=(v, lm.SKETCH))))


def plain_chances(stream, lay, model):
    """Chance of every id after the last of a stream of slots, one token at a time and without tables or batches."""
    x = [model.x[lay.slot_of[i]].astype(float) for i in stream]
    q = x[-1] @ model.wq / math.sqrt(lm.QUERY)
    a = np.array([q @ (k @ model.wk) + model.place[len(x) - 1 - j] for j, k in enumerate(x)])
    a = np.exp(a - a.max())
    h = sum(w * (v @ model.wv) for w, v in zip(a / a.sum(), x, strict=True))
    slot = lay.slot_of[stream[-1]]
    z = h @ model.wo + x[-1] @ model.wr + lay.table[slot]
    p = np.exp(z - z.max())
    p /= p.sum()
    every = np.arange(lay.size)
    return p[lay.class_of] * np.exp(lay.within(np.full(lay.size, stream[-1]), every))


def moved(lay, seed=5):
    """A model with weights that matter."""
    model = lm.Attention(lay.slots)
    model.flat += np.random.default_rng(seed).normal(0, 0.3, len(model.flat)).astype(np.float32)
    return model


def test_base_columns_and_one_row_for_each_document(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(odd_documents(spark).where("k > 0 or k is null").select("doc_id", "text"))
    got = lm.score(docs, BLOCKS).collect()
    rows = [(r["doc_id"], [*cut(r["text"]), None]) for r in docs.collect()]
    counts = Counter(w for d, ws in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(ws), sum(counts[x] > 0 for x in ws), round(sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in ws), 6)) for d, ws in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)
    assert lm.score(no_documents(spark), BLOCKS).count() == 0


def test_without_learning_documents(spark):
    held = next(k for k in range(1000) if lm.is_held(k))
    got = lm.score(spark.createDataFrame([(held, "some words here"), (held, None)], "doc_id long, text string"), BLOCKS).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in got] == [(0, 0)] * 2 and all(math.isfinite(r["score"]) for r in got)


def test_held_out_score_beats_single_ids_and_the_counts(spark, monkeypatch):
    """Held-out documents of the table: well above add-one counts of single ids, and above the same counts without attention."""
    kept, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda found, lay: kept.append((lay, real(found, lay))) or kept[-1][1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, BLOCKS).where("held_out").collect()}
    rows = docs.collect()
    vocabulary = sorted({w for r in rows for w in cut(r["text"])})
    of = dict(zip(vocabulary, (np.frombuffer(x, "<u4") for x in lm.encoder(BLOCKS).after_blank(vocabulary)), strict=True))
    lay = kept[0][0]
    single, held = np.zeros(lay.size), []
    for r in rows:
        ids = np.concatenate([*(of[w] for w in cut(r["text"])), [lay.end]]).astype(np.int64)
        if lm.is_held(r["doc_id"]):
            held.append((r["doc_id"], ids))
        else:
            single += np.bincount(ids, minlength=lay.size)
    plain = np.log10((single + 1) / (single.sum() + lay.size))
    by_single = sum(plain[ids].sum() for _, ids in held)
    before = lambda ids: np.r_[lay.end, ids[:-1]]
    by_counts = sum((lay.within(before(ids), ids) + lay.table[lay.slot_of[before(ids)], lay.class_of[ids]]).sum() for _, ids in held) / math.log(10)
    ours = sum(got[d] for d, _ in held)
    assert ours > 0.75 * by_single and ours > 0.95 * by_counts


def test_chances_of_all_ids_add_up():
    lay, rng = layout(), np.random.default_rng(1)
    model = moved(lay)
    for n in (1, 2, 9):
        assert plain_chances(rng.integers(0, lay.size, n), lay, model).sum() == pytest.approx(1.0, abs=1e-4)


def test_scores_equal_a_plain_reference():
    """Batched windows against one token at a time; every window has OVERLAP tokens of context at least."""
    lay, rng = layout(), np.random.default_rng(7)
    model = moved(lay)
    sizes = np.array([1, 2, lm.LENGTH, lm.LENGTH + 1, 3 * lm.LENGTH, 5])
    target = rng.integers(0, lay.size, sizes.sum())
    stream = np.r_[lay.end, target[:-1]]
    got = lm.stream_scores(stream, target, sizes, lay, model.tables(lay))
    base, step = 0, lm.LENGTH - lm.OVERLAP
    for n in sizes.tolist():
        for i in range(n):
            low = 0 if i < lm.LENGTH else -(-(i - lm.LENGTH + 1) // step) * step
            want = math.log(plain_chances(stream[base + low : base + i + 1], lay, model)[target[base + i]])
            assert got[base + i] == pytest.approx(want, abs=2e-3)
        base += n


def test_large_logits_stay_finite():
    lay, rng = layout(), np.random.default_rng(8)
    model = moved(lay)
    model.flat *= 40
    target = rng.integers(0, lay.size, 80)
    got = lm.stream_scores(np.r_[lay.end, target[:-1]], target, np.array([80]), lay, model.tables(lay))
    assert np.isfinite(got).all()


def test_gradient():
    lay, rng = layout(), np.random.default_rng(2)
    own = moved(lay)
    s = rng.integers(0, lay.slots, (3, lm.LENGTH))
    given = lay.table[s.ravel()]
    target, weight = rng.integers(0, lm.BEGINNING + lm.INSIDE, s.shape), np.ones(s.shape, np.float32)
    _, g = own.step(s, given, target, weight)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 2e-3), 12, replace=False):
        loss = []
        for by in (1e-2, -1e-2):
            flat = own.flat.copy()
            flat[i] += np.float32(by)
            loss.append(lm.Attention(lay.slots, flat).step(s, given, target, weight)[0])
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[i], rel=0.06, abs=3e-4)


def test_every_id_has_weight_in_one_window():
    lay = layout()
    rows = [np.arange(n, dtype="<u2") % lay.size for n in (0, 5, 31, 32, 33, 700)]
    slots, classes, weight, places = lm.lessons(rows, lay)
    assert (np.bincount(places[weight], minlength=len(classes)) == np.r_[np.ones(len(classes) - 1), 0]).all()
    target = np.concatenate([np.r_[x, lay.end] for x in rows]).astype(int)
    assert (classes[:-1] == lay.class_of[target]).all() and (slots[:-1] == lay.slot_of[np.r_[lay.end, target[:-1]]]).all()


def test_training_covers_every_id_of_long_and_of_all_documents(spark, monkeypatch):
    kept, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda found, lay: kept.append((lay, real(found, lay), [(r["turn"], len(r["ids"]) // 2) for r in found.collect()])) or kept[-1][1])
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    words = [w for w in "".join(c if c.isalpha() else " " for c in " ".join(texts)).lower().split()][:900]
    rows = [(k, " ".join(words[k * 300 : (k + 1) * 300])) for k in range(3)]
    learning = [r for r in rows if not lm.is_held(r[0])]
    lm.score(spark.createDataFrame(rows, "doc_id long, text string"), BLOCKS).collect()
    lay, model, trained = kept[0]
    changed = (model.x != lm.Attention(lay.slots).x).any(1)
    ids = [i for _, t in learning for i in ids_of(t.split())]
    assert len(learning) >= 2 and changed[lay.slot_of[sorted(set(ids))]].all()
    assert sum(n for _, n in trained) == len(ids) and all(0 <= t < lm.ROUNDS for t, _ in trained)


@pytest.mark.parametrize("own", [None, 6])
def test_every_pair_within_words_counts(spark, monkeypatch, own):
    """However many pairs and first ids there are, scores are those of all of them, counted one by one and held in memory."""
    if own:
        monkeypatch.setattr(lm, "OWN", own)  # most first ids share the attention's vector
    monkeypatch.setattr(lm, "MOST_PAIRS", 50, raising=False)  # a bound that once left the rarer pairs out
    monkeypatch.setattr(lm, "PAIR_ROWS", 64, raising=False)
    kept, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda found, lay: kept.append((lay, real(found, lay))) or kept[-1][1])
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, BLOCKS).collect()}
    lay, model = kept[0]
    rows = {r["doc_id"]: [ids_of([w]) for w in cut(r["text"])] for r in docs.collect()}
    single, last, pairs = np.zeros(lay.size, np.int64), np.zeros(lay.size, np.int64), Counter()
    learning = [words for d, words in rows.items() if not lm.is_held(d)]
    for ids in (ids for words in learning for ids in words):
        np.add.at(single, ids, 1)
        last[ids[-1]] += 1
        pairs.update(a * lay.size + b for a, b in zip(ids[:-1], ids[1:], strict=True))
    single[-1] += len(learning)
    counts = lm.Counts(np.append(lm.encoder(BLOCKS).starts[:-1], True), single, last, len(learning))
    keys = np.array(sorted(pairs))
    every = lm.Layout(counts.with_pairs(keys, np.array([pairs[k] for k in keys.tolist()])), lay.class_of.astype(np.int64))
    assert len(keys) > 500 and np.allclose(every.table, lay.table, atol=1e-5) and len(set(keys // lay.size)) > 100
    assert np.allclose(every.part, lay.part) and lay.slots == (own or lm.OWN) + 1
    for d, words in rows.items():
        target = np.array([*(i for ids in words for i in ids), lay.end])
        want = lm.stream_scores(np.r_[lay.end, target[:-1]], target, np.array([len(target)]), every, model.tables(every)).sum() / math.log(10)
        assert got[d] == pytest.approx(want, rel=1e-5)


def test_gradient_of_places_with_a_weight_only():
    """Rows without a weight take no part: the gradient is that of the loss over all places, difference by difference."""
    lay, rng = layout(), np.random.default_rng(4)
    own = moved(lay)
    s, target = rng.integers(0, lay.slots, (3, lm.LENGTH)), rng.integers(0, lm.BEGINNING + lm.INSIDE, 3 * lm.LENGTH)
    weight = (rng.random(s.shape) < 0.6).astype(np.float32)
    used = np.flatnonzero(weight)
    chance, g = own.gradient(s, used, lay.table[s.ravel()[used]], target[used], np.ones(len(used), np.float32))

    def loss(flat):
        """Place by place, in double precision."""
        m, total = lm.Attention(lay.slots, flat), 0.0
        for i in used.tolist():
            row, at = divmod(i, lm.LENGTH)
            x = m.x[s[row, : at + 1]].astype(float)
            a = np.exp((x[-1] @ m.wq) @ (x @ m.wk).T / math.sqrt(lm.QUERY) + m.place[at - np.arange(at + 1)])
            z = (a / a.sum()) @ (x @ m.wv) @ m.wo + x[-1] @ m.wr + lay.table[s[row, at]]
            total -= z[target[i]] - math.log(np.exp(z).sum())
        return total / len(used)

    assert -np.log(chance).mean() == pytest.approx(loss(own.flat), rel=1e-4)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 2e-3), 12, replace=False):
        moves = [own.flat.copy() for _ in range(2)]
        for flat, by in zip(moves, (1e-2, -1e-2), strict=True):
            flat[i] += np.float32(by)
        assert (loss(moves[0]) - loss(moves[1])) / 2e-2 == pytest.approx(g[i], rel=0.03, abs=1e-4)


def test_occurrences_of_ids_in_documents():
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 50, n).astype("<u2") for n in (1, 7, 300)]
    ids, n = lm.occurrences([x.tobytes() for x in rows], 600)
    assert ids.tolist() == sorted(set(np.concatenate(rows).tolist()))
    assert [[int((x == i).sum()) for i in ids] for x in rows] == n.tolist()


def test_wide_vocabularies_are_an_error():
    lm.narrow(np.zeros(1 << 16))
    with pytest.raises(ValueError, match="16 bits"):
        lm.narrow(np.zeros((1 << 16) + 1))


def test_first_ids_that_share_a_vector_keep_their_own_pairs():
    """Two rare first ids of one slot: the chance within a class is that of each one's own pairs."""
    v = 100
    begins = np.arange(v) < 50
    begins[-1] = True
    single = np.arange(v)[::-1] + 2
    counts = lm.Counts(begins, single, np.ones(v, np.int64), 3)
    counts.slot_of[:] = np.where(np.arange(v) < 40, np.arange(v), lm.OWN - 1)
    counts.with_pairs(np.array([60 * v + 70, 61 * v + 80]), np.array([9, 9]))
    chance = lm.Chances(counts)
    at = lambda a, b: math.exp(chance.logs(np.array([a]), np.array([b]))[0])
    assert at(60, 70) > 10 * at(61, 70) and at(61, 80) > 10 * at(60, 80)


def with_head(lay, seed=12):
    model = moved(lay)
    model.head = np.random.default_rng(seed).normal(0, 0.5, (len(lay.tree.odds), 2 * lm.WIDTH)).astype(np.float32)
    return model


def test_the_attention_tells_ids_of_one_class_apart():
    """Chances of all ids add up with a head; two texts before shift ids of one class against each other; without a head nothing changes."""
    lay = layout()
    model, every = with_head(lay), np.arange(lay.size)
    first = [lay.end, 5, 9], [lay.end, 17, 9]
    logs = []
    for own in first:
        rows = [lm.stream_scores(np.array(own), np.array([*own[1:], k]), np.array([3]), lay, model.tables(lay))[-1] for k in every.tolist()]
        logs.append(np.array(rows))
        assert np.exp(logs[-1]).sum() == pytest.approx(1.0, abs=1e-3)
    apart = logs[0] - logs[1]
    shifts = [np.ptp(apart[(lay.class_of == k) & (lay.tree.leaf_of > 0)]) for k in range(lm.BEGINNING)]
    assert max(shifts) > 0.05
    zero = moved(lay)
    zero.head = np.zeros_like(model.head)
    target = np.random.default_rng(2).integers(0, lay.size, 70)
    plain, same = (lm.stream_scores(np.r_[lay.end, target[:-1]], target, np.array([70]), lay, m.tables(lay)) for m in (moved(lay), zero))
    assert np.allclose(plain, same, atol=1e-5)


def test_gradient_with_ways():
    """Of the loss of classes and ways together, by the attention's numbers and by the head's, difference by difference."""
    lay, rng = layout(), np.random.default_rng(5)
    own = with_head(lay)
    target = rng.integers(0, lay.size, (3, lm.LENGTH))
    stream = np.concatenate([np.full((3, 1), lay.end), target[:, :-1]], 1)
    s, used, ones = lay.slot_of[stream].astype(np.int64), np.arange(target.size), np.ones(target.size, np.float32)
    _, g = own.gradient(s, used, lay.table[s.ravel()], lay.class_of[target].ravel().astype(np.int64), ones, lay.tree, lay.tree.leaf_of[target].ravel())
    given = lay.table[s.ravel(), lay.class_of[target].ravel()]

    def loss(flat, head):
        tables = lm.Attention(lay.slots, flat, head).tables(lay)
        return -np.mean(lm.class_scores(stream.ravel(), target.ravel(), np.full(3, lm.LENGTH), lay, tables)) + 0 * given.sum()

    flat = own.flat.size
    for i in rng.choice(np.flatnonzero(np.abs(g) > 2e-3), 30, replace=False):
        moves = []
        for by in (1e-2, -1e-2):
            x, h = own.flat.copy(), own.head.copy()
            if i < flat:
                x[i] += np.float32(by)
            else:
                h.reshape(-1)[i - flat] += np.float32(by)
            moves.append(loss(x, h))
        assert (moves[0] - moves[1]) / 2e-2 == pytest.approx(g[i], rel=0.06, abs=4e-4)


def test_branches_by_level():
    """Ways laid out level by level are those from the root to each leaf, and sums by place take in all levels."""
    lay, rng = layout(), np.random.default_rng(3)
    tree, leaf = lay.tree, lay.tree.leaf_of[rng.integers(0, lay.size, 200)]
    there, sizes, row, node, sign = tree.levels(leaf)
    assert sorted(there.tolist()) == np.flatnonzero(tree.depth[leaf]).tolist() and sizes.sum() == len(row) == tree.depth[leaf].sum()
    for k, at in enumerate(there.tolist()):
        first, n = tree.first[leaf[at]], tree.depth[leaf[at]]
        assert node[row == k].tolist() == tree.node[first : first + n].tolist() and sign[row == k].tolist() == tree.sign[first : first + n].tolist()
    x = rng.normal(0, 1, (len(row), 4)).astype(np.float32)
    want, of_node = np.zeros((len(there), 4)), np.zeros((len(tree.odds), 4))
    np.add.at(want, row, x)
    np.add.at(of_node, node, x)
    assert np.allclose(lm.by_place(x, sizes), want, atol=1e-5) and np.allclose(lm.summed(x, node, len(tree.odds)), of_node, atol=1e-5)
    none = tree.levels(np.zeros(5, np.int32))
    assert [len(part) for part in none] == [0] * 5 and lm.by_place(x[:0], none[1]).shape == (0, 4)


def test_exponentials_out_of_bounds_are_taken_again():
    """Logits of any size: shares of a row are those of double precision."""
    rng = np.random.default_rng(9)
    for by in (1, 200):
        z = (rng.normal(0, 1, (6, 8)) * by - np.array([0, 0, 300, -300, 0, 0])[:, None] * (by > 1)).astype(np.float32)
        got, mass = lm.weighed(z.copy, np.ones(8, np.float32))
        want = np.exp(z.astype(float) - z.max(1, keepdims=True).astype(float))
        assert np.allclose(got / mass[:, None], want / want.sum(1, keepdims=True), rtol=2e-4, atol=1e-30)
