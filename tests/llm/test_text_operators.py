import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from frames import no_documents, odd_documents  # noqa: E402
from oracle import same  # noqa: E402

from tessera.llm import decontaminate, lines, passages, pieces, pii, queries, simhash, token_store, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PIECES, BLOCKS = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("byte_bpe_50k.json")


def texts(spark, n=200):
    return [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(n).collect()]


def fuzz(seed, n, alphabet, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(n)]


# ---------------------------------------------------------------- op3


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c = pieces.PieceCodec(PIECES, memo=50)
    alphabet = [*"aabcdeeehiinorst  \n\t\0▁éñß0123.,<>世日😀ﬁ́", "the", "ing", "  ", "▁▁", "<s>", "<0x0A>", "----", "aaaa"]
    vocabulary = [p.replace("▁", " ") for p in list(c.id_of)[::7]]
    for text in [*texts(spark), *fuzz(1, 4000, alphabet, 25), *fuzz(2, 4000, vocabulary, 6)]:
        ids = sp.encode(text)
        assert c.encode(text) == ids and c.decode(ids) == sp.decode(ids)
        parts = c.parts(text)
        assert ",".join(p[0] for p in parts) == ",".join(map(str, ids)) and "".join(p[2] for p in parts)[1:] == sp.decode(ids)


def test_pieces_query(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for d in odd_documents(spark).collect():
        ids = sp.encode(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(odd_documents(spark), PIECES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[1] == 0 for x in got) >= 3
    clash = odd_documents(spark).selectExpr("*", "1 AS ids", "'x' AS n_tokens", "doc_id AS round_trip")
    again = pieces.encode_documents(clash, PIECES)
    assert again.columns == ["doc_id", "source", "h", "k", "n_tokens", "ids", "round_trip"] and dict(again.dtypes)["ids"] == "array<int>"
    kept = pieces.encode_documents(odd_documents(spark), PIECES)
    assert {"source", "h", "k", "ids"} <= set(kept.columns) and kept.count() == 11
    assert pieces.digests(no_documents(spark), PIECES).count() == 0


# ---------------------------------------------------------------- op7


def test_block_encoder_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BLOCKS)
    e = token_store.BlockEncoder(BLOCKS, most=200)
    alphabet = [*"aabce  \n\t\x1c\x85\xa0'’sétß0123.,<|>世😀²", "<|endoftext|>", "the", " ", "n't", ".\n"]
    signs = [*"abé", " ", "\n", *token_store.SIGNS, "'", "'s", "9"]
    for batch in (texts(spark), fuzz(8, 6000, signs, 14), fuzz(3, 4000, alphabet, 30), fuzz(4, 4000, [*"abcé.,'\n " * 2, "\0", "the "], 30)):
        want = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(batch, add_special_tokens=False)]
        assert e.encode(batch) == want


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BLOCKS)
    docs = odd_documents(spark)
    manifest = token_store.write(docs, BLOCKS, 2)
    got = token_store.read(manifest).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start = 0
    for r, d in zip(sorted(got, key=lambda r: r["start"]), rows, strict=True):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d["doc_id"], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shard = next(s for s in map(token_store.ShardReader, [r["path"] for r in manifest.collect()]) if 5 in s.doc_ids)
    assert len(shard.find(5)) == next(r["n_tokens"] for r in got if r["doc_id"] == 5)
    with pytest.raises(KeyError):
        shard.find(123456)
    assert token_store.read(token_store.write(no_documents(spark), BLOCKS, 2)).count() == 0


# ---------------------------------------------------------------- op8


def test_base_spans_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for text in fuzz(5, 20_000, [*"aB1.@-+% ,"], 18):
        assert pii.emails(text) == [m.span() for m in email.finditer(text)]
    for text in fuzz(6, 20_000, [*"12.. a", "255", "999"], 20):
        want = [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in pii.base_spans(text) if s[1] == 1] == want
    assert pii.base_spans("call +1 (784) 555-8120, card 4111 1111 1111 1111.") == [(5, 3, 22), (29, 2, 48)]
    assert pii.base_spans("4111 1111 1111 1112 or +12 34") == []


def test_detect(spark):
    rows = [(k, f"my password=49b0203a9cc466e6e{k:02d} and mail a{k}@x.org", "b") for k in range(30)] + [(40, None, "b"), (41, "", "b"), (42, "version=1234567", "b")]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    assert len(got) == 33 and got[40]["spans"] == "" and got[41]["n_email"] == 0
    assert got[3]["n_email"] == 1 and got[3]["base_sha256"] == hashlib.sha256(b"email:41:49").hexdigest()
    assert got[3]["spans"] == "secret:12:31,email:41:49" and got[42]["spans"] == ""
    assert pii.detect(no_documents(spark)).count() == 0 and pii.detect(odd_documents(spark)).count() == 11


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes = "".join("1" if (truth if rng.random() < good else not truth) else "0" for good in (0.95, 0.9, 0.9, 0.5, 0.85, 0.5))
        counts[votes] = counts.get(votes, 0) + 1
    _, rate, _ = pii.reliabilities(sorted((4, v, n) for v, n in counts.items()))
    assert rate[4][0][0] > 0.9 and rate[4][1][0] < 0.1 and abs(rate[4][0][3] - 0.5) < 0.06


def test_reliabilities_are_those_of_each_kind():
    """A labeler that is right for one kind and says 1 to everything for another."""
    rng = np.random.default_rng(2)
    counts = {}
    for k in (4, 7):
        for _ in range(3000):
            truth = rng.random() < 0.5
            good = (0.95, 0.9, 0.9, 0.85, 0.85, 0.8)
            said = ["1" if (truth if rng.random() < g else not truth) else "0" for g in good]
            if k == 7:
                said[0] = "1"
            key = (k, "".join(said))
            counts[key] = counts.get(key, 0) + 1
    _, rate, _ = pii.reliabilities(sorted((*key, n) for key, n in counts.items()))
    assert rate[4][1][0] < 0.1 and rate[7][1][0] > 0.9 and rate[7][0][1] > 0.85


def test_span_classifier_learns_from_text_what_votes_leave_open():
    """Spans whose votes abstain follow spans of like characters and like words around them; held out from the fit."""
    rng = random.Random(6)
    def span(real):
        body = "".join(rng.choices("0123456789abcdef", k=24)) if real else "".join(rng.choices("aeiourstln", k=9))
        text = f"the {'auth' if real else 'draft'} note says id={body} today"
        at = text.index(body)
        return pii.features(text, at, 4, at + len(body), "------")
    truth = [k % 2 for k in range(400)]
    rows = [np.array(span(t)) for t in truth]
    w = pii.fit(rows[:300], np.array([0.85 if t else 0.2 for t in truth[:300]]))
    assert np.mean([(w[x].sum() + w[-1] >= 0) == bool(t) for x, t in zip(rows[300:], truth[300:], strict=True)]) > 0.97


def test_names_and_addresses_are_proposed():
    text = "Contact: Maria Lopez, 12 Green Park Road, or Dr. Klein-Weber there."
    got = [(pii.KINDS[k], text[a:z]) for a, k, z, _ in pii.candidates(text)]
    assert got == [("name", "Maria Lopez"), ("address", "12 Green Park Road"), ("name", "Klein-Weber")]


def test_cards_and_phones_equal_the_patterns():
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    def luhn(d):
        own = [int(c) for c in reversed(d)]
        return sum(own[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in own[1::2]) % 10
    texts_ = fuzz(21, 3000, [*"0123456789" * 3, " ", "-", "  ", "a", "4111 1111 1111 1111"], 30) + fuzz(22, 6000, [*"0123456789", "+", " ", "(", ")", ".", "-", "a", "+1 "], 24)
    hits = 0
    for text in texts_:
        want = [(m.start(), 2, m.end()) for m in card.finditer(text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        got = [x for x in pii.base_spans(text) if x[1] in (2, 3)]
        assert sorted(want) == got
        hits += len(got)
    assert hits > 100


def test_detect_over_the_table(spark):
    """Base columns against the plain patterns over whole documents; all spans hold the base ones and are sorted."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text_of = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = pii.detect(docs).collect()
    assert len(got) == len(text_of)
    for r in got:
        text = text_of[r["doc_id"]]
        base = sorted([(m.start(), 0, m.end()) for m in email.finditer(text)] + [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))] + [x for x in pii.base_spans(text) if x[1] > 1])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in range(4)]
        said = [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        every = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        order = [(int(a), pii.KINDS.index(k)) for k, a, _ in every]
        assert set(said) <= {":".join(x) for x in every} and order == sorted(order)


# ---------------------------------------------------------------- op5


def test_toxicity_held_out(spark):
    bad = ["vile", "nasty", "rotten"]
    rng = random.Random(4)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1500):
        toxic = rng.random() < 0.15
        words = rng.choices(plain, k=40) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "x"))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    held = [(got[k], t) for k, t in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(got) == 1502 and got[5000] == got[5001] and got[5000][1] == 0
    assert np.mean([p == t for (_, p), t in held]) > 0.97


def test_toxicity_without_labels(spark):
    model = toxicity.train(odd_documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd_documents(spark), model).where("predicted = 0").count() == 11
    assert toxicity.score(no_documents(spark), model).count() == 0


# ---------------------------------------------------------------- op6


def test_masks_cover_every_set_of_places():
    rng = random.Random(2)
    own = simhash.masks()
    assert len(own) == 31
    for _ in range(30_000):
        d = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not d & m for m in own)


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least.setdefault(find(i), []).append(d)
    return [min(x for x in least[find(i)] if x is not None) if any(x is not None for x in least[find(i)]) else None for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text").withColumn("doc_id", __import__("pyspark").sql.functions.expr("doc_id + 1000")))
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in simhash.classes(docs).collect()}
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    assert got == {p: c for p, c in zip(prints, brute_components(prints), strict=True)}


@pytest.mark.parametrize("large", [10_000, 5])
def test_links_of_random_balls(spark, large, monkeypatch):
    """Also with every bucket over the bound, where neighbourhoods take the place of pairs."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(9)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))))
    rows = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(sorted(prints))]
    hashed = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.with_components(hashed).collect()}
    assert [got[k] for k in range(len(rows))] == brute_components([(k, p & (1 << 64) - 1) for k, p in rows])


def test_near_dedup_keeps_one_of_each_group(spark):
    kept = simhash.near_dedup(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert -9 in ids and 1 not in ids and ids.count(4) <= 1 and 8 in ids
    assert simhash.near_dedup(no_documents(spark)).count() == 0


# ---------------------------------------------------------------- op4


def test_passages_resist_insertions(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for k in range(40):
        shared = text(60)
        for d in (3 * k, 3 * k + 1):
            rows.append((d, f"{text(rng.randint(5, 90))} {shared} {text(30)}"))
            want.add(d)
        rows.append((3 * k + 2, text(150)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 500)]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["is_repeat"]} == {3 * k + 1 for k in range(40)}
    by = dict(rows)
    assert all(by[r["doc_id"]].encode()[r["start"] : r["stop"]] in by[r["first_doc_id"]].encode() or not r["is_repeat"] for r in got)
    assert passages.repeated(no_documents(spark)).count() == 0 and passages.repeated(odd_documents(spark)).count() > 0


def test_a_stray_chunk_elsewhere_does_not_take_the_passage(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(80), text(60)
    raw = shared.encode()
    bounds = [int(x) for x in passages.cuts(raw)]
    k = next(i for i in range(3, len(bounds) - 4) if bounds[i + 1] - bounds[i] >= passages.LEAST_CHUNK and bounds[i] > 200)
    stray = raw[bounds[k] - passages.WINDOW : bounds[k + 1]].decode()
    rows = [(1, f"{text(40)} {stray} {text(40)}"), (2, f"{text(30)} {shared} {text(30)}"), (3, f"{text(50)} {shared} {text(10)} {other}"), (4, f"{other} {text(20)}")]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["is_repeat"]) for r in got} == {(2, False), (3, True), (3, False), (4, True)}
    assert {r["first_doc_id"] for r in got if r["doc_id"] == 3 and r["is_repeat"]} == {2}


def test_gear_hash_is_a_window(spark):
    raw = bytes(random.Random(1).choices(range(256), k=300))
    h = passages.gear_hashes(raw)
    for i in (0, 5, 40, 299):
        want = sum(int(passages.GEAR[raw[i - a]]) << a for a in range(min(passages.WINDOW, i + 1))) % 2**32
        assert int(h[i]) == want


# ---------------------------------------------------------------- op1, op2


def test_lines(spark):
    got = {}
    for r in lines.line_dedup(odd_documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[-9][0]["n_dropped"] == 0 and got[1][0]["text"] == "" and got[1][0]["n_dropped"] == 2
    assert got[2][0]["text"] == "more words that stand here alone"
    assert got[3][0]["text"] is None and got[3][0]["n_lines"] == 0 and len(got[4]) == 2 and got[4][0]["text"] == ""
    assert got[None][0]["n_dropped"] == 0
    assert lines.line_dedup(no_documents(spark)).count() == 0


def test_two_texts_under_one_id_lose_only_their_own_lines(spark):
    shared = "the same opening line of many words in several documents"
    rows = [(1, shared + "\nwords of the first"), (5, "a wholly unique opening line that stands nowhere else\nmore of it here"), (5, shared + "\nsomething else again"), (5, shared + "\nsomething else again"), (7, shared)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in got)
    assert found == [(1, rows[0][1], 0), (5, rows[1][1], 0), (5, "something else again", 1), (5, "something else again", 1), (7, "", 1)]


def test_many_lines_take_linear_time(spark):
    text = "\n".join(f"four {chr(97 + k % 26)}{chr(97 + k // 26 % 26)} {chr(97 + k // 676)} words" for k in range(15_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nown end of it")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.line_dedup(docs).collect()}
    assert got[1]["n_dropped"] == 0 and got[2]["text"] == "own end of it" and got[2]["n_dropped"] == 15_000



def test_templates_generalise_variable_fields(spark):
    rows = [(k, f"user {k} logged in from host{k} at noon today\nown words of document {'abcdefghij'[k]} go here {'xyzuvwrstq'[k]}") for k in range(10)]
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all("logged" not in got[k] for k in range(1, 10))


def test_containment(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rng = random.Random(3)
    filler = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    docs = [(1, f"{filler(3000)} {item.upper()} {filler(2000)}"), (2, filler(100)), (3, item.replace("twelve", "end")), (4, item.replace("six", "6")), (5, "only  two"), (6, None), (7, ""), (None, item)]
    items = spark.createDataFrame([(1, item), (2, "only two"), (3, None), (4, ""), (5, filler(20))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained(df, items).collect()}
    assert got == {(1, 1): 1.0, (3, 1): 0.875, (5, 2): 1.0}
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, items).collect()} == {2, 4, 6, 7, None}
    assert decontaminate.contained(no_documents(spark), items).count() == 0
    assert decontaminate.contained(df, items.limit(0)).count() == 0


def test_containment_of_repeated_rows_and_clashing_columns(spark):
    """Rows that share an id are one item or one document; other columns change nothing, also without any broadcast."""
    parts = ["a b c d e f g", "g h i j k l m n", "g h i j k l m n"]
    items = spark.createDataFrame([(1, t, "x", 5) for t in parts] + [(None, "q r s t u", "y", 1)], "item_id long, text string, doc_id string, n_shared int")
    docs = spark.createDataFrame([(7, "x " + parts[0], "a"), (7, parts[1] + " y", "b"), (7, parts[1], "b"), (8, parts[0], "c"), (9, "Q R S T U", None)], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(7, 1): (7, 7)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [8, 9]


def test_containment_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW_BYTES", -1)
    _, extra, missing = same(spark, queries.QUERIES["op2_decontaminate"], queries.ORACLE_SQL["op2_decontaminate"], FOLDER)
    assert not extra and not missing


def test_a_phrase_that_all_items_share_makes_no_candidates(spark):
    """Signatures are minimum hashes; one phrase alone never reaches the number of them that a document must have."""
    common = "which of these is the right answer"
    items = spark.createDataFrame([(k, f"{common} " + " ".join(f"w{k}x{i}" for i in range(12))) for k in range(50)], "item_id long, text string")
    shingled = decontaminate.item_shingles(items)
    shared = {r["h"] for r in shingled.groupBy("h").count().where("count > 1").collect()}
    signature = defaultdict(set)
    for r in decontaminate.sketches(shingled).collect():
        signature[r["item_id"], r["need"]].add(r["h"])
    every = defaultdict(list)
    for r in shingled.collect():
        every[r["item_id"]].append(r["h"])
    assert shared and all(len(hs & shared) < need for (_, need), hs in signature.items())
    assert all(hs == set(sorted(every[item])[: len(hs)]) for (item, _), hs in signature.items())


def test_no_document_with_the_containment_has_too_few_of_a_signature(spark):
    """Items of all sizes, each missing as many shingles as the containment allows, those of its signature first."""
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in range(1, 70)], "item_id long, text string")
    shingled = decontaminate.item_shingles(items)
    signature, sizes = defaultdict(set), {r["item_id"]: r["count"] for r in shingled.groupBy("item_id").count().collect()}
    for r in decontaminate.sketches(shingled).collect():
        signature[r["item_id"], r["need"]].add(r["h"])
    assert len(signature) == 69
    for (item, need), hs in signature.items():
        n = sizes[item]
        may_miss = max(m for m in range(n + 1) if n - m >= n * decontaminate.CONTAINED)
        assert 1 <= need <= len(hs) - may_miss



def test_lines_against_brute_force_over_odd_rows(spark):
    from test_pipeline import brute_lines

    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, f"All rights reserved.\n{long}\n12 34\n"), (2, f"{long}\nAll rights reserved.\n12 34"), (3, "see the page of Anna today please\nsee the page of Bert today please"), (4, "see the page of Carl today please\n\nAll rights reserved."), (5, None), (6, ""), (7, "word\nword"), (8, "word")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines int, source string")
    got = lines.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    want = brute_lines(rows)
    assert {r["doc_id"]: r["text"] or "" for r in got.collect()} == want
    assert want[4] == "" and want[8] == "word" and want[2].endswith("12 34") and "reserved" not in want[2]


def test_store_over_the_table_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BLOCKS)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = token_store.read(token_store.write(docs, BLOCKS, 2), with_ids=False).orderBy("start").collect()
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    for r, d, e in zip(got, rows, t.encode_batch([d["text"] or "" for d in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_near_dedup_of_rows_that_differ_elsewhere(spark):
    """Which of them stays doesn't depend on their order."""
    rows = [(1, "some words that stand here twice", "b"), (1, "some words that stand here twice", "a"), (2, "quite another text of other words", None)]
    one, two = (sorted(simhash.near_dedup(spark.createDataFrame(x, "doc_id long, text string, source string")).collect()) for x in (rows, rows[::-1]))
    assert one == two and [r["doc_id"] for r in one] == [1, 2]


def test_toxicity_of_repeated_ids(spark):
    """Of rows that share an id one text is learnt from, the same whatever their order; each is scored."""
    rows = [(k % 40, f"word{k % 7} {'vile' if k % 5 == 0 else 'plain'} text") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(40)], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1])]
    assert models[0] == models[1]
    assert toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), models[0]).count() == 400


def test_toxicity_against_a_plain_scorer(spark):
    """Scores over the table against a sum of weights over each whole text's words; held-out labels are predicted."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    for r in docs.select("doc_id", "text").collect():
        z = model[1] + sum(model[0].get(s, 0.0) for w in set(re.findall(r"\w+", (r["text"] or "").lower())) for s in toxicity.slots(w))
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert got[r["doc_id"]][0] == pytest.approx(want, abs=1e-9) and got[r["doc_id"]][1] == int(got[r["doc_id"]][0] >= 0.7)
    held = [(got[r["doc_id"]][1], r["toxic"]) for r in labels.collect() if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.9
