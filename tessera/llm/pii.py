"""Personal data: base patterns, plus spans that weakly supervised labelers find together.

Besides the base spans (email, ip, card, phone) loose patterns propose further spans: secrets, phone numbers without a
country code, e-mail addresses written out in words, account numbers, names and street addresses. Three families of labelers
vote on each (1 personal, 0 not, abstain): regular expressions on its shape, gazetteers (provider domains, key words, first
names) and the words around it. The votes of all candidates of all documents are counted by kind and pattern;
expectation-maximisation (Dawid and Skene 1979) over those counts estimates for each kind how reliable each labeler is there
(drawn towards the labeler's rate over all kinds where a kind has few candidates) and how likely each pattern is personal
data. These probabilities are the soft labels on which a logistic span classifier is trained: over the characters of the span
(trigrams, with digits and letters by class), its length, entropy and mix, the words around it, kind and votes. A candidate is
kept if the classifier gives it KEEP or more. It is fitted on at most FIT candidates, those with the smallest hash of document
and place; what else the driver gathers is bounded by the number of vote patterns, not by the data.

Defined results: a null text is an empty text; an empty text has no spans and the digest of the empty text; offsets count
code points, ends exclusive; a candidate that overlaps a base span is dropped, so base spans always stay; of candidates that
overlap each other the first, then the longest stays. Rows that share a doc_id are treated one by one.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone", "spelled_email", "account", "name", "address")
KINDS = (*BASE, *ADDED)

_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL_HERE = re.compile(_LOCAL + r"++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_ON = re.compile(rf"(?<!{_LOCAL})" + _EMAIL_HERE.pattern)
_IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SECRET = re.compile(r"(?i)(?<![A-Za-z0-9])(token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|license|version|build|commit|id)\s{0,2}[=:]\s{0,2}\"?([A-Za-z0-9_\-+/]{6,})")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+().-])(\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])")
_SPELLED = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z0-9-]{2,63})+")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

_WORD = r"[A-Z][a-z]{1,20}"
_NAME = re.compile(rf"(?<!\w)(?:(Mr|Mrs|Ms|Miss|Dr|Prof)\.?\x20|([Nn]ame|[Cc]ontact|[Aa]ttn|[Ss]igned|[Ff]rom)\s{{0,2}}[:=]\s{{0,2}})({_WORD}(?:-{_WORD})?(?:\x20{_WORD}){{0,2}})(?!\w)")
_ADDRESS = re.compile(rf"(?<![\w.])[0-9]{{1,5}}\x20(?:{_WORD}\x20){{1,3}}(Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Ct|Square)(?!\w)")
_NAME_MARKS, _ADDRESS_MARKS = ("Mr", "Ms", "Miss", "Dr", "Prof", "ame", "ontact", "ttn", "igned", "rom"), ("St", "Av", "R", "L", "Dr", "B", "C", "Sq")

#: Fixed values of the gazetteers and of the words around a span.
SECRET_NAMES = frozenset("token password passwd pwd secret api_key api-key apikey access_key access-key accesskey".split())
HARMLESS_NAMES = frozenset("license version build commit id".split())
DOMAIN_ENDS = frozenset("com org net edu gov de fr es it uk eu info io".split())
ACCOUNT_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
FOR_WORDS = frozenset("call phone tel telephone mobile contact mail email e-mail write login user account iban bank key auth bearer".split())
FIRST_NAMES = frozenset(
    "Alice Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Claire Daniel David Elena Elizabeth Emily Emma Eric Eva Francois Frank George Hans Helen Isabel James Jane Jean Jennifer Johann "
    "John Jose Joseph Juan Julia Karl Katharina Klaus Laura Linda Louis Luis Manuel Maria Marie Martin Mary Michael Nina Olga Patricia Paul Peter Pierre Richard Robert Sarah Sofia Susan Thomas William".split()
)
AGAINST_WORDS = frozenset("version isbn issn page pages chapter section license build release example figure table".split())
LABELERS = ("shape", "varied", "gazetteer", "name", "context", "length")
ROUNDS, KEEP = 60, 0.5
#: Candidates that the classifier is fitted on, hashed features, steps and width of them, ridge.
FIT, SLOTS, STEPS, RATE, RIDGE = 20_000, 4096, 300, 0.05, 2e-4


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; the look-behind keeps the search linear, a match may follow another at once."""
    out, at = [], 0
    while (m := _EMAIL_HERE.match(text, at) or _EMAIL_ON.search(text, at)) is not None:
        out.append(m.span())
        at = m.end()
        if text.find("@", at) < 0:
            break
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, name before it)."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(2), 4, m.end(2), m[1].lower()) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 5, m.end(), "") for m in _LOCAL_PHONE.finditer(text)]
        out += [(m.start(), 7, m.end(), "") for m in _ACCOUNT.finditer(text)]
    if "[" in text or "(" in text:
        out += [(m.start(), 6, m.end(), "") for m in _SPELLED.finditer(text)]
    if any([x in text for x in _NAME_MARKS]):
        out += [(m.start(3), 8, m.end(3), (m[1] or m[2]).lower()) for m in _NAME.finditer(text)]
    if _DIGIT.search(text) and any([x in text for x in _ADDRESS_MARKS]):
        out += [(m.start(), 9, m.end(), "") for m in _ADDRESS.finditer(text)]
    return sorted(out)


def votes(text: str, start: int, kind: int, end: int, name: str) -> str:
    """One character for each labeler: 1 for, 0 against, - abstains."""
    found = text[start:end]
    digits, letters = sum(map(str.isdigit, found)), sum(map(str.isalpha, found))
    before = re.findall(r"[\w-]+", text[max(0, start - 60) : start].lower())[-4:]
    if kind == 4:
        shape = "1" if len(found) >= 12 and digits and letters else "0"
        varied = "1" if len(set(found)) >= 8 else "0"
        gazetteer = "1" if re.fullmatch(r"[0-9a-f]{16,}", found) else "-"
        named = "1" if name in SECRET_NAMES else "0" if name in HARMLESS_NAMES else "-"
        length = "1" if 16 <= len(found) <= 128 else "0"
    elif kind == 5:
        shape = "1" if re.fullmatch(r"\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9][0-9]{2}[.-][0-9]{4}", found) else "0"
        varied = "1" if len(set(found)) >= 5 else "0"
        gazetteer, named, length = "-", "-", "1" if digits == 10 else "0"
    elif kind == 6:
        shape, varied = "1", "1" if len(set(found)) >= 6 else "0"
        gazetteer = "1" if re.findall(r"[a-z]+", found.lower())[-1:] and re.findall(r"[a-z]+", found.lower())[-1] in DOMAIN_ENDS else "0"
        named, length = "-", "1" if len(found) <= 120 else "0"
    elif kind == 8:
        parts = found.split(" ")
        shape, varied = "1" if len(parts) > 1 else "-", "1" if len(set(parts)) == len(parts) else "0"
        gazetteer = "1" if parts[0] in FIRST_NAMES else "-"
        named, length = "0" if name == "from" else "1", "1" if len(found) >= 5 else "0"
    elif kind == 9:
        shape, varied, gazetteer = "1" if digits <= 4 else "0", "1" if found[0] != "0" else "0", "1"
        named, length = "-", "1" if 8 <= len(found) <= 60 else "0"
    else:
        plain = found.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        shape, varied = "1" if int(turned) % 97 == 1 else "0", "1" if len(set(plain)) >= 5 else "0"
        gazetteer, named, length = "1" if plain[:2] in ACCOUNT_COUNTRIES else "0", "-", "1" if 15 <= len(plain) <= 34 else "0"
    context = "1" if FOR_WORDS & set(before) else "0" if AGAINST_WORDS & set(before) else "-"
    return shape + varied + gazetteer + named + context + length


def features(text: str, start: int, kind: int, end: int, said: str) -> list[int]:
    """Hashed features of a candidate: its characters, length, entropy and mix, the words around it, kind and votes."""
    found = text[start:end]
    shape = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in found[:200])
    n = len(found)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(found).values())
    before = re.findall(r"[\w-]+", text[max(0, start - 60) : start].lower())[-4:]
    after = re.findall(r"[\w-]+", text[end : end + 40].lower())[:2]
    own = {f"l{n.bit_length()}", f"e{int(2 * entropy)}", f"d{10 * sum(map(str.isdigit, found)) // n}", f"u{10 * sum(map(str.isupper, found)) // n}"}
    own |= {f"s{shape[i : i + 3]}" for i in range(max(1, len(shape) - 2))} | {f"t{found[:200].lower()[i : i + 3]}" for i in range(max(1, min(n, 200) - 2))}
    own |= {f"b{w}" for w in before} | {f"a{w}" for w in after} | {f"v{i}{c}" for i, c in enumerate(said)}
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % SLOTS for x in own} | {zlib.crc32(x.encode()) % SLOTS for x in own})


def reliabilities(patterns: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns (kind, votes, count).

    Returns each pattern's probability, each labeler's rate of 1 among personal and among other spans of each kind (kinds x 2 x
    labelers), and the prior by kind. Starts from the majority of the votes; a kind's rates are smoothed by four votes at the
    labeler's rate over all kinds, and these by one vote either way, 0.7 for being right.
    """
    n = np.array([c for _, _, c in patterns], float)
    v = np.array([[{"1": 1.0, "0": 0.0}.get(c, np.nan) for c in x] for _, x, _ in patterns]).reshape(len(patterns), len(LABELERS))
    kinds = np.array([k for k, _, _ in patterns], int)
    said, v0 = ~np.isnan(v), np.nan_to_num(v)
    q = np.clip((v0.sum(1) + 0.5) / (said.sum(1) + 1), 0.05, 0.95)
    rate, prior = np.full((len(KINDS), 2, len(LABELERS)), 0.5), np.full(len(KINDS), 0.5)
    for _ in range(ROUNDS):
        for side, weight in enumerate((q * n, (1 - q) * n)):
            ones, votes_n = weight[:, None] * v0 * said, weight[:, None] * said
            overall = (ones.sum(0) + 2 * (0.7 if side == 0 else 0.3)) / (votes_n.sum(0) + 2)
            for k in set(kinds.tolist()):
                at = kinds == k
                rate[k, side] = (ones[at].sum(0) + 4 * overall) / (votes_n[at].sum(0) + 4)
        for k in set(kinds.tolist()):
            at = kinds == k
            prior[k] = ((q * n)[at].sum() + 1) / (n[at].sum() + 2)
        safe = np.clip(rate, 1e-4, 1 - 1e-4)
        log = [np.where(said, np.where(v0 == 1, np.log(safe[kinds, side]), np.log1p(-safe[kinds, side])), 0).sum(1) for side in (0, 1)]
        odds = np.log(prior[kinds]) - np.log1p(-prior[kinds]) + log[0] - log[1]
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, rate, prior


def fit(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights by slot, the bias last: logistic regression on soft labels, by Adam over all rows."""
    w = np.zeros(SLOTS + 1)
    if not rows:
        return w
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[flat], len(rows)) + w[-1], -30, 30)))
        d = (s - labels) / len(rows)
        grad = np.append(np.bincount(flat, d[doc], SLOTS) + RIDGE * w[:-1], d.sum())
        mean, spread = 0.9 * mean + 0.1 * grad, 0.999 * spread + 0.001 * grad**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return w


def train(found: DataFrame) -> np.ndarray:
    """found: kind, votes, features, place (hash of document and place) of all candidates. The classifier's weights."""
    counted = sorted((r["kind"], r["votes"], r["n"]) for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect())
    if not counted:
        return fit([], np.zeros(0))
    chance = dict(zip([x[:2] for x in counted], reliabilities(counted)[0].tolist(), strict=True))
    rows = found.orderBy("place", "kind", "votes").limit(FIT).select("kind", "votes", "features").collect()
    return fit([np.array(r["features"], np.int64) for r in rows], np.array([chance[r["kind"], r["votes"]] for r in rows]))


def _join(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, counts, digest and text of the base spans, and the candidates with their votes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, texts, found = [], [], [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                counts.append([sum([k == x for _, k, _ in base]) for x in range(4)])
                texts.append(_join(base))
                shas.append(hashlib.sha256(texts[-1].encode()).hexdigest())
                own, at = [], -1
                for a, k, z, name in sorted(candidates(text), key=lambda c: (c[0], -c[2], c[1])):
                    if a >= at and not any(x < z and a < y for x, _, y in base):
                        said = votes(text, a, k, z, name)
                        own.append({"start": a, "kind": k, "end": z, "votes": said, "features": features(text, a, k, z, said)})
                        at = z
                found.append(own)
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(found, _CANDIDATES)], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "found"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<start: long, kind: int, end: long, votes: string, features: array<int>>>"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, schema)


_CANDIDATES = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans) and spans (all), one row for each document."""
    found, _ = materialize(extract(docs), "pii")
    each = found.select("doc_id", F.explode("found").alias("c")).select("c.*", F.xxhash64("doc_id", "c.start", "c.end").alias("place"))
    weights, least = train(each), math.log(KEEP / (1 - KEEP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for base, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own := [(c["start"], c["kind"], c["end"]) for c in own if weights[c["features"]].sum() + weights[-1] >= least]:
                    parts = [x.split(":") for x in base.split(",")] if base else []
                    base = _join(sorted([*own, *((int(a), KINDS.index(k), int(z)) for k, a, z in parts)]))
                spans.append(base)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(spans, pa.string())], names=[*names, "spans"])

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256"]
    return found.select("base", "found", *names).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
