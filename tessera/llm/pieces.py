"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A sequence of pieces is the encoding of a text exactly when every two neighbours, put together and merged
anew, come out as the same two pieces. So the encoder takes the longest piece that an Aho-Corasick automaton
finds at a position, checks it against the piece before, and falls back to the next shorter prefix; positions
from which there is no way on are marked in a bitfield and never tried again. Work is linear in the text.

Defined results: a null text is an empty text; an empty text has no ids and decodes to an empty text. Texts of any length
are encoded whole; rows that share a doc_id are encoded one by one. Extra input columns are ignored by `digests` and kept by
`encode_documents`, but columns named n_tokens, ids and round_trip are replaced there, and text goes.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Memo, bounded_batches, worker_cache

SPACE = "▁"


class PieceCodec:
    """Encoder and decoder of one sentencepiece BPE model file."""

    def __init__(self, model_file: str, memo: int = 350_000, raw: bool = False):
        """raw: parts() gives ids as 32-bit integers, not as text."""
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.unknown = sp.unk_id()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_of = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        self.piece = {i: p for p, i in self.id_of.items()}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        by_score = sorted((p for p in self.id_of if len(p) > 1), key=lambda p: -sp.get_score(self.id_of[p]))
        #: Order in which merges happen; single characters come before all merges.
        self.rank = {self.id_of[p]: 0 for p in self.id_of if len(p) == 1} | {self.id_of[p]: k + 1 for k, p in enumerate(by_score)}
        #: How each piece comes about: the ranks of its merges in their order, and its last and first part at each state.
        self.history: dict[int, tuple[list[int], list[str], list[str]]] = {}
        for p, i in self.id_of.items():
            if len(p) == 1 or self._merge(p, note=i) == [i]:
                self.history.setdefault(i, ([], [p], [p]))
        reachable = self.history.keys()
        joined = {c for p in by_score for c in p}
        if joined - set(self.id_of) or any(SPACE in p.lstrip(SPACE) for p in by_score):
            raise ValueError(f"{model_file}: not a model whose pieces start at word boundaries")
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.piece[i], (i, len(self.piece[i])))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for i in reachable:
            p = self.piece[i]
            self.shorter[i] = next((j for k in range(len(p) - 1, 0, -1) if (j := self.id_of.get(p[:k], -1)) in reachable), -1)
        self.digits = [str(i) for i in range(n)]
        self.shown = {i: p.replace(SPACE, " ") for i, p in self.piece.items()}
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.spans = re.compile("[" + "".join(map(re.escape, sorted(joined))) + "]+|.", re.DOTALL)
        self.chunks, self.raw = re.compile(" +[^ ]*"), raw
        self.memo, self.pairs = Memo(self._known, memo, longest=64), Memo(lambda pair: self._remerged(*divmod(pair, 1 << 32)), 1_000_000)

    def _merge(self, text: str, note: int = -1) -> list[int]:
        """Plain merging: the best pair first, the leftmost of equals. note: the piece whose history is to be kept."""
        ids = [self.id_of.get(c, -1) for c in text]
        if -1 in ids:
            return ids
        parts = list(text)
        ranks, lasts, firsts = [], [parts[-1]], [parts[0]]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks.append(best)
            lasts.append(parts[-1])
            firsts.append(parts[0])
        if note >= 0 and len(parts) == 1:
            self.history[note] = (ranks, lasts, firsts)
        return [self.id_of[p] for p in parts]

    def _remerged(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their text is merged anew.

        As long as nothing is merged across the seam, either side goes through its own history; the better next merge
        comes first, the left one of equals. At each state the two parts at the seam must not make a piece that is
        better than both next merges.
        """
        rank, id_of = self.rank, self.id_of
        left_ranks, lasts, _ = self.history[left]
        right_ranks, _, firsts = self.history[right]
        never = len(rank) + 1
        m, n, j, k = len(left_ranks), len(right_ranks), 0, 0
        while True:
            a = left_ranks[j] if j < m else never
            b = right_ranks[k] if k < n else never
            both = id_of.get(lasts[j] + firsts[k])
            if both is not None and rank[both] < a and rank[both] <= b:
                return False
            if a <= b:
                if a == never:
                    return True
                j += 1
            else:
                k += 1

    def _span(self, text: str) -> list[int]:
        """Ids of a text whose characters all take part in merges."""
        n = len(text)
        if (i := self.id_of.get(text)) is not None and i in self.shorter:
            return [i]
        pairs, ids, last, done = self.pairs, [], -1, 0
        for _, (i, size) in self.automaton.iter_long(text):  # longest pieces one after another often fit already
            if last >= 0 and not pairs[last << 32 | i]:
                break
            ids.append(i)
            last, done = i, done + size
        if done == n:
            return ids
        longest = [-1] * (n + 1)
        for end, (i, size) in self.automaton.iter(text):
            longest[end - size + 1] = i
        failed = bytearray(n // 8 + 1)
        shorter, length = self.shorter, self.length
        ids = []
        at, i = 0, longest[0]
        while at < n:
            while i >= 0:
                end = at + length[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not ids:
                        break
                    if pairs[ids[-1] << 32 | i]:
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                at = end
                i = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not ids:
                    raise AssertionError("no encoding")
                i = ids.pop()
                at -= length[i]
                i = shorter[i]
        return ids

    def _chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.spans.findall(chunk):
            if len(part) > 1:
                out += self._span(part)
            elif (i := self.id_of.get(part)) is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in part.encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def _surface(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.shown.__getitem__, ids))
        except KeyError:  # bytes or unknown characters among them
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(self.piece.get(i, " ⁇ " if i == self.unknown else "").replace(SPACE, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def _words(self, text: str) -> list[str]:
        """Words with the blanks before them; the text's first word has one more, and the space sign is a blank."""
        return self.chunks.findall(" " + text.replace(SPACE, " "))

    def parts(self, text: str | None) -> list[tuple[str | bytes, int, str]]:
        """For each word with the blanks before it: ids (as text, or raw), their number, what they decode to."""
        return list(map(self.memo.__getitem__, self._words(text))) if text else []

    def _known(self, word: str) -> tuple[str | bytes, int, str]:
        ids = self._chunk(word.replace(" ", SPACE))
        shown = self._surface(ids)
        own = array("i", ids).tobytes() if self.raw else ",".join(map(self.digits.__getitem__, ids))
        return own, len(ids), word if shown == word else shown

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [i for w in self._words(text) for i in self._chunk(w.replace(" ", SPACE))]

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        return text[1:] if text.startswith(" ") and ids and self.piece.get(ids[0], "").startswith(SPACE) else text


def _utf8(raw: bytearray) -> str:
    """Bytes as text; each byte that is no part of a character becomes U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + size].decode())
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def codec(model_file: str, raw: bool = False) -> PieceCodec:
    """One codec for each worker process and model."""
    return worker_cache(("pieces", model_file, raw), lambda: PieceCodec(model_file, raw=raw))


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """docs without text (its other columns pass through), with n_tokens, ids (array<int>) and round_trip: whether they decode to the text."""
    bounded_batches(docs.sparkSession)
    source = docs.drop("n_tokens", "ids", "round_trip", "text").select("*")
    names, types = source.columns, [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, raw=True)
        for b in batches:
            n, ids, same = [], [], []
            for text in b.column(len(names)).to_pylist():
                parts = c.parts(text)
                n.append(sum([p[1] for p in parts]))
                ids += [p[0] for p in parts]
                same.append("".join([p[2] for p in parts])[1:] == text)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), values, pa.array(same, pa.bool_())], names=[*names, "n_tokens", "ids", "round_trip"])

    return source.mapInArrow(run, ", ".join([*types, "n_tokens long, ids array<int>, round_trip boolean"]))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, without keeping the ids."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        sha = hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for text in b.column(1).to_pylist():
                parts = c.parts(text)
                decoded = "".join([p[2] for p in parts])
                n.append(sum([p[1] for p in parts]))
                of_ids.append(sha(",".join([p[0] for p in parts]).encode()).hexdigest())
                of_text.append(sha((decoded[1:] if decoded else decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
