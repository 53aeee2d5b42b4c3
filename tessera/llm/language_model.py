"""Scores of whole texts by add-one word counts and by a causal self-attention model over subword ids.

The words of all documents are numbered within blocks of documents, counted over all learning documents, and each different
word is cut into subword ids once; counts and ids go back to the blocks that hold the word. The model's chance of the next id
is that of its class times that of the id within the class. Classes are found by clustering ids by the documents and the ids
that they stand with. The chance of a class is a softmax over masked self-attention (relative places as a bias) plus the
logarithm of what the counts of all learning documents say after the last id, so the attention learns what these leave
open. Which id of its class begins a word follows from the attention too: by a binary tree over the class's ids (Morin and Bengio
2005), at whose branches the counts' odds are shifted by what the attention gives and by the last id's vector. Within a word, the
id within the class comes from the pair counts after the id before. All chances of a next id add up to 1. All pairs of ids within
words are counted, each by its own two ids; they stay in a table of the shared folder, which each block reads in slices, once for
every WORDS of its different words. The attention's own vectors are shared by the ids beyond the OWN - 1 most frequent ones; no
count is; in a tree the ids of a class without a vector of their own are one leaf, which they share as they are counted. Ids take 16 bits: a tokenizer of more than 65,536 ids is an error.

Training and scoring go through the same overlapping windows: each covers the tokens that the one before did not, with
OVERLAP tokens of context at least. Every learning document is trained on whole, once, in one of ROUNDS rounds; in a round
each partition trains on its own documents from the same weights, and the weights are averaged.

Defined results: a null text is an empty text and consists of the end alone; a document is a learning document unless the crc32
of its id as text modulo 7 is 2 (of a null id: "None"); rows that share a doc_id are scored one by one; without learning
documents all counts are zero and the classes' chances follow from smoothing alone. Extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import heapq
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, functions as F

from .common import batch_rows, bounded_batches, filesystem, fresh_path, materialize, py_crc_mod, release, temporary
from .token_store import encoder

FOLDS, HELD = 7, 2
#: Bytes of text in a block, window, tokens that only give context, width, width of a query, ids with an embedding of their own.
BLOCK_BYTES, LENGTH, OVERLAP, WIDTH, QUERY, OWN = 32 << 20, 32, 4, 8, 4, 2048
#: Classes of ids that begin a word and of others, numbers that describe an id's documents and its ids before.
BEGINNING, INSIDE, SKETCH = 24, 40, 24
#: Pairs of ids that are read at a time, ids and words whose pairs are looked up at a time.
PAIR_ROWS, LOOKUP, WORDS = 1 << 20, 1 << 20, 1 << 18
#: Training: windows in a step, step width, rounds; a document falls into one of the rounds.
BATCH, RATE, ROUNDS = 128, 0.07, 3
#: Windows that are scored, documents whose ids are counted at a time.
_SLICE, SIDE = 256, 32


def split(texts: pa.Array) -> pa.ListArray:
    """Words of each text. Arrow's ASCII functions know ASCII only, as the definition asks; blanks at the ends give empty words."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def is_held(doc_id: int | None) -> bool:
    return py_crc_mod(doc_id, FOLDS) == HELD


def narrow(ids: np.ndarray) -> None:
    """Ids are kept in 16 bits."""
    if len(ids) > 1 << 16:
        raise ValueError(f"{len(ids)} ids don't fit in 16 bits")


class Pairs:
    """Counts of all pairs of ids within words by key (the first * number of ids + the second): in memory or in a table."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, folder: str | None = None):
        """keys ascending; folder: a Parquet table of key and n in the shared folder, each file in ascending order."""
        self.keys, self.n, self.folder, self.files, self.rows = keys, n, folder, [], PAIR_ROWS
        if folder is not None:
            fs, top = filesystem(folder)
            self.files = sorted(x.base_name for x in fs.get_file_info(FileSelector(top)) if x.base_name.endswith(".parquet"))

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All keys and their counts, ascending within a slice."""
        if len(self.keys):
            yield self.keys, self.n
        for name in self.files:
            fs, top = filesystem(self.folder)
            with fs.open_input_file(f"{top}/{name}") as f:
                for b in pq.ParquetFile(f).iter_batches(self.rows, columns=["key", "n"]):
                    if len(b):
                        yield b.column(0).to_numpy(), b.column(1).to_numpy()

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of different keys in ascending order, 0 where there is none."""
        out = np.zeros(len(wanted), np.int64)
        for keys, n in self.slices():
            low, high = np.searchsorted(wanted, [keys[0], keys[-1] + 1])
            at = np.searchsorted(keys, wanted[low:high])
            hit = np.flatnonzero(keys[at] == wanted[low:high])
            out[low + hit] = n[at[hit]]
        return out


class Counts:
    """What the words of all learning documents say about ids: single ids, ends of words, pairs within a word."""

    def __init__(self, begins: np.ndarray, single: np.ndarray, last: np.ndarray, documents: int):
        """begins: which ids begin a word, the end of a document (the last id) included; last: words that end with an id."""
        self.begins, self.single, self.end = begins, single, len(single) - 1
        order = np.argsort(-single, kind="stable")
        order = np.r_[self.end, order[order != self.end]][: OWN - 1]
        self.slot_of = np.full(len(single), OWN - 1, np.int32)
        self.slot_of[order] = np.arange(len(order))
        self.slots, self.pad = OWN + 1, OWN
        self.ended, self.seen = last.astype(float), single.astype(float)
        self.ended[self.end] += documents
        self.with_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def with_pairs(self, keys: np.ndarray, n: np.ndarray, folder: str | None = None) -> Counts:
        """keys: the first * number of ids + the second, ascending; or those of a table."""
        self.pairs = Pairs(keys, n, folder)
        return self


class Chances:
    """Chances of ids that the counts give, whatever the ids' classes: among those that begin words, and of others after an id."""

    def __init__(self, counts: Counts):
        self.begins, self.pairs, self.size = counts.begins, counts.pairs, len(counts.single)
        mass = counts.single + 1.0
        self.own = np.where(counts.begins, mass / mass[counts.begins].sum(), mass / max(mass[~counts.begins].sum(), 1.0))  # among those that begin, among the others
        self.total, kinds = np.zeros(self.size), np.zeros(self.size)
        for keys, n in self.pairs.slices():
            self.total += np.bincount(keys // self.size, n, self.size)
            kinds += np.bincount(keys // self.size, minlength=self.size)
        self.rest = (kinds + 1) / (self.total + kinds + 1)  # Witten and Bell 1991
        self.ended = np.clip((counts.ended + 0.5) / (counts.seen + 1.0), 1e-9, 1 - 1e-9)

    def share(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of pairs after ids `at` that occur n times: what they get of the words that go on, without the rest for all."""
        return (1 - self.rest[at]) * n / np.maximum(self.total[at], 1e-300)

    def logs(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of target ids: those that begin words among each other, the others after these ids."""
        out = np.log(self.own)[target]
        inside = np.flatnonzero(~self.begins[target])
        for low in range(0, len(inside), LOOKUP):
            part = inside[low : low + LOOKUP]
            found = pa.array(before.take(part).astype(np.int64) * self.size + target.take(part)).dictionary_encode()  # several times as fast as np.unique
            keys, place = found.dictionary.to_numpy(), found.indices.to_numpy()
            order = np.argsort(keys)
            n = np.empty(len(keys), np.int64)
            n[order] = self.pairs.find(keys.take(order))
            at = keys // self.size
            chance = (1 - self.ended[at]) * (self.share(at, n) + self.rest[at] * self.own[keys % self.size])
            out[part] = np.log(chance).take(place)
        return out


class Tree:
    """Binary trees over the ids of each class that begin words, by mass (Huffman 1952): ways from the root of a class to its leaves."""

    def __init__(self, own: np.ndarray, begins: np.ndarray, class_of: np.ndarray, slot_of: np.ndarray, shared: int):
        """own: mass of each id; ids whose slot is `shared` are one leaf for each class. leaf_of: leaf of each id, 0 without a way."""
        ids = np.flatnonzero(begins)
        keys, leaf = np.unique(class_of[ids].astype(np.int64) * (shared + 1) + slot_of[ids], return_inverse=True)
        mass, of_class = np.bincount(leaf, own[ids], len(keys)), keys // (shared + 1)
        self.leaf_of = np.zeros(len(own), np.int32)
        self.leaf_of[ids] = leaf + 1
        ways: list[list[tuple[int, int]]] = [[] for _ in range(len(keys) + 1)]
        odds: list[float] = []
        for k in np.unique(of_class).tolist():
            heap = [(float(mass[j]), int(j), [int(j) + 1]) for j in np.flatnonzero(of_class == k)]
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, _, left), (b, at, right) = heapq.heappop(heap), heapq.heappop(heap)
                for side, sign in ((left, 1), (right, -1)):
                    for j in side:
                        ways[j].append((len(odds), sign))
                odds.append(math.log(a) - math.log(b))
                heapq.heappush(heap, (a + b, at, left + right))
        self.depth = np.array([len(w) for w in ways], np.int16)
        self.first = np.cumsum(self.depth, dtype=np.int64) - self.depth
        self.node = np.array([n for w in ways for n, _ in w], np.int64)
        self.sign = np.array([x for w in ways for _, x in w], np.float32)
        self.odds = np.array(odds, np.float32)
        #: Logarithm of the chance of a way that the counts alone give.
        self.base = np.bincount(np.repeat(np.arange(len(ways)), self.depth), -np.log1p(np.exp(-self.sign * self.odds[self.node].astype(float))), len(ways))

    def levels(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Branches on the ways to these leaves: all first ones, then all second ones and so on.

        Returns the places of leaves that have a way, the longest ways first; how many of these, from the first on, each level has;
        and of each branch its place among these, its number and its side.
        """
        depth = self.depth.take(leaf)
        there = np.flatnonzero(depth)
        depth = depth.take(there)
        there = there.take(np.argsort(-depth, kind="stable"))  # of 16 bits: by radix
        sizes = len(there) - np.cumsum(np.bincount(depth))[:-1]
        row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = self.first.take(leaf.take(there)).take(row)
        at += np.repeat(np.arange(len(sizes)), sizes)
        return there, sizes, row, self.node.take(at), self.sign.take(at)


def by_place(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of what Tree.levels lays out level by level, for each of its places."""
    out, low = x[: sizes[0]].copy() if len(sizes) else x, 0
    for n, m in zip(sizes.tolist(), sizes[1:].tolist()):
        low += n
        out[:m] += x[low : low + m]
    return out


class Layout:
    """Classes, and the chances that the counts give: of classes after an id or a slot, of an id within its class after an id."""

    def __init__(self, counts: Counts, class_of: np.ndarray, chances: Chances | None = None):
        v, slots, classes = len(counts.single), counts.slots, BEGINNING + INSIDE
        self.slot_of, self.class_of, self.end, self.pad, self.slots, self.size = counts.slot_of, class_of.astype(np.int32), counts.end, counts.pad, slots, v
        self.chances = c = chances or Chances(counts)
        of_class = np.bincount(class_of, c.own, classes)
        #: Row of each id that goes on with some other within a word; row 0 is that of all ids that never do.
        goes_on = np.flatnonzero(c.total > 0)
        self.row_of = np.zeros(v, np.int32)
        self.row_of[goes_on] = np.arange(1, len(goes_on) + 1)
        self.start_of = self.row_of.astype(np.int64) * classes
        rows = len(goes_on) + 1
        inside = np.zeros(rows * classes)
        for keys, n in counts.pairs.slices():
            at = keys // v
            inside += np.bincount(self.row_of[at].astype(np.int64) * classes + class_of[keys % v], c.share(at, n), rows * classes)
        of_row = inside.reshape(rows, classes) + np.append(1.0, c.rest[goes_on])[:, None] * of_class
        #: What the class's part of an id's chance in `chances` is: by row, and for words that go on less log_on of the id before.
        self.part, self.log_on = np.log(np.maximum(of_row, 1e-300)), np.log1p(-c.ended)
        self.part[:, :BEGINNING] = np.log(np.maximum(of_class[:BEGINNING], 1e-300))
        self.tree = Tree(c.own, counts.begins, self.class_of, counts.slot_of, OWN - 1)
        # a slot of several ids has the mean of theirs
        weight = counts.seen + 1.0
        of_slot = np.bincount(counts.slot_of, weight, slots)
        on, over = np.zeros((slots, classes)), np.zeros(slots)
        np.add.at(over, counts.slot_of, weight * c.ended)
        for low in range(0, v, 4096):  # so that few rows are in memory at a time
            ids = np.arange(low, min(low + 4096, v))
            np.add.at(on, counts.slot_of[ids], (weight[ids] * (1 - c.ended[ids]))[:, None] * of_row[self.row_of[ids]])
        table = on / np.maximum(of_slot, 1.0)[:, None]
        table[:, :BEGINNING] = (over / np.maximum(of_slot, 1.0))[:, None] * of_class[:BEGINNING]
        self.table = np.log(np.maximum(table, 1e-30)).astype(np.float32)

    def parts(self, before: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural logarithm of these classes' part in the chances after the ids before."""
        out = self.log_on.take(before)
        np.copyto(out, 0.0, where=classes < BEGINNING)
        at = self.start_of.take(before)
        at += classes
        out += self.part.reshape(-1).take(at)
        return out

    def within(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of target ids among those of their class, after the ids before."""
        return self.chances.logs(before, target) - self.parts(before, self.class_of[target])


def cluster(features: np.ndarray, weight: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Weighted k-means from the heaviest rows; the class of each row. A centre that loses all its rows stays."""
    c = features[np.argsort(-weight, kind="stable")[:k]].copy()
    own = np.zeros(len(features), np.int64)
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * (features @ c.T), axis=1)
        mass = np.bincount(own, weight, len(c))
        total = np.stack([np.bincount(own, weight * f, len(c)) for f in features.T], 1)
        c[mass > 0] = total[mass > 0] / mass[mass > 0, None]
    return own


def directions(n: int) -> np.ndarray:
    """Fixed random signs for each id."""
    return np.random.default_rng(23).choice(np.array([-1, 1], np.float32), (n, SKETCH))


def classes_of(counts: Counts, beside: np.ndarray) -> np.ndarray:
    """Class of each id, from the sums of its documents' sketches and from the slots before it within words."""
    v = len(counts.single)
    mass = counts.single + 1.0
    near = beside / mass[:, None]
    near /= max(1e-12, math.sqrt(float((near * near).sum(1) @ mass / mass.sum())))
    before = np.zeros((v, SKETCH))
    sign = directions(counts.slots)
    for keys, n in counts.pairs.slices():
        at, second = counts.slot_of[keys // v], keys % v
        for k in range(SKETCH):
            before[:, k] += np.bincount(second, n * sign[at, k], v)
    before /= mass[:, None]
    before /= max(1e-12, math.sqrt(float((before * before).sum(1) @ mass / mass.sum())))
    out = np.zeros(v, np.int64)
    for which, k, base, x in ((counts.begins, BEGINNING, 0, near), (~counts.begins, INSIDE, BEGINNING, np.concatenate([near, before], 1))):
        at = np.flatnonzero(which)
        if len(at):
            out[at] = base + cluster(x[at], mass[at], min(k, len(at)))
    return out


def longest(x: np.ndarray) -> float:
    """Largest norm of the vectors along the last axis."""
    return math.sqrt(float(np.einsum("...i,...i->...", x, x).max(initial=0.0)))


def exponential(z: np.ndarray, bound: float) -> None:
    """exp(z) in place, up to a factor of each row, which a softmax takes out again: where the bound on z allows it, the factor is 1."""
    if not bound < 60:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)


def weighed(logits: Callable[[], np.ndarray], ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits up to a factor of each row, and the rows' sums: the factor is 1 unless a sum is out of bounds."""
    z = logits()
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=z)
        mass = z.reshape(-1, len(ones)) @ ones
    if not (mass.min(initial=1.0) > 1e-20 and mass.max(initial=1.0) < 1e20):
        exponential(z := logits(), math.inf)
        mass = z.reshape(-1, len(ones)) @ ones
    return z, mass


def summed(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of x (contiguous, of an even width) by their numbers `at` under n. Two numbers are added at a time, as one complex number."""
    pairs = x.view(np.complex64)
    out, width = np.zeros(n * pairs.shape[1], np.complex64), pairs.shape[1]
    np.add.at(out, np.arange(n * width).reshape(n, width).take(at, 0).ravel(), pairs.ravel())
    return out.view(np.float32).reshape(n, -1)


class Attention:
    """One layer: corrections to the classes' chances from masked attention over the ids so far and from the last id itself."""

    def __init__(self, slots: int, flat: np.ndarray | None = None, head: np.ndarray | None = None):
        """head: a vector of 2 * WIDTH for each branch of the layout's trees; without, the trees' odds are those of the counts."""
        self.head = head
        d, c = WIDTH, BEGINNING + INSIDE
        rng = np.random.default_rng(11)
        self.shapes = {"x": (slots, d), "wq": (d, QUERY), "wk": (d, QUERY), "wv": (d, d), "wo": (d, c), "wr": (d, c), "place": (LENGTH,)}
        if flat is None:
            start = {"x": 0.3, "wq": 0.3, "wk": 0.3, "wv": 0.3, "wo": 0.05, "wr": 0.0, "place": 0.0}
            flat = np.concatenate([(rng.normal(0, 1, s) * start[n]).ravel() for n, s in self.shapes.items()]).astype(np.float32)
        self.flat, at = flat, 0
        for n, s in self.shapes.items():
            setattr(self, n, flat[at : at + math.prod(s)].reshape(s))
            at += math.prod(s)
        i = np.arange(LENGTH)
        self.lag = i[:, None] - i[None, :]
        self.near = np.maximum(self.lag, 0)
        self.masked = np.where(self.lag >= 0, 0, -np.inf).astype(np.float32)
        self.beside = np.zeros((0, 2 + d // QUERY), np.int64)  # places of what is put side by side, the same in steps of one size
        self.one_place, self.one_class, self.one_both, self.minus_one = np.ones(LENGTH, np.float32), np.ones(c, np.float32), np.ones(2 * d, np.float32), np.full(d, -1, np.float32)

    def scores_bias(self) -> np.ndarray:
        return self.place.take(self.near) + self.masked

    def step(self, s: np.ndarray, given: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and gradient for slots s (b, L), the counts' logits, classes of the next ids and their weights."""
        used, w = np.flatnonzero(weight), weight.ravel()
        chance, g = self.gradient(s, used, given.take(used, 0), target.ravel().take(used), w.take(used))
        return -float(np.log(np.maximum(chance, 1e-30)) @ w.take(used)) / max(1.0, float(w.sum())), g

    def gradient(self, s: np.ndarray, used: np.ndarray, given: np.ndarray, target: np.ndarray, w: np.ndarray, tree: Tree | None = None, leaf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the targets, and the gradient, for slots s (b, L) and those places of them, laid end to end, that have a weight.

        With leaves of the tree for the targets, the loss includes the ways to them, and the head's gradient follows behind.

        Narrow rows are gathered and put side by side by take, which is several times as fast as an index or a slice. What a softmax
        divides by is put where rows are narrow.
        """
        d, e, (b, n) = WIDTH, QUERY, s.shape
        m, slot = b * n, s.ravel()
        three, both = np.concatenate([self.wq / np.float32(math.sqrt(e)), self.wk, self.wv], 1), np.concatenate([self.wo, self.wr])
        y_of = np.concatenate([self.x @ three, np.ones((len(self.x), 1), np.float32)], 1)
        y = y_of.take(slot, 0).reshape(b, n, -1)
        q, k, v, v_one = y[:, :, :e], y[:, :, e : 2 * e], y[:, :, 2 * e : -1], y[:, :, 2 * e :]
        bias = self.scores_bias()
        a, per = weighed(lambda: np.add(raw := q @ k.transpose(0, 2, 1), bias, out=raw), self.one_place)
        per = 1 / per[:, None]
        h = (a @ v).reshape(-1, d)
        h *= per
        hx = np.concatenate([h, self.x]).take(np.stack([used, slot.take(used) + m], 1), 0).reshape(-1, 2 * d)
        below = None if leaf is None else self.on_ways(hx, tree, leaf, w)  # before hx is scaled
        z, mass = weighed(lambda: np.add(raw := hx @ both, given, out=raw), self.one_class)
        flat, at = z.reshape(-1), np.arange(0, z.size, z.shape[1]) + target
        chance = flat.take(at) / mass
        flat[at] -= mass
        share = (w * np.float32(1 / max(1.0, float(w.sum()))) / mass)[:, None]
        hx *= share
        g_both = (z.T @ hx).T
        g = {"wo": g_both[:d], "wr": g_both[d:]}
        back = np.zeros(m, np.int64)  # places without a weight get the row of zeros
        back[used] = np.arange(2, 2 * len(used) + 2, 2)
        dhx = np.zeros((len(used) + 1, 2 * d), np.float32)
        np.multiply(z @ both.T, share, out=dhx[1:])
        if below is not None:
            dhx[1:] += below[0]
        halves = dhx.reshape(-1, d)
        dh, dx = halves.take(back, 0), halves.take(back + 1, 0)
        dh *= per
        dh_one = np.empty((b, n, d + 1), np.float32)
        dh_one[:, :, :d] = dh.reshape(b, n, d)
        dh_one[:, :, d] = ((dh * h) @ self.minus_one).reshape(b, n)  # less the mean of da under a
        ds = dh_one @ v_one.transpose(0, 2, 1)
        ds *= a
        g["place"] = np.bincount(self.near.ravel(), np.ones(b, np.float32) @ ds.reshape(b, -1), LENGTH).astype(np.float32)  # masked ones are 0
        parts = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh.reshape(b, n, d)
        if len(self.beside) != m:
            pieces = np.arange(0, 2 * m, 2)
            self.beside = np.stack([pieces >> 1, (pieces >> 1) + m, *(pieces + 2 * m + i for i in range(d // e))], 1)
        d3 = np.concatenate([x.reshape(-1, e) for x in parts]).take(self.beside, 0).reshape(m, -1)
        all3 = (d3.T @ self.x.take(slot, 0)).T
        g["wq"], g["wk"], g["wv"] = all3[:, :e] / np.float32(math.sqrt(e)), all3[:, e : 2 * e], all3[:, 2 * e :]
        dx += d3 @ three.T
        g["x"] = summed(dx, slot, len(self.x))
        return chance, np.concatenate([*(g[n].ravel() for n in self.shapes), *([] if below is None else [below[1].ravel()])])

    def on_ways(self, hx: np.ndarray, tree: Tree, leaf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the ways' mean loss by hx (attention's mean and last id's vector of each place) and by the head."""
        there, sizes, row, node, sign = tree.levels(leaf)
        at = there.take(row)
        x, v = hx.take(at, 0), self.head.take(node, 0)
        t = (x * v) @ self.one_both
        t += tree.odds.take(node)
        t *= sign
        np.exp(np.minimum(t, 60, out=t), out=t)
        t += 1
        np.divide(-sign, t, out=t)  # the loss is log(1 + exp(-sign * odds))
        t *= w.take(at)
        t *= np.float32(1 / max(1.0, float(w.sum())))
        t = t[:, None]
        v *= t
        x *= t
        place = np.zeros(len(hx), np.int64)  # places without a way get the row of zeros
        place[there] = np.arange(1, len(there) + 1)
        by_row = np.concatenate([np.zeros((1, hx.shape[1]), np.float32), by_place(v, sizes)]).take(place, 0)
        return by_row, summed(x, node, len(self.head))

    def tables(self, layout: Layout) -> tuple[np.ndarray, ...]:
        """What inference needs of each slot: query, key, value, own part of the classes' logits; places and output weights; vectors and the trees' head."""
        q, own = self.x @ self.wq / np.float32(math.sqrt(QUERY)), self.x @ self.wr + layout.table
        own -= own.max(1, keepdims=True)  # what a softmax takes out again
        return q, self.x @ self.wk, self.x @ self.wv, own, self.scores_bias().astype(np.float32), self.wo, self.x, self.head


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For streams of these sizes laid end to end: start, end of stream and first scored place of every window."""
    step = LENGTH - OVERLAP
    n = 1 + np.maximum(0, -(-(sizes - LENGTH) // step))
    base = np.cumsum(sizes) - sizes
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(base, n) + k * step, np.repeat(base + sizes, n), np.where(k > 0, OVERLAP, 0)


def stream_scores(stream: np.ndarray, target: np.ndarray, sizes: np.ndarray, layout: Layout, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """Natural log-probability of every target id, given the ids before it in its stream."""
    return layout.chances.logs(stream, target) + class_scores(stream, target, sizes, layout, tables)


def class_scores(stream: np.ndarray, target: np.ndarray, sizes: np.ndarray, layout: Layout, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """What the attention makes of the chance that the counts give every target: of its class and, where it begins a word, of its way there."""
    q_of, k_of, v_of, own_of, bias, wo, x_of, head = tables
    start, end, first = windows(sizes)
    slots, classes = np.append(layout.slot_of.take(stream), np.full(LENGTH, layout.pad, np.int32)), layout.class_of.take(target)
    out, leaves = layout.parts(stream, classes), layout.tree.leaf_of.take(target)
    np.negative(out, out=out)
    if head is not None:
        out -= layout.tree.base.take(leaves)
    start, end, first = (x.astype(np.int32) for x in (start, end, first))
    place, ones, one_class, one_both = np.arange(LENGTH, dtype=np.int32), np.ones(LENGTH, np.float32), np.ones(wo.shape[1], np.float32), np.ones(2 * WIDTH, np.float32)
    most = longest(q_of) * longest(k_of) + float(np.abs(bias[np.isfinite(bias)]).max())
    most_z = float(np.abs(v_of @ wo).max())  # beside a slot's own part, which is 0 for its best class: a mean of the values' parts
    done = 0  # the windows' scored places are all places in their order
    for low in range(0, len(start), _SLICE):
        at = start[low : low + _SLICE, None] + place
        s = slots.take(at)  # what lies behind the end of a stream comes after all its places and is not used
        a = q_of.take(s, 0) @ k_of.take(s, 0).transpose(0, 2, 1)
        a += bias
        exponential(a, most)
        use = np.flatnonzero((at < end[low : low + _SLICE, None]) & (place >= first[low : low + _SLICE, None]))
        h = (a @ v_of.take(s, 0)).reshape(-1, WIDTH).take(use, 0)
        h /= (a.reshape(-1, LENGTH) @ ones).take(use)[:, None]
        scored = slice(done, done + len(use))
        done += len(use)
        z = h @ wo
        z += own_of.take(slots[scored], 0)
        if not most_z < 60:
            z -= z.max(1, keepdims=True)
        chosen = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + classes[scored])
        np.exp(z, out=z)
        out[scored] += chosen - np.log(z @ one_class)
        if head is not None:
            there, levels, row, node, sign = layout.tree.levels(leaves[scored])
            hx = np.concatenate([h, x_of]).take(np.stack([there, slots[scored].take(there) + len(h)], 1), 0).reshape(len(there), -1)
            t = (hx.take(row, 0) * head.take(node, 0)) @ one_both
            t += layout.tree.odds.take(node)
            t *= -sign
            loss = np.abs(t)
            np.exp(np.negative(loss, out=loss), out=loss)
            loss += 1
            np.log(loss, out=loss)
            loss += np.maximum(t, 0, out=t)
            out[scored][there] -= by_place(loss, levels)
    return out


def with_ends(rows: list[np.ndarray], end: int) -> np.ndarray:
    """Ids of documents laid end to end, the end behind each."""
    last = np.array([end], "<u2")
    return np.concatenate([part for x in rows for part in (x, last)]).astype(np.int64)


def lessons(rows: list[np.ndarray], layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, classes of the next ids, their weights and the windows' places for the ids of whole documents, the end behind each.

    The first two are streams, of which places (one row for each window) picks; each id has the weight 1 in one window only.
    """
    target = with_ends(rows, layout.end)
    start, stop, first = windows(np.array([len(x) + 1 for x in rows], np.int64))
    slots = np.append(layout.slot_of.take(np.r_[layout.end, target[:-1]]), layout.pad).astype(np.int64)
    classes = np.append(layout.class_of.take(target), 0).astype(np.int64)
    places = start[:, None] + np.arange(LENGTH)
    behind = places >= stop[:, None]
    weight = np.arange(LENGTH) >= first[:, None]
    weight &= ~behind
    np.copyto(places, len(target), where=behind)
    return slots, classes, weight, places


def train_on(model: Attention, squares: np.ndarray, rows: list[np.ndarray], layout: Layout, rng: np.random.Generator) -> int:
    """One pass of Adagrad (Duchi et al. 2011) over the windows of these documents, in random order; the number of windows.

    squares: those of the model's numbers and, behind them, of its head's.
    """
    slots, classes, weight, places = lessons(rows, layout)
    leaves = np.append(layout.tree.leaf_of.take(with_ends(rows, layout.end)), 0)
    order = rng.permutation(len(places))
    for low in range(0, len(places), BATCH):
        pick = order[low : low + BATCH]
        at, used = places.take(pick, 0), np.flatnonzero(weight.take(pick, 0))
        s = slots.take(at)
        place = at.ravel().take(used)
        _, g = model.gradient(s, used, layout.table.take(s.ravel().take(used), 0), classes.take(place), np.ones(len(used), np.float32), layout.tree, leaves.take(place))
        squares += g * g
        g /= np.sqrt(squares)
        g *= np.float32(RATE)
        model.flat -= g[: len(model.flat)]
        model.head -= g[len(model.flat) :].reshape(model.head.shape)
    return len(places)


def steady_heap() -> None:
    """Lets the C library keep freed arrays of up to 4 MB for the next ones, in place of new pages for each."""
    release()
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is not None:
        tune(-3, 4 << 20)  # M_MMAP_THRESHOLD
        tune(-1, 32 << 20)  # M_TRIM_THRESHOLD


def added(parts: DataFrame, n: int) -> np.ndarray | None:
    """Sum of n-vectors of doubles (column v, binary, one row for each partition), by a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                part = np.frombuffer(x, "<f8")
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    left = parts.rdd.getNumPartitions()
    while True:
        left = -(-left // 32)
        parts = parts.repartition(left).mapInArrow(add, "v binary")
        if left <= 8:
            break
    rows = parts.collect()
    return sum(np.frombuffer(r["v"], "<f8", n) for r in rows) if rows else None


def train(found: DataFrame, layout: Layout) -> Attention:
    """found: ids, turn (round) of all learning documents. ROUNDS rounds of local training and averaging, weighted by windows."""
    spark = found.sparkSession
    model = Attention(layout.slots, head=np.zeros((len(layout.tree.odds), 2 * WIDTH), np.float32))
    flat, n = model.flat.size, model.flat.size + model.head.size
    squares = np.full(n, 1e-4, np.float32)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.flat, model.head, squares, layout))

        def local(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            steady_heap()
            flat, head, before, lay = sent.value
            own, seen, sq = Attention(lay.slots, flat.copy(), head.copy()), 0, before.copy()
            rng = np.random.default_rng(turn)
            for b in batches:
                if rows := [np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()]:
                    seen += train_on(own, sq, rows, lay, rng)
            if seen:
                v = np.r_[1.0, own.flat.astype(np.float64), own.head.ravel().astype(np.float64), sq.astype(np.float64)] * seen
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])

        total = added(found.where(F.col("turn") == turn).select("ids").mapInArrow(local, "v binary"), 1 + 2 * n)
        if total is not None:
            mean = (total[1:] / total[0]).astype(np.float32)
            model, squares = Attention(layout.slots, mean[:flat].copy(), mean[flat:n].reshape(model.head.shape).copy()), mean[n:]
    return model


def blocks(docs: DataFrame, folder: str) -> DataFrame:
    """Writes documents as numbers of words, in blocks of about BLOCK_BYTES of text, to the shared folder.

    Returns block long, at int (number within the block; 0 is the end), word binary, n int (learning tokens) of each block's
    different words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, size = [], [], 0
        for b in batches:
            ids.append(b.column(0))
            lists.append(split(b.column(1)))
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield from finish(ids, lists)
                ids, lists, size = [], [], 0
                release()
        if ids:
            yield from finish(ids, lists)

    def finish(ids: list[pa.Array], lists: list[pa.ListArray]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        name = uuid.uuid4().int >> 65
        coded = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode()
        words = coded.chunk(0).dictionary.cast(pa.binary())
        empty = pc.index(words, b"").as_py()
        n, learnt = np.zeros(len(words) + 1, np.int64), 0
        with pa.ipc.new_stream(fs.open_output_stream(f"{top}/{name}.arrow", compression=None), schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for doc_ids, x, part in zip(ids, lists, coded.chunks, strict=True):
                sizes, numbers = np.diff(x.offsets.to_numpy()).astype(np.int64), part.indices.to_numpy() + 1
                held = np.array([is_held(d) for d in doc_ids.to_pylist()], bool)
                learnt += int((~held).sum())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if empty >= 0:
                    doc, numbers = doc[numbers != empty + 1], numbers[numbers != empty + 1]
                n += np.bincount(numbers[~held[doc]], minlength=len(n))
                bounds = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(sizes)))].astype(np.int32) * 4
                placed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(numbers.astype("<i4"))])
                out.write_batch(pa.RecordBatch.from_arrays([doc_ids, placed], schema=schema))
        n[0] = learnt
        at = np.delete(np.arange(1, len(n), dtype=np.int32), [empty] if empty >= 0 else [])
        rows = pa.RecordBatch.from_arrays([pa.array(np.r_[np.int32(0), at].astype(np.int32)), pa.concat_arrays([pa.array([b""], pa.binary()), words.take(pa.array(at - 1))]), pa.array(n[np.r_[0, at]].astype(np.int32))], names=["at", "word", "n"])
        for low in range(0, len(rows), 100_000):
            part = rows.slice(low, 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name, np.int64)), *part.columns], names=["block", "at", "word", "n"])

    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    temporary(docs.sparkSession, folder)
    return docs.mapInArrow(run, "block long, at int, word binary, n int")


def vocabulary(rows: DataFrame, tokenizer: str) -> DataFrame:
    """word, c (count in learning documents) and its subword ids, as they are after a blank; the end has none."""
    counts = rows.groupBy("word").agg(F.sum("n").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            ids = [x if w else b"" for w, x in zip(words, encoder(tokenizer).after_blank([w.decode() for w in words]), strict=True)]
            bounds = np.r_[0, np.cumsum([len(x) // 2 for x in ids])].astype(np.int32)
            short = np.frombuffer(b"".join(ids), "<u4").astype("<u2")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(short)])], names=["word", "c", "ids"])

    return counts.mapInArrow(run, "word binary, c long, ids binary")


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words (c, ids) with ids: all ids, the words' counts, numbers of ids and first places."""
    raw = b.column(1).to_pylist()
    n = np.array([len(x) // 2 for x in raw], np.int64)
    c, ids = b.column(0).to_numpy()[n > 0], np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
    n = n[n > 0]
    return ids, c, n, np.cumsum(n) - n


def gather(words: DataFrame, begins: np.ndarray, documents: int) -> Counts:
    """Counts of single ids, last ids and pairs over the vocabulary of the learning documents."""
    v = len(begins)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, v), np.int64)
        for b in batches:
            ids, c, n, first = _joined(b)
            total[0] += np.bincount(ids, np.repeat(c, n), v).astype(np.int64)
            total[1] += np.bincount(ids[first + n - 1], c, v).astype(np.int64)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["id", "n", "last"])

    known = words.where("c > 0").select("c", "ids")
    single, last = np.zeros(v, np.int64), np.zeros(v, np.int64)
    summed = known.mapInArrow(singles, "id long, n long, last long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("last").alias("last")).toArrow()  # v rows at most
    at = summed["id"].to_numpy()
    single[at], last[at] = summed["n"].to_numpy(), summed["last"].to_numpy()
    single[-1] += documents
    counts = Counts(begins, single, last, documents)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, c, n, first = _joined(b)
            after = np.ones(len(ids), bool)
            after[first] = False
            after = np.flatnonzero(after)
            keys, at = np.unique(ids[after - 1] * v + ids[after], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, np.repeat(c, n)[after], len(keys)).astype(np.int64))], names=["key", "n"])

    found = known.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    _, folder = materialize(found.sortWithinPartitions("key"), "lm-pairs")
    return counts.with_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64), folder)


def occurrences(rows: list[bytes], v: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that stand in some of these documents, ascending, and how often each document (row) has them."""
    sizes, every = np.array([len(x) // 2 for x in rows]), np.frombuffer(b"".join(rows), "<u2").astype(np.int64)
    there = np.bincount(every, minlength=v) > 0
    place, ids = np.cumsum(there) - 1, np.flatnonzero(there)
    n = np.bincount(np.repeat(np.arange(len(rows)) * len(ids), sizes) + place.take(every), minlength=len(rows) * len(ids))
    return ids, n.reshape(len(rows), -1).astype(float)


def beside(found: DataFrame, single: np.ndarray) -> np.ndarray:
    """For each id the sum, over its places in learning documents, of what the document's mean sketch has beyond the corpus's."""
    v = len(single)
    sent = found.sparkSession.sparkContext.broadcast((single / max(1, single.sum())) @ directions(v))

    names = [f"v{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        signs, mean, total = directions(v).astype(float), sent.value, np.zeros((v, SKETCH))
        for b in batches:
            rows = [x for x in b.column(0).to_pylist() if x]
            for low in range(0, len(rows), SIDE):
                ids, n = occurrences(rows[low : low + SIDE], v)
                total[ids] += n.T @ ((n @ signs.take(ids, 0)) / n.sum(1, keepdims=True) - mean)
        there = np.flatnonzero(total.any(1))
        for low in range(0, len(there), 10_000):
            at = there[low : low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(SKETCH))], names=["id", *names])

    parts = found.select("ids").mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names))
    summed = parts.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # v rows at most
    out = np.zeros((v, SKETCH))
    out[summed["id"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], 1)
    return out


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    spark = docs.sparkSession
    narrow(encoder(tokenizer).starts)
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    folder = fresh_path(spark, "lm-blocks")
    rows, _ = materialize(blocks(docs, folder), "lm-words")
    with batch_rows(spark, 20_000):
        words, _ = materialize(vocabulary(rows.select("word", "n"), tokenizer), "lm-vocabulary")
        total, different, documents = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
        counts = gather(words, np.append(encoder(tokenizer).starts[:-1], True), int(documents))
    chances = Chances(counts)
    counted = spark.sparkContext.broadcast((int(total), int(different), chances, counts.end))

    def encode(table: pa.Table) -> pa.Table:
        release()
        total, different, chances, end = counted.value
        at = table.column("at").to_numpy()
        size = int(at.max()) + 1
        c = np.zeros(size)
        c[at] = table.column("c").to_numpy()
        log_c = np.log10((c + 1) / (total + 1 * (different + 1)))
        raw = table.column("ids").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset)
        ids = np.frombuffer(raw.buffers()[2] or b"", "<u2", int(offsets[-1]) // 2)
        n_ids, first = np.zeros(size, np.int32), np.zeros(size, np.int32)
        n_ids[at], first[at] = (offsets[1:] - offsets[:-1]) // 2, offsets[:-1] // 2
        log_ids, log_end = np.zeros(size), math.log(chances.own[end])
        for low in range(0, len(at), WORDS):
            bounds = offsets[low : low + WORDS + 1] // 2
            part = ids[bounds[0] : bounds[-1]]
            logs = np.r_[0.0, np.cumsum(chances.logs(np.r_[end, part[:-1]][: len(part)], part))]  # a word's first id begins a word, whatever stands before
            log_ids[at[low : low + WORDS]] = np.diff(logs.take(bounds - bounds[0]))
        fs, top = filesystem(folder)
        out = []
        with fs.open_input_stream(f"{top}/{table.column('block')[0].as_py()}.arrow", compression=None) as f, pa.ipc.open_stream(f) as stream:
            for b in stream:
                doc_ids, own = b.column(0).to_pylist(), b.column(1).to_pylist()
                if not own:
                    continue
                n_words = np.array([len(x) // 4 for x in own], np.int64)
                placed, doc = np.frombuffer(b"".join(own), "<i4"), np.repeat(np.arange(len(own)), n_words)
                n = n_ids.take(placed)
                so_far = np.cumsum(n, dtype=np.int64)
                stream_ids = ids.take(np.repeat(first.take(placed) - (so_far - n), n) + np.arange(so_far[-1] if len(so_far) else 0)).tobytes()
                bounds = np.r_[0, np.r_[0, so_far][np.cumsum(n_words)]] * 2
                add = lambda x: np.bincount(doc, x.take(placed), len(own))
                out.append(pa.table({
                    "doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array([is_held(x) for x in doc_ids], pa.bool_()), "n_tokens": n_words + 1,
                    "n_known": (add(c > 0) + (c[0] > 0)).astype(np.int64), "train_tokens": np.full(len(own), total, np.int64), "base_score": add(log_c) + log_c[0], "chances": add(log_ids) + log_end,
                    "ids": pa.array([stream_ids[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
                }))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    back = rows.select("block", "at", "word").join(words.hint("shuffle_hash"), "word").select("block", "at", "c", "ids")
    found, _ = materialize(back.groupBy("block").applyInArrow(encode, f"{schema}, chances double, ids binary"), "lm-ids")
    learning = found.where("not held_out").select("ids", F.pmod(F.hash("doc_id", "n_tokens", "base_score"), F.lit(ROUNDS)).alias("turn"))
    layout = Layout(counts, classes_of(counts, beside(learning, counts.single)), chances)
    model = train(learning, layout)
    sent = spark.sparkContext.broadcast((layout, model.tables(layout)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        layout, tables = sent.value
        for b in batches:
            texts = [np.frombuffer(x, "<u2") for x in b.column(b.num_columns - 1).to_pylist()]
            if not texts:
                continue
            target = with_ends(texts, layout.end)
            n = np.array([len(x) + 1 for x in texts], np.int64)
            before = np.r_[layout.end, target[:-1]]  # the end of one document stands before the next
            logs = class_scores(before, target, n, layout, tables)
            scores = (np.bincount(np.repeat(np.arange(len(n)), n), logs, len(n)) + b.column(b.num_columns - 2).to_numpy()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(scores)], names=[*b.schema.names[:-2], "score"])

    return found.mapInArrow(run, f"{schema}, score double")
