"""Token ids of documents in binary shards, compressed document by document with one shared zstandard dictionary.

A shard is a file of frames and an index, so that one short document is read without its neighbours:

    magic (8 bytes) | sha256 of the dictionary (32) | frames, one for each document
    | doc_id int64[n] | frame offset uint64[n + 1] | n_tokens uint32[n] | n uint64 | place of the index uint64 | magic

Each frame holds the ids as little-endian unsigned 32-bit integers, compressed with the dictionary that lies beside the
shards as `<sha256>.zdict`. Documents are in ascending doc_id order over all shards (then by text; null ids first); the
manifest, one row for each shard, has the number of ids in all shards before.

Defined results: a null text is an empty text; an empty text is its end id alone; rows that share a doc_id are kept, one frame
each; an empty table gives a manifest without rows. Texts are encoded whole. Other input columns are not stored.
"""

from __future__ import annotations

import gc
import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, bounded_batches, filesystem, fresh_path, temporary, worker_cache

#: Signs that the pre-tokenizer always cuts off letters before them: ASCII signs but the apostrophe.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC = b"TIDZ\x01\n\r\n"
#: Documents whose ids the dictionary is trained on (a bound that ids and digests don't depend on, only the compression: 8,000
#: documents in place of 400 make the shards of sf0.1 1 % smaller), its size in bytes, and zstandard's level.
SAMPLE_DOCS, DICT_BYTES, LEVEL = 400, 65_536, 3


class Words(dict):
    """Numbers of words and their ids by number; words that the generation before knew are taken over, others wait in fresh."""

    def __init__(self, old: Words | None = None):
        super().__init__()
        self.old, self.raw, self.fresh, self.numbers = old, [], [], []
        if old is not None:
            old.old = None

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.raw)
        k = None if self.old is None else self.old.get(word)
        if k is None:
            self.raw.append(None)
            self.fresh.append(word)
            self.numbers.append(n)
        else:
            self.raw.append(self.old.raw[k])
        return n

    def taken(self) -> tuple[list[str], list[int]]:
        """The fresh words and their numbers, which are no longer fresh then."""
        out, self.fresh, self.numbers = (self.fresh, self.numbers), [], []
        return out


class BlockEncoder:
    """Encodes with the tokenizers library; words seen before come from a bounded memo.

    A byte-level pre-tokenizer always cuts before a single blank between two other characters, and between letters, a run of
    signs, and a line feed; so text is encoded by such parts with the same result. Texts that may hold special
    tokens, and words next to more than one blank, go to the library as they are.
    """

    def __init__(self, file: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(file), Tokenizer.from_file(file)
        #: For runs of letters, which the pre-tokenizer's pattern leaves whole.
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: For many such runs, each with a blank before it.
        self.spaced = Tokenizer.from_file(file)
        self.spaced.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), self.letters.pre_tokenizer])
        self.starts = np.zeros(self.spaced.get_vocab_size(), bool)
        self.starts[[i for x, i in self.spaced.get_vocab().items() if x.startswith("\u0120")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.words = most, Words()
        self.marks = Memo(lambda mark: self._raw(self.tokenizer, [mark])[0], 20_000)
        gc.set_threshold(200_000, 50, 1000)

    @staticmethod
    def _raw(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_blank(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters as they are after a blank, many in one call: a new word starts at each id of a blank."""
        out = []
        for low in range(0, len(words), 500):
            ids = np.array(self.spaced.encode_batch_fast([" " + " ".join(words[low : low + 500])], add_special_tokens=False)[0].ids, "<u4")
            at = (np.flatnonzero(self.starts[ids]) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(at, [*at[1:], len(raw)], strict=True)]
        return out

    @staticmethod
    def _cut(word: str) -> tuple[str, str, str, str] | None:
        """Letters, signs and line feed, letters, signs; None if the word has another form."""
        head, feed, tail = word.partition("\n")
        a, b = head.rstrip(SIGNS), tail.rstrip(SIGNS)
        if a.isalpha() and (b.isalpha() or not feed) and len(head) + len(tail) - len(a) - len(b) <= 16:
            return a, head[len(a) :] + feed, b, tail[len(b) :]
        return None

    def _learn(self) -> None:
        """Ids of the fresh words as they are after a blank; where signs or a line feed follow letters, by parts.

        Words that are empty or begin or end with white space get none: a cut beside them is no cut of the pre-tokenizer.
        """
        words, raw = self.words, self.words.raw
        letters, at_letters, odd, at_odd, parts, at_parts = [], [], [], [], [], []
        for w, n in zip(*words.taken(), strict=True):
            if w.isalpha():
                letters.append(w)
                at_letters.append(n)
            elif (cut := self._cut(w)) is not None:
                parts.append(cut)
                at_parts.append(n)
            elif w and not w[0].isspace() and not w[-1].isspace():
                odd.append(w)
                at_odd.append(n)
        heads = [words[head] for head, *_ in parts]
        for own, more in zip((letters, at_letters), words.taken(), strict=True):
            own += more
        for n, x in zip(at_letters, self._after_blank(letters), strict=True):
            raw[n] = x
        for n, x in zip(at_odd, self._raw(self.tokenizer, [" " + w for w in odd]), strict=True):
            raw[n] = x
        tails = list({tail for *_, tail, _ in parts if tail})
        bare = dict(zip(tails, self._raw(self.letters, tails), strict=True)) | {"": b""}
        for n, head, (_, mark, tail, last) in zip(at_parts, heads, parts, strict=True):
            raw[n] = raw[head] + self.marks[mark] + bare[tail] + self.marks[last]

    def after_blank(self, words: list[str]) -> list[bytes]:
        """Ids of different words as they are after a blank, without the memo; signs behind letters are cut off."""
        whole = list(map(str.isalpha, words))
        cuts = {w: cut for w, x in zip(words, whole, strict=True) if not x and "\n" not in w and (cut := self._cut(w)) is not None}
        letters = list({*compress(words, whole), *(cut[0] for cut in cuts.values())})
        ids = dict(zip(letters, self._after_blank(letters), strict=True))
        odd = [w for w, x in zip(words, whole, strict=True) if not x and w not in cuts]
        ids.update(zip(odd, self._raw(self.tokenizer, [" " + w for w in odd]), strict=True))
        return [ids[cuts[w][0]] + self.marks[cuts[w][1]] if w in cuts else ids[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) >= self.most:
            self.words = Words(self.words)
        words, split = self.words, []
        for text in texts:
            first, *rest = text.split(" ")
            by_word = rest and first and not first[-1].isspace() and not any([x in text for x in self.special])
            split.append((first, list(map(words.__getitem__, rest))) if by_word else (text, []))
        long = [w for w in words.fresh if len(w) > 64]
        self._learn()
        whole, bodies = [], []
        for text, (first, numbers) in zip(texts, split, strict=True):
            try:
                body = b"".join(map(words.raw.__getitem__, numbers))
            except TypeError:  # a word without ids
                first, body = text, b""
            whole.append(first)
            bodies.append(body)
        for w in long:
            words.raw[words.pop(w)] = b""
        return [x + body for x, body in zip(self._raw(self.tokenizer, whole), bodies, strict=True)]


def encoder(file: str) -> BlockEncoder:
    return worker_cache(("blocks", file), lambda: BlockEncoder(file))


def _train(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; where they are too few, their bytes as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """Trains on SAMPLE_DOCS documents, those with the smallest hash of their id, in a task of its own."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x + end for b in batches for x in encoder(tokenizer).encode([t or "" for t in b.column(0).to_pylist()])]
        yield pa.RecordBatch.from_arrays([pa.array([_train(samples) if samples else b""], pa.binary())], names=["dictionary"])

    picked = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("text").limit(2 * SAMPLE_DOCS).coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return max((bytes(r[0]) for r in rows), key=len, default=b"")


class ShardWriter:
    def __init__(self, stream, dictionary: bytes):
        import zstandard

        self.stream, self.at = stream, 0
        self.data = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.ids, self.offsets, self.sizes = [], [], []
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(-(2**63) if doc_id is None else doc_id)
        self.offsets.append(self.at)
        self.sizes.append(len(ids) // 4)
        self._put(self.data.compress(ids))

    def close(self) -> None:
        index = self.at
        self._put(np.array(self.ids, "<i8").tobytes() + np.array([*self.offsets, index], "<u8").tobytes() + np.array(self.sizes, "<u4").tobytes())
        self._put(struct.pack("<QQ", len(self.ids), index) + MAGIC)
        self.stream.close()


class ShardReader:
    """Reads single documents by their place in the shard."""

    def __init__(self, url: str):
        import zstandard

        self.fs, self.path = filesystem(url)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if tail[16:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{url}: not a whole shard")
        n, index = struct.unpack("<QQ", tail[:16])
        raw = self.file.read_at(size - 16 - len(MAGIC) - index, index)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 * n)
        self.sizes = np.frombuffer(raw, "<u4", n, 16 * n + 8)
        digest = head[len(MAGIC) :].hex()
        with self.fs.open_input_stream(f"{self.path.rpartition('/')[0]}/{digest}.zdict", compression=None) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError(f"{url}: another dictionary")
        self.data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, k: int) -> np.ndarray:
        """Ids of the document at place k, from its frame alone."""
        return np.frombuffer(next(self.frames(k, k + 1)), "<u4")

    def frames(self, low: int, high: int) -> Iterator[bytes]:
        """Decompressed ids of the documents from place low to before high, after one read."""
        at = self.offsets[low : high + 1].astype(np.int64)
        raw = memoryview(self.file.read_at(int(at[-1] - at[0]), int(at[0])))
        for x, y in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
            yield self.data.decompress(raw[x:y])

    def find(self, doc_id: int) -> np.ndarray:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        if k == len(self) or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.read(k)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs (doc_id, text) into a folder that all machines share; returns their manifest.

    Without a folder they lie in the one for intermediate tables and go when the application ends.

    Manifest: shard int (place in the order), path string, n_docs long, n_tokens long, start long.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own, folder = not folder, folder or fresh_path(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary, end = train_dictionary(docs, tokenizer, end_id), struct.pack("<I", end_id)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.zdict", compression=None) as f:
        f.write(dictionary)
    if own:
        temporary(spark, folder)
    sent = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = filesystem(folder)
        out, name, n_docs, n_tokens = None, "", 0, 0
        for b in batches:
            if out is None:
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tidz"  # a repeated task writes a file of its own
                out = ShardWriter(where.open_output_stream(f"{top}/{name}", compression=None), sent.value)
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist()), strict=True):
                out.add(doc_id, ids + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    order = ["doc_id", F.xxhash64("text")]
    shards = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "shard int, path string, n_docs long, n_tokens long").collect()
    rows, start = [], 0
    for r in sorted(shards, key=lambda r: r["shard"]):
        rows.append((r["shard"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(rows, "shard int, path string, n_docs long, n_tokens long, start long")


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, read from the shards."""
    spark: SparkSession = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = ShardReader(url)
                for low in range(0, len(shard), 512):
                    part = list(shard.frames(low, min(low + 512, len(shard))))
                    sizes = np.array([len(x) // 4 for x in part], np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    ids = shard.doc_ids[low : low + len(part)]
                    columns = [pa.array(ids, pa.int64(), mask=ids == -(2**63)), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(x) for x in part], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in part], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    tasks = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.createDataFrame(manifest.select("path", "start").collect(), "path string, start long").repartition(tasks).mapInArrow(run, schema)
