"""Token-id shards with one shared zstandard dictionary and an offset index for reading single documents.

A shard file holds::

    magic "STKZ0001" | dictionary sha-256 (32 bytes) | frames ... | index | index length (8 bytes) | count (8 bytes)

Each frame is the zstandard compression, with the shared dictionary, of one document's ids as little-endian
unsigned 32-bit integers. The index is an array of (offset, length, ids) as unsigned 64-bit little-endian integers,
so a document is read with two small range reads. The dictionary lies beside the shards in ``dictionary.bin``.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written
from .texthash import LONG, MASKS, U, buffers, eights, span_hashes

MAGIC = b"STKZ0001"
LEVEL = 1
#: Documents and ids of each that the dictionary is trained on; they bound the dictionary's training, not the output.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
#: Texts that are encoded at once.
BATCH_BYTES = 1 << 20
DOCS_PER_SHARD = 20_000
#: Shards whose sizes are added up in one task.
SHARDS_PER_RUN = 4096


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


#: Distinct pieces that an encoder remembers before it starts anew; it bounds memory and changes no result.
REMEMBERED = 500_000
#: Kinds of bytes: the parts of letters, digits, other printable signs, space, line feed, and all others.
LETTER, DIGIT, SIGN, SPACE, LINE, OTHER = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = SIGN
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[39] = OTHER  # an apostrophe can begin a contraction
    kind[32], kind[10] = SPACE, LINE
    return kind


_KIND = _kinds()


class ByteLevelEncoder:
    """Encodes with a byte-level BPE tokenizer, each distinct piece of its first split once.

    Texts of ASCII and Latin-1 letters with lone white space are split here: a piece is a run of letters, digits or
    other signs with the lone space before it, or a lone line feed. Pieces are looked up by a 64-bit hash and then
    compared byte by byte with the piece remembered. New ones are encoded by the tokenizer, those with a space
    together: there, a token that begins with the space's byte begins a piece. The tokenizer encodes all other texts
    whole: those with other signs, with pieces of over 64 bytes, with strings of special tokens, or with a piece
    whose bytes are not those remembered under its hash.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size()
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._spaced = np.array([(self._tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        sample = ["Aé", ",", " bü", " 12", "\n", "c", "#.", " ("]
        whole, parts = self._direct(["".join(sample)])[0], self._direct(sample)
        self._split = whole.tolist() == np.concatenate(parts).tolist() and bool(self._spaced[parts[2][0]])
        self._forget()

    def _forget(self) -> None:
        self._keys, self._start, self._length, self._pool = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self._from, self._size, self._bytes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        spaced = np.array([p[0] == 32 for p in raw])
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        joined = self._direct([b"".join(p for p in raw if p[0] == 32).decode()])[0]
        alone = self._direct([p.decode() for p in raw if p[0] != 32])
        start = np.flatnonzero(self._spaced[joined])
        length = np.concatenate([np.diff(np.append(start, len(joined))), np.array([len(a) for a in alone], np.int64)])
        begin = np.concatenate([[0], np.cumsum(length)])[:-1] + len(self._pool)
        self._pool = np.concatenate([self._pool, joined, *alone])
        sizes = np.array([len(raw[k]) for k in order], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1] + len(self._bytes)
        self._bytes = np.concatenate([self._bytes, np.frombuffer(b"".join(raw[k] for k in order), np.uint8)])
        keys = np.concatenate([self._keys, keys[order]])
        at = np.argsort(keys, kind="stable")
        self._keys = keys[at]
        self._start, self._from = np.concatenate([self._start, begin])[at], np.concatenate([self._from, first])[at]
        self._length, self._size = np.concatenate([self._length, length.astype(np.int32)])[at], np.concatenate([self._size, sizes.astype(np.int32)])[at]

    def _same(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of the piece remembered in its slot."""
        same = sizes == self._size[slots]
        text, known = eights(data), eights(self._bytes)
        rows, at, other, left = np.arange(len(starts)), starts, self._from[slots], sizes
        while len(rows):
            mask = MASKS[np.minimum(left, 8)]
            same[rows] &= (text[at] & mask) == (known[np.minimum(other, len(self._bytes))] & mask)
            more = left > 8
            rows, at, other, left = rows[more], at[more] + 8, other[more] + 8, left[more] - 8
        return same

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self._split or not texts:
            return self._direct(texts)
        if len(self._keys) > REMEMBERED:
            self._forget()
        data, offsets = buffers(pa.array(texts, pa.large_string()))
        n = len(data)
        kind = np.append(_KIND[data], SPACE)
        wide = np.flatnonzero(data == 0xC3)  # the lead byte of the letters U+00C0 to U+00FF, but for two signs
        tail = data[np.minimum(wide + 1, n - 1)] if n else wide
        wide = wide[(tail != 0x97) & (tail != 0xB7)]
        kind[wide] = kind[wide + 1] = LETTER
        blank = kind >= SPACE
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        odd = kind[:n] == OTHER
        odd |= blank[:n] & blank[1:] & ~fresh[1:]  # white space that touches more of it
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        odd[last] |= blank[last]  # or that ends a text
        raw = data.tobytes()
        for special in self._special:
            at = raw.find(special)
            while at >= 0:
                odd[at] = True
                at = raw.find(special, at + 1)
        plain = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) == 0
        cut = fresh[:n].copy()
        if n:
            cut[1:] |= (kind[1:n] != kind[: n - 1]) & ((kind[: n - 1] != SPACE) | (kind[1:n] == LINE))
        cut &= np.repeat(plain, np.diff(offsets))
        starts = np.flatnonzero(cut)
        owner = np.searchsorted(offsets, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], n), offsets[owner + 1]) if len(starts) else starts
        plain[owner[ends - starts > LONG]] = False
        starts, ends = starts[plain[owner]], ends[plain[owner]]
        keys = span_hashes(data, starts, ends)[0]
        known, code = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self._keys, known)
        missing = np.ones(len(known), bool)
        inside = at < len(self._keys)
        missing[inside] = self._keys[at[inside]] != known[inside]
        if missing.any():
            first = np.full(len(known), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            new = first[missing]
            self._learn(known[missing], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self._keys, known)
        unlike = starts[~self._same(data, starts, ends - starts, at[code])]
        plain[np.searchsorted(offsets, unlike, "right") - 1] = False
        length = self._length[at].astype(np.int64)[code]
        edge = np.concatenate([[0], np.cumsum(length)])
        ids = self._pool[np.repeat(self._start[at][code] - edge[:-1], length) + np.arange(edge[-1])]
        bounds = edge[np.searchsorted(starts, offsets)]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k, whole in zip(np.flatnonzero(~plain).tolist(), self._direct([texts[k] for k in np.flatnonzero(~plain)]), strict=True):
            out[k] = whole
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def encode(texts: list[str], path: str, end_id: int | None) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer's plain call gives them (strings of special tokens are such tokens), with the end id after them."""
    end = np.array([] if end_id is None else [end_id], "<u4")
    return [np.concatenate([ids, end]) for ids in _encoder(path).encode(texts)]


def _in_batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts = column.to_pylist()
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_BYTES or i + 1 == len(texts):
            yield start, [t or "" for t in texts[start : i + 1]]
            start, size = i + 1, 0


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialised id arrays; too few samples to train on give their concatenation."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardReader:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _filesystem(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        if self._file.read_at(40, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token shard, or written with another dictionary")
        length, count = np.frombuffer(self._file.read_at(16, size - 16), "<u8")
        self.index = np.frombuffer(self._file.read_at(int(length), size - 16 - int(length)), "<u8").reshape(int(count), 3)
        self._frames = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        offset, length, n = map(int, self.index[k])
        return np.frombuffer(self._frames.decompress(self._file.read_at(length, offset), max_output_size=max(1, 4 * n)), "<u4")

    def close(self) -> None:
        self._file.close()


def _write_shard(root: str, dictionary: bytes, path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, base = _filesystem(root)
        # A task may run twice. Each attempt writes a file of its own, and only the one whose row is kept is read.
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.stkz"
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        index, ids, at = [], [], 40
        out = None
        for batch in batches:
            for first, texts in _in_batches(batch.column(1)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC + hashlib.sha256(dictionary).digest())
                for k, own in enumerate(encode(texts, path, end_id)):
                    frame = packer.compress(own.tobytes())
                    out.write(frame)
                    index.append((at, len(frame), len(own)))
                    ids.append(batch.column(0)[first + k].as_py())
                    at += len(frame)
        if out is None:
            return
        raw = np.array(index, "<u8").reshape(-1, 3)
        out.write(raw.tobytes())
        out.write(np.array([raw.nbytes, len(raw)], "<u8").tobytes())
        out.close()
        yield pa.record_batch({"shard": [shard], "file": [name], "n_docs": [len(raw)], "n_ids": [int(raw[:, 2].sum())], "doc_ids": pa.array([ids], pa.list_(pa.int64()))})

    return run


def write_shards(docs: DataFrame, tokenizer: str, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Encode ``docs`` in ascending id order into shard files below ``root`` (a folder that all machines share).

    Returns the manifest (shard, file, n_docs, n_ids, doc_ids, start, root), also written to ``root``/manifest.
    ``start`` counts the ids of all shards before. Null texts are empty (only the end id); null ids come first;
    rows that repeat an id are kept, in the order of a hash of their texts. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    root = root or new_path(spark, "tokens")
    fs, base = _filesystem(root)
    fs.create_dir(base, recursive=True)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = plain.select("doc_id").count()
    sample = plain.select("doc_id", F.substring("text", 1, 6 * SAMPLE_IDS).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _in_batches(batch.column(1)):
                yield pa.record_batch({"raw": pa.array([x[:SAMPLE_IDS].tobytes() for x in encode(texts, tokenizer, end_id)], pa.binary())})

    dictionary = train_dictionary([bytes(r.raw) for r in sample.mapInArrow(serialised, "raw binary").collect()])
    with fs.open_output_stream(f"{base}/dictionary.bin") as out:
        out.write(dictionary)
    shards = max(1, -(-rows // docs_per_shard), min(rows // 500, spark.sparkContext.defaultParallelism))
    ordered = plain.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = ordered.mapInArrow(_write_shard(root, dictionary, tokenizer, end_id), "shard long, file string, n_docs long, n_ids long, doc_ids array<long>")
    made = written(made, "shards")
    # Sums of all shards before, first in runs of shards, then over the runs, of which there are few.
    sizes = made.select("shard", "n_ids", F.expr(f"shard div {SHARDS_PER_RUN}").alias("run"))
    runs = sizes.groupBy("run").agg(F.sum("n_ids").alias("ids"))
    runs = runs.select("run", F.coalesce(F.sum("ids").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sizes.withColumn("own", own).join(runs, "run").select("shard", (F.col("before") + F.col("own")).alias("start"))
    made.join(known, "shard").withColumn("root", F.lit(root)).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, read back from the files."""
    return _read(spark, root, True)


def read_digest(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; the ids stay in the readers."""
    return _read(spark, root, False)


def _read(spark: SparkSession, root: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        with fs.open_input_file(f"{base}/dictionary.bin") as f:
            dictionary = f.read()
        for batch in batches:
            for name, start, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                reader, at, rows = ShardReader(f"{root}/{name}", dictionary), start, []
                for k in range(len(reader)):
                    own = reader.ids(k)
                    rows.append((at, len(own), own if whole else zlib.crc32(own.tobytes())))
                    at += len(own)
                    if len(rows) == 1000 or k + 1 == len(reader):
                        last = pa.array([r[2] for r in rows], pa.list_(pa.int64()) if whole else pa.int64())
                        yield pa.record_batch({"doc_id": ids.values.slice(k + 1 - len(rows), len(rows)), "start": pa.array([r[0] for r in rows], pa.int64()), "n_tokens": pa.array([r[1] for r in rows], pa.int64()), "x": last})
                        rows = []
                reader.close()

    manifest = spark.read.parquet(f"{root}/manifest")
    files = manifest.select("file", "start", "doc_ids")
    n = max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 4))
    last = "ids array<long>" if whole else "ids_crc32 long"
    return files.repartition(n, "file").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
