"""Byte-level BPE over a table of texts: encoding in overlapping chunks, decoding by concatenated bytes.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, from its first character
on, which may lie inside a pre-token. Neighbouring chunks are stitched at the first place of their overlap where both
begin a pre-token: a match of the pattern depends on nothing before it, so from there on both splits are the same. What
lies between two such places is encoded as one piece, in any task, and the pieces' ids follow each other. Texts of one
chunk need no stitching and are encoded where they are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, short, written

#: Characters of a chunk's own part, and of the next chunk that it reads too.
CHUNK, OVERLAP = 16_384, 512
#: Characters after the end of a match that may have decided it (two, in a contraction cut off after its apostrophe).
AHEAD = 2
#: Characters that are encoded before their ids are handed on.
BATCH = 1 << 20
#: Stands for signs that only one of the two pattern engines knows as letters or numbers.
_SIGN = 0x2603


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """Bytes of each token; ids without a token have none."""
    ranks = read_ranks(path)
    out: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


@lru_cache(maxsize=1)
def unlike_signs() -> dict[int, int]:
    """Characters that the two engines, of other Unicode versions, do not both take for letters, numbers or space, each
    with one that both take for what it is to the encoder's. Made once on the driver."""
    import regex
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = (r"\p{L}", r"\p{N}", r"\s")
    single = {bytes([b]): b for b in range(256)}
    theirs = [set(bytes(tiktoken.Encoding("kind", pat_str=k, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)).decode()) for k in kinds]
    ours = [set(regex.findall(k, everything)) for k in kinds]
    stands = ["a", "1", " "]
    out = {}
    for c in set.union(*(a ^ b for a, b in zip(theirs, ours, strict=True))):
        out[ord(c)] = next((ord(s) for s, kind in zip(stands, theirs, strict=True) if c in kind), _SIGN)
    return out


@lru_cache(maxsize=1)
def _unlike_table(codes: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[list(codes)] = True
    return table


def boundaries(text: str, pattern: str, unlike: dict[int, int]) -> np.ndarray:
    """Starts of the pre-tokens of ``text`` that follow no white space: before those a text may be cut, as a run of
    white space is split by what follows it."""
    import regex

    plain = text
    if not text.isascii() and _unlike_table(tuple(unlike))[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
        plain = text.translate(unlike)
    return np.array([m.start() for m in regex.finditer(pattern, plain) if m.start() == 0 or not plain[m.start() - 1].isspace()], np.int64)


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for first in range(0, len(text), chunk * 64):  # 64 chunks at a time, so that a long text is not held twice
                    at = list(range(first, min(len(text), first + chunk * 64), chunk))
                    own = [min(len(text), a + chunk) for a in at]
                    yield pa.record_batch({"row": pa.array([row] * len(at), pa.int64()), "at": pa.array(at, pa.int64()), "own": pa.array(own, pa.int64()), "last": pa.array([o + overlap >= len(text) for o in own]), "text": pa.array([text[a : o + overlap] for a, o in zip(at, own, strict=True)])})

    return run


def _marks(pattern: str, overlap: int):
    unlike = unlike_signs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for at, own, last, text in zip(*(batch.column(c).to_pylist() for c in ("at", "own", "last", "text")), strict=True):
                found = boundaries(text, pattern, unlike) + at
                # The end of a match is sure where what follows it is there; the next match begins there.
                sure = at + len(text) - (0 if last else AHEAD)
                heads.append(found[found <= at + overlap])
                tails.append(found[(found >= own) & (found <= sure)])
            yield pa.record_batch({**{c: batch.column(c) for c in ("row", "at", "turn")}, "heads": pa.array(heads, pa.list_(pa.int64())), "tails": pa.array(tails, pa.list_(pa.int64()))})

    return run


def _marked(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Places where a chunk may be stitched to the one before it (heads) and to the next one (tails)."""
    return chunks.mapInArrow(_marks(pattern, overlap), "row long, at long, turn int, heads array<long>, tails array<long>")


def stitched(chunks: DataFrame, pattern: str, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(chunks, cuts): cuts has for each chunk (row, at, turn) the place ``begin`` from which on its text is its own
    piece, and ``end``, where the next one's begins (null: the text's end).

    Chunks whose overlap has no common boundary, as inside one very long pre-token, are joined to one chunk, which is
    split anew and takes their place, in another turn. That is repeated until all are stitched; each turn has fewer
    chunks.
    """
    order = Window.partitionBy("row").orderBy("at")
    key = ["row", "at", "turn"]
    turn = 0
    chunks = chunks.withColumn("turn", F.lit(turn))
    marks = written(_marked(chunks, pattern, overlap), "marks")
    while True:
        shared = F.array_min(F.array_intersect("heads", F.lag("tails").over(order)))
        cuts = written(marks.select(*key, F.when(F.col("at") == 0, F.col("at")).otherwise(shared).alias("begin")), "cuts")
        if cuts.where("begin is null").isEmpty():
            return chunks, cuts.withColumn("end", F.lead("begin").over(order))
        groups = cuts.withColumn("head", F.max(F.when(F.col("begin").isNotNull(), F.col("at"))).over(order))
        several = groups.withColumn("n", F.count("*").over(Window.partitionBy("row", "head"))).where("n > 1")
        several = short(written(several.select(*key, "head"), "several"))
        joined = chunks.join(several, key).groupBy("row", "head").agg(F.array_sort(F.collect_list(F.struct("at", "own", "last", "text"))).alias("c"))
        end = F.element_at("c", -1)
        whole = F.concat(F.array_join(F.transform(F.slice("c", 1, F.size("c") - 1), lambda c: F.substring(c["text"], F.lit(1), c["own"] - c["at"])), ""), end["text"])
        turn += 1
        longer = written(joined.select("row", F.col("head").alias("at"), end["own"].alias("own"), end["last"].alias("last"), whole.alias("text"), F.lit(turn).alias("turn")), "chunks")
        marks = written(marks.join(several, key, "left_anti").unionByName(_marked(longer, pattern, overlap)), "marks")
        chunks = chunks.unionByName(longer)


def _encoded(path: str, pattern: str):
    """The last column, a text, becomes the ids of its pre-tokens as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            n = pc.binary_length(text).to_numpy(zero_copy_only=False)
            start = size = 0
            for k in range(len(n)):
                size += int(n[k])
                if size >= BATCH or k + 1 == len(n):
                    part = batch.slice(start, k + 1 - start)
                    ids = [np.array(known.encode_ordinary(t), "<u4").tobytes() for t in part.column(part.num_columns - 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*part.schema.names[:-1], "ids"])
                    start, size = k + 1, 0

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, id_col, part, whole, ids): the ids of each text, in one row for each of its pieces, by ascending ``part``.

    ``path`` names a file of ranks and ``pattern`` what splits texts before the merges; a match must depend on nothing
    before it and on AHEAD characters after it at most, but for runs. There are no special tokens: their strings are
    ordinary text. ``ids`` holds little-endian unsigned 32-bit integers. ``row`` tells rows apart whatever their ids;
    rows with ``whole`` are a whole text. A null text is empty; empty texts have one row without ids. Null and repeated
    ids stay as they are, no other column is read, and an empty table gives no rows. Memory is bounded by a batch of
    texts, the longest text and the longest pre-token, which is never cut.
    """
    key = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    short = key.where(F.char_length("text") <= chunk).mapInArrow(_encoded(path, pattern), f"row long, id {kind}, ids binary")
    short = short.select("row", "id", F.lit(0).cast("long").alias("part"), F.lit(True).alias("whole"), "ids")
    large = written(key.where(F.char_length("text") > chunk), "long-texts")
    chunks = written(large.select("row", "text").mapInArrow(_cut(chunk, overlap), "row long, at long, own long, last boolean, text string"), "chunks")
    chunks, cuts = stitched(chunks, pattern, overlap)
    begin = F.col("begin") - F.col("at") + 1
    size = F.coalesce(F.col("end") - F.col("begin"), F.char_length("text").cast("long"))
    pieces = chunks.join(cuts.hint("merge"), ["row", "at", "turn"]).select("row", "begin", F.substring("text", begin, size).alias("text"))
    pieces = pieces.mapInArrow(_encoded(path, pattern), "row long, part long, ids binary").join(large.select("row", "id"), "row")
    (name,) = fresh(["row", "part", "whole", "ids"], id_col)
    return short.union(pieces.select("row", "id", "part", F.lit(False).alias("whole"), "ids")).withColumnRenamed("id", name)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            column = batch.column("ids")
            out = [_bytes_of(known, np.frombuffer(ids.as_buffer(), "<u4")) if ids.is_valid else None for ids in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    return run


def _bytes_of(known: pa.Array, ids: np.ndarray) -> bytes:
    taken = known.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)
    return taken.buffers()[2].slice(offsets[0], offsets[len(ids)] - offsets[0]).to_pybytes() if len(ids) else b""


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``bytes``: those of each row's tokens one after the other. A piece may end inside a character;
    the bytes of a text's rows, by ascending ``part``, make the text. Null ids give null; an id without a token is an
    error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(path), f"{schema}, bytes binary")


def _hashed(path: str):
    """Digests over the pieces of each text, which follow each other; only the hashes' states are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        row = doc = None
        n = 0
        ids_hash = bytes_hash = hashlib.sha256()

        def made():
            return pa.record_batch({"id": doc, "n_tokens": pa.array([n], pa.int64()), "ids_sha256": pa.array([ids_hash.hexdigest()]), "decoded_sha256": pa.array([bytes_hash.hexdigest()])})

        for batch in batches:
            for k, at in enumerate(batch.column("row").to_pylist()):
                if at != row:
                    if row is not None:
                        yield made()
                    row, doc, n = at, batch.column("id").slice(k, 1), 0
                    ids_hash, bytes_hash = hashlib.sha256(), hashlib.sha256()
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "<u4")
                n += len(ids)
                ids_hash.update(ids)
                bytes_hash.update(_bytes_of(known, ids))
        if row is not None:
            yield made()

    return run


def digest(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each text of ``encode``'s rows, decoded again. Only texts of
    several pieces are brought together, by a hash of their rows; they pass through their task piece by piece and are
    decoded there."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.withColumnRenamed(id_col, "id")
    whole = decode(rows.where("whole").select("id", "ids"), path)
    whole = whole.select("id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    pieces = rows.where("not whole").select("row", "part", "id", "ids").repartition("row").sortWithinPartitions("row", "part")
    streamed = pieces.mapInArrow(_hashed(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return whole.union(streamed).withColumnRenamed("id", id_col)
