import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from semspark.llm import bytebpe
from semspark.llm.queries import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pieces that meet in odd ways: contractions, white space of several kinds, signs that only one engine takes for letters.
PARTS = ["a", "'ll", "'", "l", "  ", "\n", " ", "é", "1", "!", "##", "՘", "日本", " ", " the", " quick", "\t", "'s", "12", "x" * 30, "   \n", "\U00011de0", " ", "<|endoftext|>"]


def plain(text):
    ids = np.array(bytebpe.encoder(RANKS, PATTERN).encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def digests(df, **options):
    rows = bytebpe.digest(bytebpe.encode(df, RANKS, PATTERN, **options), RANKS).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)


def test_chunks_give_the_ids_of_the_plain_call(spark):
    """With tiny chunks, so that runs are longer than the overlap and chunks are joined; null and repeated ids too."""
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300)))) for k in range(80)]
    rows += [(1000, None), (None, "a b c"), (1000, ""), (1000, ""), (1001, "z" * 3000 + " q"), (1002, " " * 2000 + "x y"), (1003, "'" * 1500 + "ll ok"), (None, "b " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    want = sorted((-1 if k is None else k, *plain(text)) for k, text in rows)
    assert digests(df, chunk=50, overlap=12) == want
    assert digests(df) == want  # in one chunk each
    assert digests(df.limit(0)) == []


def test_pieces_are_cut_only_between_pretokens(spark):
    text = ("Ceci n'est pas l'été.  \n\n" * 40) + "y" * 200 + " end"
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    rows = bytebpe.decode(bytebpe.encode(df, RANKS, PATTERN, chunk=64, overlap=16), RANKS).orderBy("part").collect()
    assert len(rows) > 10 and not any(r.whole for r in rows)
    assert b"".join(r.bytes for r in rows).decode() == text
    starts = set(bytebpe.boundaries(text, PATTERN, bytebpe.unlike_signs()).tolist())
    assert {r.part for r in rows} <= starts


def test_ids_without_a_token_are_an_error(spark):
    df = spark.createDataFrame([(bytearray(np.array([10**6], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(Exception, match="bounds"):
        bytebpe.decode(df, RANKS).collect()
    assert bytebpe.decode(spark.createDataFrame([(None,), (bytearray(),)], "ids binary"), RANKS).collect()[0].bytes is None
