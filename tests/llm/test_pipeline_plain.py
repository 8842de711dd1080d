"""The pipeline's last rows against a plain version of all five stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from semspark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keeps_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words) >= 20 and 100 * len(repeated) <= 30 * len(words)


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def least_of_groups(docs):
    """Documents that have the least id of their group of texts linked at 0.75."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def reduced(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip().encode()


def holds(item, text):
    """Whether the item occurs in the text with 6 % edits at most, by a whole alignment."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    data = np.frombuffer(text, np.uint8)
    for k, c in enumerate(item, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (data != c))
        new[0] = k
        row = np.minimum.accumulate(new - steps) + steps
    return row.min() <= int(len(item) * 0.06)


def copies(doc_id, mean):
    u = int(hashlib.md5(f"mix:{doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
    n, total = 0, 0.0
    while True:
        total += math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
        if total > u:
            return n
        n += 1


def plain_rows(docs, items):
    from tokenizers import Tokenizer

    kept = {i: t for i, (t, _) in docs.items() if keeps_base(t)}
    kept = least_of_groups(kept)
    kept = {i: t for i, t in kept.items() if not any(holds(reduced(item), reduced(t)) for item in items)}
    count = Counter(docs[i][1] for i in kept)
    shares = sum(n**0.7 for n in count.values())
    encoder = Tokenizer.from_file(tokenizer_path())
    rows, start = [], 0
    for i in sorted(kept):
        n = count[docs[i][1]]
        ids = np.array([*encoder.encode(kept[i], add_special_tokens=False).ids, 2], "<u4")
        for _ in range(copies(i, n**0.7 * len(kept) / (shares * n))):
            rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return rows, set(kept)


def test_last_rows_are_those_of_a_plain_pipeline(spark, tmp_path):
    rng = random.Random(21)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n))
    items = [text(25), text(12)]
    docs = {k: (text(rng.randint(15, 90)), f"s{0 if k % 3 else rng.randrange(4)}") for k in range(70)}
    for k in range(70, 90):  # near copies of several strengths
        words = docs[rng.randrange(40)][0].split(" ")
        for _ in range(rng.randint(0, len(words) // 12)):
            words[rng.randrange(len(words))] = "changed"
        docs[k] = (" ".join(words), "s1")
    docs[90] = (f"{text(30)} {items[0].upper()} {text(20)}", "s2")
    docs[91] = (f"{text(30)} {items[1].replace(' ', '  ', 3)} {text(20)}", "s0")
    docs[92] = (f"{text(30)} {items[0][:40]} {text(20)}", "s0")  # a part of an item only
    docs[93] = (" ".join(["all of this is said again and again"] * 9), "s0")
    docs[94], docs[95] = (None, "s1"), ("", None)
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in docs.items()]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, kept = plain_rows(docs, items)
    assert 90 not in kept and 91 not in kept and 92 in kept and 93 not in kept and 0 < sum(k in kept for k in range(70, 90)) < 20 and len({i for i, *_ in want}) > 30
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in out) == want
