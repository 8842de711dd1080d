import random
import re
import zlib
from collections import Counter

from semspark.llm import spelling
from semspark.llm.spelling import HalvesAutomaton


def one_edit(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced code point, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def brute_counts(rows, one_in):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if one_in and h % one_in == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            out[low] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute_forms(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(near), best if best is not None and counts[best] >= 2 * n else None)
    rows = []
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        rows.append((w, form, root, n, k, counts[form] if form else None))
    return sorted(rows, key=str)


def words_of(rng, n, letters, lengths=(5, 8)):
    return list({"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)})


def test_automaton_finds_what_trying_all_finds():
    rng = random.Random(1)
    for _ in range(20):
        held, scanned = words_of(rng, 60, "abé", (6, 6)), words_of(rng, 60, "abé", (6, 7))
        shard = HalvesAutomaton(held)
        for w in scanned:
            got = sorted(shard.same(w)) if len(w) == 6 else sorted(shard.longer(w))
            assert got == [k for k, h in enumerate(held) if one_edit(h, w)], w


def test_vocabulary_of_whole_texts(spark, monkeypatch):
    """Windows end outside runs; null ids and texts, repeated rows, other letters and signs."""
    monkeypatch.setattr(spelling, "WINDOW", 7)
    rng = random.Random(2)
    rows = [(k % 40, " ".join(rng.choice(["Maison", "MAISON", "été-là", "Über×fluß", "abcdefghijklmnopqrst", "İstanbul", "naïve1naïve", "日本house"]) for _ in range(30))) for k in range(50)]
    rows += [(None, "Maison maison"), (3, None), (4, ""), (5, "x" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for text in ("Maison maison", "x" * 100, "aÉb-ÀÿA"):
        assert spelling.runs(text) == Counter(re.findall("[a-zÀ-ÿ]+", text.encode().lower().decode()))
    for one_in in (None, 5, 97):
        got = {r.word: r.n for r in spelling.vocabulary(df, one_in=one_in).collect()}
        assert got == brute_counts(rows, one_in)
    assert spelling.vocabulary(df.limit(0)).collect() == []


def test_forms_match_brute_force(spark):
    """In one block of each length and in many; hot halves, ties, chains of forms."""
    rng = random.Random(3)
    counts = {w: rng.choice([3, 4, 7, 15, 31, 100]) for w in words_of(rng, 250, "ab", (5, 8)) + words_of(rng, 150, "abcdefgh", (5, 7)) + ["entre" + x for x in words_of(rng, 60, "abc", (1, 4))]}
    counts |= {"zzzzzzz": 3, "zzzzzzy": 6, "zzzzzyy": 12, "zzzzyyy": 24, "zzzyyyy": 48, "alonely": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumnRenamed("n", "n").selectExpr("word", "n", "'x' as form", "1 as held")
    want = brute_forms(counts)
    for block in (1 << 16, 40):
        got = sorted((tuple(r) for r in spelling.spelling_forms(df, block=block).collect()), key=str)
        assert got == want
    assert spelling.spelling_forms(df.limit(0)).collect() == []
