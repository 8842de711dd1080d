import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspark.llm import decontamination, hilbert, html_suffix, minhash, mixing, quality_rules, tokenfiles
from semspark.llm.queries import tokenizer_path
from semspark.runtime.shared import new_path

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    """Null and empty texts, null ids, repeated rows and ids, copies, near copies, a long text, odd white space."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "ab cd ef gh ij kl mn op".split() for b in "ra sé to ÜX vi w1".split()]
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \n\t", "one two", "one  two", "One TWO", "x " * 5000, "a\n\nb  c <|endoftext|>", "日本 語 x"]
    for b in base:
        words = b.split()
        texts.append(b)
        for k in (1, 2, 4, 9, 30):
            w = words.copy()
            for _ in range(k):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
        texts.append(b.upper() if b.isascii() else b + "\nagain")
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base[0], None, None, None), (None, None, None, None, 3), (3, base[1], "en", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates_match_brute_force(spark):
    docs = corpus(spark).withColumn("n", F.lit(1)).withColumn("kept", F.lit("clash"))
    rows = docs.collect()
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    parent = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            lo, hi = sorted((find(i), find(j)))
            parent[hi] = lo
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(s)) for i, s in sets)
    kept = [r.doc_id for r in got if r.kept and r.doc_id is not None]
    assert sorted(kept) == sorted({find(i) for i in parent})
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(kept)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_bucket_needs_no_pairs_and_loses_no_link(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        w = base.copy()
        for _ in range(rng.choice([2, 4, 6, 8])):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            lo, hi = sorted((find(i), find(j)))
            parent[hi] = lo
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_token_shards_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    docs = corpus(spark)
    own = Tokenizer.from_file(tokenizer_path())
    root = new_path(spark, "t")
    tokenfiles.write_shards(docs, tokenizer_path(), root, docs_per_shard=7)
    got = tokenfiles.read_digest(spark, root).orderBy("start").collect()
    rows = docs.withColumn("tie", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert sum(len(r.ids) for r in tokenfiles.read_shards(spark, root).collect()) == at
    with pytest.raises(ValueError):
        m = spark.read.parquet(f"{root}/manifest").first()
        tokenfiles.ShardReader(f"{root}/{m.file}", b"another")
    total = spark.read.parquet(f"{root}/manifest").agg(F.sum("n_ids")).first()[0]
    assert total == at and tokenfiles.SHARDS_PER_RUN > 1
    monkeypatch.setattr(tokenfiles, "SHARDS_PER_RUN", 2)
    again = new_path(spark, "t")
    tokenfiles.write_shards(docs.withColumns({"shard": F.lit(1), "tie": F.lit(2), "raw": F.lit(3)}), tokenizer_path(), again, docs_per_shard=7)
    assert sorted(map(tuple, tokenfiles.read_digest(spark, again).collect()), key=str) == sorted(map(tuple, got), key=str)
    empty = new_path(spark, "t")
    tokenfiles.write_shards(docs.limit(0), tokenizer_path(), empty)
    assert tokenfiles.read_digest(spark, empty).count() == 0


def morse(k, other=False):
    """Words of two letters that have one value under any polynomial hash modulo 2 ** 64 once they are long enough."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if other else word


def test_encoder_is_the_plain_call():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    letters = "ab cd E.é×\n'<|>12ß_日 \t"
    texts = [morse(11), morse(11, True), f"q {morse(5)} x", f"q {morse(5, True)} x", f"q {morse(6)} x", f"q {morse(6, True)}b", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>", "<|endoftext|", "", " ", "it's", "é×÷ ß"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [f"{'x' * n} {'y' * n}" for n in (7, 8, 9, 15, 16, 17, 62, 63, 64, 65, 66, 200)] + ["word " * 30_000 + "end"]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokenfiles.ByteLevelEncoder(tokenizer_path())
    assert [x.tolist() for x in encoder.encode(texts)] == want  # all are new
    assert [x.tolist() for x in encoder.encode(texts)] == want  # all are known


def test_encoder_survives_equal_hashes(monkeypatch):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(tokenfiles, "span_hashes", lambda data, starts, ends: [(ends - starts).astype(np.uint64)])
    texts = ["one two six", "ten ant bee", "plain letters", "other letters", "one two six"]
    encoder = tokenfiles.ByteLevelEncoder(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_unlike_words_are_no_copies(spark):
    docs = spark.createDataFrame([(1, morse(11)), (2, morse(11, True)), (3, f"a b c d {morse(7)}"), (4, f"a b c d {morse(7, True)}"), (5, morse(11).upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_groups_of_several_blocks_lose_no_link(spark, monkeypatch):
    """Families of like texts that share bands with others: each centre's members make many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    rng = random.Random(12)
    common = [f"c{i}" for i in range(90)]
    texts = []
    for f in range(14):
        own = common + [f"f{f}x{i}" for i in range(30)]
        for _ in range(rng.choice([1, 2, 12])):
            w = own.copy()
            for _ in range(rng.choice([0, 1, 3])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[5]), (0, texts[5]), (3, None)], "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for i, j in [*links, (0, 5)]:
        lo, hi = sorted((find(i), find(j)))
        parent[hi] = lo
    got = minhash.near_duplicates(docs).collect()
    assert all(r.component_id == find(r.doc_id) for r in got) and len({find(i) for i in parent}) > 3
    assert sorted(r.doc_id for r in got if r.kept) == sorted({find(i) for i in parent})
    left = minhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted({find(i) for i in parent})


def test_items_of_any_length_are_found(spark):
    rng = random.Random(15)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(n - 2)).strip() for n in [*range(5, 28)] * 3] + ["ab", "日本", "q"]
    items = [decontamination.normalised(t).decode() for t in items]
    docs = []
    for t in items:
        edited = t[: len(t) // 2] + "z" + t[len(t) // 2 + 1 :]
        docs += [t, f"x{t}x", f"some words {t.upper()}! more", f"some {edited} more", edited, f"some {t[:-1]} more", f"y {t[1:]}"]
    docs.append("long text " * 20_000 + f" {items[30]} end")

    def edits(item, text):
        row = [0] * (len(text) + 1)
        for k, c in enumerate(item, 1):
            new = [k]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(frame, bench).collect()}
    want = {}
    for j, t in enumerate(items):
        raw = decontamination.normalised(t)
        for i, d in enumerate(docs[:-1]):
            text = decontamination.normalised(d)
            if 0 < len(raw) < decontamination.Q:
                if b" " + raw + b" " in b" " + text + b" ":
                    want[i, j] = 0
            elif raw and (e := edits(raw, text)) <= int(len(raw) * decontamination.EDITS):
                want[i, j] = e
    assert {k: v for k, v in got.items() if k[0] < len(docs) - 1} == want
    assert got[len(docs) - 1, 30] == 0 and any(v == 1 for v in want.values())


def test_many_items_with_one_phrase_are_searched_in_parts(monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 500)
    phrase = "a phrase that all of the items begin with "
    items = [(i, f"{phrase}{i:04d} end {i * 7919 % 10007} of item") for i in range(200)]
    (index,) = decontamination.indexes(items)
    data = np.frombuffer(b" " + decontamination.normalised(phrase * 3 + items[77][1]) + b" \n", np.uint8)
    assert decontamination._found(index, data, np.array([0, len(data)]))[0, 77] == 0
    assert sum(len(w) for w, *_ in index.hits(data)) > 10_000 and max(len(w) for w, *_ in index.hits(data)) < 1000


def test_slices_and_steps_change_no_result(monkeypatch):
    """Texts longer than a slice, and more shared q-grams than are counted at once; repetitive texts and items among
    them. The edits are those of a whole alignment."""
    rng = random.Random(8)
    phrase = "ba" * 15
    items = [(k, text) for k, text in enumerate(["ha " * 20, phrase, " ".join(rng.choice(["ab", "ba", "abc"]) for _ in range(25)), "the quick brown fox jumps over the lazy dog and runs away"])]
    texts = ["ha " * 150, "ab" * 200, "x " * 50 + "ha " * 9 + "hu " + "ha " * 12 + "y " * 60, " ".join(rng.choice(["ab", "ba", "abc", "fox"]) for _ in range(150)), "so the quick brown fax jumps over the lazy dog and runs away now " * 3]
    texts += [f"ab ba {items[2][1]} end", f"ba {items[3][1]} ha " + "ha " * 30]

    def edits(item, text):
        """Least edits between the item and any part of the text."""
        row = [0] * (len(text) + 1)
        for k, c in enumerate(item, 1):
            old, row = row, [k]
            for j, x in enumerate(text):
                row.append(min(old[j] + (x != c), old[j + 1] + 1, row[j] + 1))
        return min(row)

    reduced = [b" " + decontamination.normalised(t) + b" " for t in texts]
    data = np.frombuffer(b"\n".join(reduced) + b"\n", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in reduced])])
    want = {}
    for t, text in enumerate(reduced):
        for i, item in items:
            own = edits(decontamination.pattern(item), text)
            if own <= decontamination.edits_of(decontamination.pattern(item)):
                want[t, i] = own
    assert len(want) >= 6
    for chunk, hits, region in ((1 << 20, 1 << 19, 1 << 16), (64, 1 << 19, 40), (100, 7, 1 << 16), (17, 50, 1)):
        monkeypatch.setattr(decontamination, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(decontamination, "HITS", hits)
        monkeypatch.setattr(decontamination, "REGION", region)
        got = {}
        for index in decontamination.indexes(items):
            got |= {(t, index.ids[i]): e for (t, i), e in decontamination._found(index, data, offsets).items()}
        assert got == want


def test_a_long_repetitive_text_takes_bounded_memory():
    import tracemalloc

    (index,) = decontamination.indexes([(1, "ha" * 60)])
    peaks = []
    for size in (50_000, 400_000):
        data = np.frombuffer(b" " + b"ha" * (size // 2) + b"hu \n", np.uint8)
        tracemalloc.start()
        assert decontamination._found(index, data, np.array([0, len(data)])) == {(0, 0): 0}
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (32 << 20) and peaks[1] < 300 << 20


def test_drop_contaminated_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "the whole item text is here now", 5), (2, None, 6), (3, "", 7), (None, "clean text", 8), (4, "clean", 9), (4, "clean", 9)], "doc_id long, text string, hit long").withColumn("_hit", F.lit(1))
    bench = spark.createDataFrame([(1, "whole item text is here"), (2, None), (3, "!!")], "item_id long, text string")
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.hit) for r in left.collect()) == [(0, 8), (2, 6), (3, 7), (4, 9), (4, 9)]
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 6 and decontamination.drop_contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    items = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(12, 40))) for _ in range(25)]
    rows = []
    for i, t in enumerate(items):
        noise = " ".join(rng.choice(items).split()[:3] * 30)
        edited = list(t)
        for _ in range(len(t) // 30):
            edited[rng.randrange(len(edited))] = "q"
        rows += [(4 * i, f"{noise} {t.upper()}! {noise}"), (4 * i + 1, "".join(edited)), (4 * i + 2, noise), (4 * i + 3, t[: len(t) // 2])]
    rows += [(1000, None), (1001, ""), (None, items[0]), (0, "clean")]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "ab"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5))

    def edits(item, text):
        row = [0] * (len(text) + 1)
        for k, c in enumerate(item, 1):
            new = [k]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(docs, bench).collect()}
    reduced = [decontamination.normalised(t) for t in items]
    for doc_id, text in rows[:40]:
        for j in range(0, 10):
            own = edits(reduced[j], decontamination.normalised(text))
            assert got.get((doc_id, j)) == (own if own <= int(len(reduced[j]) * decontamination.EDITS) else None), (doc_id, j, own)
    assert (None, 0) in got and not {i for i, _ in got} & {1000, 1001}
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()}.isdisjoint({i for i, _ in got})
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_text_statistics_match_brute_force(spark):
    docs = corpus(spark).union(spark.createDataFrame([(500, "a b c d e f g h i " * 3 + "\nline one\nline one\n \n\nLINE #1 $%& |<>!", "en", "s", 1)], SCHEMA))
    want = []
    for r in docs.collect():
        text = r.text or ""
        w = re.findall(WORD, text)
        spans = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, s in enumerate(spans) if spans.count(s) > 1 for j in range(8)} if len(spans) < 3000 else set(range(len(w)))
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality_rules.apply_rules(docs, [])
    found = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()]
    assert sorted(found) == sorted(want)
    assert got.where("kept = base_failed").count() == 0
    kept = quality_rules.keep_good(docs, [])
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality_rules.apply_rules(docs.limit(0), []).count() == 0


def test_decision_list_learns_planted_rules(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = [f"word{rng.randrange(500)}" for _ in range(60)]
        bad = i % 3 == 0
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality_rules.learn_from_labels(docs, spark.createDataFrame(labels[:450], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, rules).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(450, 600))
    assert quality_rules.learn_from_labels(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []


def test_decision_list_grows_and_prunes_conjunctions(spark):
    """Bad is what is shouted and full of signs; either alone is good. The first condition is the best of all."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        words = [f"word{rng.randrange(500)}" for _ in range(60)]
        loud, signs = rng.random() < 0.4, rng.random() < 0.4
        words = [w.upper() if loud else w for w in words]
        words = [w + "##" if signs and rng.random() < 0.8 else w for w in words]
        rows.append((i, " ".join(words), loud and signs))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean")
    labels = docs.where("doc_id < 600").selectExpr("doc_id", "if(bad, 0, 1) as quality", "0 as toxic")
    rules = quality_rules.learn_from_labels(docs, labels)
    assert any(len(r.conditions) >= 2 for r in rules)
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, rules).collect()}
    assert sum(got[i] != bad for i, _, bad in rows[600:]) >= 298
    stats = quality_rules.text_statistics(docs.where("doc_id < 600").select(F.col("doc_id").alias("key"), "text", "bad"))
    values = quality_rules.features()
    grow = stats.where(F.pmod(F.xxhash64("key"), F.lit(3)) > 0).select("bad", *[c.alias(n) for n, c in values.items()]).collect()
    all_bad = sum(r.bad for r in grow)

    def gain(test):
        bad, good = sum(r.bad for r in grow if test(r)), sum(not r.bad for r in grow if test(r))
        return quality_rules._gain(good, bad, len(grow) - all_bad, all_bad) if bad >= quality_rules.LEAST_CAUGHT else -1.0

    first = rules[0].conditions[0]
    best = max(gain(lambda r: (r[n] > x) == above) for n in values for x in {r[n] for r in grow} for above in (True, False))
    assert gain(lambda r: (r[first.feature] > first.threshold) == first.above) >= 0.9 * best


def test_hilbert_curve_and_shards(spark):
    cells = spark.range(512).selectExpr("cast(id % 8 as int) a", "cast(id div 8 % 8 as int) b", "cast(id div 64 as int) c")
    path = cells.withColumn("h", hilbert.hilbert_index(["a", "b", "c"], 3)).orderBy("h").collect()
    assert [r.h for r in path] == list(range(512))
    assert all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in itertools.pairwise(path))
    docs = corpus(spark)
    got = hilbert.hilbert_shards(docs, part_rows=5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    counts = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert all(p.curve <= q.curve for p, q in itertools.pairwise(order))
    assert sorted(r.shard for r in hilbert.hilbert_shards(docs.limit(3)).collect()) == [0, 1, 2]
    assert hilbert.hilbert_shards(docs.limit(0)).count() == 0


def test_poisson_replication(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then null when id % 3 = 1 then 'big' else 'b' end as source", "'x' as mix_n")
    mixed = mixing.replicate(docs, {None: 1.0, "big": 2.0, "b": 1.0}, size=2.0, extras=True)
    assert mixed.columns == [*docs.columns, "copy_no", "mix_key"]
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n[None] - 3000) < 220 and abs(n["big"] - 6000) < 310 and abs(n["b"] - 3000) < 220
    assert mixing.replicate(docs, {"big": 1.0}).where("source is null or source = 'b'").count() == 0
    large = spark.createDataFrame([(i, "s") for i in range(40)], "doc_id long, source string")
    assert abs(mixing.replicate(large, size=100.0).count() - 4000) < 260
    assert mixing.replicate(docs.limit(0)).count() == 0
    assert mixing.replicate(corpus(spark)).columns == corpus(spark).columns


def test_html_blocks():
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>M</ul></nav><div class="ad">A</div><main><article><header><h1>Head &amp; shoulders</h1></header><p><b>One\n  two<br>three<p>Four<script>var a="</p>";</script><aside>S</aside><form>F</form><!-- c --><div id="comments"><p>C</div></article></main><div class="cookie-notice">N</div><footer>F</footer>'
    main = lambda page: [b for b in html_suffix.blocks_of(page) if b[1] != html_suffix.CHROME]
    assert main(page) == [("Head & shoulders", 1), ("One two three", 1), ("Four", 1)]
    assert [t for t, k in html_suffix.blocks_of(page) if k == html_suffix.CHROME] == ["H", "M", "A", "S", "F", "C", "N", "F"]
    assert html_suffix.blocks_of('<p>a <span class="ad">b<br>c</span> d</p><p hidden>e</p>') == [("a d", 0), ("b c", 3)]
    assert html_suffix.blocks_of(None) == [] and html_suffix.blocks_of("<p>a &lt;b&gt; c<div>d") == [("a <b> c", 0), ("d", 0)]
    assert html_suffix.blocks_of("plain < text") == [("plain < text", 0)]
    page = '<article>Intro<section id="related-work">R</section><h2 id="comments">C</h2><div class="social-history">S</div><div class="share-buttons">X</div><div class="top-ad">X</div><p class="notice">X</p><ul id="comments"><li>X</ul></article><div class="foo-ad-x">X</div>'
    assert main(page) == [("Intro", 1), ("R", 2), ("C", 1), ("S", 2)]
    long = "<article>" + "<p>word &amp; word</p>" * 40_000 + "</article>"
    assert html_suffix.blocks_of(long) == [("word & word", 1)] * 40_000


def _random_page(rng, article):
    """(html, main text): an article of random blocks, with chrome around and inside it, or bare blocks."""
    word = lambda: rng.choice(["plain", "word", "été", "x1", "a-b", "C.", "日本"]) + str(rng.randrange(10**6))
    words = lambda n: [word() for _ in range(n)]
    want, body = [], []
    space = lambda: rng.choice([" ", "\n", "  \t", " \r\n "])

    def marked_up(ws):
        out = []
        for w in ws:
            kind = rng.randrange(9)
            out.append({0: f"<b>{w}</b>", 1: f'<a href="/x?a=1&b=>">{w}</a>', 2: f"<!-- gone <p> -->{w}", 3: f"{w}<script>var p = '<p>gone</p>';</script>"}.get(kind, w.replace("a", "&#97;") if kind == 4 else w))
        return space().join(out)

    chrome = lambda: rng.choice(['<aside>{}</aside>', '<div class="ad">{}</div>', "<form><p>{}</p><input value='x'></form>", '<div id="comments"><p>{}</p><ul><li>{}</ul></div>', "<nav><ul><li>{}<li>{}</ul></nav>", '<p class="notice">{}</p>', '<section class="newsletter-signup"><h3>{}</h3></section>', "<style>p{{}}</style>", '<footer>{}</footer>', '<div hidden>{}</div>']).format(*words(2))
    for _ in range(rng.randrange(1, 9)):
        kind = rng.randrange(6)
        if kind < 3:
            ws = words(rng.randrange(1, 12))
            body.append(f"<p>{marked_up(ws)}" + rng.choice(["</p>", ""]))
            want.append(" ".join(ws))
        elif kind == 3:
            ws = words(3)
            body.append(f"<h2>{marked_up(ws)}</h2>")
            want.append(" ".join(ws))
        elif kind == 4:
            items = [words(2) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li>{marked_up(i)}" for i in items) + "</ul>")
            want += [" ".join(i) for i in items]
        else:
            cells = [words(1) for _ in range(4)]
            body.append("<table><tr>" + "".join(f"<td>{marked_up(c)}" for c in cells) + "</table>")
            want += [" ".join(c) for c in cells]
        if rng.random() < 0.4:
            body.append(chrome())
    inner = "".join(body)
    around = [f"<header><h1>{word()}</h1></header>", chrome(), f"<footer>{word()}</footer>"]
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{around[0]}{around[1]}" + (f"<article>{inner}</article>" if article else f"<div>{inner}</div>") + f"{around[2]}</body></html>", "\n\n".join(want)


def test_extraction_of_random_pages(spark):
    rng = random.Random(31)
    made = [_random_page(rng, k % 3 > 0) for k in range(400)]
    pages = spark.createDataFrame([(k, f"http://h{k % 9}.org/{k}", h) for k, (h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_suffix.extract_text(pages).collect()}
    wrong = [(k, made[k], got[k]) for k in range(400) if got[k] != made[k][1]]
    assert not wrong, wrong[0]


def test_suffix_array_finds_what_recurs():
    rng = random.Random(2)
    for _ in range(30):
        pages = [[rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(5)]
        words = np.array([w for p in pages for w in p], np.uint64)
        page = np.repeat(np.arange(5), [len(p) for p in pages])
        got = html_suffix.repeated_words(words, page, page, run=4, pages=3)
        want = []
        seen = {}
        streams = [[-1, *p] for p in pages if p]
        for k, s in enumerate(streams):
            for i in range(len(s) - 3):
                seen.setdefault(tuple(s[i : i + 4]), set()).add(k)
        for s in streams:
            mark = [False] * len(s)
            for i in range(len(s) - 3):
                if len(seen[tuple(s[i : i + 4])]) >= 3:
                    mark[i : i + 4] = [True] * 4
            want += mark[1:]
        assert got.tolist() == want


def test_pages_without_marked_content_lose_their_boilerplate(spark):
    rng = random.Random(4)
    story = lambda k: " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(30))
    own = [story(k) for k in range(12)]
    rows = [(k, f"http://a.org/{k}", f"<div>Welcome to the one site for all news of today</div><p>{own[k]}</p><div>All rights are reserved by the owners of this site</div>") for k in range(12)]
    rows += [(20, None, None), (21, "http://b.org", ""), (None, "bad url", "<p>x</p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_suffix.extract_text(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert all(texts[k] == own[k] for k in range(1, 12)) and texts[20] == texts[21] == "" and texts[None] == "x"
    assert html_suffix.extract_text(pages.limit(0)).count() == 0


def test_doubtful_parts_of_articles_stay_unless_they_recur(spark):
    rng = random.Random(6)
    story = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    advert = "order two of these now and get a third one free"
    quote = "a saying that all of the writers of this site like to quote"
    rows, want = [], {}
    for k in range(20):
        own, part = story(20), story(9)
        rows.append((k, f"http://a.org/{k}", f'<nav>menu</nav><article><p>{own}</p><p>{quote}</p><div class="sponsored-word">{advert}</div><section id="related-work">{part}</section></article><div>{quote}</div>'))
        want[k] = f"{own}\n\n{quote}\n\n{part}"
    rows.append((50, "http://b.org/1", f'<article><p>one</p><div class="sponsored-word">{advert}</div></article>'))
    want[50] = f"one\n\n{advert}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size, runs in ((4, 10**6), (256, 10**6), (4, 0), (256, 0)):
        got = html_suffix.extract_text(pages, group_pages=size, broadcast_runs=runs).collect()
        assert {r.page_id: r.text for r in got} == want
        assert sum(r.n_removed_tokens for r in got) == 20 * (1 + len(advert.split()) + len(quote.split()))  # 1: the menu's word


def test_names_inside_content_propose_and_recurrence_decides(spark):
    """Sections named navigation, reviews and menu, a paragraph of class comment, one-off and recurring parts: what recurs
    on the host goes, the rest stays; with the method switched off the recurring parts stay. Strong names go either way."""
    rng = random.Random(9)
    story = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    box = "sign our guest book and tell all of your friends about it"
    rows, want, off = [], {}, {}
    for k in range(12):
        own = [story(12) for _ in range(6)]
        head, nav, reviews, menu, comment, once = own
        html = (
            f'<article><h1 id="overview">{head}</h1><section id="navigation"><h2>Navigation</h2><p>{nav}</p></section><section id="reviews">{reviews}</section>'
            f'<div class="menu">{menu}</div><p class="comment">{comment}</p><div class="widget">{once}</div><div class="social" id="s1">{box}</div>'
            f'<div class="advert">buy {story(8)}</div><ul class="comments"><li>{story(9)}</li></ul></article><div id="menu">{story(5)}</div>'
        )
        rows.append((k, f"http://a.org/{k}", html))
        want[k] = "\n\n".join([head, "Navigation", nav, reviews, menu, comment, once])
        off[k] = want[k] + "\n\n" + box
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_suffix.extract_text(pages).collect()} == want
    assert {r.page_id: r.text for r in html_suffix.extract_text(pages, least_pages=10**6).collect()} == off


def test_recurrence_is_counted_over_the_whole_host(spark):
    rng = random.Random(5)
    footer, rare = "this footer is on many of the pages here", "this other line is on too few pages here"
    rows, want = [], {}
    for k in range(1000):
        own = " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(12))
        rows.append((k, f"http://a.org/{k}", f"<p>{own}</p>" + f"<div>{footer}</div>" * (k < 50) + f"<div>{rare}</div>" * (k >= 951)))
        want[k] = own + ("\n\n" + rare) * (k >= 951)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (64, 256, 2000):
        got = html_suffix.extract_text(pages, group_pages=size).collect()
        assert {r.page_id: r.text for r in got} == want and sum(r.n_removed_tokens for r in got) == 50 * 9


def test_repeated_rows_are_one_page(spark):
    line = "a line of more than six words that one page alone has"
    rows = [(1, "http://a.org/1", f"<p>{line}</p>")] * 4  # one row, repeated
    rows += [(2, "http://a.org/2", f"<p>{word} {line} two</p>") for word in ("new", "newer", "newest")]  # one page, changed
    rows += [(k, f"http://b.org/{k}", "<p>these pages are copies of each other under several names</p>") for k in range(5)]
    rows += [(k, f"http://c.org/{k}", f"<p>own{k}</p><p>a footer that three other pages of this host share</p>") for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_suffix.extract_text(pages).collect()
    plain = lambda h: h.replace("</p><p>", "\n\n").replace("<p>", "").replace("</p>", "")
    want = [(u, plain(h) if "c.org" not in u else f"own{k}") for k, u, h in rows]
    assert sorted((r.url, r.text) for r in got) == sorted(want)


def test_sketch_drops_no_more_than_one_pair_in_ten_million():
    least, p = minhash._least_matches(75, 128), 0.75
    lost = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(least))
    assert least == 69 and lost < 1e-7


def test_hilbert_shards_prune_by_each_dimension_and_split_copies(spark):
    rng = random.Random(3)
    rows = [(k, f"site{rng.randrange(16):02d}", f"l{rng.randrange(8)}", "x" * rng.randrange(2000)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumns({"row": F.lit(1), "curve": F.lit(2), "part": F.lit(3), "size": F.lit("clash")})
    got = hilbert.hilbert_shards(docs, shards=64).select("doc_id", "size", "shard").join(docs.drop("size"), "doc_id")
    bounds = got.groupBy("shard").agg(F.min("source").alias("s0"), F.max("source").alias("s1"), F.min("lang").alias("l0"), F.max("lang").alias("l1"), F.min("size").alias("z0"), F.max("size").alias("z1")).collect()
    touched = [sum(b.s0 <= "site03" <= b.s1 for b in bounds), sum(b.l0 <= "l2" <= b.l1 for b in bounds), sum(b.z0 <= 300 <= b.z1 for b in bounds)]
    assert len(bounds) == 64 and all(t <= 36 for t in touched), touched
    both = sum(b.s0 <= "site03" <= b.s1 and b.l0 <= "l2" <= b.l1 and b.z0 <= 300 <= b.z1 for b in bounds)
    assert both <= 6, both
    one = spark.createDataFrame([(7, "s", "l", "same")] * 300, "doc_id long, source string, lang string, text string")
    placed = hilbert.hilbert_shards(one, part_rows=10).collect()
    assert sorted((r.shard, r.slot) for r in placed) == [(k, j) for k in range(8) for j in range(38 if k < 4 else 37)]


def test_hilbert_dimensions_are_whole_strings(spark):
    rows = [(k, f"https://www.example.org/{k % 4}" if k % 5 else None, "en", "same text") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = {r.doc_id: r.curve for r in hilbert.hilbert_shards(docs).collect()}
    cells = {(k % 4 if k % 5 else None): {got[j] for j in range(200) if rows[j][1] == rows[k][1]} for k in range(200)}
    assert all(len(c) == 1 for c in cells.values()) and len(set.union(*cells.values())) == 5


def test_classes_of_many_rows_and_broadcasts_off(spark, monkeypatch):
    """Copies that are a third of all rows, blank texts another; with classes broadcast and with their rows dealt out."""
    rng = random.Random(12)
    own = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(20)) for _ in range(20)]
    rows = [(k, own[0] if k % 3 == 0 else " \n" if k % 3 == 1 else own[k % 20]) for k in range(150)] + [(3, "twice"), (None, own[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    least = {}
    for k, t in rows:
        if k is not None and t.strip() and t != "twice":
            least[t] = min(k, least.get(t, k))
    want = sorted((k, least[t] if t.strip() else k) for k, t in rows if k not in (None, 3))
    for most in (10**6, 0):
        monkeypatch.setattr(minhash, "BROADCAST_IDS", most)
        got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect() if r.doc_id not in (None, 3))
        assert got == want
