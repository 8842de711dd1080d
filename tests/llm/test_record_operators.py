import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from semspark.llm import empirical_bayes, quality_rules, texthash, toolchat, urlfilter


def test_url_filter_by_day(spark):
    entries = spark.createDataFrame(
        [("block", "domain", "bad.org", "add", "2024-01-10"), ("block", "domain", "bad.org", "remove", "2024-02-10"), ("block", "domain", "bad.org", "add", "2024-03-10"),
         ("allow", "prefix", "www.bad.org/ok", "add", "2024-01-01"), ("block", "host", "a.com", "add", "2024-01-01"), ("block", "host", "a.com", "add", "2024-01-05"), ("allow", "host", "a.com", "add", "2024-01-03"), (None, "host", "x", "add", "2024-01-01")],
        "action string, kind string, value string, op string, day string")
    rows = [("http://www.bad.org/x", "2024-01-09", False), ("http://www.bad.org/x", "2024-01-10", True), ("https://u@WWW.Bad.org:80/x?q", "2024-02-09", True), ("http://bad.org", "2024-02-10", False),
            ("http://bad.org/", "2024-12-31", True), ("http://www.bad.org/ok/page", "2024-01-20", False), ("http://notbad.org/", "2024-01-20", False), ("http://a.com/", "2024-01-04", True),
            (None, "2024-01-20", False), ("http://bad.org", None, False), ("no url", "2024-01-20", False), ("http://bad.org/", "2024-12-31", True)]
    captures = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, fetched string, want boolean").withColumn("blocked", F.lit("clash"))
    got = urlfilter.filter_urls(captures, entries).collect()
    assert len(got) == len(rows) and all(r.blocked == r.want for r in got), [r for r in got if r.blocked != r.want]
    salted = urlfilter.filter_urls(captures, entries, broadcast_rows=0).collect()
    assert sorted(map(tuple, salted), key=str) == sorted(map(tuple, got), key=str)
    assert urlfilter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.filter_urls(captures.limit(0), entries).count() == 0


TOOLS = {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "c1", 0, "f", '{"b": "x\\"<", "a": 1}', None), (1, "c2", 1, "f", '{"a": "1"}', ["c1"]), (1, "c3", 2, "g", "{}", ["c2", "c1", "gone", None]), (1, "c3", 3, "f", "{}", None), (1, "c4", 4, "f", "{", None),
         (1, "c5", 5, "h", "{}", None), (1, "c6", 6, "f", '{"a": 2, "z": 1}', []), (1, "c7", 7, "f", "{}", None), (2, "p", 0, "g", "{}", ["q"]), (2, "q", 1, "g", "{}", ["p"]), (2, "r", 2, "g", "{}", ["q"]), (None, "c", 0, "g", "{}", None), (3, None, 0, "g", "{}", None)],
        "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "c1", 1, "é\n"), (1, "c1", 2, "later"), (1, "c3", 9, None), (4, "lost", 0, "x"), (2, "p", 3, "y")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolchat.link_tool_calls(calls, results, TOOLS).collect()}
    assert {k: (r.status, r.error, r.level, r.position) for k, r in got.items()} == {
        (1, "c1"): ("ok", None, 0, 1), (1, "c2"): ("invalid", "type:a", 1, 6), (1, "c3"): ("ok", None, 2, 7), (1, "c4"): ("invalid", "not_an_object", 0, 2), (1, "c5"): ("invalid", "unknown_tool", 0, 3),
        (1, "c6"): ("invalid", "unknown:z", 0, 4), (1, "c7"): ("invalid", "missing:a", 0, 5), (2, "p"): ("cycle", None, None, None), (2, "q"): ("cycle", None, None, None), (2, "r"): ("cycle", None, None, None), (4, "lost"): ("orphan_result", None, None, None)}
    assert got[1, "c1"].message == '{"arguments":{"a":1,"b":"x\\"<"},"id":"c1","result":"é\\n","tool":"f"}'
    assert json.loads(got[1, "c4"].message)["arguments"] == "{"
    assert toolchat.link_tool_calls(calls.limit(0), results.limit(0), TOOLS).count() == 0


def test_nested_arguments_and_allowed_values(spark):
    tools = {"f": {"where": ("object", True, {"city": ("string", True), "at": ("object", False, {"x": ("number", True)})}), "unit": ("string", False, ["C", "F"]), "n": ("integer", False, [1, 2])}}
    want = {
        '{"where": {"city": "a"}}': None, '{"where": {"city": "a", "at": {"x": 1.5}}, "unit": "F", "n": 2}': None, '{"where": {}}': "missing:where.city", '{"where": {"city": 1}}': "type:where.city",
        '{"where": {"city": "a", "at": {"x": "1"}}}': "type:where.at.x", '{"where": {"city": "a", "b": 1, "c": 1}}': "unknown:where.b", '{"where": "a"}': "type:where", '{"where": {"city": "a"}, "unit": "K"}': "value:unit",
        '{"where": {"city": "a"}, "n": 3}': "value:n", '{"unit": "K"}': "missing:where", '{"where": {"city": "a", "at": {}}}': "missing:where.at.x", '{"where": null}': "type:where"}
    calls = spark.createDataFrame([(1, f"c{k}", k, "f", a, None) for k, a in enumerate(want)], "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r.error for r in toolchat.link_tool_calls(calls, results, tools).collect()}
    assert [got[f"c{k}"] for k in range(len(want))] == list(want.values())


def _levels_one_by_one(needs):
    level = {}
    while True:
        ready = {c for c, n in needs.items() if c not in level and all(x in level for x in n if x in needs)}
        if not ready:
            return level
        level |= {c: max((level[x] + 1 for x in needs[c] if x in needs), default=0) for c in ready}


def test_levels_of_chains_and_branches(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(12):
        size = [41, 1, 30][conv % 3]
        needs = {}
        for k in range(size):
            below = [k - 1] if conv % 3 == 0 else [rng.randrange(max(0, k - 6), k) for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))] if k else []
            needs[f"k{k}"] = [f"k{n}" for n in below if n >= 0] + ["gone"] * (k % 5 == 0)
        if conv in (3, 5):
            needs["k4"] = ["k9", "k7"][: conv - 3 or 1]
        rows += [(conv, c, [*n, *n[:1]]) for c, n in needs.items()]
        want |= {(conv, c): v for c, v in _levels_one_by_one(needs).items()}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, needs array<string>").repartition(4)
    got = toolchat.topological_levels(calls).collect()
    assert len(got) == len(want) and {(r.conv_id, r.call_id): r.level for r in got} == want
    assert max(want.values()) >= 39 and len(want) < len(rows)


def test_positions_of_a_large_conversation(spark):
    calls = spark.range(3000).selectExpr("if(id < 2900, 1, id % 7) as conv_id", "concat('c', id * 7919 % 3000) as call_id", "id % 50 as turn", "cast(id % 4 as int) as level").repartition(6)
    rows = calls.collect()
    want = {}
    for conv in {r.conv_id for r in rows}:
        own = sorted((r.level, r.turn, r.call_id) for r in rows if r.conv_id == conv)
        want |= {(conv, c): k for k, (_, _, c) in enumerate(own, 1)}
    got = toolchat.positions(calls).collect()
    assert len(got) == len(rows) and {(r.conv_id, r.call_id): r.position for r in got} == want


def _posteriors(rows, evidence):
    """Host and path rates in plain Python: (doc_id -> host rate, path rate, p_bad)."""
    p = {r[0]: 1 / (1 + math.exp(-max(-30, min(30, evidence[r[0]])))) for r in rows}
    groups = lambda key: {k: [p[r[0]] for r in rows if key(r) == k] for k in {key(r) for r in rows}}

    def strength(found, parent):
        n = sum(len(v) for v in found.values())
        q = sum(len(v) * (sum(v) / len(v) - parent(k)) ** 2 for k, v in found.items())
        noise = sum(parent(k) * (1 - parent(k)) for k in found)
        tau2 = max(0.0, (q - noise) / n)
        spread = sum(len(v) * parent(k) * (1 - parent(k)) for k, v in found.items()) / n
        return min(1e6, max(1.0, spread / tau2 - 1)) if tau2 > 0 else 1e6

    rate = sum(p.values()) / len(p)
    hosts, paths = groups(lambda r: r[2]), groups(lambda r: (r[2], r[3]))
    k = strength(hosts, lambda h: rate)
    host_rate = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in hosts.items()}
    k = strength(paths, lambda hp: host_rate[hp[0]])
    path_rate = {hp: (sum(v) + k * host_rate[hp[0]]) / (len(v) + k) for hp, v in paths.items()}
    out = {}
    for r in rows:
        q = path_rate[r[2], r[3]]
        x = evidence[r[0]] + math.log(q / (1 - q)) - math.log(rate / (1 - rate))
        out[r[0]] = (host_rate[r[2]], q, 1 / (1 + math.exp(-x)))
    return out


def test_posteriors_match_plain_python_and_turn_verdicts(spark):
    """Hosts and paths come from urls; the model is given, so that the posteriors are known to the last place."""
    rng = random.Random(21)
    rows = []
    for i in range(1500):
        host = rng.choice(["spam.org"] * 4 + ["news.org"] * 12 + [None] + [f"tiny{rng.randrange(60)}.org"] * 3)
        path = rng.choice(["a", "b", "b", ""]) if host else None
        odds = {"spam.org": 0.85 if path == "b" else 0.5, "news.org": 0.02}.get(host, 0.15)
        words = ["foul"] * (rng.random() < odds) + ["doubt"] * (rng.random() < 0.5) + ["plain", "word"]
        rows.append((i, " ".join(words), host, path, host and f"https://{host.upper()}/{path}/{i}.html?x#y"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, p string, url string")
    sited = empirical_bayes.with_site(docs.drop("h", "p"))
    # A url without a path ends in its page's name; here the first part of such a path is the page itself.
    sited = sited.withColumn("path", F.when(F.col("path").endswith(".html"), "").otherwise(F.col("path")))
    got = {r.doc_id: (r.host, r.path) for r in sited.collect()}
    assert all(got[r[0]] == (r[2], r[3]) for r in rows)
    hashes = np.sort(np.concatenate([texthash.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0] for w in (b"foul", b"doubt")]))
    foul = texthash.word_hashes(np.frombuffer(b"foul", np.uint8), np.array([0, 4]))[0][0]
    n = len(hashes) + len(empirical_bayes.FIGURES)
    weights = np.array([-2.5, *(2.8 if h == foul else 1.7 for h in hashes), *[0.0] * len(empirical_bayes.FIGURES)])
    model = empirical_bayes.Model(hashes, np.zeros(n), np.ones(n), weights, 0.1)
    evidence = {r[0]: -2.5 + 2.8 * ("foul" in r[1]) + 1.7 * ("doubt" in r[1]) for r in rows}
    want = _posteriors(rows, evidence)
    result = empirical_bayes.classify(sited, None, "host", "path", model=model).collect()
    assert len(result) == len(rows)
    for r in result:
        host, path, p_bad = want[r.doc_id]
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9 and abs(r.p_bad - p_bad) < 1e-9
    site = {r[0]: r[2] for r in rows}
    turned = [r for r in result if r.kept != (r.evidence < 0.5)]
    assert sum(not r.kept and site[r.doc_id] == "spam.org" for r in turned) > 20 and any(r.kept for r in turned)
    whole = sum(r.evidence for r in result) / len(result)
    sizes = {h: sum(s == h for s in site.values()) for h in set(site.values())}
    for r in result:  # sparse hosts stay near the corpus's rate, whatever their few documents are
        if sizes[site[r.doc_id]] <= 2 and site[r.doc_id]:
            assert abs(r.host_rate - whole) < 0.12


def test_hierarchical_bayes(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        host = f"h{i % 6}"
        bad = rng.random() < (0.6 if host == "h0" else 0.1)
        words = [f"w{rng.randrange(80)}" for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["foul", "vile"])
        rows.append((i, " ".join(words), host, "en" if i % 2 else "de"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, None, None), (2001, "", "h1", "en"), (2002, "w1 foul", "rare", None), (0, rows[0][1], "h0", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("evidence", F.lit(1))
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    got = empirical_bayes.classify(docs, known).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] == (labels[i][2] == 0) for i in range(600, 900)) >= 297
    rate = {r.doc_id: r.host_rate for r in got}
    assert rate[6] > 2 * rate[1] and not kept[2002]
    assert empirical_bayes.classify(docs.limit(0), known).count() == 0
    assert empirical_bayes.classify(docs, known.limit(0)).count() == len(rows)


def test_word_beginnings_tell(spark):
    """Each bad document has compounds of one stem, no two alike, so only their beginnings tell."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(80)}" for _ in range(30)]
        if i % 5 == 0:
            words[3] = f"Rottenx{i}ung"
        rows.append((i, " ".join(words), "h", "de"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.kept for r in empirical_bayes.classify(docs, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == (i % 5 > 0) for i in range(400, 600))


def test_pipeline(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    rng = random.Random(9)
    text = lambda k: " ".join(f"t{k}v{rng.randrange(900)}" for _ in range(60))
    clean = [text(k) for k in range(30)]
    leak = text(99)
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(clean[:5])] + [(200, "too short"), (201, f"{text(50)} {leak} {text(51)}")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == list(range(30))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(30)) and len(out) > 10


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    rng = random.Random(10)
    text = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(60))
    leak, same = text(), text()
    long = " ".join(f"v{rng.randrange(50_000)}" for _ in range(40_000))
    rows = [(1, same), (2, same), (2, same), (2, text()), (None, text()), (None, same), (5, None), (6, ""), (7, long), (8, f"{text()} {leak}"), (9, text()), (9, None)]
    clash = ["_hit", "hit", "dropped_id", "kept_id", "qr_text", "qr_one", "n_words", "mix_n", "mix_key", "copy_no", "rep", "component", "tie", "row"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in clash})
    spark.createDataFrame([(1, leak), (None, same), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, None), (1, 1, 0), (1, None, 0), (None, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted((r.doc_id or 0 for r in df.collect()))
    quality, near, clean, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    for stage, want in ((quality, [0, 0, 1, 2, 2, 2, 7, 8, 9]), (near, [0, 0, 1, 5, 6, 7, 8, 9]), (clean, [0, 0, 1, 2, 2, 2, 5, 6, 7, 9, 9])):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and ids(out) == want, stage
        assert all(r[n] == n for r in out.collect() for n in clash)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    mixed = mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and set(ids(mixed)) <= {0, 1, 2, 5, 6, 7, 8, 9} and mix(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = tokens(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == sorted(i or 0 for i, _ in rows) and sum(r.n_tokens == 1 for r in out) == 3
    assert tokens(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_and_null_labels(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(["foul" if i % 3 == 0 and k == 4 else f"w{rng.randrange(60)}" for k in range(40)])) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in rows] + [(None, "foul w1", None, None)], "doc_id long, text string, source string, lang string")
    labels = [(i, int(i % 3 != 0), None) for i in range(240)]
    worse = spark.createDataFrame([*labels, *labels[:90], (1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = empirical_bayes.classify(docs, worse).collect()
    assert len(got) == 241 and all(r.kept == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None) and not [r for r in got if r.doc_id is None][0].kept
    assert empirical_bayes.fit(docs, worse).rate == empirical_bayes.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).rate
    assert quality_rules.learn_from_labels(docs, worse) == quality_rules.learn_from_labels(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
