import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from semspark.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The nodes of the rebuilt conversations from (conv_id, turn, role, text), by a set of members for each prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, children = defaultdict(set), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[c] for c in children[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def nodes(df, **options):
    made = trie.prefix_trie(trie.rebuilt(trie.turn_sequences(df)), **options)
    assert made.columns == COLUMNS
    return sorted((tuple(r) for r in made.collect()), key=str)


def conversations(rng, n, long=()):
    """Few different turns, so that many beginnings are shared; copies, and conversations that begin others."""
    rows = []
    for c in rng.sample(range(n * 2), n):
        size = rng.choice([1, 2, 3, 5, 8]) if c not in long else 60
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "a", "bb", "", None, "ccc"])) for t in range(size)]
    for c in range(3000, 3030):
        rows += [(c, t, "user", "same") for t in range(4 + c % 2)]
    return rows


def test_trie_matches_brute_force(spark, monkeypatch):
    """In one range and in many; blocks of ids; null turns, roles and texts; repeated rows; hosts that are not there."""
    rng = random.Random(4)
    rows = conversations(rng, 150, long=(0, 100, 101, 102))
    rows += [(5000, None, "user", "first"), (5000, 0, "user", "next"), (5000, -3, None, None), (None, 1, "user", "nobody"), (-7, 0, "user", "a"), (777, 3, "user", "a")]
    rows += [(6000, 1, "user", "twice")] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "Key": F.lit("x")}).repartition(3)
    want = brute(rows)
    monkeypatch.setattr(trie, "BLOCK_IDS", 8)
    for turns in (1 << 20, 60, 7):
        assert nodes(df, turns=turns) == want
    assert nodes(df.limit(0)) == []


def test_conversations_without_turns_end_at_the_root(spark):
    """Conversation 301 has no host and fewer turns than are taken away: a member of the root alone."""
    c = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(df) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_points_are_branches_ends_and_leaves_only():
    """A path of a hundred turns that two sequences share is one edge."""
    turn = lambda k: k.to_bytes(16, "big")
    path = b"".join(turn(k) for k in range(100))
    rows = sorted([(path + turn(7), [1] * 101, 2, 4, "x"), (path + turn(9) * 5, [1] * 105, 1, 3, "y")])
    points = trie.compressed(rows, 0, 0, True)
    assert sorted((p.depth, p.n, p.conv, p.children, p.leaves) for p in points) == [(0, 3, 3, 1, 2), (100, 3, 3, 2, 2), (101, 2, 4, 0, 1), (105, 1, 3, 0, 1)]
    # A range that ends or begins inside the path has its nodes as points, to be added up.
    assert len(trie.compressed(rows[:1], 0, 100, True)) == 102
    assert [p.first for p in trie.compressed(rows[1:], 100, 0, False)] == [True] + [False] * 101
