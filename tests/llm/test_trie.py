import hashlib
import random
import re
import zlib
from collections import defaultdict

from stockwarden.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, one string"


def plain(rows):
    """The trie of (conv_id, turn, role, text) rows, node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **settings):
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), **settings)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot"]), " ".join(rng.choices("a b\tc", k=rng.randrange(3)))) for c in range(90) for t in range(rng.randrange(1, 6))]
    check(spark, rows)
    check(spark, rows, run=7)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "hello there"), (0, 1, "user", "hello there"), (0, None, None, None), (0, 1, "bot", "tie"), (1, 5, "user", ""), (1, None, "user", None),
        (None, 1, "user", "belongs to nothing"), (3, 0, "u", "x" * 50_000), (23, None, None, None), (45, 2, "user", "only one"), (46, 2, "user", "only one"),
        (41, 0, "ab", "c"), (42, 0, "a", "bc"), (63, 0, "u", "ß 日本\n語"), (64, 0, "u", None), (2**40, 3, "u", "far"),
    ]
    check(spark, rows)
    check(spark, [r for r in rows if r[0] is None])
    check(spark, [])


def test_one_sequence_for_most_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(5)] + [(c, t, "user", f"own {c} {t}") for c in range(400, 420) for t in range(4)]
    check(spark, rows, run=16)
