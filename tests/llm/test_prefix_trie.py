"""The trie against a plain walk over all prefixes, at component bounds that force many cuts."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from stripweave.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string"


def plain_trie(built):
    members, children, sums, out = defaultdict(list), defaultdict(set), {}, []
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    for k in sorted(members, key=len, reverse=True):
        n, below = len(members[k]), children[k]
        own = (n - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = (sum(sums[x][0] for x in below) or 1, own + sum(sums[x][1] for x in below))
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(built[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, n, len(below), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def plain_rebuild(turns):
    own = defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, token), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + s[h:]
    return built


def check(spark, turns, max_nodes, parts=3):
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], SCHEMA).repartition(parts)
    nodes = P.build_trie(*P.rebuild(df), max_nodes)
    assert sorted((tuple(r) for r in nodes.collect()), key=lambda r: (r[1], r[0])) == plain_trie(plain_rebuild(turns))


def random_turns(seed, convs=60):
    rng = random.Random(seed)
    turns = []
    for c in range(convs):
        turns += [(c, t, rng.choice("ua"), f"text {rng.randrange(2)} é") for t in range(rng.randrange(1, 14))]
    turns += [(2**53 + 1, 0, "u", "text 0 é"), (2**63 - 6, None, None, None), (2**63 - 6, None, "u", ""), (-3, 1, "u", "x"), (-8, 1, "a", "y"), (None, 1, "u", "lost")]
    turns += [(501, 5, "u", "tie"), (501, 5, "u", "tie"), (501, 5, "a", "tie"), (502, 0, "u", "long " * 60_000), (503, 0, "u", "")]
    return turns


@pytest.mark.parametrize("max_nodes", [4096, 5])
def test_odd_conversations(spark, max_nodes):
    check(spark, random_turns(1), max_nodes)


def test_long_hot_conversation_and_copies(spark):
    """One conversation holds a third of all turns and spans ranges; another stands under many ids."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = [(10, t, "u", f"turn {t}") for t in range(250)] + [(11, t, "u", f"turn {t % 5}") for t in range(200)]
        turns += [(1000 + i, t, "u", f"turn {t}") for i in range(40) for t in range(6)] + [(2000 + i, 0, "s", "first") for i in range(60)]
        check(spark, turns, 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes = P.build_trie(*P.rebuild(df))
    assert nodes.collect() == [] and nodes.columns[-1] == "ends_sha256"


def test_component_totals_are_subtree_sums():
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 200):
        for shape in ("random", "path", "star"):
            parent = [-1] + [rng.randrange(i) if shape == "random" else i - 1 if shape == "path" else 0 for i in range(1, n)]
            values = [(rng.randrange(9), 1) for _ in range(n)]
            want = [list(v) for v in values]
            for i in range(n - 1, 0, -1):
                want[parent[i]] = [a + b for a, b in zip(want[parent[i]], want[i])]
            assert P._totals(parent, values) == want
