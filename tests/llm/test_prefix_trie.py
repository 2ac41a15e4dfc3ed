"""The trie of conversations against a trie made turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from portcullis.llm import prefix_trie
from portcullis.llm.common import Scratch

R = random.Random(13)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())} {role}{text}".encode()).hexdigest()


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            node = nodes.setdefault(tuple(convs[c][:d]), {"members": [], "ends": []})
            node["members"].append(c)
        node["ends"].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(nodes, key=len, reverse=True):
        n = nodes[p]
        below = [nodes[c] for c in children[p]]
        n["leaves"] = sum(c["leaves"] for c in below) if below else 1
        n["saved"] = sum(c["saved"] for c in below) + (len(n["members"]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (n["members"][0], len(p), nodes[p[:-1]]["members"][0] if p else -1, len(n["members"]), len(children[p]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest())
        for p, n in nodes.items()
    )


def mixed(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), digest(role, text), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return found


def rows_of(found):
    return sorted(tuple(-1 if x is None else x for x in (r[c] for c in COLUMNS)) for r in found.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_rebuilt_conversations(spark):
    rows = [(c, t, R.choice(["user", "assistant", None]), R.choice(["a", "bé", "", None, "long " * 9])) for c in range(120) if c % 17 for t in range(R.randint(1, 12))]
    rows += [(3, None, "user", "null turn"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 1, "user", "nobody's"), (7, 400, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = brute(mixed(rows))
    assert rows_of(prefix_trie.conversation_trie(df)) == expected
    clashing = df.withColumns({c: F.lit(1) for c in ("place", "digest", "depth", "px", "n_convs", "size")})
    assert rows_of(prefix_trie.conversation_trie(clashing)) == expected
    assert rows_of(prefix_trie.conversation_trie(df.limit(0))) == []


@pytest.mark.parametrize("block", [2, 4096])
def test_trie_of_long_and_nested_conversations(spark, monkeypatch, block):
    """Paths that hang on one another many deep, exact copies, conversations without turns, one very long."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    base = [("user", f"turn {i}") for i in range(40)]
    convs = {100: base[:9], 101: base[:9], 102: [], 103: [], 90: [("user", str(i % 3)) for i in range(700)]}
    for i in range(12):  # each leaves the one before it two turns further on
        convs[i + 1] = base[: 2 * i] + [("assistant", f"own {i} {k}") for k in range(i % 4)]
    for i in range(40):
        convs[1000 + i] = base[:1] + [("assistant", str(i % 7))]
    turns = [(c, i, digest(*t), len(t[1])) for c, own in convs.items() for i, t in enumerate(own)]
    found = prefix_trie.trie(spark.createDataFrame(turns, "conv_id long, place long, digest string, size long").repartition(3), spark.createDataFrame([(c,) for c in convs], "conv_id long"))
    assert rows_of(found) == brute(convs)


def test_places_of_a_conversation_that_goes_over_ranges(spark):
    rows = [(c, R.randrange(500), f"{R.random()}") for c in (1, 2, 2, 3, 4) for _ in range(600 if c == 2 else 30)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, digest string").repartition(7)
    for partitions in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            with_places = prefix_trie.numbered(df, "conv_id", ["turn", "digest"], Scratch(spark)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        places = defaultdict(list)
        for r in with_places:
            places[r.conv_id].append((r.turn, r.digest, r.place))
        assert all([x[2] for x in sorted(v)] == list(range(len(v))) for c, v in places.items() if c is not None) and len(with_places) == len(rows)
