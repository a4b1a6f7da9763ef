from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from slimlake.llm import prefix_trie
from slimlake.llm.common import kept

SCHEMA = "conv_id long, turn long, role string, text string, length string, depth string, position string, at string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "l", "d", "p", "a") for r in rows], SCHEMA).repartition(3)


def sequences(rows):
    """Each conversation's turns in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in found.items()}


def shared(found):
    made = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made[c] = found.get(base, [])[:h] + own[h:]
    return made


def plain(found):
    """The nodes by looking every prefix up."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    rows = []
    for node, own in members.items():
        subtree = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(own) if len(found[c]) == len(node))
        rows.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]),
            sum(not children[m] for m in subtree),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in subtree if m),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def odd_rows():
    draw = random.Random(7)
    words = ["", "a", "b", "é漢", None, "long " * 400]
    rows = []
    for c in [*range(-6, 24), 1 << 40, (1 << 40) + 1]:
        for turn in range(draw.randrange(1, 12)):
            rows.append((c, draw.choice([turn, turn, turn, None]), draw.choice(["u", "u", None]), draw.choice(words[:3])))
    # Copies of one conversation, repeated rows, rows without a number or an id.
    for c in range(100, 140):
        rows += [(c, k, "u", f"copy {k}") for k in range(12)]
    rows += rows[:9] + [(None, 1, "u", "lost"), (200, None, None, None), (200, None, "x", words[5]), (201, 0, "u", "é漢")]
    return rows


@pytest.mark.parametrize("width,piece", [(32, 1 << 16), (3, 1 << 16), (2, 5), (1, 3), (32, 1)])
def test_nodes_of_rebuilt_conversations(spark, width, piece):
    rows = odd_rows()
    turns = kept(prefix_trie.rank_turns(conversations(spark, rows)), "turns")
    assert nodes(prefix_trie.trie(*prefix_trie.rebuild(turns), width, piece)) == plain(shared(sequences(rows)))


def test_a_very_long_conversation_is_many_short_rows(spark):
    rows = [(c, k, "u", f"{k}") for c in (1, 2, 3) for k in range(400)] + [(3, 400, "u", "more"), (4, 0, "u", "0")]
    rows[500] = (2, 100, "u", "different")
    turns = kept(prefix_trie.rank_turns(conversations(spark, rows)), "turns")
    got = prefix_trie.trie(*prefix_trie.whole(turns))
    want, found = {}, sequences(rows)
    for c, own in found.items():
        for d in range(len(own) + 1):
            want.setdefault(hash(tuple(own[:d])), [c, d, 0])[2] += 1
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in got.collect()) == sorted(map(tuple, want.values()))
    assert prefix_trie.sorted_bands(turns).selectExpr("max(length(key))").first()[0] == 33 * 16


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")]])
def test_no_conversations_no_nodes(spark, rows):
    turns = kept(prefix_trie.rank_turns(conversations(spark, rows)), "turns")
    assert nodes(prefix_trie.trie(*prefix_trie.rebuild(turns))) == []


def test_turnless_conversations_end_at_the_root(spark):
    # Conversations whose whole own part is cut off and whose family has no first one.
    alone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:30]
    rows = [(c, 0, "u", "x") for c in alone]
    turns = kept(prefix_trie.rank_turns(conversations(spark, rows)), "turns")
    got = nodes(prefix_trie.trie(*prefix_trie.rebuild(turns)))
    assert got == plain(shared(sequences(rows))) and got[0][:6] == (alone[0], 0, None, 30, 0, 1)


def test_range_minima_and_searches_against_loops():
    draw = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 64, 65):
        values = draw.integers(0, 4, n)
        table = prefix_trie.RangeMin(values)
        for _ in range(50):
            start, need = int(draw.integers(0, n + 1)), int(draw.integers(0, 5))
            low = start
            while low > 0 and values[low - 1] >= need:
                low -= 1
            high = start
            while high < n and values[high] >= need:
                high += 1
            at, wanted = np.array([start]), np.array([need])
            assert table.left_end(at, wanted)[0] == low and table.right_end(at, wanted)[0] == high
            if n:
                a, b = sorted(draw.integers(0, n, 2).tolist())
                assert table.least(np.array([a]), np.array([b]))[0] == values[a : b + 1].min()
