import random
import zlib
from hashlib import sha256

import pytest

from tidemark.llm import common, trie

TURN = "conv_id long, turn long, role string, text string, depth int, a string, bytes int, part int"


def plain(rows, graft=None):
    """Node rows by the definition: every conversation rebuilt, every prefix listed."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = own
    if graft:
        every, most = graft
        made = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % most
            base = abs(c) // every * every * (1 if c > 0 else -1)
            made[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for path, ms in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(60), -1, -3, -5, -7, 10**15]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 12])):
            out.append((c, t, rng.choice(["user", "assistant", None]), "common" if t == 0 and c % 3 else rng.choice(["a", "b", "é", "", None])))
    out += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(4)]  # copies
    out += [(77, None, "user", "first"), (77, 4, "user", "tie b"), (77, 4, "user", "tie a"), (77, 4, "user", "tie a"), (None, 1, "user", "nowhere")]
    out += [(90, t, "user", f"t{t % 5}") for t in range(300)] + [(91, t, "user", f"t{t % 5}") for t in range(250)] + [(92, 0, "user", "x" * 300_000)]
    rng.shuffle(out)
    return [(*r, 1, "x", 2, 3) for r in out]


@pytest.mark.parametrize("graft", [None, (5, 9), (3, 2)])
def test_same_as_by_definition(spark, rows, graft):
    got = trie.trie(spark.createDataFrame(rows, TURN).repartition(3), graft).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows, graft)


def test_small_cells_blocks_and_crowded_nodes(spark, rows, monkeypatch):
    """Conversations cut into many ranges, ends hashed over many blocks, parents found by way of the crowded nodes."""
    monkeypatch.setattr(trie, "cells_for", lambda n: common.cells_for(n, per_cell=12, least=30))
    monkeypatch.setattr(trie, "LEAST_HOT", 4)
    got = trie.trie(spark.createDataFrame(rows, TURN).repartition(3), (5, 9)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows, (5, 9))


def test_empty_and_renamed(spark):
    none = spark.createDataFrame([], TURN)
    assert trie.trie(none, (5, 9)).collect() == [] and trie.trie(none).collect() == []
    renamed = spark.createDataFrame([(3, 1, "u", "hi")], "c int, n int, who string, said string")
    got = trie.trie(renamed, id_col="c", turn_col="n", role_col="who", text_col="said").collect()
    assert sorted(str(tuple(r)) for r in got) == plain([(3, 1, "u", "hi")])
