"""The trie of conversation prefixes against a trie of dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from tickerpulse.llm import conversations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v, key=lambda t: t[:4])] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = set()
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in below if m)
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(k[: len(m)] == m and len(k) > len(m) for k in below) for m in below)
        ends = ",".join(str(c) for c in sorted(of) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(of), len(node), parent, len(of), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = conversations.prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    turns = ["", None, "a b", "c\td  e", "x", "long " * 2000]
    rows = []
    for conv in rng.sample(range(0, 200), 70):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "user", None, "assistant"]), rng.choice(turns)))
    rows += [(None, 0, "user", "nobody's"), (41, 0, "user", "a b"), (41, 0, "user", "a b")] + rows[:5]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_equal_conversations_and_one_long(spark):
    rows = [(c, t, "user", "same words") for c in range(20, 5000, 20) for t in range(2)]
    rows += [(7, t, "user", f"turn {t % 5}") for t in range(3000)] + [(3, t, "user", f"turn {t % 5}") for t in range(1500)]
    got = found(spark, rows)
    assert {(r[1], r[3]) for r in got if r[0] == 20} == {(d, 249) for d in (1, 2)}
    whole = {r for r in brute([r for r in rows if r[0] not in (3, 7)])}
    assert {r[-1] for r in whole} <= {r[-1] for r in got}
    assert len(got) == 1 + 2 + len({tuple(x) for x in _paths(rows)})


def _paths(rows):
    for conv, n in ((7, 3000), (3, 1500)):
        h = zlib.crc32(str(conv).encode()) % 4
        path = [f"turn {t % 5}" for t in range(n)][h:]
        for d in range(1, len(path) + 1):
            yield (hashlib.md5("|".join(path[:d]).encode()).hexdigest(),)


def test_conversations_without_turns(spark):
    """A conversation whose turns are all taken from an absent one keeps none: it ends at the root."""
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3]
    rows = [(c, 0, "user", "hello") for c in turnless]
    ends = hashlib.sha256(",".join(map(str, turnless)).encode()).hexdigest()
    assert found(spark, rows) == [(turnless[0], 0, None, len(turnless), 0, 1, 0, ends)]


def test_empty(spark):
    assert found(spark, []) == []
