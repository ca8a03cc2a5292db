"""Context-tree scores against a plain recursion over the same counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickerpulse.llm import ctw

DEPTH = ctw.DEPTH


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def stream(text):
    return b" ".join(w.encode() for w in tokens(text)) + b"\n"


def brute(rows):
    """Counts per (context backwards, bits so far) and the recursion of the mixture, one byte after the other."""
    counts = {}
    for doc, text in rows:
        if held(doc):
            continue
        data = b"\n" * DEPTH + stream(text)
        for i in range(DEPTH, len(data)):
            for depth in range(DEPTH + 1):
                context = data[i - depth : i][::-1]
                for bit in range(8):
                    node = counts.setdefault((context, 1 << bit | data[i] >> (8 - bit)), [0, 0])
                    node[data[i] >> (7 - bit) & 1] += 1
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    longer = {}
    for context, node in counts:
        if context:
            longer.setdefault((context[:-1], node), []).append(context)
    mixed = {}
    for depth in range(DEPTH, -1, -1):
        for (context, node), (a, b) in counts.items():
            if len(context) == depth:
                own = estimate(a, b)
                rest = sum(mixed[c, node] for c in longer.get((context, node), []))
                mixed[context, node] = own if depth == DEPTH else float(np.logaddexp(own, rest)) - math.log(2)

    def chance(before, byte):
        total = 0.0
        for bit in range(8):
            node, one = 1 << bit | byte >> (8 - bit), byte >> (7 - bit) & 1
            p = None
            for depth in range(DEPTH, -1, -1):
                context = before[-depth:][::-1] if depth else b""
                if (context, node) not in counts:
                    continue
                a, b = counts[context, node]
                own = ((b if one else a) + 0.5) / (a + b + 1)
                weight = math.exp(estimate(a, b) - math.log(2) - mixed[context, node]) if depth < DEPTH else 1.0
                p = own if p is None else weight * own + (1 - weight) * p
            total += math.log10(0.5 if p is None else p)
        return total

    train = Counter()
    for doc, text in rows:
        if not held(doc):
            train.update([*tokens(text), None])
    n, v = sum(train.values()), len(train)
    out = []
    for doc, text in rows:
        data = b"\n" * DEPTH + stream(text)
        own = [*tokens(text), None]
        base = sum(math.log10((train[t] + 1) / (n + (v + 1))) for t in own)
        score = sum(chance(data[i - DEPTH : i], data[i]) for i in range(DEPTH, len(data)))
        out.append((doc, held(doc), len(own), sum(train[t] > 0 for t in own), n, base, score))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1.0, True) for d, t in rows], "doc_id long, text string, score double, held_out boolean")
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got = sorted((tuple(r) for r in ctw.scores(df, "doc_id", "text").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_equals_recursion(spark):
    rng = random.Random(5)
    words = ["the", "Then", "tent", "été", "a", "zebra", "THE", "x.", "naïve gap"]
    rows = [(i, rng.choice([" ", "  ", "\t\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t "), (None, "the the"), (3, "tent"), (3, "tent"), (-8, "a" * 3000), (60, "never seen before ☃")]
    check(spark, rows)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gam", "ma"]) for _ in range(20))) for i in range(60)]
    for name, value in (("BLOCK_BYTES", 200), ("FAN", 3), ("PART_TEXTS", 2)):
        monkeypatch.setattr(ctw, name, value)
    check(spark, rows)


def test_only_held_out_and_empty(spark):
    rows = [(i, "some text") for i in range(200) if held(i)]
    check(spark, rows)
    assert ctw.scores(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_estimates():
    a, b = np.array([0.0, 3, 1000, 5]), np.array([0.0, 0, 1, 7e6])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(a, b, strict=True)]
    assert ctw.log_estimate(a, b) == pytest.approx(want, rel=1e-9, abs=1e-9)
