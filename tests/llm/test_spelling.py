"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tickerpulse.llm import spelling


def brute_words(rows, least_length=5, least_count=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def groups(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("deepest", [3, 7, 40])
def test_groups_equal_brute_force(spark, deepest):
    rng = random.Random(deepest)
    words = set()
    while len(words) < 300:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(2, 9)))
        words.add(rng.choice([w, "x" * 6 + w, w + "yz" * 4, "pre" * 20 + w, w[::-1] + "end" * 17]))
    counted = {w: rng.choice([1, 2, 3, 4, 8, 16, 100]) for w in words if len(w) >= 4}
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert groups(spelling.variant_groups(df, deepest=deepest)) == brute_groups(counted)


def test_vocabulary_and_edge_cases(spark):
    rng = random.Random(3)
    letters = "abcdeéÀÿ×÷"
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60))) for i in range(200)]
    rows += [(7, None), (None, "Straße STRASSE straße Straße"), (8, ""), (9, "1234 ---"), (10, "Über " * 400), (10, "Über " * 400), (-11, "a" * 5000 + " " + "a" * 4999)] * 3
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n long")
    words = brute_words(rows)
    found = spelling.vocabulary(df, "doc_id", "text")
    assert {r["word"]: r["n"] for r in found.collect()} == words
    assert groups(spelling.variant_groups(found)) == brute_groups(words)


def test_spoilt_runs(spark):
    rows = [(i, "committee") for i in range(6000)]
    words = brute_words(rows)
    assert len(words) > 1  # some runs lost a letter
    found = spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r["word"]: r["n"] for r in found.collect()} == words


def test_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert groups(spelling.variant_groups(spelling.vocabulary(df, "doc_id", "text"))) == set()
