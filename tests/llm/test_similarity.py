"""Near duplicates of texts, paragraphs and vectors against brute force; components; benchmark items."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerpulse.llm import components, decontam, ngram_join, paragraphs, textio, vecdedup
from tickerpulse.llm.minhash import bands_for
from tickerpulse.llm.ngram_join import verify
from tickerpulse.llm.stored import stored
from tickerpulse.llm.textio import WORD_PATTERN

WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(40, i) for i in range(60)] + [(None, 3), (5, None), (7, 7)],
        "random": [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(80)], "none": [],
    }[shape]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    df = spark.createDataFrame(edges, "node long, component long")
    assert {r["node"]: r["component"] for r in components.connected(df, "node", "component").collect()} == want


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 5)), max_size=20))
@settings(deadline=None)
def test_local_roots(pairs):
    links = np.zeros((8, 6), bool)
    for a, b in pairs:
        links[a, b] = True
    rows, columns = np.arange(20, 28), np.arange(30, 36)
    want = roots([*rows.tolist(), *columns.tolist()], [(20 + a, 30 + b) for a, b in pairs])
    r, c = components.local_roots(links, rows, columns)
    assert [*r.tolist(), *c.tolist()] == [want[x] for x in [*rows.tolist(), *columns.tolist()]]


@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=8), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
@settings(deadline=None)
def test_verify(sets, threshold):
    arrays = [np.array(sorted(s)) for s in sets]
    left, right = np.arange(len(sets) - 1), np.array([len(sets) - 1])
    want = [[len(sets[i] & sets[-1]) / len(sets[i] | sets[-1]) >= threshold] for i in left]
    assert verify(arrays, left, right, threshold, cells=20).tolist() == want


def grams(text):
    words = re.findall(WORD_PATTERN, (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_ngram_join(spark):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 120)) for _ in range(30)]
    texts += [None, "", " ... ", "three little words", "Three, little words!", "two words", " ".join(prose(rng, 20_000))]
    for base in texts[:6]:
        for _ in range(9):
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        texts += [base.upper(), base + "."] * 3
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "class_id long, rep string, grams string")
    sets = [grams(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    counts, groups = Counter(x for p in pairs for x in p), roots(range(len(sets)), pairs)
    # Blocks of few classes, so that groups are cut.
    rows = ngram_join.similar(df, "class_id", "rep", block=5).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"], r["kept"]) for r in rows} == {i: (counts[i], groups[i], groups[i] == i) for i in groups}
    assert {r["doc_id"]: r["copy_of"] for r in rows} == {i: min((j for j in groups if sets[j] == s), default=i) if s else i for i, s in enumerate(sets)}


def test_ngram_join_without_ids_or_rows(spark):
    text = "a text of some words that stands here more than once"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (None, "alone in the world with six words")], "id long, text string")
    rows = sorted(map(tuple, ngram_join.similar(df, "id", "text").drop("text_hash").collect()), key=str)
    assert rows == sorted([(None, 2, 2, 3, False), (4, 2, 2, 3, False), (4, 2, 2, 3, False), (2, 2, 2, 3, True), (None, None, None, 0, True)], key=str)
    assert ngram_join.similar(df.limit(0), "id", "text").count() == 0
    assert bands_for(0.8, 0.999, 4) == 14


def test_ngram_join_of_texts_under_one_id(spark):
    rng = random.Random(6)
    a, b = prose(rng, 120), " ".join(prose(rng, 120))
    near = " ".join(["new", *a[1:]])
    a = " ".join(a)
    nearer = a + " end"
    for first, second in ((a, b), (b, a)):
        df = spark.createDataFrame([(3, near), (5, first), (5, second), (9, b)], "id long, text string")
        rows = ngram_join.similar(df, "id", "text").join(df.select(F.xxhash64("text").alias("text_hash"), "text").distinct(), "text_hash")
        got = {(r["doc_id"], r["text"]): (r["class_id"], r["copy_of"], r["n_links"], r["kept"]) for r in rows.collect()}
        assert got == {(3, near): (3, 3, 1, True), (5, a): (3, 5, 1, False), (5, b): (5, 5, 1, True), (9, b): (5, 5, 1, False)}
    df = spark.createDataFrame([(3, a), (3, nearer), (4, near)], "id long, text string")
    rows = ngram_join.similar(df, "id", "text").collect()
    assert {(r["class_id"], r["n_links"]) for r in rows} == {(3, 2)} and sum(r["kept"] for r in rows) == 1


def shared_windows(texts, size):
    """Per document, the words that a run of ``size`` words of an earlier document covers."""
    words = {i: re.findall(WORD_PATTERN, (t or "").lower()) for i, t in texts.items()}
    first, out = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            key = tuple(words[i][k : k + size])
            if first.setdefault(key, i) != i:
                out.setdefault(i, set()).update(range(k, k + size))
    return out


def test_paragraphs(spark):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (51, 55, 60, 90, 200)]
    texts = {}
    for i in range(60):
        words = prose(rng, rng.randint(80, 300))
        if i % 3:
            at = rng.randrange(len(words))
            words[at:at] = passages[i % 5]
        for at in sorted(rng.sample(range(10, len(words)), 3), reverse=True):
            words[at] += "\n"
        texts[i] = " ".join(words)
    line = prose(rng, 80)
    for i in range(60, 66):  # a line with one changed word each
        own = list(line)
        own[rng.randrange(80)] = f"x{i}"
        texts[i] = " ".join(prose(rng, 30)) + "\n" + " ".join(own).upper() + "\n" + " ".join(prose(rng, 30))
    texts |= {70: None, 71: "", 72: "the " * 200, 73: "the " * 200, 74: "short line\n" * 30, 75: "short line\n" * 30}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, h string, keeper int")
    spans = paragraphs.removals(df, "doc_id", "h")
    rows = spans.collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
        assert all(k < r["doc_id"] for k in r["kept_in"])
    want = shared_windows({i: t for i, t in texts.items() if i < 60}, 50)
    assert {i for i in got if i < 60} == set(want)
    assert all(got[i] <= want[i] and len(got[i]) >= len(want[i]) - 37 for i in want)
    assert {i for i in got if i >= 60} == {61, 62, 63, 64, 65, 73} - ({73} - set(got))  # near lines; a long line of one word is a line
    assert all(got[i] >= set(range(30, 110)) for i in range(61, 66))
    left = {r["doc_id"]: r for r in paragraphs.without(df, spans, "doc_id", "h").collect()}
    assert {i: r["h"] for i, r in left.items() if i not in got} == {i: t for i, t in texts.items() if i not in got}
    for i in range(61, 66):
        before = texts[i].split("\n")
        assert left[i]["h"] == before[0] + "\n" + before[2]
    assert paragraphs.removals(df.limit(0), "doc_id", "h").count() == 0


def test_repeated_seeds(spark):
    rng = random.Random(28)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = [(i, " ".join(prose(rng, 50) + (shared[i % 4] if i % 3 else []) + prose(rng, 50))) for i in range(60)]
    texts += [(7, texts[8][1]), (9, texts[9][1]), (61, ""), (62, "few words")]  # ids that repeat; a text that repeats under its own id only
    rows = spark.createDataFrame(texts, "id long, text string").repartition(3)
    data = np.frombuffer("".join(t for _, t in texts).encode(), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])])
    text, at, hashes = paragraphs._seeds(textio.words(data, starts), 10, 13)
    places = {}
    for t, a, h in zip(text.tolist(), at.tolist(), hashes.view(np.int64).tolist(), strict=True):
        places.setdefault(h, []).append((texts[t][0], a))
    want = sorted((h, i, a) for h, found in places.items() if len({i for i, _ in found}) > 1 for i, a in found)
    assert want
    for most, share in ((50, 30), (1 << 19, 1 << 20)):
        found = stored(paragraphs.paragraphs(rows, 5, 10, 13, 2, most), "found")
        hits = paragraphs._shared_seeds(paragraphs._repeated_seeds(found, share))
        assert sorted((r["h"], r["id"], r["first_word"]) for r in hits.collect()) == want
        assert all(r["keeper"] == min(i for i, _ in places[r["h"]]) for r in hits.collect())
    assert paragraphs._repeated_seeds(stored(paragraphs.paragraphs(rows.limit(0), 5, 10, 13, 2), "found")).count() == 0


def test_short_lines_and_near_passages(spark):
    rng = random.Random(18)
    line, passage, refrain = prose(rng, 9), prose(rng, 100), [w for x in prose(rng, 30) for w in ("tra", "la", x)]
    texts, at = {}, {}
    for i in range(40):
        words, own = prose(rng, 60), list(passage)
        if i:  # two changed words about 33 apart
            k = rng.randrange(30, 36)
            own[k], own[2 * k] = f"x{i}", f"y{i}"
        if i % 2:  # over several short lines, else inside one
            own = [w + "\n" * (k % 11 == i % 11) for k, w in enumerate(own)]
        at[i] = rng.randrange(10, 50)
        texts[i] = " ".join(words[: at[i]] + own + words[at[i] :])
    texts |= {i: " ".join(prose(rng, 20) + ["\n", *line, "\n"] + prose(rng, 20)) for i in range(40, 44)}
    texts |= {i: " ".join(prose(rng, 20) + refrain + prose(rng, 20)) for i in range(44, 48)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["first_word"], r["n_words"], r["kept_in"][0]) for r in paragraphs.removals(df, "doc_id", "text").collect()}
    want = {i: (at[i], 100, 0) for i in range(1, 40)} | {i: (20, 9, 40) for i in range(41, 44)} | {i: (20, 90, 44) for i in range(45, 48)}
    assert got == want


def test_cut_keeps_the_rest():
    assert paragraphs._cut("one, two three.\nfour five\nsix", [{"first_word": 1, "n_words": 1}, {"first_word": 3, "n_words": 2}]) == "one,  three.\nsix"


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(40, 140):
        near = base[i % 7] + 0.04 * rng.standard_normal(16)
        rows.append((i, (near * 10.0 ** rng.integers(-3, 3)).tolist(), int(i % 7 % 3)))
    odd = [
        (200, None, 1), (201, [0.0] * 16, 1), (202, [None] + [1.0] * 15, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] + [1.0] * 15, 1),
        (205, base[0].tolist(), None), (None, base[0].tolist(), 0), (206, base[0].tolist()[:5], 0), (207, base[0].tolist()[:5], 0), (208, [], 0), (209, (base[0] * -1).tolist(), 0),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "id long, v array<double>, label int, strip int")
    usable = [r for r in rows + odd[7:9] + odd[10:]]
    links = []
    for x, (a, va, la) in enumerate(usable):
        for b, vb, lb in usable[:x]:
            if la == lb and len(va) == len(vb) and np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.98:
                links.append((a, b))
    counts, groups = Counter(x for p in links for x in p), roots([r[0] for r in rows + odd if r[0] is not None], links)
    got = {r["vec_id"]: tuple(r)[1:] for r in vecdedup.near_duplicates(df, "id", "v", "label", block=9).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (counts[i], g, g == i) for i, g in groups.items()} and len(links) > 100
    repeated = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r)[:3] for r in vecdedup.near_duplicates(repeated, "vec_id", "embedding", "label").collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert vecdedup.near_duplicates(df.limit(0), "id", "v", "label").count() == 0


@given(st.lists(st.integers(0, 5), max_size=15), st.lists(st.integers(0, 5), max_size=15))
@settings(deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontam.common_length(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_benchmark_items(spark):
    rng = random.Random(12)
    items = {i: prose(rng, rng.randint(15, 60)) for i in range(25)}
    docs, want = {}, set()
    for d in range(150):
        words = prose(rng, rng.randint(100, 400))
        if d % 3 == 0:
            item = d % 25
            own, at = list(items[item]), rng.randrange(len(words))
            if d % 2:  # a paraphrase: a quarter of the words is new, but not the last ones
                for k in rng.sample(range(len(own) - 5), len(own) // 4):
                    own[k] = rng.choice(WORDS)
            words[at:at] = own
            want.add((d, item))
        docs[d] = " ".join(words)
    docs |= {900: None, 901: "", 902: "..."}
    df = spark.createDataFrame([(d, t, 0.0) for d, t in docs.items()], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(i, " ".join(w).title()) for i, w in items.items()] + [(90, None), (91, ""), (92, "?")], "item_id long, text string")
    found = decontam.contaminated(df, bench, "doc_id", "text", "item_id", "text", block_items=10).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(r["lcs"] == 1 for r in found if r["doc_id"] % 2 == 0)
    again = df.unionByName(df.where("doc_id < 10"))
    assert decontam.contaminated(again, bench.unionByName(bench), "doc_id", "text", "item_id", "text").count() == len(want)
    assert decontam.contaminated(df.limit(0), bench, "doc_id", "text", "item_id", "text").count() == 0
    assert decontam.contaminated(df, bench.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_verbatim_items_are_all_found(spark):
    """Items of 1 to 30 words in long and short documents, ties and repeats among them, against a plain search."""
    rng = random.Random(12)
    items = [(n * 10 + k, " ".join(prose(rng, n))) for n in (1, 2, 4, 5, 6, 7, 8, 15, 30) for k in range(4)]
    items += [(900, items[20][1]), (901, None), (902, ""), (903, items[20][1] + " " + items[21][1])]
    docs = []
    for i, (_, text) in enumerate(items * 2):
        own = prose(rng, rng.choice([0, 3, 40, 200]))
        at = rng.randint(0, len(own))
        docs.append((i, " ".join([*own[:at], (text or "").upper(), *own[at:]])))
    docs += [(500, " ".join(prose(rng, 30000) + items[30][1].split())), (501, None), (None, items[30][1]), (0, docs[0][1])]
    found = decontam.contaminated(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"),
        "doc_id", "text", "item_id", "text",
    ).collect()
    pad = lambda t: f" {t.lower()} "
    want = {(d, i) for d, text in docs for i, item in items if text and item and pad(item) in pad(text)}
    assert want <= {(r["doc_id"], r["item_id"]) for r in found}
    full = {(r["doc_id"], r["item_id"]): r for r in found if r["lcs"] == 1.0 and r["cosine"] == 1.0}
    assert want <= set(full) and all(full[k]["answer"] for k in want)


def test_axes_and_counts_come_from_all_documents(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS[:40]) for _ in range(rng.randint(1, 60))) for _ in range(2400)]
    texts[:3] = ["?", "w0 W0 none", texts[3]]
    items = [(1, " ".join(WORDS[:9])), (2, " ".join(WORDS[5:14]))]
    seen, latent_axes = [], decontam.latent_axes
    monkeypatch.setattr(decontam, "latent_axes", lambda lists, of, idf, rank: seen.append((lists.count(), of, idf, latent_axes(lists, of, idf, rank))) or seen[-1][3])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text")
    (n_texts, of, idf, axes), = seen
    split = [[w for w in t.lower().split() if w != "?"] for t in texts]
    assert n_texts == len({tuple(w) if w else t for t, w in zip(texts, split, strict=True)})
    number = {w: int(of.numbers(textio.words(*textio.column_bytes(pa.array([w])))[2])[0]) for w in WORDS[:40]}
    counts = np.zeros(len(of.terms))
    for words in split:
        for t in {number.get(w, -1) for w in words} - {-1}:
            counts[t] += 1
    assert idf == pytest.approx(np.log((len(texts) + 1) / (counts + 1)) + 0.05, rel=1e-5)
    gram = np.zeros((len(of.terms),) * 2)  # the windows of all texts, copies once
    for words in {tuple(w) for w in split}:
        for a in range(0, len(words), decontam.STEP):
            found = [number[w] for w in words[a : a + 2 * decontam.STEP] if number.get(w, -1) >= 0]
            row = np.bincount(found, minlength=len(idf)) * idf
            gram += np.outer(row, row) / max((idf[found] ** 2).sum(), 1e-9)
    own = np.stack([np.bincount(of.numbers(w), minlength=len(of.terms)) * idf for w in of.words])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    both = gram / np.trace(gram) + own.T @ own / len(own)
    inside = axes.T @ both @ axes
    assert np.diag(inside) == pytest.approx(np.sort(np.linalg.eigvalsh(both))[::-1][: axes.shape[1]], abs=1e-4)


def test_candidate_windows_join(spark):
    t, i, b, e = np.array([0, 0, 0, 1, 0]), np.array([1, 1, 1, 1, 0]), np.array([0, 300, 16, 0, 0]), np.array([64, 332, 48, 32, 32])
    got = list(decontam._joined(t, i, b, e, np.array([0.7, 0.8, 0.9, 0.7, 0.7]), np.array([10, 10])))
    assert got == [(0, 0, 0, 32, 0.7), (0, 1, 0, 64, 0.9), (0, 1, 300, 332, 0.8), (1, 1, 0, 32, 0.7)]
