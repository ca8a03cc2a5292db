"""Language, severity and page models; the pipeline's stages."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tickerpulse.llm import html_text, langid, textio, toxicity

SF_DIR = "/root/testdata/sf0.001"
EN = "the quick brown fox jumps over the lazy dog and runs into the old forest with all of her friends".split()
DE = "der schnelle braune fuchs springt über den faulen hund und läuft mit allen freunden in den alten wald".split()
RU = "быстрая коричневая лиса прыгает через ленивую собаку и бежит в старый лес со всеми своими друзьями".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, words, 40), lang) for i, (lang, words) in enumerate([("en", EN), ("de", DE), ("ru", RU)] * 40)]
    return langid.fit(spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None)], "id long, text string, lang string"), "text", "lang")


def test_spans_of_mixed_text(spark, languages):
    rng = random.Random(3)
    parts = [("en", sentence(rng, EN, 30)), ("de", sentence(rng, DE, 20)), ("ru", sentence(rng, RU, 8))]
    rows = [(0, ", 12 ".join(t for _, t in parts)), (1, None), (2, ""), (3, "12 ... !?"), (4, sentence(rng, RU, 5).upper()), (5, "日本語"), (6, sentence(rng, EN, 20_000)), (7, "ß"), (0, "the dog")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang long, text string, _lower string")
    found = langid.label(df, "text", languages).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {"lang", "text", "_lower", "language"}
    by = {(r["lang"], r["text"]): r["language"] for r in found}
    mixed = by[rows[0]]
    assert [s["lang"] for s in mixed["spans"]] == ["en", "de", "ru"] and mixed["lang"] == "en"
    assert [s["n_words"] for s in mixed["spans"]] == pytest.approx([30, 20, 8], abs=2)
    assert mixed["score"] == mixed["spans"][0]["n_words"] / 58
    for row in rows[1:4]:
        assert tuple(by[row])[:2] == ("und", 0.0) and by[row]["spans"] == []
    assert by[rows[4]]["lang"] == "ru" and by[rows[5]]["lang"] in ("en", "de", "ru") and tuple(by[rows[6]])[:2] == ("en", 1.0)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(0, 6, 4)
        scores = rng.standard_normal((lengths.sum(), 3)) * 3
        text = np.repeat(np.arange(4), lengths)
        got = langid.viterbi(scores, text, 4, 2.0)
        for t in range(4):
            own = scores[text == t]
            paths = np.stack(np.meshgrid(*[range(3)] * len(own), indexing="ij"), -1).reshape(-1, len(own)) if len(own) else np.zeros((1, 0), int)
            value = lambda p, own=own: own[np.arange(len(p)), p].sum() - 2.0 * (p[1:] != p[:-1]).sum()
            assert value(got[text == t]) == pytest.approx(max(map(value, paths)))


def test_letters_and_scripts():
    text = "aÉ1 ж日\U00020000ー.×"
    data, _ = textio.column_bytes(pa.array([text]))
    _, script = langid.letters(data)
    assert [langid.SCRIPTS[s] if s >= 0 else "" for s in script] == ["latin", "latin", "", "", "cyrillic", "han", "han", "kana", "", ""]


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "the dog", None)], "id long, text string, lang string")
    model = langid.fit(df, "text", "lang")
    assert langid.label(df, "text", model).first()["language"]["lang"] == "und" and langid.label(df.limit(0), "text", model).count() == 0


def test_language_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in contract.queries()["op2_language"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if rows[d["doc_id"]]["held_out"]]
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)


def test_ordered_grades(spark):
    rng = random.Random(5)
    mild, harsh = ["silly", "bad"], ["awful", "vile"]
    plain = [f"p{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(1200):
        words, grade = [rng.choice(plain) for _ in range(rng.randint(5, 60))], rng.choice([0, 0, 0, 1, 2])
        for _ in range(2 if grade else 0):
            words.insert(rng.randrange(len(words)), rng.choice(mild if grade == 1 else harsh))
        texts.append((i, " ".join(words), 1))
        labels.append((i, grade))
    texts += [(5000, None, 1), (5001, "", 1), (5002, "Vile " * 20_000, 1), (None, "awful", 1), (0, "again vile", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, grade int")
    marks = spark.createDataFrame([*labels, (None, 1), (7000, None), (3, labels[3][1])], "doc_id long, severity int")
    model = toxicity.fit(df, marks, "doc_id", "text", "severity", rows_per_grade=200)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score(df, "doc_id", "text", model).collect()
    assert len(rows) == len(texts)
    right = sum(r["grade"] == g for r, (_, g) in zip(sorted((r for r in rows if r["doc_id"] is not None and 0 < r["doc_id"] < 1200), key=lambda r: r["doc_id"]), labels[1:], strict=True))
    assert right > 0.88 * 1199
    assert all(r["expected_severity"] == pytest.approx(sum(k * c for k, c in enumerate(r["chances"]))) and sum(r["chances"]) == pytest.approx(1) for r in rows)
    by = {r["doc_id"]: r["expected_severity"] for r in rows}
    assert by[5000] == by[5001] < by[5002]
    alone = toxicity.fit(df, marks.limit(0), "doc_id", "text", "severity")
    assert toxicity.score(df, "doc_id", "text", alone).agg({"expected_severity": "max"}).first()[0] == 0
    assert toxicity.score(df.limit(0), "doc_id", "text", model).count() == 0


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_text.Labeller(inputs=5, hidden=3)
    model.parameters = {k: v.astype(np.float64) for k, v in model.parameters.items()}
    x, lengths, y = rng.standard_normal((2, 4, 5)), np.array([4, 2]), rng.integers(0, 2, (2, 4))
    inside = np.arange(4)[None] < lengths[:, None]

    def loss():
        c = model.chances(x, lengths)
        return -np.where(inside, np.where(y, np.log(c), np.log(1 - c)), 0).sum() / inside.sum()

    grads = model.step(x, lengths, y)
    for name, grad in grads.items():
        for at in [np.unravel_index(k, grad.shape) for k in rng.integers(0, grad.size, 4)]:
            old, values = model.parameters[name][at], []
            for step in (1e-3, -1e-3):
                model.parameters[name][at] = old + step
                values.append(loss())
            model.parameters[name][at] = old
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.02, abs=2e-4)


def test_blocks_of_broken_markup():
    page = "<p>a &amp; b&nbsp;&nbsp;c<br>d<p>e<b>f<div>g</div><script>x<p></script><ul><li>h<li>i</ul><![if IE]>j<![endif]--><td>k"
    assert [b.text for b in html_text.page_blocks(page)] == ["a & b c d", "ef", "g", "h", "i", "j", "k"]
    assert html_text.page_blocks(None) == html_text.page_blocks("") == html_text.page_blocks("<style>p{}") == []
    assert [b.text for b in html_text.page_blocks("just < text &lt;")] == ["just < text <"]


PAGE = """<html><head><title>T</title></head><body><header class="top"><a href="/">Site</a></header><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav>
<div class="cookie">We use cookies.</div><div class="content"><h1>Some long title of this page</h1><p>First paragraph of the &eacute;tude   with
several words, and commas.</p><p>Second paragraph, which goes on for a while and ends here.</p><ul><li>A point of the list.</li></ul></div>
<aside class="sidebar"><h4>Related</h4><ul><li><a href=3>Other story</a></li></ul></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this article at all.</p></div></section>
<form class="newsletter"><label>Mail</label><button>Send</button></form><footer>Copyright 2024</footer></body></html>"""


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    model = html_text.fit(pages, "html")
    rows = pages.collect()
    texts = html_text.main_texts(model, [r["html"] for r in rows])
    want = ["\n".join(b.text for b, y in zip(f, html_text.semantic_labels(f), strict=True) if y) for f in (html_text.page_blocks(r["html"]) for r in rows)]
    assert sum(a == b for a, b in zip(texts, want, strict=True)) >= 0.96 * len(rows)
    found = html_text.main_texts(model, [PAGE])[0]
    assert "First paragraph of the étude with several words, and commas.\nSecond paragraph" in found
    assert not re.search("cookies|Home|Copyright|Related|agree|Mail", found)
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, PAGE, "c"), (2, "<p>" + "word " * 30_000, "d")], "page_id long, html string, _page string")
    got = html_text.extract(df, "html", model).collect()
    assert [r["text"] for r in got][:2] == ["", ""] and got[2]["text"] == found and got[0].asDict().keys() == {"page_id", "_page", "text"}
    assert html_text.extract(df.limit(0), "html", model).count() == 0
    assert len(html_text.main_texts(html_text.fit(df.limit(0), "html"), [PAGE])) == 1


def test_pipeline(spark):
    rows = contract.queries()["pipeline"](spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert 0 < len(rows) < len(docs) and all(r["round_trip"] for r in rows)
    assert len({r["text_crc32"] for r in rows}) == len(rows)


def test_stages_take_odd_rows(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(EN + DE) + str(rng.randint(0, 99)) for _ in range(3000))
    clean = [(i, " ".join(rng.choice(EN) + rng.choice("abcdefgh") for _ in range(90)), "en", "s", 1) for i in range(10, 30)]
    rows = [(1, long, "en", "s", 3), (1, long, "en", "s", 3), (2, long, None, "s", None), (None, long, "en", None, 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), *clean]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        kept = source
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.stored(stage(spark, kept, SF_DIR), name)
            if name != "pieces":
                assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
        assert ids == ([1, *range(10, 30)] if source is docs else [])


@pytest.mark.parametrize("text", ["\u1c5a\u1c5b", "\ua984\ua985", "\u1b05\u1b06", "\u1a00\u1a01", "\ua500\ua501", "\uaa00\uaa01", "\uaa80\uaa81", "\uabc0\uabc1", "\U00010400", "\U0001d400", "\u02b0"])
def test_letters_of_any_script_are_letters(spark, text):
    docs = spark.createDataFrame([("the cat and the hat", "en"), ("le chat et le chapeau", "fr")], "text string, lang string")
    model = langid.fit(docs, "text", "lang")
    found = langid.label(spark.createDataFrame([(text,), ("12 \u0663 \u093e --",)], "text string"), "text", model).select("text", "language").collect()
    assert [r["language"]["lang"] != "und" for r in found] == [True, False]
    assert found[0]["language"]["spans"] and not found[1]["language"]["spans"]


def test_copies_of_a_text_teach_once(spark):
    rows = [("hot text in one tongue", "aa")] * 5000 + [(f"mot {i} rare et bon", "bb") for i in range(50)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    once = langid.fit(docs.distinct(), "text", "lang")
    assert (langid.fit(docs, "text", "lang").weights == once.weights).all()
