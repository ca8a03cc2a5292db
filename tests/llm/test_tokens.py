"""Token shards and pieces against the libraries and plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as contract
from tickerpulse.llm import pieces, textio, wavelet
from tickerpulse.llm.queries import BYTE_BPE, PIECE_MODEL
from tickerpulse.session import work_path

SF_DIR = "/root/testdata/sf0.001"
PARTS = ["a", "b ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "é", "日本", "\xa0", " ", "　", "'s", "12", "!?", "   ", "\x0b", "<|endoftext|>", "\x85"]


def bpe():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_pieces_of_the_pre_tokenizer_join_to_the_whole_text(texts):
    ids, at = wavelet.encode_block(BYTE_BPE, *textio.column_bytes(pa.array(texts)))
    tokenizer = bpe()
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(0, 70_000), max_size=300), st.data())
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(ids, data):
    ids = np.array(ids, np.int64)
    matrix = wavelet.WaveletMatrix.of(wavelet.WaveletMatrix.pack(ids), len(ids))
    assert matrix.decode().tolist() == ids.tolist() == matrix.access(np.arange(len(ids))).tolist()
    token = data.draw(st.sampled_from(ids.tolist())) if len(ids) else 5
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    assert matrix.count(token, low, high) == (ids[low:high] == token).sum()
    assert matrix.locate(token, low, high).tolist() == (low + np.flatnonzero(ids[low:high] == token)).tolist()
    assert matrix.count(10**6) == 0 and not len(matrix.locate(10**6))


def test_shards_hold_whole_documents(spark):
    rng = random.Random(2)
    texts = ["one two", None, "", "word " * 30_000, "one two"] + ["".join(rng.choices(PARTS, k=20)) for _ in range(60)]
    ids = [7, 3, None, 1, 7, *range(100, 160)]
    df = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, n_tokens long")
    path = work_path(spark, "shards")
    wavelet.write_shards(df, "doc_id", "text", path, BYTE_BPE, shard_bytes=400, shard_tokens=50)
    assert wavelet.shard_files(spark, path).count() > 3
    found = [tuple(r) for r in wavelet.read_documents(spark, path, with_ids=True).orderBy("start").collect()]
    tokenizer, start, want = bpe(), 0, []
    for doc_id, text in sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
        start += len(own)
    assert found == want
    token = want[-1][4][0]
    spots = {(r["doc_id"], r["at"]) for r in wavelet.lookup(spark, path, [token]).collect()}
    assert spots == {(w[0], i) for w in want for i, t in enumerate(w[4]) if t == token}


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_special_tokens_as_in_a_plain_call(texts):
    ids, at = wavelet.encode_block(BYTE_BPE, *textio.column_bytes(pa.array(texts)), special=True)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_writes_special_tokens_as_one_id(spark):
    path = work_path(spark, "special")
    rows = [(1, "one<|endoftext|>two"), (2, "three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = contract.queries()["op7_token_shards"](spark, path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in found] == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = work_path(spark, "shards")
    wavelet.write_shards(df, "doc_id", "text", path, BYTE_BPE)
    assert wavelet.read_documents(spark, path).count() == 0
    assert pieces.digest(df, "doc_id", "text", PIECE_MODEL).count() == 0


def test_token_query_on_the_table(spark):
    found = contract.queries()["op7_token_shards"](spark, SF_DIR).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    tokenizer, start = bpe(), 0
    for row, doc in zip(found, docs, strict=True):
        own = [*tokenizer.encode(doc["text"], add_special_tokens=False).ids, 0]
        assert tuple(row) == (doc["doc_id"], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECE_MODEL)


@pytest.fixture(scope="module")
def scores():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    usual = [i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    return {library.id_to_piece(i): (library.get_score(i), i) for i in usual}


def plain_segmentation(text, scores, unknown):
    """All pairs of begin and end, without an automaton."""
    best = [(0.0, [])] + [(-float("inf"), None)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in scores:
                score, i = scores[text[start:end]]
                if best[start][0] + score > best[end][0]:
                    best[end] = best[start][0] + score, [*best[start][1], i]
        if text[end - 1] not in scores and best[end - 1][0] + unknown > best[end][0]:
            best[end] = best[end - 1][0] + unknown, [*best[end - 1][1], text[end - 1]]
    return best[-1]


@pytest.mark.parametrize("text", ["▁ ", "a▁ b", "▁  ▁ a", " ▁", "▁", " ", "", "é ▁▁  b▁"])
def test_a_blank_behind_a_mark_begins_no_word(text):
    model = pieces._load(PIECE_MODEL)[0]
    data, starts = textio.column_bytes(pa.array([" " + text, " b"] if text else ["", " b"]))
    ids, at = pieces.encode_block(PIECE_MODEL, data, starts)
    assert ids[: at[1]].tolist() == model.segment(("▁" + text.replace(" ", "▁")) if text else "")
    assert ids[at[1] :].tolist() == model.segment("▁b")


@given(st.text(st.sampled_from("abcdehinorst éßñ▁\n.日\U0001f600"), max_size=24))
@settings(max_examples=150, deadline=None)
def test_segmentation_is_the_best(text):
    model, library_scores = pieces._load(PIECE_MODEL)[0], _all_scores()
    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    score, want = plain_segmentation(marked, library_scores, model.unknown)
    flat = [i for x in want for i in ([x] if isinstance(x, int) else [int(model.byte_ids[b]) for b in x.encode()])]
    assert model.segment(marked) == flat
    data, starts = textio.column_bytes(pa.array([" " + text if text else ""]))
    ids, at = pieces.encode_block(PIECE_MODEL, data, starts)
    got = sum({i: s for s, i in library_scores.values()}.get(i, 0) for i in ids.tolist())
    assert at.tolist() == [0, len(ids)] and (("\U0001f600" in text) or got == pytest.approx(score) or any(not isinstance(x, int) for x in want))
    raw, ends = model.decode(ids, at)
    assert raw.tobytes()[1:].decode() == text.replace("▁", " ")


_SCORES = {}


def _all_scores():
    if not _SCORES:
        library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
        for i in range(library.get_piece_size()):
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                _SCORES[library.id_to_piece(i)] = library.get_score(i), i
    return _SCORES


def test_piece_columns_and_round_trip(spark):
    texts = ["the cat  sat\n", None, "", " x", "é日本 \U0001f600", "the cat  sat\n", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "ids long, text string").withColumnRenamed("ids", "n_pieces")
    coded = pieces.encode(df, "text", PIECE_MODEL)
    back = pieces.decode(coded, "ids", PIECE_MODEL, "again").orderBy("n_pieces").collect()
    assert [r["again"] for r in back] == [t or "" for t in texts] and back[0]["ids"] == back[5]["ids"] and back[1]["ids"] == []
    rows = pieces.digest(df, "n_pieces", "text", PIECE_MODEL).orderBy("doc_id").collect()
    assert all(r["round_trip"] for r in rows)
    assert [r["text_crc32"] for r in rows] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [r["n_pieces"] for r in rows] == [len(b["ids"]) for b in back]
