"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

``fit`` counts byte n-grams of words per language over a sample of the labelled rows of documented size. The model
is a table of log-odds per hashed n-gram and language, of fixed size.

``label`` scores every word of a text by its n-grams. The script ranges of its letters leave the languages that use
one of these scripts in the training texts; a script that no language uses leaves all. Viterbi then labels all words
of a text: a word adds its score under a label, and a change of label costs ``penalty``. Words without a letter have
no score. Texts that are NULL or have no letter get ``und`` and score 0.

The predicted language is the label of most words with letters (ties: the first in alphabetical order), the score
their share. An empty training set predicts ``und`` everywhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio

UNDETERMINED = "und"
GRAMS = (1, 2, 3, 4)
# First code points of Unicode script ranges that hold letters. Each reaches to the next; 0 means none.
SCRIPT_STARTS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "greek"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"),
    (0x00F7, "none"), (0x00F8, "latin"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "none"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "none"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "none"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
    (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"),
    (0x2E00, "none"), (0x3041, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "none"), (0x31F0, "kana"), (0x3200, "none"),
    (0x3400, "han"), (0x4DC0, "none"), (0x4E00, "han"), (0xA000, "yi"), (0xA4D0, "none"), (0xA640, "cyrillic"), (0xA6A0, "none"),
    (0xA720, "latin"), (0xA800, "none"), (0xA960, "hangul"), (0xA980, "none"), (0xAC00, "hangul"), (0xD800, "none"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"), (0xFE70, "arabic"), (0xFF00, "none"),
    (0xFF21, "latin"), (0xFF3B, "none"), (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "none"),
    (0x20000, "han"), (0x323B0, "none"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS} - {"none"} | {"other"})


def _letter_ranges() -> tuple[np.ndarray, np.ndarray]:
    """First code points of ranges and their script number: letters are those of a Unicode category L, ``other`` those
    of none of the scripts above, -1 what is no letter."""
    codes = np.arange(0x40000)  # no letter lies above
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in codes.tolist()), bool, len(codes))
    named = np.array([SCRIPTS.index("other" if s == "none" else s) for _, s in SCRIPT_STARTS])
    number = np.where(letter, named[np.searchsorted([a for a, _ in SCRIPT_STARTS], codes, "right") - 1], -1)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return np.append(first, len(codes)), np.append(number[first], -1)


_STARTS, _NUMBER = _letter_ranges()
_ASCII = _NUMBER[np.searchsorted(_STARTS, np.arange(128), "right") - 1]


@dataclass
class Model:
    """Languages, log-odds per n-gram bucket and language, and which scripts each language uses."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of characters and their script number, -1 where the character is no letter."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    script = np.full(len(at), -1)
    if len(at):
        lead = data[at]
        small = lead < 128
        script[small] = _ASCII[lead[small]]
        wide = np.flatnonzero(~small)
        place, first = at[wide], lead[wide].astype(np.int64)
        byte = lambda k: (data[np.minimum(place + k, len(data) - 1)] & 0x3F).astype(np.int64)
        two = (first & 0x1F) << 6 | byte(1)
        three = (first & 0x0F) << 12 | byte(1) << 6 | byte(2)
        four = (first & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
        code = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
        script[wide] = _NUMBER[np.searchsorted(_STARTS, code, "right") - 1]
    return at, script


def word_grams(data: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Words with a letter in them: the bytes of each with a blank on both sides, cut into n-grams.

    Gives bucket and word of every n-gram, the text of every word, and a bit per script that its letters are of.
    """
    begin, end = textio.runs(textio.WORD_BYTES[data], starts[:-1])
    at, script = letters(data)
    bits = np.where(script >= 0, np.uint64(1) << script.clip(0).astype(np.uint64), np.uint64(0))
    before = np.searchsorted(at, begin)
    masks = np.bitwise_or.reduceat(np.append(bits, np.uint64(0)), np.append(before, len(bits)))[:-1] if len(begin) else bits[:0]
    has = masks != 0
    begin, end, masks = begin[has], end[has], masks[has]
    text = np.searchsorted(starts, begin, "right") - 1
    # Words one after the other, each with a blank on both sides.
    length = end - begin
    at = np.concatenate([[0], np.cumsum(length + 2)])
    word = np.repeat(np.arange(len(begin)), length + 2)
    inner = np.arange(at[-1]) - at[:-1][word] - 1
    flat = np.where((inner >= 0) & (inner < length[word]), data[np.clip(begin[word] + inner, 0, max(len(data) - 1, 0))] if len(data) else 0, 32)
    code, out, owner = np.zeros(len(flat), np.uint64), [], []
    for k in range(1, max(GRAMS) + 1):
        n = len(flat) - k + 1
        if n <= 0:
            break
        code = code[:n] * np.uint64(257) + flat[k - 1 :].astype(np.uint64) + np.uint64(1)
        whole = word[:n] == word[k - 1 :]
        if k in GRAMS:
            out.append(np.compress(whole, textio.mix(code) >> np.uint64(40)).astype(np.int64) % buckets)
            owner.append(np.compress(whole, word[:n]))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out) if out else empty), (np.concatenate(owner) if owner else empty), text, masks


def fit(df: DataFrame, text_col: str, lang_col: str, rows_per_lang: int = 2000, buckets: int = 1 << 16, seed: int = 7) -> Model:
    """Fit on about ``rows_per_lang`` different texts of each language, chosen by their hash; the driver gets a count
    per language and bucket. Rows without text or language teach nothing, copies of a text no more than one."""
    hashed = F.xxhash64(F.col(text_col), F.lit(seed)).alias("h")
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), hashed).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((0, len(SCRIPTS)), bool))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_lang / sizes[k]))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    some = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), buckets), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        number = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            data, starts = textio.column_bytes(pc.utf8_lower(batch.column("text")))
            lang = np.array([number[k] for k in batch.column("lang").to_pylist()], np.int64)
            for a, z in textio.blocks(starts, 1_000_000):
                grams, word, text, masks = word_grams(data[starts[a] : starts[z]], starts[a : z + 1] - starts[a], buckets)
                of = lang[a:z][text]
                np.add.at(sums.reshape(-1), of[word] * buckets + grams, 1)
                for s in range(len(SCRIPTS)):
                    scripts[:, s] += np.bincount(of[(masks >> np.uint64(s)) & np.uint64(1) == 1], minlength=len(languages))
        lang, bucket = np.nonzero(sums)
        own, script = np.nonzero(scripts)
        yield pa.record_batch(
            [
                pa.array(np.concatenate([lang, own]), pa.int32()), pa.array(np.concatenate([bucket, buckets + script]), pa.int32()),
                pa.array(np.concatenate([sums[lang, bucket], scripts[own, script]]), pa.int64()),
            ],
            ["lang", "bucket", "n"],
        )

    counts = some.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), buckets + len(SCRIPTS)))
    table[counts["lang"], counts["bucket"]] = counts["n"]
    grams, scripts = table[:, :buckets], table[:, buckets:]
    share = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * buckets))
    uses = scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(languages, (share - share.mean(0)).T.astype(np.float32), uses)


def word_scores(model: Model, grams: np.ndarray, word: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A score per word and language: the mean log-odds of its n-grams times the root of their number."""
    n = len(masks)
    total = np.empty((n, len(model.languages)), np.float32)
    count = np.bincount(word, minlength=n)
    for k in range(len(model.languages)):
        total[:, k] = np.bincount(word, model.weights[:, k][grams], minlength=n)
    total /= np.sqrt(np.maximum(count, 1))[:, None]
    distinct, back = np.unique(masks, return_inverse=True)
    scripts = (distinct[:, None] >> np.arange(len(SCRIPTS), dtype=np.uint64)) & np.uint64(1) == 1
    fits = (scripts[:, None, :] & model.uses[None]).any(2)
    fits[~fits.any(1)] = True
    return np.where(fits[back], total, -1e6)


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """The best label of every word. All texts advance together, word by word; the longest are the last to end."""
    count = np.bincount(text, minlength=n_texts)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    best = scores[np.minimum(first[order], len(scores) - 1)].copy()
    came, jumped = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
    lengths = count[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # texts that have a word t
    for t in range(1, lengths[0]):
        m = active[t]
        at = first[order[:m]] + t
        top = best[:m].argmax(1)
        other = best[np.arange(m), top][:, None] - penalty
        jump = other > best[:m]
        came[at], jumped[at] = top, jump
        best[:m] = np.where(jump, other, best[:m]) + scores[at]
    at_end = best.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        m = active[t]
        at = first[order[:m]] + t
        state = at_end[:m]
        label[at] = state
        if t:
            at_end[:m] = np.where(jumped[at, state], came[at], state)
    return label


def label(df: DataFrame, text_col: str, model: Model, penalty: float = 6.0, out: str = "language", spans: bool = True) -> DataFrame:
    """Adds a struct column: lang, score and, if asked for, spans, an array of (first_word, n_words, lang) over the words with letters."""
    fields = [f for f in df.schema.fields if f.name != out]
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x languages
    names = [f.name for f in fields]
    source = df.select(*[F.col(f"`{n}`") for n in names])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, starts = textio.column_bytes(batch.column(at))
            for a, z in textio.blocks(starts, 4_000_000):
                part = batch.slice(a, z - a)
                found = _label_block(model, *textio.column_bytes(pc.utf8_lower(part.column(at))), penalty, spans)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*names, out])
        pa.default_memory_pool().release_unused()  # workers live on

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    of_spans = ",spans:array<struct<first_word:int,n_words:int,lang:string>>" if spans else ""
    return source.mapInArrow(run, f"{schema}, `{out}` struct<lang:string,score:double{of_spans}>")


def _label_block(model: Model, data: np.ndarray, starts: np.ndarray, penalty: float, spans: bool) -> pa.StructArray:
    n, n_langs = len(starts) - 1, len(model.languages)
    names = pa.array([*model.languages, UNDETERMINED], pa.string())
    # N-grams take memory, so few texts at a time; Viterbi takes steps as long as the longest text, so many at a time.
    parts = []
    for a, z in textio.blocks(starts, 500_000):
        if n_langs:
            grams, word, text, masks = word_grams(data[starts[a] : starts[z]], starts[a : z + 1] - starts[a], len(model.weights))
            parts.append((word_scores(model, grams, word, masks), text + a))
    scores, text = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros((0, n_langs)), np.zeros(0, np.int64))
    chosen = viterbi(scores, text, n, penalty)
    votes = np.bincount(text * n_langs + chosen, minlength=n * n_langs).reshape(n, n_langs) if n_langs else np.zeros((n, 1), np.int64)
    total = votes.sum(1)
    winner = np.where(total > 0, votes.argmax(1), n_langs)
    columns = [names.take(pa.array(winner)), pa.array(votes.max(1) / np.maximum(total, 1), pa.float64())]
    if spans:
        first = np.cumsum(total) - total
        change = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
        size = np.diff(np.append(change, len(text)))
        inner = [pa.array(change - first[text[change]], pa.int32()), pa.array(size, pa.int32()), names.take(pa.array(chosen[change]))]
        ends = np.searchsorted(text[change], np.arange(n + 1)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(inner, ["first_word", "n_words", "lang"])))
    return pa.StructArray.from_arrays(columns, ["lang", "score", "spans"][: len(columns)])


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model may learn from; false for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
