"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The pieces and their scores come from a model file. A text gets a blank in front and every blank becomes the word
mark; the segmentation with the greatest sum of scores wins, on ties the one whose last pieces are longer. The
automaton reads a text once: at every position it stops at the longest piece that ends there and follows the output
links to the shorter ones, and each relaxes the best score up to that position. A character that no piece covers
costs ten more than the worst score and is written as its UTF-8 bytes.

No piece holds a word mark after another character (checked when the model is read), so the best segmentation of a
text is that of its words one after the other. Each worker keeps the words it has segmented.

NULL and empty texts have no ids. Decoding gives the text back, except that a word mark in the text comes back as a
blank, as in the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio

MARK = "▁"
_MARK_BYTES = MARK.encode()


class Pieces:
    """The pieces of a model file with their automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.byte_ids, raw, scores = np.full(256, -1), [], []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} runs over the end of a word")
                scores.append(model.get_score(i))
                self.automaton.add_word(piece, (len(piece), scores[-1], i))
                raw.append(piece.replace(MARK, " ").encode())
        self.automaton.make_automaton()
        self.unknown = min(scores) - 10.0
        self.raw_start = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose blanks are word marks."""
        best, back = [0.0], [(0, -1)]
        matches = self.automaton.iter(text)
        end, match = next(matches, (-1, None))
        for at in range(len(text)):
            score, link, single = -np.inf, (at, -1), False
            while end == at:
                length, value, piece = match
                single = single or length == 1
                value += best[at + 1 - length]
                if value > score:
                    score, link = value, (at + 1 - length, piece)
                end, match = next(matches, (-1, None))
            if not single and best[at] + self.unknown > score:
                score, link = best[at] + self.unknown, (at, -1)
            best.append(score)
            back.append(link)
        ids, at = [], len(text)
        while at:
            start, piece = back[at]
            ids.extend([piece] if piece >= 0 else [int(self.byte_ids[b]) for b in reversed(text[start:at].encode())])
            at = start
        return ids[::-1]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [self.segment(w.decode("utf8").replace(" ", MARK)) for w in words]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts one after the other, still with the blank in front, and where each begins."""
        length = np.diff(self.raw_start)[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.raw[np.repeat(self.raw_start[ids] - ends[:-1], length) + np.arange(ends[-1])], ends[offsets]


_LOADED: dict[str, tuple[Pieces, textio.UnitCache]] = {}  # lives as long as the Python worker


def _load(path: str) -> tuple[Pieces, textio.UnitCache]:
    if path not in _LOADED:
        pieces = Pieces(path)
        _LOADED[path] = pieces, textio.UnitCache(pieces.encode)
    return _LOADED[path]


def _marked(text: Column) -> Column:
    """A blank in front of a text that is not empty."""
    return F.when(F.octet_length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))


def encode_block(path: str, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts that begin with a blank, and where each text's ids begin (one entry more)."""
    _, cache = _load(path)
    blank = data == 32
    cut = np.zeros(len(data) + 1, bool)
    # A blank behind a blank begins no word, nor does one behind a word mark that stands in the text itself.
    behind = np.concatenate([[False], blank[:-1]])[: len(data)]
    behind[3:] |= (data[:-3] == _MARK_BYTES[0]) & (data[1:-2] == _MARK_BYTES[1]) & (data[2:-1] == _MARK_BYTES[2])
    cut[:-1] = blank & ~behind
    cut[starts[:-1][np.diff(starts) > 0]] = True
    cut[len(data)] = False
    begin = np.flatnonzero(cut)
    ids, offsets = cache(data, begin, np.concatenate([begin[1:], [len(data)]])[: len(begin)])
    return ids, offsets[np.searchsorted(begin, starts)]


def encode(df: DataFrame, text_col: str, model: str, out_col: str = "ids") -> DataFrame:
    """Adds the ids of every whole text as ``array<int>``."""
    fields = [f for f in df.schema.fields if f.name != out_col]
    source = df.select(*[F.col(f"`{f.name}`") for f in fields], _marked(F.col(text_col)))  # the last column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = textio.column_bytes(batch.column(len(fields)))
            for a, z in textio.blocks(starts):
                ids, at = encode_block(model, data[starts[a] : starts[z]], starts[a : z + 1] - starts[a])
                kept = [batch.column(i).slice(a, z - a) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, textio.lists(ids, at, pa.int32())], [*[f.name for f in fields], out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` array<int>"
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str, model: str, out_col: str = "text") -> DataFrame:
    """Adds the text that some ids stand for; NULL ids give an empty text."""
    fields = [f for f in df.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _load(model)
        for batch in batches:
            column = batch.column(ids_col)
            lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            data, at = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]))
            raw = data.tobytes()
            texts = [raw[a + 1 : b].decode("utf8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*[f.name for f in fields], out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` string"
    return df.mapInArrow(run, schema)


def digest(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """Encodes and decodes every text in one pass and returns what proves it: the id, n_pieces, ids_crc32 (CRC-32 of
    the ids as little-endian unsigned 32-bit integers), n_bytes (UTF-8 length of the decoded text), text_crc32 (of
    its bytes) and round_trip (the decoded text is the text, word marks taken as blanks)."""
    source = df.select(F.col(id_col).alias("doc_id"), _marked(F.col(text_col)).alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["n_pieces", "ids_crc32", "n_bytes", "text_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _load(model)
        mark = MARK.encode()
        for batch in batches:
            data, starts = textio.column_bytes(batch.column("text"))
            for a, z in textio.blocks(starts):
                own, place = data[starts[a] : starts[z]], starts[a : z + 1] - starts[a]
                ids, at = encode_block(model, own, place)
                text, ends = pieces.decode(ids, at)
                raw, given, coded = text.tobytes(), own.tobytes(), memoryview(ids.astype("<u4").tobytes())
                rows = []
                for i in range(z - a):
                    back = raw[ends[i] + 1 : ends[i + 1]]
                    same = back == given[place[i] + 1 : place[i + 1]].replace(mark, b" ")
                    rows.append((int(at[i + 1] - at[i]), zlib.crc32(coded[4 * at[i] : 4 * at[i + 1]]), len(back), zlib.crc32(back), same))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), *columns], ["doc_id", *names])
        pa.default_memory_pool().release_unused()  # workers live on

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, n_bytes long, text_crc32 long, round_trip boolean")
