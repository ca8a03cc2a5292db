"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a query set, taken in blocks of ``block_items`` items. For each block, against all documents:

1. The terms are the words of its items. Every distinct text is kept as the numbers of its terms, with the number of
   documents that have it. How many documents hold a term is counted over all documents.
2. Passages are rows of TF-IDF weights over the terms: the items, and all windows of all documents, copies once. A
   randomised SVD runs over these rows where they lie: they are multiplied with a random matrix and back, the
   columns of the sum are made orthonormal, and the products with that basis give a small Gram matrix, whose
   eigenvectors turn the basis into the latent axes. The driver gets terms x rank sums, no passage.
3. Every window of every document (two widths, half overlapping) is mapped onto the axes. A window and an item whose
   latent cosine is at least ``cosine`` are a candidate.
4. A candidate is verified on its words: the longest common subsequence of the item and stretches of about its length
   around the window, as a share of the item. From ``copy`` on it is a copy. From ``paraphrase`` on it
   is one if the answer stands there too: the words of the ``answer`` column, else the last words of the item.
5. Beside that, every place where an item stands word for word is found by a hash of its first words and compared in full, so
   that no verbatim copy depends on a cosine. Its cosine, share and answer are 1, 1 and true.

One row per document and item found: doc_id, item_id, cosine, lcs (share of the item), first_word and n_words of the
stretch, answer (its words stand there). NULL and empty texts and items find nothing. Rows that repeat an id are one
document or item: the best match counts. Items of fewer than ``min_words`` words must stand there in full. All documents are
read twice per block of items, their term numbers three times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio
from tickerpulse.llm.stored import release, stored

STEP = 16  # words; windows are two and four steps wide
WIDTHS = (2, 4)
ANSWER_WORDS = 5
PROBE = 5  # words
BLOCK_WORDS = 80_000  # words whose windows are multiplied at a time
OFTEN = 64  # terms in most documents: half of all places in running text
LEAD, ONE = np.uint64(48), np.uint64(1)  # words are looked up by the first 16 bits of their hashes
SUM_ROWS = 256  # rows of a task's matrix that travel together


class Items:
    """A block of benchmark items with its terms."""

    def __init__(self, rows: list[tuple]):
        texts = pa.array([r[1] for r in rows], pa.string())
        data, starts = textio.column_bytes(texts)
        _, _, hashes, first = textio.words(data, starts)
        self.words = [hashes[a:z] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        answers = []
        for row, words in zip(rows, self.words, strict=True):
            own = words[-ANSWER_WORDS:]
            if row[2]:
                data, starts = textio.column_bytes(pa.array([row[2]], pa.string()))
                own = textio.words(data, starts)[2]
            answers.append(own)
        kept = [i for i, w in enumerate(self.words) if len(w)]
        self.ids = [rows[i][0] for i in kept]
        self.words, self.answers = [self.words[i] for i in kept], [answers[i] for i in kept]
        self.terms = np.unique(np.concatenate(self.words)) if kept else np.zeros(0, np.uint64)
        # Where the terms with the same first bits begin.
        self.leads = np.searchsorted(self.terms >> LEAD, np.arange(1 + (1 << 16), dtype=np.uint64)).astype(np.int32)
        # Where an item may begin: its first word, then a hash of its first words, by their number.
        self.begins = np.append(np.isin(self.terms, [w[0] for w in self.words]), False)
        lengths = np.minimum([len(w) for w in self.words], PROBE).astype(np.int64)
        self.probes = []
        for k in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == k)
            flat, at = np.concatenate([self.words[i][:k] for i in own]), np.arange(len(own)) * k
            hashes = textio.sequence_hashes(flat, at, at + k)
            order = np.argsort(hashes, kind="stable")
            self.probes.append((k, hashes[order], own[order]))

    def verbatim(self, hashes: np.ndarray, first: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and first word of every item that stands in a text word for word."""
        at = np.flatnonzero(self.begins[terms])
        text = np.searchsorted(first, at, "right") - 1
        for k, known, item in self.probes:
            inside = at + k <= first[1:][text]
            place, of = at[inside], text[inside]
            found = textio.sequence_hashes(hashes, place, place + k)
            low, high = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
            for j in np.flatnonzero(high > low).tolist():
                for i in item[low[j] : high[j]].tolist():
                    n = len(self.words[i])
                    if place[j] + n <= first[of[j] + 1] and (hashes[place[j] : place[j] + n] == self.words[i]).all():
                        yield int(of[j]), i, int(place[j])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for other words. Most of these begin like no term."""
        out, lead = np.full(len(hashes), -1), hashes >> LEAD
        at = np.flatnonzero(self.leads[lead + ONE] > self.leads[lead])
        place, end = self.leads[lead[at]], self.leads[lead[at] + ONE]
        while len(at):
            hit = self.terms[place] == hashes[at]
            out[at[hit]] = place[hit]
            left = np.flatnonzero(~hit & (place + 1 < end))
            at, place, end = at[left], place[left] + 1, end[left]
        return out


def _block_terms(items: Items, texts: pa.Array, block_bytes: int = 4_000_000) -> Iterator[tuple]:
    data, starts = textio.column_bytes(texts)
    for a, z in textio.blocks(starts, block_bytes):
        _, _, hashes, first = textio.words(data[starts[a] : starts[z]], starts[a : z + 1] - starts[a])
        yield a, z, hashes, first, items.numbers(hashes)


def _windows(first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Steps of every text: number of each text's first step, first word and text of every step."""
    n = -(-np.diff(first) // STEP)
    offsets = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    return offsets, first[:-1][text] + (np.arange(offsets[-1]) - offsets[text]) * STEP, text


def _often(idf: np.ndarray) -> np.ndarray:
    """The terms in most documents."""
    return np.argsort(idf, kind="stable")[:OFTEN]


def _often_counts(terms: np.ndarray, start: np.ndarray, often: np.ndarray, n_terms: int) -> tuple[Iterator[tuple], np.ndarray, np.ndarray]:
    """How many times each of the ``often`` terms stands in each step, for some steps at a time (first, last, counts); place and
    step of all other terms."""
    rank = np.full(n_terms + 1, -1)  # the last one for words that are no terms
    rank[often] = np.arange(len(often))
    ranks = rank[terms]
    step = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(terms))))
    known = np.flatnonzero(ranks >= 0)
    flat, of = step[known] * len(often) + ranks[known], step[known]

    def some() -> Iterator[tuple]:
        for low in range(0, len(start), 4096):
            high = min(low + 4096, len(start))
            a, z = np.searchsorted(of, [low, high])
            counts = np.bincount(flat[a:z] - low * len(often), minlength=(high - low) * len(often))
            yield low, high, counts.reshape(high - low, len(often)).astype(np.float32)

    others = np.flatnonzero((terms >= 0) & (ranks < 0))
    return some(), others, step[others]


def _step_sums(terms: np.ndarray, start: np.ndarray, matrix: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Per step, the sum of the matrix rows of its terms: those of the ``often`` terms as a product of matrices."""
    out = np.zeros((len(start), matrix.shape[1]), np.float32)
    counted, at, step = _often_counts(terms, start, often, len(matrix))
    for low, high, counts in counted:
        np.matmul(counts, matrix[often], out=out[low:high])
    if len(at):
        begin = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        for low in range(0, len(begin), 512):  # what a core holds close by
            high = min(low + 512, len(begin))
            stop = begin[high] if high < len(begin) else len(at)
            part = matrix[terms[at[begin[low] : stop]]]
            out[step[begin[low:high]]] += np.add.reduceat(part, begin[low:high] - begin[low], axis=0)
    return out


def _windows_of(sums: np.ndarray, offsets: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Every step summed with the ``width - 1`` steps behind it in its text."""
    out = sums.copy()
    last = offsets[1:][text]
    for k in range(1, width):
        inside = np.flatnonzero(np.arange(len(sums)) + k < last)
        out[inside] += sums[inside + k]
    return out


def term_lists(rows: DataFrame, items: Items) -> DataFrame:
    """(h, terms, n) of every distinct text: the term numbers of its words in order, the number of terms standing for other
    words, as the bytes of one array; and how many rows have the text."""
    shared = rows.sparkSession.sparkContext.broadcast(items)  # one block of items
    kind = _kind(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for a, z, _, first, terms in _block_terms(items, batch.column("text")):
                numbers = np.where(terms < 0, len(items.terms), terms).astype(kind)
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(first * kind.itemsize), pa.py_buffer(numbers)])
                yield pa.record_batch([batch.column("h").slice(a, z - a), lists.cast(pa.binary())], ["h", "terms"])

    found = rows.select("text", F.xxhash64("text").alias("h")).mapInArrow(run, "h long, terms binary")
    return found.groupBy("h").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n"))


def _kind(items: Items) -> np.dtype:
    return np.min_scalar_type(len(items.terms))


def _listed(items: Items, lists: pa.Array) -> Iterator[tuple]:
    """First and last list, first words (one more) and term numbers, -1 for other words, of blocks of whole lists."""
    data, starts = textio.column_bytes(lists)
    numbers, first = data.view(_kind(items)), starts // _kind(items).itemsize
    for a, z in textio.blocks(first, BLOCK_WORDS):
        terms = numbers[first[a] : first[z]].astype(np.int64)
        yield a, z, first[a : z + 1] - first[a], np.where(terms < len(items.terms), terms, -1)


def document_counts(lists: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents."""
    shared = lists.sparkSession.sparkContext.broadcast(items)  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n = shared.value, 0
        counts = np.zeros(len(items.terms), np.int64)
        for batch in batches:
            copies = batch.column("n").to_numpy()
            n += int(copies.sum())
            for a, _, first, terms in _listed(items, batch.column("terms")):
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                found = terms >= 0
                pairs = np.sort(text[found] * len(items.terms) + terms[found])
                pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
                np.add.at(counts, pairs % len(items.terms), copies[a + pairs // len(items.terms)])
        term = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(term, -1), pa.int32()), pa.array(np.append(counts[term], n), pa.int64())], ["term", "n"])

    found = lists.select("terms", "n").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.terms))
    terms = found[found["term"] >= 0]
    counts[terms["term"]] = terms["n"]
    return counts, int(found.loc[found["term"] < 0, "n"].sum())


def _summed(lists: DataFrame, task, width: int) -> np.ndarray:
    """The sum over all tasks of the matrix of ``width`` columns that ``task`` makes from a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(batches)
        at = np.arange(0, len(total), SUM_ROWS)
        ends = np.append(at, len(total)) * width
        yield pa.record_batch([pa.array(at, pa.int32()), textio.lists(total.reshape(-1), ends, pa.float64())], ["row", "v"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        column = table.column("v").combine_chunks()
        total = column.flatten().to_numpy().reshape(len(column), -1).sum(0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), textio.lists(total, np.array([0, len(total)]), pa.float64())], ["row", "v"])

    found = lists.select("terms").mapInArrow(run, "row int, v array<double>").groupBy("row").applyInArrow(add, "row int, v array<double>").toPandas()
    return np.concatenate(found.sort_values("row")["v"].to_numpy()).reshape(-1, width)


def latent_axes(lists: DataFrame, items: Items, idf: np.ndarray, rank: int, seed: int = 17) -> np.ndarray:
    """terms x rank: TF-IDF vectors times this matrix are latent vectors. ``lists`` are those of all texts; the items'
    rows weigh as much as all their windows together."""
    n_terms, often = len(items.terms), _often(idf)
    width = min(rank + 8, n_terms)
    start = np.random.default_rng(seed).standard_normal((n_terms, width)).astype(np.float32)
    shared = lists.sparkSession.sparkContext.broadcast((items, idf))

    def rows_times(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[tuple]:
        items, weights = shared.value
        weighted = np.column_stack([matrix * weights[:, None], weights**2])  # the last column sums to the squared length
        for batch in batches:
            for _, _, first, terms in _listed(items, batch.column("terms")):
                offsets, at, text = _windows(first)
                sums = _windows_of(_step_sums(terms, at, weighted, often), offsets, text, WIDTHS[0])
                norm = np.sqrt(np.maximum(sums[:, -1:], 1e-9))
                yield terms, offsets, at, text, sums[:, :-1] / norm, norm

    def back(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((n_terms, width))
        for terms, offsets, at, text, product, norm in rows_times(batches, start):
            # Transposed: a term gets the products of the windows it stands in, which begin at its step and before.
            scaled = product / norm
            reach = scaled.copy()
            begin = offsets[:-1][text]
            for k in range(1, WIDTHS[0]):
                inside = np.flatnonzero(np.arange(len(at)) - k >= begin)
                reach[inside] += scaled[inside - k]
            counted, place, step = _often_counts(terms, at, often, n_terms)
            for low, high, counts in counted:
                total[often] += counts.T @ reach[low:high]
            if not len(place):
                continue
            order = np.argsort(terms[place], kind="stable")
            sorted_terms = terms[place][order]
            first = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]]))
            total[sorted_terms[first]] += np.add.reduceat(reach[step[order]], first, axis=0)
        return total * shared.value[1][:, None]

    def gram(basis: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((width, width))
            for *_, product, _ in rows_times(batches, basis):
                total += product.T @ product
            return total

        return run

    own = np.zeros((len(items.ids), n_terms), np.float32)
    for row, words in zip(own, items.words, strict=True):
        np.add.at(row, items.numbers(words), 1)
    own *= idf
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    weigh = lambda of_texts, of_items: of_texts / max(np.trace(of_texts), 1e-9) + of_items / max(np.trace(of_items), 1e-9)
    z_texts, z_items = _summed(lists, back, width), own.T @ (own @ start)
    z = z_texts / max(np.linalg.norm(z_texts), 1e-9) + z_items / max(np.linalg.norm(z_items), 1e-9)
    basis = np.linalg.qr(z)[0].astype(np.float32)
    of_items = own @ basis
    values, vectors = np.linalg.eigh(weigh(_summed(lists, gram(basis), width), of_items.T @ of_items))
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_length(one: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict[int, int] = {}
    for i, w in enumerate(one.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for w in other.tolist():
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(one) - row.bit_count()


def best_stretch(item: np.ndarray, words: np.ndarray, low: int, high: int, least: int) -> tuple[int, int, int]:
    """Common length, first word and number of words of the best stretch of about the item's length in words[low:high].
    Stretches that cannot reach ``least`` common words are not looked at."""
    size = len(item) + max(4, len(item) // 4)
    stride = max(1, len(item) // 8)
    best = (least - 1, low, 0)
    # An upper bound: words of the stretch that stand in the item.
    counts = np.concatenate([[0], np.cumsum((words[low:high, None] == item).any(1))]).tolist()
    for at in range(low, max(low + 1, high - size + stride), stride):
        end = min(at + size, high)
        if counts[end - low] - counts[at - low] > best[0]:
            length = common_length(item, words[at:end])
            if length > best[0]:
                best = (length, at, end - at)
    return best


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, answer_col: str | None = None,
    rank: int = 96, cosine: float = 0.65, copy: float = 0.8, paraphrase: float = 0.6, min_words: int = 8,
    block_items: int = 1000,
) -> DataFrame:
    """Documents that hold benchmark items. Terms, latent axes, windows and candidates are those of all documents."""
    session = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text")).where("text <> ''")
    answer = F.lower(answer_col) if answer_col else F.lit(None).cast("string")
    queries = benchmark.select(F.col(item_col).cast("long"), F.lower(item_text_col), answer).orderBy(item_col).toLocalIterator()
    schema = "doc_id long, item_id long, cosine double, lcs double, first_word int, n_words int, answer boolean"
    found = [session.createDataFrame([], schema)]
    while block := [tuple(r) for r in islice(queries, block_items)]:
        items = Items(block)
        if not len(items.terms):
            continue
        lists = stored(term_lists(rows, items), "term_lists")
        counts, n = document_counts(lists, items)
        if n:
            idf = np.log((n + 1) / (counts + 1)).astype(np.float32) + np.float32(0.05)
            axes = latent_axes(lists, items, idf, rank) * idf[:, None]
        release(lists)
        if not n:
            continue
        found.append(_search(rows, items, axes, _often(idf), schema, cosine, copy, paraphrase, min_words))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    best = F.max_by(F.struct("cosine", "lcs", "first_word", "n_words", "answer"), F.struct("lcs", "cosine", -F.col("first_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def _joined(text: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, cosine: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Windows of a text near one item and near each other as one: text, item, first and last word, best cosine."""
    if not len(text):
        return
    order = np.lexsort((begin, item, text))
    text, item, begin, end, cosine = (x[order] for x in (text, item, begin, end, cosine))
    other = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
    group = np.cumsum(other) * (int(end.max()) + 1)  # the furthest end so far, within a text and item
    furthest = np.maximum.accumulate(group + end) - group
    apart = np.concatenate([[True], begin[1:] > (furthest + sizes[item] + sizes[item] // 2)[:-1]])
    new = np.flatnonzero(other | apart)
    ends, values = np.maximum.reduceat(end, new), np.maximum.reduceat(cosine, new)
    yield from zip(text[new].tolist(), item[new].tolist(), begin[new].tolist(), ends.tolist(), values.tolist(), strict=True)


def _search(rows: DataFrame, items: Items, axes: np.ndarray, often: np.ndarray, schema: str, cosine: float, copy: float, paraphrase: float, min_words: int) -> DataFrame:
    latent = np.stack([axes[items.numbers(w)].sum(0) for w in items.words])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    shared = rows.sparkSession.sparkContext.broadcast((items, axes, latent))  # one block of items x rank
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]

    sizes = np.array([len(w) for w in items.words])

    def matches(hashes: np.ndarray, first: np.ndarray, terms: np.ndarray) -> Iterator[tuple]:
        items, axes, latent = shared.value
        offsets, start, text = _windows(first)
        sums = _step_sums(terms, start, axes, often)
        near_text, near_item, near_begin, near_end, near_cosine = [], [], [], [], []
        for width in WIDTHS:
            vectors = _windows_of(sums, offsets, text, width)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for low in range(0, len(vectors), 1024):
                near = vectors[low : low + 1024] @ latent.T
                some = np.flatnonzero(near.max(1) >= cosine)  # few windows come near any item
                w, i = np.nonzero(near[some] >= cosine)
                w = some[w]
                near_text.append(text[low + w])
                near_item.append(i)
                near_begin.append(start[low + w])
                near_end.append(start[low + w] + width * STEP)
                near_cosine.append(near[w, i])
        best: dict[tuple[int, int], tuple] = {}
        for t, i, at in items.verbatim(hashes, first, terms):
            row = (1.0, 1.0, at - int(first[t]), len(items.words[i]), True)
            best[t, i] = max(row, best.get((t, i), row), key=lambda r: (r[0], r[1], -r[2]))
        whole = set(best)
        if near_text:
            columns = [np.concatenate(c) for c in (near_text, near_item, near_begin, near_end, near_cosine)]
            for t, i, at, end, value in _joined(*columns, sizes):
                if (t, i) in whole:
                    continue
                item = items.words[i]
                least = len(item) if len(item) < min_words else max(1, int(np.ceil(paraphrase * len(item))))
                reach = len(item) + len(item) // 2
                length, begin, n = best_stretch(item, hashes, max(int(first[t]), at - reach), min(int(first[t + 1]), end + reach), least)
                if not n:
                    continue
                held = common_length(items.answers[i], hashes[begin : begin + n]) >= copy * len(items.answers[i])
                row = (length / len(item), value, begin - int(first[t]), n, held)
                if (row[0] >= copy or held) and ((t, i) not in best or best[t, i] < row):
                    best[t, i] = row
        for (t, i), (share, value, begin, n, held) in best.items():
            yield t, items.ids[i], value, share, begin, n, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value[0]
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for a, _, hashes, first, terms in _block_terms(items, batch.column("text"), 2_000_000):
                rows = [(ids[a + t], *rest) for t, *rest in matches(hashes, first, terms)]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
