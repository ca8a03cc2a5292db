"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page.

``page_blocks`` turns a page into its text blocks in page order, each with the path of tags, classes and ids above
it. ``vectors`` gives a block a vector: the path and the words as sums of fixed random vectors per hash, and a few
measures (length, share of link text, punctuation, place). A numpy LSTM reads the sequence forward, a second one
backward, and a logistic layer over both states labels every block, so the whole page is its context.

``fit`` trains on a documented number of pages. A block of such a page counts as main text if semantic elements say
so (in an article or main element, outside what the contract excludes). As real pages often lack these elements, every
page is rendered again in several layouts whose labels are known by construction.

NULL and empty pages have an empty text. References are decoded, white space inside a block becomes one blank, blocks
are trimmed and joined by one line break. Markup that does not close is read to its end, as browsers do.
"""

from __future__ import annotations

import html as markup
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements without content, those that begin a new block, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template svg iframe object canvas math".split())
# Elements that end an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
EXCLUDED = frozenset(
    "nav header footer aside form menu sidebar notice cookie banner ad ads advert advertisement promo sponsored newsletter comment comments "
    "breadcrumb related share social login search popup modal widget button select title head".split()
)
MAIN = frozenset({"article", "main"})
WIDTH, HASHES, MEASURES = 24, 4096, 7
_TOKEN = re.compile(r"[a-z]+")
_TABLE = np.random.default_rng(5).standard_normal((HASHES, WIDTH)).astype(np.float32) / np.sqrt(WIDTH)


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # of every element from the outside in: its tag, then words of its class and id
    linked: int  # characters inside links


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.path: tuple[tuple[str, ...], ...] = ()
        self.linked = self.links = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append(Block(text, self.path, self.linked))
        self.parts, self.linked = [], 0

    def leave(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        for tag, _ in self.stack[depth:]:
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN
        del self.stack[depth:]

    def last(self, tags: set[str], stop: frozenset[str] = frozenset()) -> int:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in tags:
                return depth
            if self.stack[depth][0] in stop:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if (depth := self.last({"p"}, frozenset({"button", "td", "th"}))) >= 0:
                self.leave(depth)
            if tag in SIBLINGS and (depth := self.last(SIBLINGS[tag], frozenset({"ul", "ol", "dl", "table", "select"}))) >= 0:
                self.leave(depth)
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
            self.stack.append((tag, (tag, *_TOKEN.findall(named))))
            self.links += tag == "a"
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in HIDDEN:  # only foreign elements close themselves
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if (depth := self.last({tag})) >= 0:
            self.leave(depth)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self.parts or not any(p.strip() for p in self.parts):
            self.path = tuple(names for _, names in self.stack)
        self.parts.append(data)
        self.linked += len(data.strip()) * (self.links > 0)


def page_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    if not page:
        return []
    reader = _Reader()
    # Marked sections are no HTML; the parser would stop at unknown ones.
    reader.feed(re.sub(r"<!\[", "&lt;![", re.sub(r"<!\[[^>]*>", " ", page)))
    reader.close()
    reader.flush()
    return reader.found


def _hash(token: str) -> int:
    return zlib.crc32(token.encode()) % HASHES


_VECTOR_OF: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Inner elements weigh more than outer ones."""
    if path not in _VECTOR_OF:
        if len(_VECTOR_OF) > 50_000:
            _VECTOR_OF.clear()
        out = np.zeros(WIDTH, np.float32)
        for depth, names in enumerate(reversed(path)):
            for name in names:
                out += 0.85**depth * _TABLE[_hash("<" + name)]
        _VECTOR_OF[path] = out
    return _VECTOR_OF[path]


def vectors(found: list[Block]) -> np.ndarray:
    """A vector per block: path, words, measures."""
    out = np.zeros((len(found), 2 * WIDTH + MEASURES), np.float32)
    for i, block in enumerate(found):
        words = block.text.split()
        hashes = [zlib.crc32(w.encode()) % HASHES for w in words]
        out[i, :WIDTH] = _path_vector(block.path)
        bag = _TABLE[hashes].sum(0)
        out[i, WIDTH : 2 * WIDTH] = bag / np.linalg.norm(bag)  # so that long blocks look like short ones
        n = len(block.text)
        out[i, 2 * WIDTH :] = (
            min(2.0, np.log1p(len(words)) / 3), min(1.0, block.linked / n), 10 * sum(map(block.text.count, ".,;:!?")) / n,
            block.text[-1] in ".!?:", i / len(found), 1 / (1 + i), 1 / (len(found) - i),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output; ``parameters`` maps names to arrays."""

    def __init__(self, inputs: int = 2 * WIDTH + MEASURES, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.parameters = hidden, {}
        for side in ("f", "b"):
            self.parameters[f"x{side}"] = rng.standard_normal((inputs, 4 * hidden)).astype(np.float32) / np.sqrt(inputs)
            self.parameters[f"h{side}"] = rng.standard_normal((hidden, 4 * hidden)).astype(np.float32) / np.sqrt(hidden)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.parameters[f"c{side}"] = bias
        self.parameters["out"] = rng.standard_normal(2 * hidden).astype(np.float32) / np.sqrt(hidden)
        self.parameters["bias"] = np.zeros(1, np.float32)

    @staticmethod
    def turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Where each step of a sequence stands when the sequence is read from its end; padding stays in place."""
        at = np.arange(steps)[None, :]
        return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)

    def _forward(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        size, wh = self.hidden, self.parameters[f"h{side}"]
        gates = x @ self.parameters[f"x{side}"] + self.parameters[f"c{side}"]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out = np.empty((n, steps, size), np.float32)
        for t in range(steps):
            g = gates[:, t] + h @ wh
            io = _sigmoid(g[:, : 3 * size])
            new = np.tanh(g[:, 3 * size :])
            before = c, h
            c = io[:, size : 2 * size] * c + io[:, :size] * new
            squashed = np.tanh(c)
            h = io[:, 2 * size :] * squashed
            out[:, t] = h
            if keep is not None:
                keep.append((io, new, squashed, *before))
        return out

    def _backward(self, x: np.ndarray, side: str, keep: list, d_out: np.ndarray, grads: dict) -> None:
        size, wh = self.hidden, self.parameters[f"h{side}"]
        dg_all = np.empty((*x.shape[:2], 4 * size), np.float32)
        dh_next, dc_next = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
        g_h = np.zeros_like(wh)
        for t in range(x.shape[1] - 1, -1, -1):
            io, new, squashed, c_before, h_before = keep[t]
            i, f, o = io[:, :size], io[:, size : 2 * size], io[:, 2 * size :]
            dh = d_out[:, t] + dh_next
            dc = dc_next + dh * o * (1 - squashed**2)
            dg = np.concatenate([dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], 1)
            g_h += h_before.T @ dg
            dh_next, dc_next = dg @ wh.T, dc * f
            dg_all[:, t] = dg
        flat = dg_all.reshape(-1, 4 * size)
        grads[f"h{side}"], grads[f"c{side}"] = g_h, flat.sum(0)
        grads[f"x{side}"] = x.reshape(len(flat), -1).T @ flat

    def chances(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Chance of every block to be main text; x is padded to the longest sequence."""
        turn = self.turned(lengths, x.shape[1])
        rows = np.arange(len(x))[:, None]
        both = np.concatenate([self._forward(x, "f"), self._forward(x[rows, turn], "b")[rows, turn]], 2)
        return _sigmoid(both @ self.parameters["out"] + self.parameters["bias"])

    def step(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean log-loss."""
        turn, rows = self.turned(lengths, x.shape[1]), np.arange(len(x))[:, None]
        back = x[rows, turn]
        keep_f, keep_b, grads = [], [], {}
        both = np.concatenate([self._forward(x, "f", keep_f), self._forward(back, "b", keep_b)[rows, turn]], 2)
        inside = np.arange(x.shape[1])[None] < lengths[:, None]
        error = np.where(inside, _sigmoid(both @ self.parameters["out"] + self.parameters["bias"]) - y, 0).astype(np.float32) / inside.sum()
        grads["out"], grads["bias"] = (both * error[..., None]).sum((0, 1)), error.sum(keepdims=True).reshape(1)
        d_both = error[..., None] * self.parameters["out"]
        self._backward(x, "f", keep_f, d_both[..., : self.hidden], grads)
        self._backward(back, "b", keep_b, d_both[..., self.hidden :][rows, turn], grads)
        return grads


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), max(lengths.max(), 1), sequences[0].shape[1]), np.float32)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = s
    return out, lengths


def semantic_labels(found: list[Block]) -> list[bool] | None:
    """Main text by semantic elements; None where a page has none."""
    inside = [any(names[0] in MAIN for names in b.path) for b in found]
    if not any(inside):
        return None
    kept = []
    for block, is_in in zip(found, inside, strict=True):
        first = next((k for k, names in enumerate(block.path) if names[0] in MAIN), 0)
        kept.append(is_in and not any(EXCLUDED.intersection(names) for names in block.path[first:]) and not EXCLUDED.intersection(*block.path[:first]))
    return kept


# Names that layouts give to the parts of a page, as tag and class.
BODY_NAMES = ["article", "main", "div class=content", "div id=main", "div class=post", "section class=entry", "div class=article-body", "div class=story", "div class=text", "div id=content"]
OTHER_NAMES = {
    "menu": ["nav", "div class=menu", "ul class=nav", "div id=navigation", "div class=breadcrumb", "header", "div class=navbar"],
    "header": ["header", "div class=header", "div id=top", "div class=site-title", "div class=logo", "div class=masthead"],
    "footer": ["footer", "div class=footer", "div id=bottom", "div class=copyright", "div class=site-info"],
    "sidebar": ["aside", "div class=sidebar", "div id=secondary", "div class=widget", "div class=related", "section class=recommended", "div class=popular"],
    "notice": ["div class=notice", "div class=cookie", "div id=cookie-banner", "div class=alert", "div class=consent", "div class=popup", "div class=disclaimer", "p class=notice"],
    "ad": ["div class=ad", "div class=advert", "div class=sponsored", "div class=promo", "aside class=ads", "div class=banner", "ins class=adsbygoogle"],
    "form": ["form", "form class=search", "div class=newsletter", "form class=login", "div class=subscribe", "form id=contact"],
    "share": ["div class=share", "ul class=social", "div class=tags", "div class=meta", "div class=byline", "div class=author"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class=responses", "div class=discussion", "section id=reviews"],
}


def _element(name: str, inner: str) -> str:
    return f"<{name.replace('=', '=\"') + '\"' * ('=' in name)}>{inner}</{name.split()[0]}>"


def layouts(texts: list[str], number: int, rng: random.Random) -> Iterator[tuple[list[Block], list[bool]]]:
    """Pages that show some texts as article in random layouts, with the label of every block."""
    words = " ".join(texts).split() or ["text"]
    some = lambda low, high: markup.escape(" ".join(rng.choice(words) for _ in range(rng.randint(low, high))))
    sign = "\x02"  # before every text of the article, so that its blocks are known after parsing

    def paragraph(text: str) -> str:
        text = sign + markup.escape(text)
        kind = rng.random()
        if kind < 0.08:
            return f"<ul><li>{text}</li><li>{sign}{some(2, 12)}</li></ul>"
        if kind < 0.14:
            return f"<h{rng.randint(2, 4)}>{sign}{some(1, 8)}</h2><p>{text}</p>"
        if kind < 0.18:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.22:
            return f"<table><tr><td>{sign}{some(1, 4)}</td><td>{text}</td></tr></table>"
        if kind < 0.30:
            return f"<div>{text}</div>"
        if kind < 0.38:
            return f"<p>{text} <a href='#'>{some(1, 4)}</a> {some(2, 9)}</p>"
        return f"<p>{text}</p>" if kind < 0.9 else f"<p>{text}"

    def other(kind: str) -> str:
        links = "".join(f"<li><a href='#'>{some(1, 3)}</a></li>" for _ in range(rng.randint(2, 8)))
        if kind == "menu":
            inner = f"<ul>{links}</ul>"
        elif kind == "form":
            inner = f"<label>{some(1, 4)}</label><input name='q'><button>{some(1, 2)}</button><p>{some(3, 15)}</p><select><option>{some(1, 2)}</option></select>"
        elif kind == "comments":
            inner = f"<h3>{some(1, 3)}</h3>" + "".join(
                f"<{tag}><span>{some(1, 2)}</span><p>{some(4, 60)}</p></{tag}>" for tag in [rng.choice(["div class='comment'", "li", "div"])] * rng.randint(1, 4)
            ).replace("</div class='comment'>", "</div>")
        elif kind == "sidebar":
            inner = f"<h4>{some(1, 4)}</h4><ul>{links}</ul>" if rng.random() < 0.6 else f"<h4>{some(1, 4)}</h4><p>{some(5, 40)}</p>"
        elif kind in ("share", "header"):
            inner = f"<span>{some(1, 6)}</span>" if rng.random() < 0.5 else f"<ul>{links}</ul>"
        else:
            inner = rng.choice([some(4, 30), f"<p>{some(4, 50)}</p>", f"<span>{some(1, 9)}</span> <a href='#'>{some(1, 3)}</a>"])
        return _element(rng.choice(OTHER_NAMES[kind]), inner)

    for _ in range(number):
        chance = lambda kind, p: other(kind) if rng.random() < p else ""
        inner = [f"<h1>{sign}{some(2, 12)}</h1>" if rng.random() < 0.8 else ""]
        inner += [chance("share", 0.2)]
        for text in texts:
            inner += [paragraph(text), chance("ad", 0.05), chance("sidebar", 0.02), chance("notice", 0.02)]
        inner += [chance("share", 0.3), chance("comments", 0.15), chance("form", 0.1)]
        body = _element(rng.choice(BODY_NAMES), "".join(inner))
        if rng.random() < 0.3:
            body = _element(rng.choice(["div class=wrapper", "div id=page", "section"]), body)
        page = (
            f"<html><head><title>{some(2, 9)}</title></head><body>" + chance("notice", 0.3) + chance("header", 0.6) + chance("menu", 0.8) + chance("ad", 0.4)
            + chance("sidebar", 0.2) + body + chance("comments", 0.35) + chance("sidebar", 0.4) + chance("form", 0.3) + chance("ad", 0.2) + chance("footer", 0.8) + "</body></html>"
        )
        found = page_blocks(page)
        labels = [sign in b.text for b in found]
        for block in found:
            block.text = " ".join(block.text.replace(sign, " ").split())
        kept = [(b, y) for b, y in zip(found, labels, strict=True) if b.text]
        yield [b for b, _ in kept], [y for _, y in kept]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int, size: int = 32, rate: float = 0.01) -> Labeller:
    """Adam on batches of sequences of like length."""
    model, rng = Labeller(), np.random.default_rng(1)
    sequences = sorted(sequences, key=lambda s: len(s[0]))
    batches = [sequences[i : i + size] for i in range(0, len(sequences), size)]
    mean = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    square = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    t, total = 0, max(1, epochs * len(batches))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x, lengths = padded([s for s, _ in batches[k]])
            y, _ = padded([y[:, None] for _, y in batches[k]])
            grads = model.step(x, lengths, y[..., 0])
            t += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for name, grad in grads.items():
                grad = grad * min(1.0, 1.0 / (norm + 1e-9))
                mean[name], square[name] = 0.9 * mean[name] + 0.1 * grad, 0.99 * square[name] + 0.01 * grad**2
                step = rate * (1 - t / (total + 1)) * (mean[name] / (1 - 0.9**t)) / (np.sqrt(square[name] / (1 - 0.99**t)) + 1e-7)
                model.parameters[name] = (model.parameters[name] - step).astype(np.float32)
    return model


def fit(df: DataFrame, html_col: str, pages: int = 240, sequences: int = 1200, epochs: int = 10, seed: int = 23) -> Labeller:
    """Train on the ``pages`` pages with the smallest hashes, which come to the driver, and on layouts of them that
    make about ``sequences`` sequences in all."""
    some = df.select(F.col(html_col).alias("html")).where("html IS NOT NULL").orderBy(F.xxhash64("html", F.lit(seed)), "html").limit(pages)
    rng, known, rows = random.Random(seed), [], some.collect()
    for row in rows:
        found = page_blocks(row["html"])
        labels = semantic_labels(found)
        if labels is not None:
            known.append((vectors(found), np.array(labels, np.float32)))
        texts = [b.text for b, y in zip(found, labels or [True] * len(found), strict=True) if y]
        for blocks, kept in layouts(texts, max(1, sequences // len(rows) - 1), rng):
            known.append((vectors(blocks), np.array(kept, np.float32)))
    return train([s for s in known if len(s[0])], epochs)


def main_texts(model: Labeller, pages: list[str | None], cells: int = 20_000) -> list[str]:
    """The main text of every page. Pages of like length are labelled together, about ``cells`` blocks at a time."""
    found = [page_blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    while order:
        n = max(1, min(len(order), cells // len(found[order[-1]])))
        group, order = order[-n:], order[:-n]
        x, lengths = padded([vectors(found[i]) for i in group])
        for i, chance in zip(group, model.chances(x, lengths), strict=True):
            out[i] = "\n".join(b.text for b, c in zip(found[i], chance, strict=False) if c > 0.5)
    return out


def extract(df: DataFrame, html_col: str, model: Labeller, out_col: str = "text", most_pages: int = 500) -> DataFrame:
    """Adds the main text of every page."""
    fields = [f for f in df.schema.fields if f.name not in (out_col, html_col)]
    names = [f.name for f in fields]
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(html_col))  # the last column
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most_pages):
                part = batch.slice(at, most_pages)
                texts = main_texts(shared.value, part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], [*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(run, f"{schema}, `{out_col}` string")
