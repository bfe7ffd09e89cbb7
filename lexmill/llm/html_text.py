"""Operator 10: main text of web pages by a bidirectional LSTM that labels every block."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks as blocks_in
from lexmill.llm.common import drawn

#: Pages that the labeller is fitted on, blocks that it learns from at once, and how many such windows a page gives.
SAMPLE, WINDOW, WINDOWS = 400, 200, 2
TAG_DIMS, WORD_DIMS, EXTRA = 64, 32, 5
#: Bytes of html that are labelled at once.
HELD = 1 << 20
DIMS, HIDDEN = TAG_DIMS + WORD_DIMS + EXTRA, 16

#: A comment (`<!-->` and `<!--->` are whole ones), or a tag to its end; a `>` inside a quoted attribute value doesn't end it.
MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/]?[a-zA-Z?!](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+(?:>|\Z)""", re.S)
#: Elements that go with their content. Where no end tag follows, only raw text runs to the end of the page.
RAW_TEXT = set("script style title textarea".split())
HIDDEN_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in (*RAW_TEXT, *"noscript template svg iframe select button".split())}
NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
NAMED = {"class", "id", "role"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same set.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

ASIDE_TAGS = set("nav header footer aside form menu dialog".split())
ASIDE_NAMES = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie disqus footer header login menu modal nav navigation navbar newsletter "
    "notice popup promo promotion related replies search share sidebar signup social sponsor sponsored subscribe widget".split()
)


class Node:
    """An open element: its tag with its names, and the element around it. Blocks share the nodes of their elements."""

    __slots__ = ("items", "parent")

    def __init__(self, items: tuple[str, ...], parent: Node | None):
        self.items, self.parent = items, parent


@dataclass
class Block:
    text: str
    node: Node | None
    linked: int = 0

    @property
    def path(self) -> tuple[str, ...]:
        """All tags and names around the block, outermost first."""
        out, node = [], self.node
        while node is not None:
            out.append(node.items)
            node = node.parent
        return tuple(x for items in reversed(out) for x in items)


def gathered(blocks: list[Block], own: Callable[[tuple[str, ...]], int]) -> list[int]:
    """Bits that the elements of each block's path have between them; each element is looked at once."""
    known: dict[Node | None, int] = {None: 0}
    out = []
    for b in blocks:
        fresh, node = [], b.node
        while node not in known:
            fresh.append(node)
            node = node.parent
        bits = known[node]
        for node in reversed(fresh):
            bits = known[node] = bits | own(node.items)
        out.append(bits)
    return out


def blocks_of(page: str | None) -> list[Block]:
    """Text leaves of a page in order, each with its path of tags and of class, id and role names.

    Broken markup is read as far as it goes: unclosed elements end with their parent, stray end tags are passed over,
    an unfinished tag, comment or raw text runs to the end of the page. Markup in a comment is none, nor are comments in
    a hidden element. Of any other hidden element without an end tag the content stays; a self-closed svg is empty.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Node] = []
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    links, linked, at = 0, 0, 0
    endless: set[str] = set()  # hidden elements with no end tag from here on

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append(Block(text, stack[-1] if stack else None, linked))
        linked = 0

    def close() -> str:
        tag = stack.pop().items[0]
        open_tags[tag] -= 1
        return tag

    while m := MARKUP.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        mark = m.group()
        name = NAME.match(mark)
        if not name:
            continue
        tag = name.group(1).lower()
        if tag in HIDDEN_END and mark[1] != "/" and tag not in endless:
            closed = tag == "svg" and mark.endswith("/>")
            end = None if closed else HIDDEN_END[tag].search(page, at)
            if closed or end or tag in RAW_TEXT:
                at = end.end() if end else at if closed else len(page)
                pieces.append(" ")
                linked += 1 if links else 0
                continue
            endless.add(tag)
        if tag == "br":
            pieces.append(" ")
        elif tag in INLINE:
            links = max(0, links + (-1 if mark[1] == "/" else 1)) if tag == "a" else links
        elif mark[1] == "/":
            if open_tags.get(tag):
                flush()
                while close() != tag:
                    pass
        else:
            flush()
            ends = CLOSES.get(tag, {"p"} if tag in ENDS_P else set())
            while stack and stack[-1].items[0] in ends:
                close()
            if tag not in VOID and not mark.endswith("/>"):
                names = [a or b or c for name, a, b, c in ATTRIBUTE.findall(mark) if name.lower() in NAMED] if "=" in mark else []
                items = (tag, *("." + n for x in names for n in re.split(r"[\s_-]+", x.lower()) if n))
                stack.append(Node(items, stack[-1] if stack else None))
                open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return out


_buckets: dict[str, int] = {}


def bucket(word: str, dims: int) -> int:
    got = _buckets.get(word)
    if got is None:
        if len(_buckets) > 200_000:
            _buckets.clear()
        got = _buckets[word] = zlib.crc32(word.encode())
    return got % dims


def vectors(blocks: list[Block], shown: Callable[[tuple[str, ...]], tuple[str, ...]] = tuple) -> np.ndarray:
    """Hashed tag path, hashed words, size, link share, punctuation and place of each block; of each element in a path
    counts what is `shown` of it."""
    out = np.zeros((len(blocks), DIMS), np.float32)

    def bits(items: tuple[str, ...]) -> int:
        mask = 0
        for x in shown(items):
            mask |= 1 << bucket(x, TAG_DIMS)
        return mask

    marks = np.array(gathered(blocks, bits), np.uint64)
    out[:, :TAG_DIMS] = (marks[:, None] >> np.arange(TAG_DIMS, dtype=np.uint64)) & np.uint64(1)
    for k, b in enumerate(blocks):
        row = out[k]
        words = b.text.split(" ")
        counts = np.bincount([bucket(w, WORD_DIMS) for w in words], minlength=WORD_DIMS)
        row[TAG_DIMS : TAG_DIMS + WORD_DIMS] = counts / len(words)
        row[TAG_DIMS + WORD_DIMS :] = (
            np.log1p(len(b.text)) / 10, min(1.0, b.linked / len(b.text)), b.text.count(",") / len(words), b.text[-1] in ".!?", (k + 1) / len(blocks)
        )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM direction over (time, batch, DIMS) with a mask; masked steps keep the state."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.wx = (rng.normal(size=(DIMS, 4 * HIDDEN)) / np.sqrt(DIMS)).astype(np.float32)
        self.wh = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        steps, batch = x.shape[:2]
        drive = x @ self.wx + self.b
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        self.kept = []
        for t in range(steps):
            z = drive[t] + h @ self.wh
            gate, cell = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            fresh = f * c + i * cell
            squashed = np.tanh(fresh)
            self.kept.append((h, c, i, f, o, cell, squashed, m))
            c = m * fresh + (1 - m) * c
            h = m * o * squashed + (1 - m) * h
            out[t] = h
        return out

    def backward(self, x: np.ndarray, grad: np.ndarray) -> list[np.ndarray]:
        dwx, dwh, db = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh = dc = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, cell, squashed, m = self.kept[t]
            dh = dh + grad[t]
            do, inner = m * dh * squashed, m * dc + m * dh * o * (1 - squashed**2)
            dz = np.concatenate([inner * cell * i * (1 - i), inner * c * f * (1 - f), do * o * (1 - o), inner * i * (1 - cell**2)], axis=1)
            dwx += x[t].T @ dz
            dwh += h.T @ dz
            db += dz.sum(axis=0)
            dh = dz @ self.wh.T + (1 - m) * dh
            dc = inner * f + (1 - m) * dc
        return [dwx, dwh, db]


class Labeller:
    """Bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = 5):
        self.ahead, self.back = Direction(seed), Direction(seed + 1)
        self.out = np.zeros(2 * HIDDEN + 1, np.float32)

    def _states(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.ahead.forward(x, mask), self.back.forward(x[::-1], mask[::-1])[::-1]], axis=2)
        return np.concatenate([both, np.ones((*both.shape[:2], 1), np.float32)], axis=2)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def predict(self, pages: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
        """Chance of main text for each block. Pages of like length run together, about `cells` blocks at once."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            size = max(1, cells // len(pages[order[-1]]))
            group, order = order[-size:], order[:-size]
            x, mask = self.padded([pages[k] for k in group])
            p = sigmoid(self._states(x, mask) @ self.out)
            self.ahead.kept = self.back.kept = []
            for j, k in enumerate(group):
                out[k] = p[: len(pages[k]), j]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the cross-entropy of all blocks."""
        rng = np.random.default_rng(seed)
        weights = [self.ahead.wx, self.ahead.wh, self.ahead.b, self.back.wx, self.back.wh, self.back.b, self.out]
        mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x, mask = self.padded([pages[k] for k in pick])
                y = np.zeros_like(mask)
                for j, k in enumerate(pick):
                    y[: len(labels[k]), j] = labels[k]
                states = self._states(x, mask)
                slope = (sigmoid(states @ self.out) - y) * mask / mask.sum()
                into = slope[:, :, None] * self.out[: 2 * HIDDEN]
                grads = self.ahead.backward(x, into[:, :, :HIDDEN]) + self.back.backward(x[::-1], into[::-1, :, HIDDEN:])
                grads.append(np.einsum("tb,tbh->h", slope, states))
                step += 1
                for w, g, m, v in zip(weights, grads, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.ahead.kept = self.back.kept = []


def structure_labels(blocks: list[Block]) -> np.ndarray:
    """Labels for training: inside the article or main element, or the body where there is none, and not in an aside."""

    def kinds(items: tuple[str, ...]) -> int:
        inner = any(x in ("article", "main", ".main") for x in items)
        aside = any(x in ASIDE_TAGS or (x[0] == "." and x[1:].rstrip("0123456789") in ASIDE_NAMES) for x in items)
        return inner + 2 * aside

    found = gathered(blocks, kinds)
    anchored = any(k & 1 for k in found)
    return np.array([(k & 1 or not anchored) and not k & 2 for k in found], np.float32)


def with_furniture(page: str, rng: random.Random) -> str:
    """The page with furniture that pages often have, made of its own words, at places where it is usual."""
    words = re.sub(r"<[^>]*>", " ", page).split() or ["text"]
    some = lambda a, b: html.escape(" ".join(rng.choice(words) for _ in range(rng.randint(a, b))))
    items = lambda tag, n, a, b: "".join(f"<{tag}>{some(a, b)}</{tag}>" for _ in range(n))
    before = [
        f'<div class="cookie-notice"><p>{some(8, 25)}</p></div>',
        f'<header><div class="banner">{some(2, 6)}</div></header>',
        f'<form class="search"><label>{some(1, 2)}</label></form>',
        f'<aside class="sidebar"><h2>{some(1, 4)}</h2><ul>{items("li", 4, 1, 6)}</ul></aside>',
    ]
    after = [
        f'<section class="comments" id="comments"><h2>{some(1, 3)}</h2>' + "".join(f'<div class="comment"><p>{some(5, 60)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
        f'<aside><div class="related">{items("p", 3, 3, 20)}</div></aside>',
        f'<form class="newsletter"><p>{some(4, 15)}</p></form>',
        f'<div class="ad">{some(3, 30)}</div>',
    ]
    for marker, kinds, ahead in (("<article", before, True), ("</article>", after, False), ("</p>", [after[3], before[0]], False)):
        spots = [m.start() if ahead else m.end() for m in re.finditer(marker, page)]
        if spots and rng.random() < 0.5:
            spot = rng.choice(spots)
            page = page[:spot] + "".join(rng.sample(kinds, rng.randint(1, len(kinds)))) + page[spot:]
    return page


def veil(rng: random.Random) -> Callable[[tuple[str, ...]], tuple[str, ...]]:
    """What is shown of an element without its class, id and role names, and with each tag that tells a part of a page
    turned into a div half of the time, so the labeller must look at words, links, size and place as well."""
    plain = {t: "div" for t in (*ASIDE_TAGS, "article", "main", "section") if rng.random() < 0.5}
    return lambda items: tuple(plain.get(x, x) for x in items if x[0] != ".")


def examples(page: str, seed: int, teacher: Callable[[list[Block]], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of a page as it is, of the page with furniture, and of the latter with its names veiled.

    Labels come from the page's own structure before it is veiled. A page of more than WINDOW blocks gives WINDOWS windows,
    its first one and others drawn by the seed.
    """
    rng = random.Random(seed)
    plain, full = blocks_of(page), blocks_of(with_furniture(page, rng))
    for blocks, shown in ((plain, tuple), (full, tuple), (full, veil(rng))):
        x, y = vectors(blocks, shown), teacher(blocks)
        starts = [*range(0, len(blocks), WINDOW)]
        for at in starts[:1] + sorted(rng.sample(starts[1:], min(len(starts[1:]), WINDOWS - 1))):
            yield x[at : at + WINDOW], y[at : at + WINDOW]


def fit_labeller(pages: DataFrame, sample: int = SAMPLE, teacher: Callable[[list[Block]], np.ndarray] = structure_labels) -> Labeller:
    """Fit on about `sample` different pages, drawn by the hash of their html, labelled by their own structure.

    The tasks turn pages into vectors, so what reaches the driver is bounded: sample x 3 x WINDOWS windows of WINDOW
    blocks. Null html is not learnt from, equal pages once; rows with a null or repeated id count like others.
    """
    chosen = drawn(pages.select("html").filter(F.col("html").isNotNull()), ["html"], sample, "html").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_in(batches, "html", HELD):
            for page in batch.column(0).to_pylist():
                seed = zlib.crc32(page.encode("utf-8", "replace"))
                found = [(seed, k, x.tobytes(), y.tobytes()) for k, (x, y) in enumerate(examples(page, seed, teacher))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["page", "nth", "x", "y"])

    rows = sorted(chosen.select("html").mapInArrow(run, "page long, nth int, x binary, y binary").collect(), key=lambda r: (r["page"], r["nth"], bytes(r["x"])))
    model = Labeller()
    if rows:
        model.fit([np.frombuffer(r["x"], np.float32).reshape(-1, DIMS) for r in rows], [np.frombuffer(r["y"], np.float32) for r in rows])
    return model


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): blocks of main text in page order, joined by an empty line.

    Every block is labelled in the context of its whole page. Null or empty html: empty text. Character references are
    decoded once; white space inside a block becomes one space. Repeated rows and equal pages give equal results; a block
    with a chance of exactly one half is main text. A null id or url is passed on. Empty table: no rows. Other columns are
    not read, whatever their names. The weights go to the workers by broadcast; nothing is shuffled.
    """
    box = pages.sparkSession.sparkContext.broadcast(model or fit_labeller(pages))

    def label(texts: list[str | None]) -> list[str]:
        parsed = [blocks_of(t) for t in texts]
        chances = box.value.predict([vectors(b) for b in parsed])
        return ["\n\n".join(b.text for b, c in zip(bs, cs, strict=True) if c >= 0.5) for bs, cs in zip(parsed, chances, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_in(batches, "html", HELD):
            out = label(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
