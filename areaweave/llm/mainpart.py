"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks, the runs of text that no block-level tag interrupts. Each block has features of its ancestors
(tags, words of class, id and role) and of its text (length, share of links, punctuation, likeness to the title, words of
short blocks). A chain of two labels, main or not, with transitions that depend on whether two neighbours share their parent,
is trained on labelled pages by gradient ascent on the conditional likelihood, and decoded by Viterbi. The main blocks in
page order, parted by an empty line, are the text.

Labelled pages carry their labels in the markup: ``data-main`` of the nearest element says what a block is (see
`layouts`). Training takes at most `MAX_PAGES` of them, so what the driver holds is bounded; pages to extract from never leave
the executors, each is read whole where it is scanned, and no shuffle is needed.

Defined cases: null, empty and markup-free pages (a page without tags is one block, judged by its text) give a text, at
worst the empty one. Comments, scripts, styles, templates and the head are no text. Character references are decoded as
browsers do, also without their semicolon; a tag or comment that never ends takes the rest of the page. White space is what
Python calls so, no-break spaces included; ``<br>`` is white space. Of equally good labellings the one with fewer main
blocks is taken. Repeated rows keep their rows, an empty table gives an empty table, and columns other than those kept
play no part (one named ``text`` is replaced).
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import slices

#: Labelled pages that a model is trained on, at most.
MAX_PAGES = 600

# Elements by how a browser lays them out.
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math noembed noframes xmp audio video".split())
#: An opening tag closes these if they are open innermost.
CLOSES = {
    **{t: frozenset(["p"]) for t in BLOCK - {"body", "html", "head"}},
    "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head", "title"]),
}

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([a-zA-Z][a-zA-Z-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(f"</{t}\\s*>", re.I) for t in RAW}


class Block:
    """A run of text, with the tags around it (outermost first), their names, and those of the innermost two."""

    __slots__ = ("text", "linked", "tags", "names", "near", "parent", "label")

    def __init__(self, text, linked, tags, names, near, parent, label):
        self.text, self.linked, self.tags, self.names, self.near, self.parent, self.label = text, linked, tags, names, near, parent, label


def blocks(page: str | None) -> tuple[list[Block], str]:
    """The leaf blocks of a page in order, and its title."""
    page = page or ""
    out: list[Block] = []
    # of each open block element: tag, names, number, label
    stack: list[tuple[str, frozenset, int, str | None]] = []
    text: list[str] = []
    linked, links, number, title, pos, n = 0, 0, 0, "", 0, len(page)

    def flush() -> None:
        nonlocal linked, title
        words = " ".join("".join(text).split())
        text.clear()
        share, linked = linked, 0
        if not words:
            return
        tags = tuple(s[0] for s in stack)
        if "title" in tags:
            title = title or words
        elif "head" not in tags:
            names, near = (frozenset().union(*(s[1] for s in part)) for part in (stack, stack[-2:]))
            label = next((s[3] for s in reversed(stack) if s[3] is not None), None)
            out.append(Block(words, share, tags, names, near, stack[-2][2] if len(stack) > 1 else 0, label))

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if links:
                linked += len(plain)

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        comment, other, closing, tag = m.groups()
        if comment:
            end = page.find("-->", m.end() - 2)  # <!--> is a whole comment
            pos = n if end < 0 else end + 3
            continue
        end = page.find(">", m.end())
        if end < 0:
            break
        if other:
            pos = end + 1
            continue
        attrs = page[m.end() : end]
        if '"' in attrs or "'" in attrs:
            whole = _REST.match(page, m.end())
            if whole:
                end = whole.end() - 1
                attrs = page[m.end() : end]
        pos, tag = end + 1, tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if at is not None:
                    del stack[at:]
                    links = 0
            elif tag == "a" and links:
                links -= 1
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                shut = _END[tag].search(page, pos)
                pos = shut.end() if shut else n
            text.append(" ")
        elif tag in BLOCK:
            flush()
            shuts = CLOSES.get(tag, frozenset())
            while stack and stack[-1][0] in shuts:
                stack.pop()
            if tag not in VOID:
                number += 1
                stack.append((tag, _said(attrs), number, _label(attrs)))
        elif tag in VOID:
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
        elif tag == "a":
            links = 1  # links do not nest
    flush()
    return out, title


def _said(attrs: str) -> frozenset:
    """What class, id and role say, in lower-case words, and whether the element is hidden."""
    if "=" not in attrs and "hidden" not in attrs:
        return frozenset()
    found = set()
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found.update(w.lower() for w in _PART.findall(value))
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("(hidden)")
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs):
        found.add("(hidden)")
    return frozenset(found)


def _label(attrs: str) -> str | None:
    m = re.search(r"data-main=[\"']?([01])", attrs) if "data-main" in attrs else None
    return m[1] if m else None


_BINS = (1, 2, 3, 5, 8, 12, 20, 35, 60)


def features(page: list[Block], title: str) -> list[list[str]]:
    """The features of each block, as text."""
    out = []
    for b in page:
        words = b.text.split(" ")
        f = [f"in:{t}" for t in set(b.tags)]
        f += [f"name:{w}" for w in b.names] + [f"stem:{w[:4]}" for w in b.names if len(w) > 4]
        f += [f"near:{w}" for w in b.near]
        own = b.tags[-1] if b.tags else ""
        up = b.tags[-2] if len(b.tags) > 1 else ""
        size = sum(len(words) > x for x in _BINS)
        share = b.linked / len(b.text)
        f += ["bias", f"own:{own}", f"up:{up}", f"size:{size}", f"links:{0 if share == 0 else 1 + min(2, int(share * 3))}", f"size:{size}:{own}"]
        last = b.text[-1]
        f.append("ends:" + ("stop" if last in ".!?…。»\"”" else "colon" if last == ":" else "word" if last.isalnum() else "other"))
        if "," in b.text:
            f.append("comma")
        if "©" in b.text or "®" in b.text:
            f.append("copyright")
        if any(c in b.text for c in "·|›»•→"):
            f.append("bar")
        if "@" in b.text or "http" in b.text:
            f.append("address")
        if sum(map(str.isdigit, b.text)) * 4 > len(b.text):
            f.append("digits")
        if title and (b.text == title or (len(title) > 15 and (b.text.startswith(title) or title.startswith(b.text)))):
            f += ["title", f"title:{own}"]
        if len(words) <= 12:
            f += [f"word:{w}" for w in {w.strip(".,:;!?()…").lower() for w in words[:12]} if w]
        out.append(f)
    return out


class Chain:
    """Weights of features for the label main (against not main), and of transitions by whether the parent is shared."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def scores(self, feats: list[list[str]]) -> list[float]:
        w = self.weights
        return [sum(w.get(x, 0.0) for x in f) for f in feats]

    def decode(self, page: list[Block], title: str) -> list[bool]:
        """Viterbi: the likeliest labels of a page's blocks."""
        score = self.scores(features(page, title))
        best, back = [0.0, 0.0], []
        for k, s in enumerate(score):
            if k == 0:
                best = [0.0, s]
                continue
            step = self.steps[int(page[k].parent == page[k - 1].parent)].tolist()
            came, new = [], []
            for y in (0, 1):
                stay, turn = best[0] + step[0][y], best[1] + step[1][y]
                came.append(int(turn > stay))
                new.append(max(stay, turn) + (s if y else 0.0))
            back.append(came)
            best = new
        if not score:
            return []
        y = int(best[1] > best[0])
        labels = [y]
        for came in reversed(back):
            y = came[y]
            labels.append(y)
        return [bool(v) for v in reversed(labels)]


def _sum(values: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[str], rounds: int = 120, rate: float = 0.15, decay: float = 0.02, least: int = 6) -> Chain:
    """A chain from labelled pages (``data-main`` in their markup), by ascent on the conditional log-likelihood.

    A feature has to be seen in ``least`` blocks; weights are held small by ``decay``. Blocks without a label are not main.
    """
    seen = []
    for p in pages[:MAX_PAGES]:
        page, title = blocks(p)
        if page:
            seen.append((features(page, title), [int(b.label == "1") for b in page], [int(b.parent == a.parent) for a, b in zip(page, page[1:])]))
    tally: dict[str, int] = {}
    for feats, _, _ in seen:
        for f in feats:
            for x in f:
                tally[x] = tally.get(x, 0) + 1
    names = sorted(x for x, c in tally.items() if c >= least)
    at = {x: k for k, x in enumerate(names)}
    size, longest = len(seen), max((len(y) for _, y, _ in seen), default=0)
    if not size:
        return Chain({}, np.zeros((2, 2, 2)))
    on, gold, same = np.zeros((size, longest), bool), np.zeros((size, longest), np.int64), np.zeros((size, longest), np.int64)
    rows, cols = [], []
    for i, (feats, y, alike) in enumerate(seen):
        on[i, : len(y)], gold[i, : len(y)], same[i, 1 : len(y)] = True, y, alike
        for k, f in enumerate(feats):
            for x in f:
                if x in at:
                    rows.append(i * longest + k)
                    cols.append(at[x])
    rows, cols = np.array(rows), np.array(cols)
    w, steps = np.zeros(len(names)), np.zeros((2, 2, 2))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(steps), np.zeros_like(steps)]]
    blocks_total = on.sum()
    for r in range(1, rounds + 1):
        s = np.bincount(rows, w[cols], minlength=size * longest).reshape(size, longest)
        node = np.stack([np.zeros_like(s), s], axis=2)
        ahead, behind = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        ahead[:, 0] = node[:, 0]
        for k in range(1, longest):
            went = _sum(ahead[:, k - 1, :, None] + steps[same[:, k]], 1) + node[:, k]
            ahead[:, k] = np.where(on[:, k, None], went, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            came = _sum(steps[same[:, k + 1]] + (node[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(on[:, k + 1, None], came, 0.0)
        whole = _sum(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - whole[:, None, None])[:, :, 1] * on
        gap = (gold - chance) * on
        grad = np.bincount(cols, gap.reshape(-1)[rows], minlength=len(names)) / blocks_total - decay * w / blocks_total * 10
        moves = np.zeros_like(steps)
        for k in range(1, longest):
            joint = np.exp(ahead[:, k - 1, :, None] + steps[same[:, k]] + (node[:, k] + behind[:, k])[:, None, :] - whole[:, None, None]) * on[:, k, None, None]
            for share in (0, 1):
                here = on[:, k] & (same[:, k] == share)
                moves[share] -= joint[here].sum(0)
                np.add.at(moves[share], (gold[here, k - 1], gold[here, k]), 1.0)
        for value, slope, (m, v) in ((w, grad, moments[0]), (steps, moves / blocks_total - decay * steps / blocks_total * 10, moments[1])):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Chain({x: float(w[k]) for x, k in at.items() if abs(w[k]) > 1e-4}, steps)


def main_text(page: str | None, model: Chain) -> str:
    """The main blocks of a page, parted by an empty line."""
    found, title = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, model.decode(found, title)) if y)


def extract(pages: DataFrame, model: Chain, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all but the page, if not given) with ``text``, the main text of each page."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text",) and (keep is not None or c != html_col)]
    whole = "__html" + "_" * max((len(c) for c in keep), default=0)
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias(whole))

    def run(batches):
        for batch in batches:
            for part in slices(batch, whole):
                made = pa.array([main_text(x.as_py(), model) for x in part.column(len(keep))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], names=[*keep, "text"])

    kinds = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])
    return rows.mapInArrow(run, kinds)
