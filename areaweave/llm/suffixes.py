"""Suffix-array dedup: strings of ``LENGTH`` bytes that start in two places or more.

A suffix array over all bytes of a corpus moves each byte dozens of times. So the texts are first cut down to what can
repeat at all, without losing any repeat (`_anchored`): strings whose anchor occurs once do not repeat, and contexts
that are equal by a digest of 128 bits repeat as a whole. One of each kind of the other contexts goes to the suffix
sort, dealt by gram, so that all places where a string may occur meet, and again by longer cores where one gram has very
many kinds. The difference-cover algorithm sorts them: the suffixes at two of three places by their triples,
recursively on the names of the triples, the rest by a symbol and the rank that follows, and a merge. Strings that repeat
stand next to each other, and adjacent prefixes are compared byte by byte over their whole length.

Defined cases: null text is empty. Matches never cross documents, may overlap, and are judged on the input. Texts
shorter than ``LENGTH`` lose nothing; a very long text is a block of its own, taken in steps. Kept bytes are returned as
binary, as a cut may part a letter. Rows of equal id or text are rows of their own. An empty table gives an empty table.
Columns other than id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areaweave.llm import _anchored, _blocks
from areaweave.llm._hash import MULTIPLIER, mix

LENGTH, GRAM = 400, 64
#: Places before the gram that share a core, for grams with very many kinds of contexts (see `_anchored`).
WIDTHS = (32, 4, 1)
#: Bytes that one suffix array holds, besides the contexts of its last gram.
SORT_BYTES = 400_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, for one step of a text."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for factor in (int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64)):
            p = np.full(size, factor, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams, from running sums of a polynomial. They only choose and group anchors: a clash costs work."""
    n = len(raw)
    if n < gram:
        return np.zeros(0, np.uint64)
    power, back = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[gram:] - sums[: n - gram + 1]) * back[: n - gram + 1])


def _view(gram: int):
    def view(raw: np.ndarray, offsets: np.ndarray):
        text = raw.tobytes()
        return (lambda begin, end: gram_hashes(raw[begin:end], gram)), (lambda a, b: text[a:b])

    return view


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of an array of positive integers, by the difference cover modulo three."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    top = int(s.max()) + 1
    # sort the sampled triples; where n leaves one over, a triple of zeros ends the first kind
    at1, at2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([at1, at2])
    triples = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
    _, names = np.unique(triples, return_inverse=True)
    names = names.astype(np.int64) + 1
    # recurse on the names until they are distinct
    order = np.argsort(names, kind="stable") if int(names.max()) == len(names) else suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    # the remaining suffixes: a symbol and the rank of what follows
    at0, many = np.arange(0, n, 3), len(sample) + 2
    key0 = s[at0] * many + rank[at0 + 1]
    by0 = np.argsort(key0, kind="stable")
    at0, key0 = at0[by0], key0[by0]
    # merge: the place of each remaining suffix among the sampled ones of either kind
    one, two = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(s[one] * many + rank[one + 1], key0)
    wide = (s[at0] * top + s[at0 + 1]) * many + rank[at0 + 2]
    before += np.searchsorted((s[two] * top + s[two + 1]) * many + rank[two + 2], wide)
    out = np.empty(n, np.int64)
    spots = before + np.arange(len(at0))
    free = np.ones(n, bool)
    free[spots] = False
    out[spots], out[free] = at0, sorted12
    return out


def repeated(contexts: list[bytes], whole: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the places at which a repeated string of ``length`` bytes starts.

    A context that is ``whole`` stands for two or more equal ones: its strings repeat whatever else is there.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    s = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    s[first[1:] - 1] = 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    rest = first[owner + 1] - 1 - np.arange(len(s))
    order = suffix_array(s + 1)
    order = order[rest[order] >= length]
    # adjacent prefixes: eight bytes at a time, as long as they agree
    text = (s - 1).astype(np.uint8)
    a, b = order[:-1], order[1:]
    same, live = np.zeros(len(a), bool), np.arange(len(a))
    eight = np.zeros(len(text), np.uint64)
    for k in range(8):
        eight[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for k in reversed(steps):
        live = live[eight[a[live] + k] == eight[b[live] + k]]
    same[live] = True
    hit = np.zeros(len(s), bool)
    hit[a[same]] = hit[b[same]] = True
    hit |= whole[owner] & (rest >= length)
    return [np.flatnonzero(hit[first[i] : first[i + 1]]) for i in range(len(contexts))]


def _solve(length: int):
    return lambda contexts, whole, keys: repeated(contexts, whole, length)


def _strip(length: int):
    def run(batches):
        for b in batches:
            whole_at, ranges_at = b.schema.get_field_index("whole"), b.schema.get_field_index("ranges")
            for i in range(b.num_rows):
                _, ids, raw, offsets = _blocks.unpack(b, i)
                edge = np.zeros(len(raw) + 1, np.int32)
                told = [(x, x + t["span"]) for t in b.column(whole_at)[i].as_py() or [] for x in t["at"]]
                told += [(t["first"], t["last"]) for t in b.column(ranges_at)[i].as_py() or []]
                if told:
                    lo, hi = np.array(told, np.int64).T
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept, spans, sizes = [], [], []
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = covered[x:y]
                    begin, end = _blocks.runs(own)
                    kept.append(raw[x:y][~own].tobytes())
                    spans.append([{"start": p, "end": q} for p, q in zip(begin.tolist(), end.tolist())])
                    sizes.append(y - x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "removed", "kept"],
                )

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, kinds: int = _anchored.KINDS, block_bytes: int = _blocks.BLOCK_BYTES, step: int = _anchored.STEP) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (byte spans, end exclusive) and ``kept`` (the remaining bytes)."""
    blocks, view = _blocks.pack(docs, id_col, text_col, block_bytes), _view(gram)
    run, schema = _anchored.send(length, gram, view, places=True, step=step)
    known = _anchored.known_contexts(blocks.mapInArrow(run, schema))
    ranges = _anchored.find(blocks, known, length, view, lambda data: lambda a, b: data[a:b], _solve(length), WIDTHS, SORT_BYTES, kinds)
    return _anchored.told(blocks, known, ranges).mapInArrow(_strip(length), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
