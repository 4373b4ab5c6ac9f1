"""Substring dedup by repeated-phrase automata.

1. Confirm: a passage is the words of all windows of ``WINDOW`` words that share an anchor (`_anchored`), or a run of
   windows of such a passage. Passages recur if a digest of 128 bits of their words does; where passages around one
   anchor differ, their windows are compared word by word. One block sends a passage once, however often it holds it.
2. Compile: the distinct confirmed passages that a block of documents may hold make one shard of Aho-Corasick automata
   (pyahocorasick), over the numbers of the block's distinct words: words match if they are equal.
3. Stream: every document of the block runs through the automaton, which locates every occurrence of every passage. What
   is sent back for a passage is its text, by one place in the block; where else it stands, the automaton tells. The
   words that an occurrence covers are removed.

Windows are judged on the input, not on what is left, and never cross documents.

Defined cases: words are runs without space, tab to carriage return, kept unchanged, of any length. Null, empty and
blank texts have no words; texts of fewer words than a window lose none; a very long text is a block of its own, taken
in steps. Rows of equal id or text are rows of their own (a copied row makes all its windows recur). An empty table
gives an empty table. Columns other than id and text play no part.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areaweave.llm import _anchored, _blocks
from areaweave.llm._hash import window_hashes, word_hashes

WINDOW, GRAM = 35, 8
#: Places before the gram that share a core, for anchors with very many kinds of passages (see `_anchored`).
WIDTHS = (6, 1)
#: Bytes of passages that are compared at a time, besides those of the last anchor.
COMPARE_BYTES = 4 << 20
#: A word goes through the automaton as two letters: the upper part of its number, and the lower.
_BITS, _UPPER, _LOWER = 8, 0x20000, 0x100


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that single blanks part."""
    blank = np.flatnonzero(raw == 32)
    return (np.concatenate([[0], blank + 1]), np.concatenate([blank, [len(raw)]])) if len(raw) else (np.zeros(0, np.int64),) * 2


def _view(gram: int):
    def view(raw: np.ndarray, offsets: np.ndarray):
        text = raw.tobytes()
        starts, ends = bounds(raw)

        def hashes(begin: int, end: int) -> np.ndarray:
            a, z = int(starts[begin]), int(ends[end - 1])
            return window_hashes(word_hashes(raw[a:z], starts[begin:end] - a, ends[begin:end] - a), gram)

        return hashes, lambda a, b: text[starts[a] : ends[b - 1]]

    return view


def _symbols(data: bytes):
    words = data.split(b" ")
    return lambda a, b: b" ".join(words[a:b])


def _solve(size: int):
    """The windows that stand in two of the contexts, or twice in one, or in one that is whole; word by word."""

    def solve(contexts: list[bytes], whole: np.ndarray, keys: list) -> list[np.ndarray]:
        split, seen = [], Counter()
        for c, w in zip(contexts, whole.tolist()):
            starts, ends = bounds(np.frombuffer(c, np.uint8))
            own = [c[a:z] for a, z in zip(starts.tolist(), ends[size - 1 :].tolist())]
            split.append(own)
            for x in own:
                seen[x] += 1 + w
        return [np.array([k for k, x in enumerate(own) if seen[x] > 1], np.int64) for own in split]

    return solve


class Numbers:
    """The words of a block by number: equal words have equal numbers, and the first of a kind decides which."""

    def __init__(self, raw: np.ndarray):
        self.starts, self.ends = bounds(raw)
        self.text = raw.tobytes()
        index: dict[bytes, int] = {}
        n, parts = len(self.starts), []
        for a in range(0, n, 1 << 17):
            b = min(a + (1 << 17), n)
            words = self.text[self.starts[a] : self.ends[b - 1]].split(b" ")
            parts.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, b - a))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        letters = np.empty((n, 2), np.uint32)
        letters[:, 0], letters[:, 1] = (ids >> _BITS) + _UPPER, (ids & ((1 << _BITS) - 1)) + _LOWER
        self.letters = letters

    def line(self, a: int, b: int) -> str:
        return self.letters[a:b].tobytes().decode("utf-32-le")


def locate(words: Numbers, offsets: np.ndarray, passages: list[tuple[int, int]]) -> np.ndarray:
    """Which words of a block some occurrence of a passage covers; a passage is told by one place, words a to b."""
    edge = np.zeros(len(words.starts) + 1, np.int64)
    if passages:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for a, b in passages:
            automaton.add_word(words.line(a, b), b - a)
        automaton.make_automaton()
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for end, n in automaton.iter(words.line(lo, hi)):
                last = lo + end // 2 + 1
                edge[last - n] += 1
                edge[last] -= 1
    return np.cumsum(edge)[:-1] > 0


def _remove(size: int):
    def run(batches):
        for b in batches:
            whole_at, ranges_at = b.schema.get_field_index("whole"), b.schema.get_field_index("ranges")
            for i in range(b.num_rows):
                _, ids, raw, offsets = _blocks.unpack(b, i)
                words = Numbers(raw)
                passages = {(t["at"][0], t["at"][0] + t["span"] + size) for t in b.column(whole_at)[i].as_py() or []}
                passages |= {(t["first"], t["last"] + size) for t in b.column(ranges_at)[i].as_py() or []}
                covered = locate(words, offsets, sorted(passages))
                kept_texts, spans, counts = [], [], []
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    gone, stay = _blocks.runs(covered[lo:hi]), _blocks.runs(~covered[lo:hi])
                    kept_texts.append(b" ".join([words.text[words.starts[lo + x] : words.ends[lo + y - 1]] for x, y in zip(*(s.tolist() for s in stay))]))
                    spans.append([{"start": x, "end": y} for x, y in zip(*(s.tolist() for s in gone))])
                    counts.append(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "removed", "kept"],
                )

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, gram: int = GRAM, block_bytes: int = _blocks.BLOCK_BYTES, kinds: int = _anchored.KINDS, step: int = _anchored.STEP) -> DataFrame:
    """``doc_id``, ``n_words``, ``removed`` (word spans, end exclusive) and ``kept`` (kept words joined by a space)."""
    blocks, view = _blocks.pack(docs, id_col, text_col, block_bytes, words=True), _view(gram)
    run, schema = _anchored.send(size, gram, view, places=False, step=step)
    known = _anchored.known_contexts(blocks.mapInArrow(run, schema))
    ranges = _anchored.find(blocks, known, size, view, _symbols, _solve(size), WIDTHS, COMPARE_BYTES, kinds)
    return _anchored.told(blocks, known, ranges).mapInArrow(_remove(size), "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string")
