"""BPE encoding and decoding by speculation and verification.

A greedy longest match over the vocabulary proposes the tokens of each new word. A sequence of tokens is the
result of the merges exactly if every adjacent pair of it is the result of the merges over that pair alone, so
one vectorised look-up of all adjacent pairs of a batch tells which words are right. Only words with a failing
pair are merged exactly. Words are the unit of work: each distinct word is encoded once per cache generation,
and a document is a gather over its words.

Defined cases: null text is an empty text (no tokens, empty decoded text). Special tokens that stand in a text
become their ids, as the library does by default. Ties between equal merges go to the leftmost. Rows are never
joined or grouped, so repeated rows and repeated ids keep their own results, and extra columns pass through
untouched; result columns replace input columns of the same name. Texts and words of any length are encoded whole. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaweave.llm._common import slices

#: Words kept by a task before the cache starts anew.
CACHE_WORDS = 300_000
#: Bytes of text that are encoded at a time: a slice's words stand apart in memory, at many times their size.
SLICE_BYTES = 1 << 19


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends: normalise, split, propose, verify, merge."""

    def __init__(self, spec: bytes):
        conf = json.loads(spec)
        model = conf["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        codes = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in pairs], np.int64)
        by_code = np.argsort(codes, kind="stable")
        self.pair_codes, self.pair_ranks = codes[by_code], by_code.astype(np.int64)
        self.pair_made = np.array([self.vocab[a + b] for a, b in pairs] + [-1], np.int64)
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        kinds = [n["type"] for n in conf["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unsupported normalizers {kinds}")
        pattern = conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        #: The same split for texts of ASCII characters only, which are in lower case by then.
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.splits = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.alphabet = _byte_alphabet()
        self.plain = set(range(33, 127))
        # a tree of the symbols of all tokens; "" holds the id of a token, "$" that of one that ends a word
        self.tree: dict = {}
        for t, i in self.vocab.items():
            last = bool(self.end) and t.endswith(self.end) and t != self.end
            node = self.tree
            for c in t[: -len(self.end)] if last else t:
                node = node.setdefault(c, {})
            node["$" * last + "id"] = i
        self.fresh()

    def fresh(self) -> None:
        """Forget all words and pairs: what a worker keeps is bounded by the words of one generation."""
        self.compatible: dict[int, bool] = {}
        self.index: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint32)]
        self.decoded: list[str] = []
        self.starts: np.ndarray = np.zeros(1, np.int64)
        self.flat: np.ndarray = np.zeros(0, np.uint32)

    # -- one word ---------------------------------------------------------------------------------------------
    def symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word  # each such byte stands for itself
        return "".join([self.alphabet[b] for b in word.encode("utf-8")])

    def propose(self, s: str) -> list[int] | None:
        """Greedy longest match over the symbols of a word; None if some symbol is in no token."""
        out, at, n, tree = [], 0, len(s), self.tree
        last = "$id" if self.end else "id"
        while at < n:
            node, k, best, end = tree, at, None, at
            for c in s[at:] if at else s:
                node = node.get(c)
                if node is None:
                    break
                k += 1
                t = node.get("id" if k < n else last)
                if t is not None:
                    best, end = t, k
            if best is None:
                return None
            out.append(best)
            at = end
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Exact merging: the pair of least rank first, the leftmost of equals."""
        parts, rank, none = list(parts), self.rank.get, len(self.rank)
        order = [rank(p, none) for p in zip(parts, parts[1:])]
        while order:
            least = min(order)
            if least == none:
                break
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """Exact merging by a heap over a linked list, for words of thousands of symbols."""
        import heapq

        n = len(parts)
        text, nxt, prv, alive = list(parts), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := self.rank.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or text[i] != a or text[j] != b:
                continue
            text[i], alive[j], nxt[i] = a + b, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (r := self.rank.get((text[k], text[nxt[k]]))) is not None:
                    heapq.heappush(heap, (r, k, text[k], text[nxt[k]]))
        return [t for t, ok in zip(text, alive) if ok]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the number of merges where there is none."""
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (a >= 0) & (b >= 0), self.pair_ranks[at], len(self.rank))

    def merge_many(self, rows: list[list[int]]) -> list[list[int]]:
        """Exact merging of many words of like length at once: each round merges one pair of every word."""
        none, width = len(self.rank), max(map(len, rows)) + 1
        ids = np.full((len(rows), width), -1, np.int64)
        for i, r in enumerate(rows):
            ids[i, : len(r)] = r
        order = np.full((len(rows), width), none, np.int64)
        order[:, :-1] = self.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        out, live, column = ids.copy(), np.arange(len(rows)), np.arange(width)[None, :]
        while len(live):
            at = order.argmin(1)
            least = order[np.arange(len(live)), at]
            done = least == none
            if done.any():
                out[live[done]] = ids[done]
                live, ids, order, at, least = live[~done], ids[~done], order[~done], at[~done], least[~done]
                if not len(live):
                    break
            row, after = np.arange(len(live)), column[:, :-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            order[:, :-1] = np.where(after, order[:, 1:], order[:, :-1])
            order[:, -1] = none
            made = self.pair_made[least]
            ids[row, at] = made
            order[row, at] = self.look_up(made, ids[row, np.minimum(at + 1, width - 1)])
            before = at > 0
            order[row[before], at[before] - 1] = self.look_up(ids[row[before], at[before] - 1], made[before])
        return [r[r >= 0].tolist() for r in out]

    def merge_rows(self, rows: list[list[int]]) -> list[list[int]]:
        """Exact merging of words given by the ids of their symbols: those of like length together."""
        out: list[list[int]] = [[]] * len(rows)
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if r:
                groups.setdefault(len(r) if len(r) < 8 else (len(r) + 3) // 4 * 4, []).append(i)
        for size, members in groups.items():
            for k in range(0, len(members), 20_000):
                part = members[k : k + 20_000]
                if size > 64:
                    one = self.merge if size < 200 else self.merge_long
                    made = [[self.vocab[p] for p in one([self.token[t] for t in rows[i]])] for i in part]
                else:
                    made = self.merge_many([rows[i] for i in part])
                for i, m in zip(part, made):
                    out[i] = m
        return out

    def symbol_ids(self, s: str) -> list[int]:
        """The ids of the symbols of a word, the last one marked as such; symbols without an id are left out."""
        get = self.vocab.get
        return [t for t in [*(get(c) for c in s[:-1]), get(s[-1] + self.end)] if t is not None]

    def exact_many(self, symbols: list[str]) -> list[list[int]]:
        return self.merge_rows([self.symbol_ids(s) for s in symbols])

    def exact(self, s: str) -> list[int]:
        parts = list(s)
        parts[-1] += self.end
        parts = [p for p in parts if p in self.vocab]
        merged = self.merge(parts) if len(parts) < 200 else self.merge_long(parts)
        return [self.vocab[p] for p in merged]

    def pieces(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = list(token[: -len(self.end)])
            body[-1] += self.end
            return body
        return list(token)

    def check_pairs(self, codes: list[int]) -> list[bool]:
        """Which pairs of adjacent tokens (or tokens alone, coded with the other absent) survive the merges, all at once."""
        pairs = [([a - 1, b] if a else [b]) for a, b in (divmod(c, 1 << 32) for c in codes)]
        rows = [[self.vocab[p] for t in pair for p in self.pieces(self.token[t])] for pair in pairs]
        return [m == pair for m, pair in zip(self.merge_rows(rows), pairs)]

    # -- many words -------------------------------------------------------------------------------------------
    def learn(self, new: list[str]) -> None:
        """Encode words not met before: propose, test every adjacent pair at once, merge the failures."""
        symbols = [self.symbols(w) for w in new]
        proposed = [self.propose(s) for s in symbols]
        known = [p if p is not None else [] for p in proposed]
        counts = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.array(list(chain.from_iterable(known)), np.int64)
        word = np.repeat(np.arange(len(new)), counts)
        first = np.ones(len(flat), bool)
        first[1:] = word[1:] != word[:-1]
        left = np.zeros(len(flat), np.int64)
        left[1:] = flat[:-1] + 1
        left[first] = 0
        codes, inverse = np.unique((left << 32) | flat, return_inverse=True)
        listed = codes.tolist()
        unmet = [c for c in listed if c not in self.compatible]
        self.compatible.update(zip(unmet, self.check_pairs(unmet)))
        verdict = np.fromiter(map(self.compatible.__getitem__, listed), bool, len(listed))
        failing = np.zeros(len(new), bool)
        np.logical_or.at(failing, word, ~verdict[inverse])
        failing |= np.fromiter((p is None for p in proposed), bool, len(new))
        again = np.flatnonzero(failing).tolist()
        for i, ids in zip(again, self.exact_many([symbols[i] for i in again])):
            known[i] = ids
        token = self.token
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new))))
        self.decoded.extend(" ".join([token[t] for t in p]) for p in known)
        counts = np.fromiter(map(len, known), np.int64, len(known))
        self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(known)), np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own, marked by a leading NUL."""
        if self.splits is not None and "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self.splits.split(text)):
                if i % 2:
                    out.append("\0" + part)
                elif part:
                    out.extend(self._plain_split(part))
            return out
        return self._plain_split(text)

    def _plain_split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.words.findall((text.replace("Σ", "σ") if "Σ" in text else text).lower())

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Little-endian ids and the decoded text of each text."""
        split = [self.split(t) for t in texts]
        new = sorted(set().union(*split).difference(self.index)) if split else []
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self.fresh()
            new = sorted(set().union(*split))
        special = [w for w in new if w[0] == "\0"]
        plain = [w for w in new if w[0] != "\0" or len(w) == 1 or w[1:] not in self.special]
        if plain:
            self.learn(plain)
        for w in special:
            if w[1:] in self.special and w not in self.index:
                self.index[w] = len(self.decoded)
                self.decoded.append(w[1:])
                self.flat = np.append(self.flat, np.uint32(self.special[w[1:]]))
                self.starts = np.append(self.starts, self.starts[-1] + 1)
        out_ids, out_text, get, decoded = [], [], self.index.__getitem__, self.decoded
        for words in split:
            at = np.fromiter(map(get, words), np.int64, len(words))
            begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
            total = int(size.sum())
            ends = np.cumsum(size)
            pos = np.arange(total) - np.repeat(ends - size, size) + np.repeat(begin, size)
            out_ids.append(self.flat[pos].astype("<u4").tobytes())
            out_text.append(" ".join([decoded[i] for i in at.tolist() if self.starts[i + 1] > self.starts[i]] if not size.all() else [decoded[i] for i in at.tolist()]))
        return out_ids, out_text

    def decode(self, ids) -> str:
        return " ".join([self.token[int(i)] for i in ids if int(i) in self.token])


_CODECS: dict[str, WordBpe] = {}


def codec(spec: bytes) -> WordBpe:
    """One codec per Python worker and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = WordBpe(spec)
    return _CODECS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _others(df: DataFrame, made: set[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name.lower() not in made]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids_le`` (binary: ids as little-endian unsigned 32-bit integers) and ``decoded`` (string).

    The vocabulary is read on the driver (a fixed file of a few MB) and broadcast. Texts stream through Arrow
    batches; no shuffle. ``keep`` names the input columns that go along (default: all but the text).
    """
    spark = docs.sparkSession
    names = keep if keep is not None else [c for c in docs.columns if c != text_col]
    fields = [f for f in _others(docs, {"ids_le", "decoded"}) if f.name in names]
    spec = spark.sparkContext.broadcast(_read(tokenizer_path))
    schema = T.StructType([*fields, T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType())])
    rows = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))

    def run(batches):
        yield from encoded(codec(spec.value), batches, [f.name for f in fields])

    return rows.mapInArrow(run, schema)


def encoded(bpe: WordBpe, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``names`` and a text to the same columns and the text's ``ids_le, decoded``.

    A Python worker outlives its task and serves other stages after it, so what it has learnt of words goes with the
    batches; the vocabulary stays.
    """
    n = len(names)
    try:
        for whole in batches:
            for part in slices(whole, "__text", SLICE_BYTES):
                ids, texts = bpe.encode_batch(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[*names, "ids_le", "decoded"])
                del ids, texts
    finally:
        bpe.fresh()
        pa.default_memory_pool().release_unused()


def ids_array(column: str = "ids_le"):
    """The ids of a packed column as an array of longs."""
    h = F.hex(F.col(column))
    n = (F.octet_length(F.col(column)) / 4).cast("int")
    word = lambda i: F.conv(F.concat(*[F.substring(h, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10).cast("long")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), word))


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids_le") -> DataFrame:
    """Add ``decoded``: the text of packed ids, special tokens included, unknown ids left out. Null ids: null."""
    spec = df.sparkSession.sparkContext.broadcast(_read(tokenizer_path))
    fields = [f for f in df.schema.fields if f.name.lower() != "decoded"]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())])
    at = [f.name for f in fields].index(ids_col)

    def run(batches):
        bpe = codec(spec.value)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[f.name for f in fields] + ["decoded"])

    return df.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)
