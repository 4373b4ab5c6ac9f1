"""Token-set similarity, for which Spark has no builtin: of two strings, and of one string to many at once."""

from __future__ import annotations

import numpy as np


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of an integer for each place of ``a``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Likeness by insertions and deletions, 0 to 1."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """The best likeness among the shared tokens and either side's tokens put after them; 1 if one holds the other."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_x or not only_y):
        return 1.0
    with_x, with_y = (f"{shared} {o}".strip() for o in (only_x, only_y))
    # the shared start is alike on both sides: only the rests differ
    apart = len(only_x) + len(only_y) - 2 * common_length(only_x, only_y)
    best = 1 - apart / (len(with_x) + len(with_y))
    if shared:
        best = max(best, *(1 - (len(w) - len(shared)) / (len(w) + len(shared)) for w in (with_x, with_y)))
    return best


class Labels:
    """Labels that addresses are compared with: an inverted index of their tokens, and what bounds need of each.

    For one address, the shared tokens of all labels are read off the index. From their lengths follows what the shared
    tokens alone are worth, and with the letters that only one side holds, the most that the rest can be worth. Labels
    are scored in order of that bound, until it falls below the best score.
    """

    def __init__(self, labels: list[str | None], ids: list[str]):
        self.labels = [x or "" for x in labels]
        # of equal scores the least id: labels are looked at in its order
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or ""))
        sets = [set(self.labels[i].split()) for i in self.order]
        at: dict[str, list[int]] = {}
        for k, tokens in enumerate(sets):
            for t in tokens:
                at.setdefault(t, []).append(k)
        self.at = {t: np.array(ks) for t, ks in at.items()}
        self.count = np.array([len(s) for s in sets], np.int64)
        self.size = np.array([sum(map(len, s)) + max(0, len(s) - 1) for s in sets], np.int64)
        self.letters = np.stack([self.held(s) for s in sets]) if sets else np.zeros((0, 64), np.int16)

    @staticmethod
    def held(tokens: set[str]) -> np.ndarray:
        """How often a set of tokens holds each letter, letters by their code modulo 64."""
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32) % 64
        return np.bincount(codes, minlength=64).astype(np.int16)

    def best(self, text: str, threshold: float, place: str | None = None) -> tuple[int, float] | None:
        """The place and score of the most similar label that reaches the threshold (and holds ``place``)."""
        tokens = set(text.split())
        if not tokens or not len(self.count):
            return None
        chars, shared = np.zeros(len(self.count), np.int64), np.zeros(len(self.count), np.int64)
        for t in tokens:
            ks = self.at.get(t)
            if ks is not None:
                shared[ks] += 1
                chars[ks] += len(t)
        x, y, n = sum(map(len, tokens)) + len(tokens) - 1, self.size, chars + np.maximum(shared - 1, 0)
        apart = np.abs(self.letters - self.held(tokens)).sum(1)
        bound = 1 - apart / np.maximum(x + y, 1)
        some = shared > 0
        bound = np.where(some, np.maximum(bound, np.maximum(1 - (x - n) / np.maximum(x + n, 1), 1 - (y - n) / np.maximum(y + n, 1))), bound)
        bound[some & ((shared == len(tokens)) | (shared == self.count))] = 1.0
        bound[self.count == 0] = -1.0
        top, found = threshold, None
        hopeful = np.flatnonzero(bound >= threshold - 1e-9)
        for k in hopeful[np.argsort(-bound[hopeful], kind="stable")].tolist():
            if bound[k] < top - 1e-9:
                break
            label = self.labels[self.order[k]]
            if place is not None and place not in label:
                continue
            score = token_set_ratio(text, label)
            if score >= threshold and (found is None or score > top or (score == top and k < found)):
                top, found = score, k
        return None if found is None else (self.order[found], top)
