"""Deep-shallow sorting of byte strings.

Strings are sorted by multikey quicksort on 8-byte characters to a shallow depth: groups
are parted in three by a pivot's next character, all of a round at once in numpy. Groups that still agree there are ordered by
a blind trie: it branches on single bytes, finds a string's place by a blind descent
and one comparison with a leaf, and so reads a long common prefix once, not once a byte.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 128


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Leaves are string numbers; an inner node is [depth, {byte or -1 at an end: child}]."""

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.same: dict[int, list[int]] = {}
        self.root: int | list = members[0]
        self.same[members[0]] = []
        for m in members[1:]:
            self._insert(m)

    def _branch(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def _insert(self, m: int) -> None:
        s = self.strings[m]
        node = self.root
        while isinstance(node, list):
            child = node[1].get(self._branch(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = self.strings[node]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            self.same[node].append(m)
            return
        self.same[m] = []
        parent, key, at = None, None, self.root
        while isinstance(at, list) and at[0] < depth:
            parent, key = at, self._branch(s, at[0])
            at = at[1][key]
        if isinstance(at, list) and at[0] == depth:
            at[1][self._branch(s, depth)] = m
            return
        fresh = [depth, {self._branch(other, depth): at, self._branch(s, depth): m}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][key] = fresh

    def ordered(self) -> tuple[list[int], list[int]]:
        """String numbers in order, and each one's common prefix with the one before (the first: -1)."""
        order, lcp = [], []
        stack: list[tuple[int | list, int]] = [(self.root, -1)]
        while stack:
            node, prefix = stack.pop()
            if isinstance(node, list):
                keys = sorted(node[1], reverse=True)
                for k in keys[:-1]:
                    stack.append((node[1][k], node[0]))
                stack.append((node[1][keys[-1]], prefix))
            else:
                order.append(node)
                lcp.append(prefix)
                for twin in self.same[node]:
                    order.append(twin)
                    lcp.append(len(self.strings[node]))
        return order, lcp


class _Characters:
    """The 8-byte characters of strings: a number, and how many of its bytes the string has."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        raw = np.frombuffer(b"".join(strings) + bytes(8), dtype=np.uint8)
        self.words = np.ndarray(len(raw) - 7, dtype=">u8", buffer=raw, strides=(1,))

    def at(self, who: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.clip(self.size[who] - depth, 0, 8)
        word = self.words[np.minimum(self.begin[who] + depth, len(self.words) - 1)].astype(np.uint64)
        drop = np.minimum((8 - left) * 8, 63).astype(np.uint64)
        return np.where(left > 0, (word >> drop) << drop, np.uint64(0)), left

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of strings a and b, which are not deep."""
        out, open_, depth = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 0
        while len(open_):
            (wa, la), (wb, lb) = self.at(a[open_], depth), self.at(b[open_], depth)
            xor, equal = wa ^ wb, np.zeros(len(open_), dtype=np.int64)
            for k in range(8):
                equal += (equal == k) & ((xor >> np.uint64(56 - 8 * k)) & np.uint64(255) == 0)
            out[open_] = depth + np.minimum(equal, np.minimum(la, lb))
            open_ = open_[(equal == 8) & (la == 8) & (lb == 8)]
            depth += 8
        return out


def multikey_quicksort(chars: _Characters, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the strings by their first ``shallow`` bytes, where a new group begins, and whether its strings go on.

    Each round parts every unsettled group in three by its middle string's next
    character; the part that equals it goes on to the character after.
    """
    n = len(chars.size)
    order, begins, deep, depth = np.arange(n), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    begins[0] = True
    open_ = np.arange(n) if n > 1 else np.zeros(0, dtype=np.int64)
    while len(open_):
        who = order[open_]
        word, left = chars.at(who, depth[open_])
        first = np.flatnonzero(begins[open_])
        run = np.cumsum(begins[open_]) - 1
        pivot = ((first + np.append(first[1:], len(open_))) // 2)[run]
        less = (word < word[pivot]) | ((word == word[pivot]) & (left < left[pivot]))
        same = (word == word[pivot]) & (left == left[pivot])
        part = 3 * run + np.where(less, 0, np.where(same, 1, 2))
        ranks = np.argsort(part, kind="stable")
        part, same, left = part[ranks], same[ranks], left[ranks]
        order[open_] = who[ranks]
        depth[open_] = depth[open_][ranks] + 8 * same
        new = np.concatenate(([True], part[1:] != part[:-1]))
        begins[open_] = new
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        goes_on = (count > 1) & ~(same & (left < 8))  # equal strings that end here agree wholly
        deep[open_] = goes_on & (depth[open_] >= shallow)
        open_ = open_[goes_on & (depth[open_] < shallow)]
    return order, begins, deep


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and each one's common prefix with the one before it (the first: -1)."""
    n = len(strings)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    chars = _Characters(strings)
    if shallow > 0:
        order, begins, deep = multikey_quicksort(chars, shallow)
    else:
        order, begins, deep = np.arange(n), np.arange(n) == 0, np.ones(n, dtype=bool)
    lcp = np.full(n, -1, dtype=np.int64)
    twin = ~begins & ~deep
    lcp[twin] = chars.size[order[twin]]
    deep_places = np.flatnonzero(deep)
    for places in np.split(deep_places, np.flatnonzero(begins[deep_places])[1:]) if len(deep_places) else []:
        order[places], lcp[places] = BlindTrie(strings, order[places].tolist()).ordered()
    after = np.flatnonzero(begins)[1:]
    lcp[after] = chars.common(order[after - 1], order[after])
    lcp[0] = -1
    return order, lcp
