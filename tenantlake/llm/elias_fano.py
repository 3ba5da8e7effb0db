"""Elias-Fano sequences and the n-gram trie built from them, in memory-mapped files.

A rising sequence of n values below u keeps l = log2(u / n) low bits of each value packed one
after another, and the high parts as a bit vector with one set bit a value. Each level of the
trie is one such sequence: a node's children are a range of it, made rising over the whole
level by adding the node's place times the width of the level's alphabet.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Log probabilities are kept in steps of this many decades, one byte each.
STEP = 0.06


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 255).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * -STEP


class EliasFano:
    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray):
        """`low` and `high` are byte arrays, possibly mapped from a file."""
        self.n, self.universe, self.low, self.high = n, universe, low, high
        self.bits = self.low_bits(n, universe)
        bits = np.unpackbits(high, bitorder="little")[:n + (universe >> self.bits) + 1]
        self._ones = np.flatnonzero(bits)
        zeros = np.flatnonzero(bits == 0)
        self._bucket = np.concatenate(([0], zeros - np.arange(len(zeros))))
        self._words = np.ndarray(max(0, len(low) - 7), "<u8", low, 0, (1,))

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, min(56, (max(1, universe) // max(1, n)).bit_length() - 1))

    @classmethod
    def parts(cls, values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray]:
        """Low and high bytes of rising values below the universe."""
        n, values = len(values), values.astype(np.uint64)
        width = cls.low_bits(n, universe)
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(),
                          bitorder="little")
        high = np.zeros(n + (universe >> width) + 1, np.uint8)
        high[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        return (np.concatenate((low, np.zeros(8, np.uint8))),
                np.packbits(high, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word = self._words[at >> 3] >> (at & 7).astype(np.uint64)
        return word & np.uint64((1 << self.bits) - 1)

    def values(self, i: np.ndarray) -> np.ndarray:
        high = (self._ones[i] - i).astype(np.uint64) << np.uint64(self.bits)
        return (high | self._low(i)).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Places of values in the sequence, -1 where they are missing."""
        if not self.n:
            return np.full(len(asked), -1)
        bucket = asked >> self.bits
        low, end = self._bucket[bucket], self._bucket[bucket + 1]
        wanted = asked.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        high = end.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self._low(np.minimum(middle, self.n - 1)) < wanted)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        spot = np.minimum(low, self.n - 1)
        return np.where((low < end) & (self._low(spot) == wanted), spot, -1)


class Store:
    """Named arrays in one file each below a folder, mapped when they are read."""

    def __init__(self, folder: str):
        self.folder = folder

    def put(self, name: str, array: np.ndarray) -> None:
        array.tofile(os.path.join(self.folder, name))

    def get(self, name: str, dtype=np.uint8) -> np.ndarray:
        path = os.path.join(self.folder, name)
        if not os.path.getsize(path):
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, mode="r")

    def put_sequence(self, name: str, values: np.ndarray, universe: int) -> None:
        low, high = EliasFano.parts(values, universe)
        self.put(name + ".low", low)
        self.put(name + ".high", high)
        with open(os.path.join(self.folder, name + ".json"), "w") as file:
            json.dump([len(values), int(universe)], file)

    def sequence(self, name: str) -> EliasFano:
        with open(os.path.join(self.folder, name + ".json")) as file:
            n, universe = json.load(file)
        return EliasFano(n, universe, self.get(name + ".low"), self.get(name + ".high"))


def _log_share(count: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of the mass a context leaves to the lower order (Witten and Bell)."""
    return np.log10(kinds / (count + kinds))


def build(folder: str, group: np.ndarray, before: np.ndarray, word: np.ndarray,
          count: np.ndarray, lower: np.ndarray, n_before: int, n_words: int) -> None:
    """Write the trie of rows (group, before, word), sorted and distinct, count > 0.

    `group` is a last context word (or a class of its successors), `before` the word before
    that (-1: none is kept), both as small numbers; `lower` is the probability of the word in the lowest order.
    """
    store = Store(folder)
    groups, first = np.unique(group, return_index=True)
    pairs, pair_of = np.unique(group * n_words + word, return_inverse=True)
    pair_group = np.searchsorted(groups, pairs // n_words)
    pair_count = np.bincount(pair_of, count, minlength=len(pairs))
    pair_lower = np.zeros(len(pairs))
    pair_lower[pair_of] = lower
    group_count = np.bincount(pair_group, pair_count, minlength=len(groups))
    group_kinds = np.bincount(pair_group, minlength=len(groups))
    chance = ((pair_count + group_kinds[pair_group] * pair_lower)
              / (group_count + group_kinds)[pair_group])
    pointer = np.searchsorted(pair_group, np.arange(len(groups) + 1))
    store.put_sequence("groups", groups, int(groups[-1]) + 1 if len(groups) else 1)
    store.put_sequence("pair_pointers", pointer, len(pairs) + 1)
    store.put_sequence("pairs", pair_group * n_words + pairs % n_words,
                       max(1, len(groups)) * n_words)
    store.put("pair_logs", quantised(np.log10(chance)))
    store.put("group_left", quantised(_log_share(group_count, group_kinds)))

    deep = before >= 0
    count, pair_of = count[deep], pair_of[deep]
    contexts = np.searchsorted(groups, group[deep]) * n_before + before[deep]
    own, context_of = np.unique(contexts, return_inverse=True)
    context_count = np.bincount(context_of, count, minlength=len(own))
    context_kinds = np.bincount(context_of, minlength=len(own))
    triple = ((count + context_kinds[context_of] * chance[pair_of])
              / (context_count + context_kinds)[context_of])
    # A third word is its place among the successors of its second word's group.
    place = pair_of - pointer[pair_group[pair_of]]
    width = int(place.max(initial=0)) + 1
    order = np.lexsort((place, context_of))
    store.put_sequence("contexts", own, max(1, len(groups)) * n_before)
    store.put_sequence("triples", (context_of * width + place)[order], max(1, len(own)) * width)
    store.put("triple_logs", quantised(np.log10(triple[order])))
    store.put("context_left", quantised(_log_share(context_count, context_kinds)))
    store.put("sizes", np.array([n_before, n_words, width], np.int64))


class Trie:
    def __init__(self, folder: str):
        store = Store(folder)
        self.n_before, self.n_words, self.width = (int(x) for x in store.get("sizes", np.int64))
        self.groups, self.pairs = store.sequence("groups"), store.sequence("pairs")
        self.contexts, self.triples = store.sequence("contexts"), store.sequence("triples")
        self.pointers = store.sequence("pair_pointers")
        self.pair_logs, self.group_left = store.get("pair_logs"), store.get("group_left")
        self.triple_logs = store.get("triple_logs")
        self.context_left = store.get("context_left")

    def logs(self, group: np.ndarray, before: np.ndarray, word: np.ndarray,
             lower: np.ndarray) -> np.ndarray:
        """log10 probability of each word after (before, group); `word` -1: not in it."""
        out = np.log10(lower)
        spot = self.groups.find(np.minimum(group, self.groups.universe - 1))
        known = np.flatnonzero((spot >= 0) & (group < self.groups.universe))
        spot, own = spot[known], word[known]
        pair = self.pairs.find(spot * self.n_words + np.maximum(own, 0))
        pair[own < 0] = -1
        out[known] = np.where(pair >= 0, restored(self.pair_logs[pair]),
                              out[known] + restored(self.group_left[spot]))
        context = self.contexts.find(spot * self.n_before + np.maximum(before[known], 0))
        context[before[known] < 0] = -1
        deep = np.flatnonzero(context >= 0)
        known, context, pair, spot = known[deep], context[deep], pair[deep], spot[deep]
        place = pair - self.pointers.values(spot)
        asked = np.where((pair >= 0) & (place < self.width), place, 0)
        triple = self.triples.find(context * self.width + asked)
        triple[(pair < 0) | (place >= self.width)] = -1
        out[known] = np.where(triple >= 0, restored(self.triple_logs[triple]),
                              out[known] + restored(self.context_left[context]))
        return out
