"""Periodic runs of words, by Lyndon roots.

A run is a stretch of words with smallest period q, at least 12 words and two periods long,
that no neighbouring word extends. Phase one of Baier's suffix sorter refines groups of
suffixes from the highest to the lowest; when it ends, the context of a suffix's group is the
longest Lyndon word at that place. Every run has a root among these words under the order of
the letters or under its reverse, so both arrays are made, and each root is extended both ways
by longest common extensions (tables of ranks of substrings of 1, 2, 4, ... words, exact).

Every word of a run lies in a window of six words that the run holds twice. So only stretches
of words covered by windows that come again within their stretch are sorted; the hashes that
find them may at worst let more through, since words are then numbered by their bytes.

Null and empty texts have no words and no runs. Each row is judged alone, so repeated rows get
equal results. A task holds one text, or about a megabyte of texts, with its tables. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenantlake.llm.frame import map_arrow
from tenantlake.llm.textkit import Words, chunks, mixed, window_hashes, words_of

SHORTEST = 12
WINDOW = SHORTEST // 2
NARROWINGS = 3

_ROW = ("doc_id bigint, n_words bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def repeated_stretches(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words outside which no run can be."""
    keys = window_hashes(hashes, WINDOW)
    at, stretch = words.windows(WINDOW), words.text_of_word
    for _ in range(NARROWINGS):
        own = mixed(keys[at] ^ mixed(stretch[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        again = np.zeros(len(own), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        kept = at[again]
        steps = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(steps, kept, 1)
        np.add.at(steps, kept + WINDOW, -1)
        covered = np.cumsum(steps[:-1]) > 0
        text = words.text_of_word
        opens = covered & np.concatenate(
            ([True], ~covered[:-1] | (text[1:] != text[:-1])))[:len(covered)]
        stretch = np.cumsum(opens)
        inside = covered[at] & covered[at + WINDOW - 1] & (
            stretch[at] == stretch[at + WINDOW - 1])
        if inside.sum() == len(at):
            break
        at = at[inside]
    starts = np.flatnonzero(opens)
    closes = covered & np.concatenate((opens[1:] | ~covered[1:], [True]))[:len(covered)]
    ends = np.flatnonzero(closes) + 1
    long = ends - starts >= SHORTEST
    return starts[long], ends[long]


def lyndon_lengths(letters: list[int], descending: bool = False) -> np.ndarray:
    """Length of the longest Lyndon word at every place.

    Negative letters separate texts (the first letter has to be one) and get 0. A word that is
    a prefix of another counts as smaller under either order.
    """
    n = len(letters)
    alphabet = sorted({x for x in letters if x >= 0}, reverse=not descending)
    top = len(alphabet)
    number = {x: i for i, x in enumerate(alphabet)}
    group = [number.get(x, -1) for x in letters]
    length = [1] * top + [0]
    below, above = [*range(1, top), -1, 0], [-1, *range(top - 1), -1]
    above[0] = top
    if not top:
        return np.zeros(n, np.int64)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for place, g in enumerate(group):
        if g >= 0:
            members[g].append(place)
    left = list(range(n))
    current = 0
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = []
        for i in own:
            left[i] = i - 1
        hits: dict[int, int] = {}
        for i in own:
            j = left[i]
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i] = j
            if group[j] >= 0:
                hits[j] = hits.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in hits.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:
                old = group[j]
                fresh = moved.get(old)
                if fresh is None:
                    fresh = moved[old] = len(length)
                    length.append(length[old] + c * length[current])
                    members.append([])
                    higher = above[old]
                    below.append(old)
                    above.append(higher)
                    below[higher], above[old] = fresh, fresh
                members[fresh].append(j)
                group[j] = fresh
        current = below[current]
    return np.array([length[g] if g >= 0 else 0 for g in group], np.int64)


class Extensions:
    """Longest common extensions from ranks of substrings of 1, 2, 4, ... letters."""

    def __init__(self, letters: np.ndarray):
        self.n = len(letters)
        ranks = np.unique(letters, return_inverse=True)[1].astype(np.int64)
        self.levels = [ranks.astype(np.int32)]
        width = 1
        while 2 * width <= self.n:
            values, inverse = np.unique(ranks[:-width] * self.n + ranks[width:],
                                        return_inverse=True)
            if len(values) == len(inverse):
                break
            ranks = inverse.astype(np.int64)
            self.levels.append(ranks.astype(np.int32))
            width *= 2

    def _extend(self, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
        total = np.zeros(len(low), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks, width = self.levels[k], 1 << k
            back = 0 if step > 0 else width - 1
            a, b = low + step * total - back, high + step * total - back
            fits = (a >= 0) & (b < len(ranks))
            same = fits.copy()
            same[fits] = ranks[a[fits]] == ranks[b[fits]]
            total += same * width
        return total

    def forward(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many letters from `low` and `high` (low < high) on agree."""
        return self._extend(low, high, 1)

    def backward(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many letters from `low` and `high` (low < high) backwards agree."""
        return self._extend(low, high, -1)


def runs_of(letters: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, ascending; each negative letter comes once."""
    roots = []
    listed = letters.tolist()
    for descending in (False, True):
        sizes = lyndon_lengths(listed, descending)
        at = np.flatnonzero(sizes)
        roots.append(np.stack([at, sizes[at]], axis=1))
    start, size = np.unique(np.concatenate(roots), axis=0).T
    fits = start + size < len(letters)
    start, size = start[fits], size[fits]
    reach = Extensions(letters)
    first = start - reach.backward(start - 1, start + size - 1)
    end = start + size + reach.forward(start, start + size)
    found = np.stack([first, end - first, size], axis=1)
    long = found[:, 1] >= np.maximum(SHORTEST, 2 * found[:, 2])
    return np.unique(found[long], axis=0)


def _letters(words: Words, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """Words of the stretches numbered by their bytes, a separator before each, and the place
    of each letter among the words."""
    data, numbers = words.data.tobytes(), {}
    letters, places = [], []
    for k, (low, high) in enumerate(zip(starts.tolist(), ends.tolist())):
        letters.append(-1 - k)
        letters.extend(numbers.setdefault(data[s:e], len(numbers)) for s, e in zip(
            words.starts[low:high].tolist(), words.ends[low:high].tolist()))
        places.append(np.arange(low - 1, high))
    letters.append(-1 - len(starts))
    return np.array(letters, np.int64), np.concatenate(places)


def text_runs(texts: list[bytes]) -> Iterator[tuple[list[dict], bytes, int]]:
    """Runs, collapsed text and number of words of every text."""
    words = words_of(texts)
    starts, ends = repeated_stretches(words, words.hashes()) if len(words.starts) else ([], [])
    found = np.zeros((0, 3), np.int64)
    if len(starts):
        letters, places = _letters(words, starts, ends)
        found = runs_of(letters)
        found[:, 0] = places[found[:, 0]]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    bounds = np.searchsorted(found[:, 0], words.first)
    for i, text in enumerate(texts):
        own = found[bounds[i]:bounds[i + 1]] - [words.first[i], 0, 0]
        split = text.split()
        if len(own):
            steps = np.zeros(len(split) + 1, np.int64)
            np.add.at(steps, own[:, 0] + own[:, 2], 1)
            np.add.at(steps, own[:, 0] + own[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()
            collapsed = b" ".join([split[k] for k in kept])
        else:
            collapsed = b" ".join(split)
        yield ([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()],
               collapsed, len(split))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            runs, collapsed, n_words = zip(*text_runs(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, _RUNS),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all runs by start and period, and the text in which every run is cut
    to its first period, words joined by one space."""
    return map_arrow(docs.select("doc_id", "text"), _find, _ROW)
