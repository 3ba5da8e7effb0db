"""Benchmark passages in documents by Wu-Manber search over words.

A window is ten consecutive words of an item; a shorter item is one window. All windows of a
length are searched together: a table gives, for the block of words that ends at a position,
how far every window's end must lie ahead, so impossible positions are skipped; where the
shift is zero, the bucket of windows with that last block is compared word by word, at last
by the bytes of the words.

Words are runs of ASCII letters, digits and all other characters above ASCII; A-Z are folded.
Null and empty texts have no words. Items without words are no windows; repeated items count
once by their id; items with a null id mark words but are not listed. The benchmark is
searched in blocks of at most `max_windows` windows, so what a task holds is bounded; every
block is searched in all documents. Repeated documents give repeated rows. Other columns of
the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow, row_key
from tenantlake.llm.textkit import ALNUM, LOWER, Words, chunks, mixed, words_of

WINDOW = 10
BLOCK = 3
SEGMENT = 256
SHIFT_SLOTS = 1 << 20

_ROW = ("row_key bigint, doc_id bigint, n_words bigint, "
        "spans array<struct<start:int,end:int>>, items array<string>")
_TO_SPACE = bytes(i if ALNUM[i] else 0x20 for i in range(256))


def _combined(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(columns[0])
    for column in columns:
        out = mixed(out + column)
    return out


@dataclass
class Patterns:
    """Distinct windows of one length: hashes of their words, their bytes, their items."""

    words: np.ndarray
    text: list[bytes]
    items: list[list[str]]

    def __post_init__(self):
        n, length = self.words.shape
        self.length, self.block = length, min(BLOCK, length)
        self.shift = np.full(SHIFT_SLOTS, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):
            slots = self.slots(_combined(list(self.words[:, end - self.block:end].T)))
            np.minimum.at(self.shift, slots, length - end)
        suffix = _combined(list(self.words[:, length - self.block:].T))
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes, self.low = np.unique(suffix[self.order], return_index=True)
        self.high = np.append(self.low[1:], n)

    @staticmethod
    def slots(blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64(SHIFT_SLOTS - 1)).astype(np.int64)

    def _possible_ends(self, hashes: np.ndarray, first: np.ndarray) -> tuple:
        """Positions with shift zero. All segments of the texts are walked in step."""
        low, high = first[:-1] + self.length - 1, first[1:]
        parts = np.maximum(0, -(-(high - low) // SEGMENT))
        text = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = low[text] + number * SEGMENT
        stop = np.minimum(at + SEGMENT, high[text])
        found, blocks = [], []
        while len(at):
            key = _combined([hashes[at - k] for k in range(self.block - 1, -1, -1)])
            step = self.shift[self.slots(key)].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(at[zero])
                blocks.append(key[zero])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(found), np.concatenate(blocks)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence, by the hashes of the words."""
        ends, blocks = self._possible_ends(hashes, first)
        spot = np.minimum(np.searchsorted(self.suffixes, blocks), len(self.suffixes) - 1)
        real = self.suffixes[spot] == blocks
        ends, spot = ends[real], spot[real]
        sizes = self.high[spot] - self.low[spot]
        starts = np.repeat(ends - self.length + 1, sizes)
        within = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = self.order[np.repeat(self.low[spot], sizes) + within]
        for k in range(self.length):
            same = hashes[starts + k] == self.words[window, k]
            starts, window = starts[same], window[same]
        return starts, window


def build_patterns(items: list[tuple[str | None, str | None]]) -> list[Patterns]:
    """The windows of the items, grouped by their length in words."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        folded = (text or "").encode().translate(LOWER.tobytes()).translate(_TO_SPACE).split()
        for i in range(max(1, len(folded) - WINDOW + 1) if folded else 0):
            owners.setdefault(b" ".join(folded[i:i + WINDOW]), set()).add(item)
    groups: dict[int, list[bytes]] = {}
    for window in sorted(owners):
        groups.setdefault(window.count(b" ") + 1, []).append(window)
    return [Patterns(words_of(group, ALNUM, LOWER).hashes().reshape(len(group), length), group,
                     [sorted(x for x in owners[w] if x is not None) for w in group])
            for length, group in sorted(groups.items())]


def occurrences(words: Words, groups: list[Patterns]) -> Iterator[tuple[int, int, int, list]]:
    """(text, first word in the text, length, items) of every confirmed occurrence."""
    hashes, cached, split = words.hashes(), -1, []
    for group in groups:
        starts, windows = group.search(hashes, words.first)
        order = np.argsort(starts, kind="stable")
        texts = np.searchsorted(words.first, starts, side="right") - 1
        for i in order:
            text = int(texts[i])
            if text != cached:
                low, high = words.text_starts[text:text + 2]
                split = words.data[low:high].tobytes().translate(_TO_SPACE).split()
                cached = text
            at = int(starts[i] - words.first[text])
            if b" ".join(split[at:at + group.length]) == group.text[windows[i]]:
                yield text, at, group.length, group.items[windows[i]]


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def _searcher(items: list[tuple[str | None, str | None]]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = build_patterns(items)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part, texts in chunks(batch):
                words = words_of(texts, ALNUM, LOWER)
                spans: list[list] = [[] for _ in texts]
                found: list[set] = [set() for _ in texts]
                for text, at, length, owners in occurrences(words, groups):
                    spans[text].append((at, at + length))
                    found[text].update(owners)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_key"), part.column("doc_id"), pa.array(words.counts),
                     pa.array([_merged(s) for s in spans], spans_type),
                     pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                    names=["row_key", "doc_id", "n_words", "spans", "items"])

    return search


def contamination(docs: DataFrame, benchmark: DataFrame,
                  max_windows: int = 1 << 18) -> DataFrame:
    """row_key, doc_id, n_words, the spans of hit words, n_hit and the items found."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text"))
    words = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    windows = items.select(F.sum(F.greatest(words, F.lit(1))).alias("n")).first().n or 0
    blocks = max(1, -(-windows // max_windows))
    keyed = docs.select(row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
    parts = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        pairs = [(r.item_id, r.text) for r in own.distinct().collect()]
        parts.append(map_arrow(keyed, _searcher(pairs), _ROW))
    found = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            found = found.unionAll(part)
        found = (found.groupBy("row_key", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            (F.count("*") / blocks).cast("int").alias("rows"))
            .withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).drop("rows", "row"))
    hit = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    return found.withColumn("n_hit", F.size(hit).cast("bigint"))
