"""Repeated passages of words across documents, by seed and extend.

A word goes if it lies in a window of `LENGTH` words that also starts earlier: in a document
with a smaller id, or further ahead in the same one. Seeds are the `SEED` words with the
smallest hash of every window (winnowing, the last of equal ones), so equal windows have equal
seeds at equal places. Seeds are counted over all documents; where one comes twice, it is
extended to the left and to the right by all lengths that make a window it is the seed of.
Extended matches are sorted by (match, doc_id, start) over slices of a range partitioning: all
but the first of equal ones are repeats, and a slice needs one row of the slice before it, so
a passage that is in every document is spread over many tasks. Overlapping repeats of a
document are joined to maximal ones.

What tells tasks which seeds are repeated is one bitmap of 2 ** `filter_bits` bits, whatever
the size of the input; a seed that passes without being repeated costs time, never a result.
Matches are compared by 128 bits: 64 of the window, 64 of its seed.

Null and empty texts have no words. A null id counts as smaller than all others. Repeated rows
(same id and text) are judged alike: neither is the earlier one. Texts that share an id are
told apart by their text. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.frame import bit_filter, map_arrow, settled
from tenantlake.llm.textkit import Words, chunks, window_hashes, words_of

LENGTH = 20
SEED = 10
FILTER_BITS = 27
FLUSH = 1 << 21
NO_ID = -(1 << 63)

_MATCH = "window bigint, seed bigint, doc_id bigint, start bigint, text_key bigint"
_MARK = ("slice int, edge string, window bigint, seed bigint, doc_id bigint, start bigint, "
         "text_key bigint")
_KEPT = "doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, kept string"


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the first word of its seed, hashes of words at all places."""
    hashes = words.hashes()
    grams = window_hashes(hashes, SEED)
    width = LENGTH - SEED + 1
    best = np.arange(len(grams))

    def smaller(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.where(grams[high] <= grams[low], high, low)

    have = 1
    while 2 * have <= width:
        best = smaller(best[:-have], best[have:]) if len(best) > have else best[:0]
        have *= 2
    rest = width - have
    if rest:
        best = smaller(best[:-rest], best[rest:]) if len(best) > rest else best[:0]
    at = words.windows(LENGTH)
    return at, best[at], grams


def _count_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the seeds and how often the task met them, in portions."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["seed", "n"])

    for batch in batches:
        for _, texts in chunks(batch):
            _, seed, grams = seeds(words_of(texts))
            own = grams[seed[np.diff(seed, prepend=-1) != 0]]
            held.append(own)
            size += len(own)
            if size >= FLUSH:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def repeated_seeds(docs: DataFrame) -> DataFrame:
    """Hashes of seeds at two places or more."""
    return (map_arrow(docs.select("text"), _count_seeds, "seed bigint, n bigint")
            .groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed"))


def _extender(known):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            for part, texts in chunks(batch):
                words = words_of(texts)
                at, seed, grams = seeds(words)
                keys = grams[seed]
                kept = bits.has(keys)
                at, keys = at[kept], keys[kept]
                if not len(at):
                    continue
                text = words.text_of_word[at]
                windows = window_hashes(words.hashes(), LENGTH)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows.view(np.int64)), pa.array(keys.view(np.int64)),
                     part.column("doc_id").take(pa.array(text)),
                     pa.array(at - words.first[text]),
                     part.column("text_key").take(pa.array(text))],
                    names=["window", "seed", "doc_id", "start", "text_key"])

    return extend


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted slice that are no first ones; the first rows of its first and of its
    last match (`edge` first and last); and the rows at the place of the former, which are
    repeats if a slice before holds that match (`edge` maybe)."""
    from pyspark import TaskContext

    number, names = TaskContext.get().partitionId(), ["window", "seed", "doc_id", "start"]
    tail, opening = None, None

    def edge(kind: str, values: tuple) -> pa.RecordBatch:
        row = {"slice": number, "edge": kind, **dict(zip(names + ["text_key"], values))}
        return pa.RecordBatch.from_pylist([row], schema=_MARK_SCHEMA)

    for batch in batches:
        if not batch.num_rows:
            continue
        window, seed, doc, start = (batch.column(n).to_numpy() for n in names)
        fresh = np.ones(len(window), bool)
        fresh[1:] = (window[1:] != window[:-1]) | (seed[1:] != seed[:-1])
        if tail is not None:
            fresh[0] = (window[0], seed[0]) != tail[:2]
        firsts = np.flatnonzero(fresh)
        owner = np.cumsum(fresh) - 1
        known = owner >= 0
        first_doc = np.where(known, doc[firsts[owner]] if len(firsts) else 0,
                             tail[2] if tail else 0)
        first_start = np.where(known, start[firsts[owner]] if len(firsts) else 0,
                               tail[3] if tail else 0)
        again = (doc != first_doc) | (start != first_start)
        key = batch.column("text_key").to_numpy()
        if opening is None:
            opening = (window[0], seed[0], doc[0], start[0])
            yield edge("first", (*opening, key[0]))
        maybe = np.logical_and.reduce(
            [c == v for c, v in zip((window, seed, doc, start), opening)])
        if len(firsts):
            i = firsts[-1]
            tail = (window[i], seed[i], doc[i], start[i], key[i])
        where = np.flatnonzero(again | maybe)
        if len(where):
            part = batch.take(pa.array(where))
            fixed = [pa.array(np.full(len(where), number, np.int32)),
                     pa.array(np.where(maybe[where], "maybe", "no").astype(object))]
            yield pa.RecordBatch.from_arrays(
                fixed + [part.column(n) for n in names + ["text_key"]], schema=_MARK_SCHEMA)
    if tail is not None:
        yield edge("last", tail)


_MARK_SCHEMA = pa.schema([("slice", pa.int32()), ("edge", pa.string())] + [
    (n, pa.int64()) for n in ("window", "seed", "doc_id", "start", "text_key")])


def _late_slices(edges: list) -> list[int]:
    """Slices whose first row repeats a match of a slice before.

    Two rows for each slice, so as many as the session has shuffle partitions.
    """
    out, held = [], None
    for row in sorted(edges, key=lambda r: (r.slice, r.edge)):
        if held is None or (row.window, row.seed) != (held.window, held.seed):
            held = row
        elif row.edge == "first" and (row.doc_id, row.start) != (held.doc_id, held.start):
            out.append(row.slice)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text",
                       F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"))


def repeated_windows(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text_key, start of every window whose words also start earlier."""
    keyed = _keyed(docs)
    known = bit_filter(repeated_seeds(keyed), "seed", filter_bits)
    matches = map_arrow(keyed, _extender(known), _MATCH)
    order = ["window", "seed", "doc_id", "start"]
    slices = matches.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = settled(map_arrow(slices, _mark, _MARK), "repeats")
    late = _late_slices(marked.filter("edge in ('first', 'last')").collect())
    return marked.filter((F.col("edge") == "no") | (
        (F.col("edge") == "maybe") & F.col("slice").isin(late))).select(
        "doc_id", "text_key", "start")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part, texts in chunks(batch):
            n_words, spans, kept = [], [], []
            for text, starts in zip(texts, part.column("starts").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if not starts:
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                at = np.sort(np.array(starts, np.int64))
                opens = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + LENGTH)))
                low = at[opens]
                high = at[np.append(opens[1:], len(at)) - 1] + LENGTH
                spans.append([{"start": s, "end": e} for s, e in zip(
                    low.tolist(), high.tolist())])
                rest, before = [], 0
                for s, e in zip(low.tolist(), high.tolist()):
                    rest.extend(words[before:s])
                    before = e
                rest.extend(words[before:])
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()),
                 pa.array(spans, spans_type), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "spans", "kept"])


def without_repeats(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, the maximal repeats of each document as spans of words, and the text
    that is left, words joined by one space."""
    starts = (repeated_windows(docs, filter_bits).groupBy("doc_id", "text_key")
              .agg(F.collect_set(F.col("start").cast("int")).alias("starts")))
    joined = _keyed(docs).join(starts, ["doc_id", "text_key"], "left")
    cut = map_arrow(joined.select("doc_id", "text", "starts"), _cut, _KEPT)
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
