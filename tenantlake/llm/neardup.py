"""Near duplicates by DartMinHash signatures over weighted word shingles.

Every text is a weighted set of its shingles of five words (a repeated shingle weighs up to a
quarter more). Each shingle owns a strip of the plane (weight, rank) with darts that hash
functions throw into it, one per unit of area on average. A text is hit by the darts within
the weights of its shingles; of those assigned to a coordinate the earliest is kept. Ranks are
searched up to a bound at which all coordinates are expected to be hit, and further for texts
where one was not. Coordinates are joined in bands.

Texts that share a band are candidates. In each band's bucket a few centres are compared with
all members of other classes, by the exact Jaccard similarity of the shingle sets; then the
centres leave the bucket. Texts left in buckets of several classes, such as many that share
a passage but are not similar enough, are dealt anew by their rarest shingles, of which
similar sets share one, and compared in the same way until all members of a bucket have one
class. So no link of a bucket is lost, and there are no pairs inside a class.

Exact copies are one node, found by the digest of the text. Words are what white space
separates, A-Z folded; a text of one to four words is one shingle. Empty texts are copies of
one another; a text without words otherwise only has its copies; every null text is a class of
its own, as is every row of it. Repeated rows are copies. The class id is the smallest doc_id
of the class (null if all are null). Other columns are ignored; an empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow, settled
from tenantlake.llm.textkit import (
    LOWER, SPACED, chunks, mixed, window_hashes, words_of)

SHINGLE = 5
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
EXTRA_WEIGHT = 0.25
FIRST_CENTRES = 4
#: Rank intervals below 1; above, every interval is one wide.
EDGES = (0.0, 1 / 64, 1 / 8, 1.0)

def content_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of every text, ascending."""
    words = words_of(texts, SPACED, LOWER)
    hashes, owner = words.hashes(), words.text_of_word
    at = words.windows(SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    whole = np.array([window_hashes(hashes[words.first[t]:words.first[t + 1]],
                                    int(words.counts[t]))[0] for t in short], np.uint64)
    text = np.concatenate((owner[at], short))
    key = np.concatenate((window_hashes(hashes, SHINGLE)[at], whole))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return text[first], key[first], np.diff(np.append(first, len(text)))


def _poisson(area: float) -> np.ndarray:
    """Numbers of darts in a cell of this area, by 16 bits of the cell's hash."""
    terms = np.cumprod(np.concatenate(([np.exp(-area)], area / np.arange(1, 12))))
    even = (np.arange(1 << 16) + 0.5) / (1 << 16)
    return np.searchsorted(np.cumsum(terms), even).astype(np.int64)


_NUMBERS = [_poisson(b - a) for a, b in zip(EDGES, EDGES[1:])]


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index i repeated counts[i] times, and 0, 1, ... within each run."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def _cells(strips: np.ndarray, bound: np.ndarray) -> Iterator[tuple]:
    """(strip, hash, number of darts, low rank, width) of the cells up to the bounds."""
    for level, numbers in enumerate(_NUMBERS):
        live = np.flatnonzero(bound > EDGES[level])
        h = mixed(strips[live] + np.uint64(level + 1))
        yield (live, h, numbers[h >> np.uint64(48)], EDGES[level],
               EDGES[level + 1] - EDGES[level])
    index, number = _places(np.maximum(0, np.ceil(bound) - 1).astype(np.int64))
    h = mixed(strips[index] + (number + 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    yield index, h, _NUMBERS_OF_ONE[h >> np.uint64(48)], number + 1, 1.0


_NUMBERS_OF_ONE = _poisson(1.0)


def _throw(strips: np.ndarray, text: np.ndarray, height: np.ndarray | None,
           bound: np.ndarray, best: np.ndarray) -> None:
    """Throw darts into strips and keep the earliest of each text and coordinate.

    A dart hits if its rank is below the text's bound and its weight below the strip's
    height (None: 1). A kept dart is its rank, then its identity, in one number.
    """
    for index, cell, counts, low, width in _cells(strips, bound[text]):
        own, number = _places(counts)
        h = mixed(cell[own] + (2 * number + 1).astype(np.uint64))
        at = index[own]
        low = low[own] if isinstance(low, np.ndarray) else low
        rank = (low + width * 2.0 ** -24 * (h >> np.uint64(40))).astype(np.float32)
        hit = rank < bound[text[at]]
        if height is not None:
            weight = (mixed(h + np.uint64(1)) >> np.uint64(40)) * 2.0 ** -24
            hit &= weight < height[at]
        rank, h, at = rank[hit], h[hit], at[hit]
        spot = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(COORDINATES)) >> np.uint64(32)
        dart = ((rank.view(np.uint32).astype(np.uint64) << np.uint64(32))
                | ((h ^ (h >> np.uint64(20))) & np.uint64(0xFFFFFFFF)))
        np.minimum.at(best, text[at] * COORDINATES + spot.astype(np.int64), dart)


def signatures(n_texts: int, text: np.ndarray, key: np.ndarray,
               count: np.ndarray) -> np.ndarray:
    """The darts kept for each text and coordinate; texts without shingles have zeros."""
    weight = 1 + EXTRA_WEIGHT * (1 - 1 / count)
    total = np.bincount(text, weight, minlength=n_texts)
    aim = COORDINATES * (np.log(COORDINATES) + 2)
    bound = np.where(total > 0, aim / np.maximum(total, 1e-9), 0)
    heavy = np.flatnonzero(count > 1)
    extra = mixed(key[heavy] + np.uint64(0xD1CE))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_texts * COORDINATES, none)
    open_texts = total > 0
    while open_texts.any():
        most = np.where(open_texts, bound, 0)
        chosen = open_texts[text]
        _throw(mixed(key[chosen]), text[chosen], None, most, best)
        chosen = open_texts[text[heavy]]
        _throw(extra[chosen], text[heavy][chosen], weight[heavy][chosen] - 1, most, best)
        open_texts &= (best.reshape(n_texts, COORDINATES) == none).any(axis=1)
        bound = bound * 2
    return best.reshape(n_texts, COORDINATES)


def band_values(signature: np.ndarray) -> np.ndarray:
    """One hash for each text and band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mixed(out + parts[:, :, k])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch, most=1 << 20):
            text, key, count = shingles(texts)
            values = band_values(signatures(len(texts), text, key, count)).view(np.int64)
            filled = np.bincount(text, minlength=len(texts)) > 0
            at = np.concatenate(([0], np.cumsum(filled * BANDS)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("content"), pa.ListArray.from_arrays(
                    pa.array(at, pa.int32()), pa.array(values[filled].ravel()))],
                names=["doc_id", "content", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            text, key, _ = shingles(texts)
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            low = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("content"),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(low))],
                names=["content", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): hook each root to its smallest
    neighbour, follow the hooks to the end, join again what edges still connect."""
    work = settled(edges.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias(
        "dst")).filter("src != dst").distinct(), "edges")
    labels = None
    while not work.isEmpty():
        hooks = settled(work.groupBy("src").agg(F.min("dst").alias("dst")), "hooks")
        while True:
            after = hooks.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
            longer = settled(hooks.join(after, "dst", "left").select(
                "src", F.coalesce("next", "dst").alias("dst"),
                F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = longer.drop("moved")
            if longer.filter("moved").isEmpty():
                break
        roots = hooks.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        if labels is None:
            labels = roots
        else:
            again = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(again, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")).unionByName(roots)
        moved = (work.join(roots.toDF("src", "a"), "src", "left")
                 .join(roots.toDF("dst", "b"), "dst", "left")
                 .select(F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")))
        work = settled(moved.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias(
            "dst")).filter("src != dst").distinct(), "edges")
    if labels is None:
        return work.toDF("node", "root")
    return settled(labels, "labels")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the wanted Jaccard similarity."""
    left, right = sets.toDF("a", "a_set"), sets.toDF("b", "b_set")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("shared"), F.size("a_set").alias("m"), F.size("b_set").alias("n"))
    return joined.filter(F.col("shared") >= least * (F.col("m") + F.col("n") - F.col("shared"))
                         ).select("a", "b")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the classes that the links join."""
    roots = components(links).toDF("label", "root")
    return members.join(roots, "label", "left").withColumn(
        "label", F.coalesce("root", "label")).drop("root")


def _prefix_buckets(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Buckets by rare shingles instead of bands, for texts that share bands with many others.

    Two sets of the wanted similarity share one of the first shingles of both, in order of
    rarity; how many are the first depends on both sizes, so places and sizes are kept.
    """
    held = members.select("content", "label").distinct().join(sets, "content")
    each = held.select("content", "label", F.size("shingles").alias("size"),
                       F.explode("shingles").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", "bucket")))
    most = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    return (each.join(counts, "bucket").groupBy("content", "label", "size")
            .agg(order.alias("ranked"))
            .select("content", "label", "size",
                    F.posexplode(F.slice("ranked", F.lit(1), most.cast("int")))
                    .alias("place", "r"))
            .filter("r.n > 1").select(
                F.col("r.bucket").cast("long").alias("bucket"), "content", "label", "size",
                (F.col("place") + 1).alias("place")))


def _centres(members: DataFrame, n: int) -> DataFrame:
    """The first `n` contents of every bucket; each task passes on `n` of a bucket at most."""
    order = Window.partitionBy("bucket").orderBy("content")
    return (members.withColumn("number", F.row_number().over(order))
            .filter(F.col("number") <= n)
            .select(F.col("bucket").alias("b_bucket"), F.col("content").alias("b"),
                    F.col("label").alias("b_label"), F.col("size").alias("b_size"),
                    F.col("place").alias("b_place")))


def _linked_classes(members: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """Links between classes; None where no bucket has two classes.

    First each content meets the first centre of all its buckets, which joins most copies of
    a text. Then every member meets the centres of its bucket that have another class, four
    times as many centres in each round, and centres leave. After the first of these rounds
    the buckets are those of rare shingles.
    """
    shared = F.ceil(least / (1 + least) * (F.col("size") + F.col("b_size")) - 1e-9)
    meet = (F.expr("bucket = b_bucket and content != b and label != b_label")
            & (F.col("place") <= F.col("size") - shared + 1)
            & (F.col("b_place") <= F.col("b_size") - shared + 1))
    links, n = None, 0
    members = members.withColumns({"size": F.lit(0), "place": F.lit(0)})
    while True:
        several = members.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        work = settled(members.join(several, "bucket", "left_semi"), "members")
        if work.isEmpty():
            return links
        centres = _centres(work, max(1, n))
        met = work.join(centres, meet)
        if not n:
            met = met.groupBy("content", "label").agg(
                F.min(F.struct("b", "b_label")).alias("c")).select("content", "label", "c.*")
        pairs = settled(met.select(
            F.least("content", "b").alias("a"), F.greatest("content", "b").alias("b"),
            F.least("label", "b_label").alias("x"),
            F.greatest("label", "b_label").alias("y")).distinct(), "pairs")
        found = settled(pairs.join(_similar(pairs.select("a", "b"), sets, least), ["a", "b"])
                        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
                        "links")
        links = found if links is None else links.unionByName(found)
        if n:
            work = work.join(centres.select(F.col("b_bucket").alias("bucket"),
                                            F.col("b").alias("content")),
                             ["bucket", "content"], "left_anti")
        members = work if found.isEmpty() else _relabelled(work, found)
        if n == FIRST_CENTRES:
            several = members.groupBy("bucket").agg(
                F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
            left = members.join(several, "bucket", "left_semi")
            members = settled(_prefix_buckets(left, sets, least), "prefixes")
        n = 4 * n or FIRST_CENTRES


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size, n_copies (rows with this very text) of every document,
    the key of its text (null without one), and whether it stands for its class.

    That is the row with the smallest id; of several texts under that id, the one with the
    smallest key. Null ids come last."""
    keyed = docs.select("doc_id", content_key().alias("content"), "text")
    sketched = settled(map_arrow(keyed.filter("text is not null"), _sketch,
                                 "doc_id bigint, content binary, bands array<bigint>"),
                       "sketches")
    nodes = sketched.groupBy("content").agg(F.first("bands").alias("bands"))
    rows = nodes.select("content", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = settled(rows.join(shared.select("bucket"), "bucket", "left_semi"), "members")
    asked = members.select("content").distinct()
    texts = keyed.join(asked, "content", "left_semi").groupBy("content").agg(
        F.first("text").alias("text"))
    sets = settled(map_arrow(texts, _shingle_sets, "content binary, shingles array<int>"),
                   "shingles")
    links = _linked_classes(members.withColumn("label", F.col("content")), sets, least)
    copies = sketched.groupBy("content").agg(F.min("doc_id").alias("first_id"),
                                             F.count("*").alias("n_copies"))
    if links is not None:
        classes = components(links).toDF("content", "root")
        copies = copies.join(classes, "content", "left")
    else:
        copies = copies.withColumn("root", F.lit(None).cast("binary"))
    copies = settled(copies.withColumn("root", F.coalesce("root", "content")), "nodes")
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "content"))
    sizes = copies.groupBy("root").agg(
        F.min("first_id").alias("class_id"), F.sum("n_copies").alias("class_size"),
        first["content"].alias("best"))
    found = (sketched.select("doc_id", "content")
             .join(copies.join(sizes, "root").drop("root", "first_id"), "content")
             .select("doc_id", "class_id", "class_size", "n_copies", "content",
                     ((F.col("content") == F.col("best"))
                      & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_first")))
    alone = docs.filter("text is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(1).cast("long").alias("n_copies"),
        F.lit(None).cast("binary").alias("content"), F.lit(True).alias("is_first"))
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for their classes; of repeated rows one."""
    winners = classes.filter("is_first").groupBy("doc_id", "content").agg(
        F.count("*").alias("n")).toDF("winner", "winner_text", "n")
    repeated = winners.filter("n > 1")
    same = F.expr("doc.doc_id <=> winner and doc_text <=> winner_text")
    keyed = docs.select(F.struct("*").alias("doc"), content_key().alias("doc_text"))
    kept = keyed.join(winners, same, "left_semi")
    again = kept.join(repeated, same, "left_semi").withColumn("id", F.col("doc.doc_id"))
    single = again.dropDuplicates(["id", "doc_text"]).select("doc")
    return kept.join(repeated, same, "left_anti").select("doc").unionByName(single).select(
        "doc.*")
