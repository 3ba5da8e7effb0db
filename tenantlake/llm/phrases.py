"""Collocations by stripes.

A phrase is 1 to `LONGEST` words within a piece of text, a piece ends at sentence marks and line
ends; A-Z are folded and every language counts alone. For each length, a prefix keys a stripe:
the associative counter of the words that come next. Tasks sum their own stripes and deal them
to `SHARDS` shards, by prefix and by parts of the next words; parts of one prefix are added up
element by element where the shuffle brings a shard together, so the stripe of a word that is
everywhere is spread over many tasks. From the merged stripes come the extensions (prefix + next word),
the totals of prefixes and rests, and the largest extension of every phrase, which decides
whether a longer phrase subsumes it.

A phrase can only be frequent if its parts are, so pairs are counted only where both words pass
a bitmap of the frequent words, and longer phrases only where all their pairs pass one of the
frequent pairs: three passes over the texts. A bitmap has 2 ** `filter_bits` bits at every size
of the input; what passes wrongly is counted and dropped. Words are known by hashes of 64 bits, phrases by those of all their words. Scores are exact.

Null and empty texts have no words, a null language is `und`. Repeated rows count as often as
they come. An empty table gives no row. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.llm.frame import bit_filter, map_arrow, settled
from tenantlake.llm.textkit import (
    LOWER, Words, chunks, mixed, span_hashes, window_hashes, words_of)

LONGEST = 5
PASSES = ((1,), (2,), tuple(range(3, LONGEST + 1)))
SHARDS = 1 << 13
FILTER_BITS = 26
FLUSH = 1 << 21
SALTS = 64

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False

_UNKNOWN = "und"


def _lang_hash(langs: list[str]) -> np.ndarray:
    """A hash of each language, the same in all tasks."""
    spelled = [lang.encode() for lang in langs]
    bounds = np.cumsum([0] + [len(s) for s in spelled])
    return span_hashes(np.frombuffer(b"".join(spelled), np.uint8), bounds[:-1], bounds[1:])


def _columns(length: int) -> list[str]:
    """Words of the prefix, the next word, its count; single words are spelled out."""
    return [f"w{i}" for i in range(length)] + ["n"] + ["spelled"] * (length == 1)


def phrase_hashes(words: np.ndarray, lang: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all phrases of `length` words, in the language of their first word."""
    return mixed(window_hashes(words, length) ^ lang[:max(0, len(words) - length + 1)])


class _Stripes:
    """What one task has counted and not yet sent."""

    def __init__(self, length: int):
        self.length, self.size, self.held, self.langs = length, 0, [], {}

    def clear(self) -> None:
        self.size, self.held = 0, []

    def add(self, lang: np.ndarray, columns: list[np.ndarray], spelled: np.ndarray | None):
        self.held.append((lang, columns, spelled))
        self.size += len(lang)

    def code(self, lang: str) -> int:
        return self.langs.setdefault(lang, len(self.langs))

    def batch(self, longest: int) -> pa.RecordBatch:
        """Stripes side by side, one row for each language and shard; words a phrase does not
        have are null. They are ordered by
        hashes and told apart by their words, so a collision may leave two parts of a stripe,
        to be added up later."""
        lang = np.concatenate([h[0] for h in self.held])
        columns = [np.concatenate([h[1][i] for h in self.held]) for i in range(self.length)]
        prefix = np.full(len(lang), 1, np.uint64)
        for column in columns[:-1]:
            prefix = mixed(prefix * np.uint64(3) + column)
        shard = ((prefix >> np.uint64(13)) + (columns[-1] >> np.uint64(51))) & np.uint64(
            SHARDS - 1)
        order = np.argsort((shard << np.uint64(51)) | (prefix >> np.uint64(38) << np.uint64(25))
                           | (columns[-1] >> np.uint64(39)))
        small = np.int16 if len(self.langs) < 1 << 15 else np.int64
        order = order[np.argsort(lang[order].astype(small), kind="stable")]
        lang, shard, columns = lang[order], shard[order], [c[order] for c in columns]
        fresh = np.ones(len(lang) + 1, bool)
        fresh[1:-1] = (lang[1:] != lang[:-1]) | (shard[1:] != shard[:-1])
        rows = np.flatnonzero(fresh)
        for column in columns:
            fresh[1:-1] |= column[1:] != column[:-1]
        entries = np.flatnonzero(fresh)
        first = entries[:-1]
        offsets = pa.array(np.searchsorted(entries, rows), pa.int32())
        names = pa.array(list(self.langs), pa.string())
        lists = [pa.array(c[first].view(np.int64)) for c in columns]
        lists += [pa.nulls(len(first), pa.int64())] * (longest - self.length)
        lists.append(pa.array(np.diff(entries), pa.int32()))
        if self.held[0][2] is not None:
            lists.append(pa.array(np.concatenate([h[2] for h in self.held])[order][first],
                                  pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(lang[rows[:-1]])), pa.array(shard[rows[:-1]].astype(np.int32)),
             *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
            names=["lang", "shard", *_columns(longest)])


def _counter(lengths: tuple[int, ...], known):
    """Counts phrases of some lengths; `known` passes all parts of one length below them."""
    part_length = lengths[0] - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = [_Stripes(length) for length in lengths]
        for batch in batches:
            for part, texts in chunks(batch):
                words = words_of(texts, _WORD, LOWER)
                if len(words.starts) < lengths[0]:
                    continue
                encoded = pc.fill_null(part.column("lang"), _UNKNOWN).dictionary_encode()
                names = encoded.dictionary.to_pylist()
                lang = encoded.indices.to_numpy()[words.text_of_word]
                hashes = words.hashes()
                piece = np.cumsum(_ENDS[words.data])[words.starts]
                good = np.ones(len(piece), bool)
                if known is not None:
                    good = parts = known.value.has(
                        phrase_hashes(hashes, _lang_hash(names)[lang], part_length))
                for held in stripes:
                    length, n = held.length, len(piece) - held.length + 1
                    if n <= 0:
                        break
                    if known is not None:
                        good = good[:n] & parts[length - part_length:][:n]
                    at = np.flatnonzero(good[:n] & (piece[:n] == piece[length - 1:]))
                    if not len(at):
                        continue
                    codes = np.array([held.code(x) for x in names])
                    held.add(codes[lang[at]], [hashes[at + i] for i in range(length)],
                             _spelled(words, hashes) if length == 1 else None)
                    if held.size >= FLUSH:
                        yield held.batch(lengths[-1])
                        held.clear()
        for held in stripes:
            if held.size:
                yield held.batch(lengths[-1])

    return count


def _spelled(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Every word as bytes, equal ones as one object."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    forms = np.array([data[s:e] for s, e in zip(
        words.starts[first].tolist(), words.ends[first].tolist())], object)
    return forms[back]


def _hash_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        phrase = batch.column("phrase")
        flat = phrase.flatten().to_numpy().view(np.uint64)
        length = len(flat) // batch.num_rows
        encoded = batch.column("lang").dictionary_encode()
        lang = _lang_hash(encoded.dictionary.to_pylist())[encoded.indices.to_numpy()]
        own = phrase_hashes(flat, np.repeat(lang, length), length)[::length]
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["hash"])


def merged_stripes(docs: DataFrame, lengths: tuple[int, ...], known=None) -> DataFrame:
    """lang, phrase (hashes of its words), n, and the word itself for length 1: the stripes of
    all prefixes, added up element by element."""
    names = _columns(lengths[-1])
    kinds = {"n": "array<int>", "spelled": "array<string>"}
    schema = ", ".join(f"{c} {kinds.get(c, 'array<bigint>')}" for c in names)
    parts = map_arrow(docs.select(F.col("lang").cast("string").alias("lang"), "text"),
                      _counter(lengths, known), f"lang string, shard int, {schema}")
    entries = (parts.repartition("shard")
               .select("lang", "shard", F.explode(F.arrays_zip(*names)).alias("entry"))
               .select("lang", "shard", "entry.*"))
    keys = [c for c in names if c != "n"]
    words = F.array_compact(F.array(*[F.col(c) for c in names if c.startswith("w")]))
    spelled = F.col("spelled") if lengths == (1,) else F.lit(None).cast("string")
    return (entries.groupBy("lang", "shard", *keys).agg(F.sum("n").alias("n"))
            .select("lang", words.alias("phrase"), "n", spelled.alias("spelled")))


def frequent_phrases(docs: DataFrame, min_count: int,
                     filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to LONGEST words with `min_count` occurrences or more, and words a language."""
    words = settled(merged_stripes(docs, PASSES[0]), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    levels, known = [words.filter(F.col("n") >= min_count)], None
    for lengths in PASSES[1:]:
        if known is not None:
            known.unpersist()
        known = bit_filter(map_arrow(levels[-1].select("lang", "phrase"), _hash_phrases,
                                     "hash bigint"), "hash", filter_bits)
        found = merged_stripes(docs, lengths, known).filter(F.col("n") >= min_count)
        levels.append(settled(found, f"phrases{lengths[0]}"))
    return reduce(DataFrame.unionByName, levels), totals


def _weakest_cuts(candidates: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """The cut of every candidate with the lowest score, and the candidate's counts."""
    size = F.size("phrase")
    cuts = candidates.select(
        "lang", "phrase", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.slice("phrase", 1, F.col("k")).alias("first"),
        F.slice("phrase", F.col("k") + 1, size).alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    exact = "decimal(20,0)"
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(
        totals, "lang").withColumn("score", F.expr(
            f"(cast(1000 * cast(a as {exact}) as decimal(23,0)) * cast(total as decimal(15,0)))"
            f" div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return (joined.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("total").alias("n"), best)
        .select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r"))


def subsumed(candidates: DataFrame) -> DataFrame:
    """lang, phrase and the count of its most frequent extension by one word. A longer phrase
    around it with as many occurrences has one in between, so one word is enough."""
    longer = candidates.filter(F.size("phrase") > 2)
    size = F.size("phrase") - 1
    sides = [longer.select("lang", F.slice("phrase", start, size).alias("phrase"), "n")
             for start in (1, 2)]
    return sides[0].unionByName(sides[1]).groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """The `top` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, min_count, filter_bits)
    known = phrases.select("lang", "phrase", "n")
    candidates = known.filter(F.size("phrase") > 1)
    kept = (_weakest_cuts(candidates, known, totals)
            .join(subsumed(candidates), ["lang", "phrase"], "left")
            .filter("longest is null or longest < a").drop("longest"))
    order = [F.desc("score"), F.desc("a")]
    salted = kept.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("place", F.rank().over(
            Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= top)
    chosen = salted.drop("place", "salt")
    spelled = phrases.filter("spelled is not null").select(
        "lang", F.element_at("phrase", 1).alias("word"), "spelled")
    texts = (chosen.select("lang", "phrase", F.posexplode("phrase").alias("pos", "word"))
             .join(spelled, ["lang", "word"])
             .groupBy("lang", "phrase").agg(
                 F.array_sort(F.collect_list(F.struct("pos", "spelled"))).alias("words")))
    named = chosen.join(texts, ["lang", "phrase"]).select(
        "lang", F.array_join("words.spelled", " ").alias("phrase"), "a", "l", "r", "n", "score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return named.select("lang", place.cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                        "score").filter(F.col("rank") <= top)
