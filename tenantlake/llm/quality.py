"""Cross-document line frequency.

Lines are normalised (words of letters and digits, lower case, digits alike) and hashed. A
line is frequent on a host if more distinct documents of the host hold it than an absolute
limit, the same at every size of the host; frequent lines are removed, and a document that
loses too much is rejected. Exact copies of a document count as one document of their host.

Null and empty texts have no words and fail the base rules; a null host counts as the
host with the empty name. Repeated rows get equal verdicts each. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow, row_key, settled
from tenantlake.llm.textkit import (
    ALNUM, LOWER_NO_DIGITS, Words, chunks, mixed, span_hashes, sums_by_text, window_hashes,
    words_of)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5

_COUNTS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint")
_MEASURES = ("row_key bigint, doc_id bigint, host string, text_key bigint, " + _COUNTS
             + ", line_hash array<bigint>, line_words array<int>")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that occur twice or more, and of all but the first of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    any_of = np.zeros(len(keys), bool)
    any_of[1:] |= same
    any_of[:-1] |= same
    return order[any_of], order[1:][same]


def _per_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ mixed(text.astype(np.uint64) + np.uint64(1)))


def repeat_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words in windows of five that the text holds twice or more."""
    at = words.windows(WINDOW)
    keys = _per_text(window_hashes(hashes, WINDOW)[at], words.text_of_word[at])
    places = at[_repeated(keys)[0]]
    steps = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + WINDOW, -1)
    return sums_by_text(np.cumsum(steps[:-1]) > 0, words.first)


def dup_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    starts, ends, first = words.lines()
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = _per_text(span_hashes(words.data, starts, ends), text)[filled]
    again = text[filled][_repeated(keys)[1]]
    return np.bincount(again, minlength=len(first) - 1)


def normalised_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (0: no words) and words of every line, and the first line of each text."""
    words = words_of(texts, ALNUM, LOWER_NO_DIGITS)
    starts, ends, first = words.lines()
    low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    hashes = span_hashes(words.hashes(), low, high)
    hashes[high == low] = 0
    return hashes, high - low, first


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            words = words_of(texts)
            hashes = words.hashes()
            chars = (words.data & 0xC0) != 0x80
            inside = np.zeros(len(words.data) + 1, np.int64)
            np.cumsum(chars, out=inside[1:])
            line_hash, line_words, first = normalised_lines(texts)
            at = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("row_key"), part.column("doc_id"), part.column("host"),
                part.column("text_key"), pa.array(words.counts),
                pa.array(sums_by_text(inside[words.ends] - inside[words.starts], words.first)),
                pa.array(sums_by_text(SYMBOLS[words.data], words.text_starts)),
                pa.array(dup_lines(words)), pa.array(repeat_words(words, hashes)),
                pa.ListArray.from_arrays(at, pa.array(line_hash.view(np.int64))),
                pa.ListArray.from_arrays(at, pa.array(line_words, pa.int32())),
            ], names=["row_key", "doc_id", "host", "text_key", "n_words", "word_chars",
                      "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash",
                      "line_words"])


def frequent_lines(measured: DataFrame, min_docs: int) -> DataFrame:
    """(host, line_hash, n_docs) of lines above the limit."""
    lines = measured.select("host", "text_key", F.explode(
        F.array_distinct("line_hash")).alias("line_hash"))
    return (lines.filter("line_hash != 0").distinct()
            .groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"))
            .filter(F.col("n_docs") > min_docs))


def line_quality(docs: DataFrame, host: str = "source", min_docs: int = 10,
                 min_left: float = 0.5) -> DataFrame:
    """Counts, verdict and cleaned text of every document.

    A line goes if more than `min_docs` documents of its host hold it. A document is
    depleted if less than `min_left` of the words in its lines stay.
    """
    keyed = docs.select(
        row_key("doc_id", host, "text").alias("row_key"), "doc_id",
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("text_key"), "text")
    measured = settled(map_arrow(keyed, measure, _MEASURES), "lines")
    frequent = frequent_lines(measured, min_docs)
    lines = measured.select("row_key", "host",
                            F.posexplode("line_hash").alias("pos", "line_hash"))
    removed = (lines.filter("line_hash != 0").join(frequent, ["host", "line_hash"])
               .groupBy("row_key").agg(F.collect_set("pos").alias("removed_lines")))
    joined = measured.join(removed, "row_key", "left").withColumn(
        "removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
    total = F.aggregate("line_words", F.lit(0).cast("bigint"), lambda a, w: a + w)
    gone = F.aggregate("removed_lines", F.lit(0).cast("bigint"),
                       lambda a, p: a + F.element_at("line_words", p + 1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = (total - gone).alias("words_left")
    depleted = (total - gone) < min_left * total
    return joined.select(
        "row_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.size("removed_lines").cast("bigint").alias("n_removed_lines"), left,
        "removed_lines")


def cleaned_texts(docs: DataFrame, judged: DataFrame, host: str = "source") -> DataFrame:
    """Kept documents with their frequent lines taken out of the text."""
    keys = judged.filter("kept").select("row_key", "removed_lines").dropDuplicates(["row_key"])
    lines = F.filter(F.split("doc.text", "\n"),
                     lambda _, i: ~F.array_contains("removed_lines", i))
    keyed = docs.select(F.struct("*").alias("doc"),
                        row_key("doc_id", host, "text").alias("row_key"))
    return (keyed.join(keys, "row_key")
            .select(F.col("doc").withField("text", F.array_join(lines, "\n")).alias("doc"))
            .select("doc.*"))
