"""Convolutional text classifier for toxic documents, trained with numpy in Spark's tasks.

A word's embedding is the sum of two rows of hashed tables: one by the word, one by its first
five bytes, so inflected forms share the second. Filters of one, two and three words run over the embeddings, each filter
keeps its maximum over the text, and a logistic layer turns the maxima into one logit. The
decision threshold is calibrated per language on documents that training does not see. The
language is guessed from the text alone, by a naive Bayes model over the first table's rows,
and the logit is shifted so that a score of 0.7 is the threshold of that language.

All labelled documents are used, whole and each text once (with the higher of its labels):
three quarters train the network, one quarter, by the hash of the text, sets the thresholds.
Texts are dealt by their hash to slices of bounded size. In an epoch every slice makes the
steps of gradient descent on its texts, from the same network; the changes are averaged over
the slices, those of a table's row over the slices that touched it, in proportion to the
touches. Sums are whole numbers, so the model does not depend on partitions or the order of tasks.

Null and empty texts have no words: their maxima are zero and they get the score of such a
text. Labels that are null or neither 0 nor 1 are not used. An id that is repeated in the
labels is used once, with the higher label. Other columns of the input are ignored. Without
labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow, remainder, settled
from tenantlake.llm.ngram_lm import packed, unpacked
from tenantlake.llm.textkit import ALNUM, LOWER, chunks, span_hashes, words_of

ROWS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 5
DECISION = 0.7
MIN_DOCS = 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: Bytes of labelled text in a slice, on average.
SLICE_BYTES = 12 << 20
#: Changes are added up in steps of 2 ** -32, margins counted in bins of 1 / 1024.
UNIT, BINS, FARTHEST = 2.0 ** 32, 1024, 30


@dataclass
class Network:
    """tables: (2, ROWS, DIM); filters[w]: (w, DIM, FILTERS); out: one weight a filter."""

    tables: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_rows: np.ndarray
    language_prior: np.ndarray
    thresholds: np.ndarray


def bucket_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two table rows of every word, and the first word of every text."""
    words = words_of(texts, ALNUM, LOWER)
    stems = span_hashes(words.data, words.starts, np.minimum(words.ends, words.starts + STEM))
    rows = np.stack((words.hashes(), stems)) & np.uint64(ROWS - 1)
    return rows.astype(np.int32), words.first


def _maxima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Column maxima of the rows of each text, zero at least."""
    out = np.zeros((len(first) - 1, values.shape[1]), np.float32)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled] = np.maximum.reduceat(values, first[:-1][filled], axis=0)
    return np.maximum(out, 0)


def _convolve(embedded: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The filter's value at every word; a text's last words see what follows them as
    nothing because texts are divided by `width - 1` rows of zeros."""
    width = kernel.shape[0]
    out = embedded @ kernel[0]
    for k in range(1, width):
        out[:-k] += embedded[k:] @ kernel[k]
    return out + bias


def _embed(net: Network, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings with two rows of zeros after every text; first row of every text."""
    counts = np.diff(first)
    gaps = np.repeat(np.arange(len(counts)), counts) * 2
    spaced = np.zeros((rows.shape[1] + 2 * len(counts), DIM), np.float32)
    spaced[np.arange(rows.shape[1]) + gaps] = net.tables[0][rows[0]] + net.tables[1][rows[1]]
    return spaced, first + 2 * np.arange(len(first))


def logits(net: Network, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    embedded, bounds = _embed(net, rows, first)
    total = np.full(len(first) - 1, net.out_bias, np.float64)
    for i, kernel in enumerate(net.filters):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        values = _convolve(embedded, kernel, net.bias[part])
        total += _maxima(values, bounds) @ net.out[part]
    return total


def guessed_languages(net: Network, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    score = np.zeros((len(first), len(net.languages)))
    evidence = np.zeros((rows.shape[1] + 1, len(net.languages)))
    np.cumsum(net.language_rows[rows[0]], axis=0, out=evidence[1:])
    score = evidence[first[1:]] - evidence[first[:-1]] + net.language_prior
    return score.argmax(axis=1)


def scores(net: Network, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    shift = net.thresholds[guessed_languages(net, rows, first)]
    raised = logits(net, rows, first) - shift + np.log(DECISION / (1 - DECISION))
    return 1 / (1 + np.exp(-np.clip(raised, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.touches = rate, {}, {}

    def step(self, name, values: np.ndarray, gradient: np.ndarray, at=...) -> None:
        """Update values[at]; rows that are not touched keep their state."""
        m, v = self.state.setdefault(name, (np.zeros_like(values), np.zeros_like(values)))
        self.touches.setdefault(name, np.zeros(len(values), np.int64))[at] += 1
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient ** 2
        values[at] -= self.rate * m[at] / (np.sqrt(v[at]) + 1e-6)


def _initial(counts: pa.Table, toxic: int, others: int) -> Network:
    """The first dimension starts at the log odds of a word's documents, shrunk to 0 where
    fewer than MIN_DOCS toxic or few other documents speak for it.

    counts: table, row and the numbers of toxic and other documents with it, MIN_DOCS at least.
    """
    rng = np.random.default_rng(SEED)
    tables = np.zeros((2, ROWS, DIM), np.float32)
    name, seen = counts["name"].to_numpy(), counts["row"].to_numpy()
    yes, no = counts["yes"].to_numpy(), counts["no"].to_numpy()
    odds = np.log((yes + 0.5) / (no + 0.5)) - np.log((toxic + 1) / (others + 1))
    odds[(yes < MIN_DOCS) & (odds > 0)] = 0
    tables[name, seen, 0] = np.clip(odds, -2, 4) / 2
    for k in range(2):
        own = np.sort(seen[name == k])
        tables[k, own, 1:] = rng.normal(0, 0.02, (len(own), DIM - 1))
    filters = []
    for width in WIDTHS:
        kernel = rng.normal(0, 0.1, (width, DIM, FILTERS)).astype(np.float32)
        kernel[:, 0, :] += 1 / width
        filters.append(kernel)
    bias = -rng.uniform(0.5, 1.5, FILTERS * len(WIDTHS)).astype(np.float32)
    out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
    return Network(tables, filters, bias, out, -1.0, [], np.zeros((ROWS, 0), np.float32),
                   np.zeros(0), np.zeros(0))


def _batch(rows, first, chosen):
    lengths = np.diff(first)[chosen]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(first[:-1][chosen] - bounds[:-1], lengths) + np.arange(bounds[-1])
    return rows[:, at], bounds


def _learn(net: Network, rows, bounds, labels, weights, adam: _Adam) -> None:
    """One step of gradient descent; only the winning positions get a gradient."""
    embedded, starts = _embed(net, rows, bounds)
    wins, tops = [], []
    for i, kernel in enumerate(net.filters):
        values = _convolve(embedded, kernel, net.bias[i * FILTERS:(i + 1) * FILTERS])
        top = np.zeros((len(labels), FILTERS), np.float32)
        win = np.zeros((len(labels), FILTERS), np.int64)
        for t in range(len(labels)):
            if bounds[t + 1] > bounds[t]:
                part = values[starts[t]:starts[t + 1] - 2]
                win[t] = part.argmax(axis=0)
                top[t] = part[win[t], np.arange(FILTERS)]
                win[t] += starts[t]
        wins.append(win)
        tops.append(np.maximum(top, 0))
    pooled = np.concatenate(tops, axis=1)
    error = weights * (1 / (1 + np.exp(-(pooled @ net.out + net.out_bias))) - labels)
    error = (error / len(labels)).astype(np.float32)
    back = error[:, None] * net.out[None, :] * (pooled > 0)
    adam.step("out", net.out, pooled.T @ error + 1e-4 * net.out)
    adam.step("bias", net.bias, back.sum(axis=0))
    net.out_bias -= float(adam.rate * np.sign(error.sum()) * min(1, abs(error.sum()) * 10))
    text_row = np.full(len(embedded), -1, np.int64)
    text_row[np.arange(rows.shape[1]) + 2 * np.repeat(np.arange(len(labels)), np.diff(bounds))] \
        = np.arange(rows.shape[1])
    deltas = np.zeros_like(embedded)
    for i, kernel in enumerate(net.filters):
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        gradient = np.zeros_like(kernel)
        for k in range(kernel.shape[0]):
            for f in range(FILTERS):
                at, g = wins[i][:, f] + k, part[:, f]
                live = np.flatnonzero(g)
                gradient[k, :, f] = embedded[at[live]].T @ g[live]
                np.add.at(deltas, at[live], g[live, None] * kernel[k, :, f])
        adam.step(("filter", i), kernel, gradient)
    touched = np.flatnonzero((text_row >= 0) & deltas.any(axis=1))
    for k in range(2):
        row, spot = np.unique(rows[k][text_row[touched]], return_inverse=True)
        gradient = np.zeros((len(row), DIM), np.float32)
        np.add.at(gradient, spot, deltas[touched])
        adam.step(("table", k), net.tables[k], gradient, row)


def _best_threshold(margins: np.ndarray, yes: np.ndarray, no: np.ndarray) -> float:
    """The middle of the gap with the best F1 (0 where a class is missing); counts by margin."""
    if not yes.sum() or not no.sum():
        return 0.0
    own = np.unique(margins)[::-1]
    place = np.searchsorted(-own, -margins)
    yes, no = (np.bincount(place, x, minlength=len(own)) for x in (yes, no))
    hits, taken = np.cumsum(yes), np.cumsum(yes + no)
    best = int(np.argmax(2 * hits / (taken + hits[-1])))
    below = own[best + 1] if best + 1 < len(own) else own[best] - 1
    return float((own[best] + below) / 2)


def _calibrate(net: Network, counts: pa.Table, min_positive: int = 20) -> None:
    """A threshold for each language; that of all where a language has few positives.

    counts: toxic and other documents by guessed language and bin of their logits."""
    guess, bins, yes, no = (counts[c].to_numpy() for c in ("name", "row", "yes", "no"))
    margins = (bins + 0.5) / BINS
    net.thresholds = np.full(len(net.languages), _best_threshold(margins, yes, no))
    for i in np.unique(guess):
        own = guess == i
        if yes[own].sum() >= min_positive and no[own].sum() >= min_positive:
            net.thresholds[i] = _best_threshold(margins[own], yes[own], no[own])


# --- slices of labelled texts ---------------------------------------------------------------
_SLICE = ("slice int, lengths binary, rows binary, toxic binary, held binary, "
          "langs array<string>")
_COUNTED = "name int, row int, yes bigint, no bigint"
_CHANGED = "name int, row int, weight bigint, " + ", ".join(
    f"c{i} bigint" for i in range(DIM))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table rows of every text; of copies that follow each other in a task mostly one."""
    sent = set()
    for batch in batches:
        for part, texts in chunks(batch):
            keys = part.column("text_key").to_numpy()
            if len(sent) > 1 << 17:
                sent.clear()
            fresh = [i for i, key in enumerate(keys.tolist())
                     if not (key in sent or sent.add(key))]
            rows, first = bucket_pairs([texts[i] for i in fresh])
            yield pa.RecordBatch.from_arrays(
                [part.column("slice").take(pa.array(fresh, pa.int64())), pa.array(keys[fresh]),
                 pa.array([packed(rows[:, low:high].reshape(-1))
                           for low, high in zip(first[:-1], first[1:], strict=True)],
                          pa.binary())], names=["slice", "text_key", "rows"])


def _pack(left: pa.Table, right: pa.Table) -> pa.Table:
    """One row for a slice: its labelled texts by their keys."""
    columns = [x.split()[0] for x in _SLICE.split(", ")]
    known = right.sort_by("text_key")
    keys, wanted = left["text_key"].to_numpy(), known["text_key"].to_numpy()
    own, first = np.unique(keys, return_index=True)
    at = np.searchsorted(own, wanted)
    found = [unpacked(x, np.int32).reshape(2, -1)
             for x in left["rows"].take(pa.array(first[at])).to_pylist()] if len(wanted) else []
    if not found:
        return pa.table([pa.array([], t) for t in (
            pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(),
            pa.list_(pa.string()))], names=columns)
    return pa.table([
        pa.array([known["slice"][0].as_py()], pa.int32()),
        pa.array([packed(np.array([x.shape[1] for x in found], np.int64))]),
        pa.array([packed(np.concatenate(found, axis=1).reshape(-1))]),
        pa.array([packed(known["toxic"].to_numpy().astype(np.int32))]),
        pa.array([packed(known["held"].to_numpy().astype(np.int32))]),
        pa.array([known["lang"].to_pylist()], pa.list_(pa.string()))], names=columns)


class _Slice:
    def __init__(self, row: dict):
        self.number, self.langs = row["slice"], row["langs"]
        lengths = unpacked(row["lengths"], np.int64)
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        self.rows = unpacked(row["rows"], np.int32).reshape(2, -1)
        self.labels = unpacked(row["toxic"], np.int32).astype(np.float32)
        held = unpacked(row["held"], np.int32)
        self.train, self.held = np.flatnonzero(held != 1), np.flatnonzero(held != 0)


def _by_slice(function):
    """Arrow batches from a function that makes one of a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield function(_Slice(batch.slice(i, 1).to_pylist()[0]))

    return run


def _counted(name, row, yes, no) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(name, pa.int32()), pa.array(row, pa.int32()), pa.array(yes, pa.int64()),
         pa.array(no, pa.int64())], names=["name", "row", "yes", "no"])


def _word_documents(part: _Slice) -> pa.RecordBatch:
    """Training documents of both classes by table and row."""
    rows, first = _batch(part.rows, part.first, part.train)
    text = np.repeat(np.arange(len(part.train)), np.diff(first))
    toxic = part.labels[part.train] > 0
    columns = [[], [], [], []]
    for k in range(2):
        once = np.unique(text * ROWS + rows[k])
        row, spot = np.unique(once % ROWS, return_inverse=True)
        yes = np.bincount(spot, toxic[once // ROWS], minlength=len(row)).astype(np.int64)
        for column, values in zip(columns, (np.full(len(row), k), row, yes,
                                            np.bincount(spot, minlength=len(row)) - yes),
                                  strict=True):
            column.append(values)
    return _counted(*map(np.concatenate, columns))


def _language_words(place: dict):
    """Words by language and row of the first table."""
    def count(part: _Slice) -> pa.RecordBatch:
        lengths = np.diff(part.first)
        number = np.repeat([place.get(x, -1) for x in part.langs], lengths).astype(np.int64)
        keys, counts = np.unique((number * ROWS + part.rows[0])[number >= 0],
                                 return_counts=True)
        return _counted(keys // ROWS, keys % ROWS, counts, np.zeros(len(keys), np.int64))

    return count


def _dense(net: Network) -> np.ndarray:
    """All weights but the tables, in rows as long as those of the tables."""
    values = np.concatenate([*(x.ravel() for x in net.filters), net.bias, net.out,
                             [net.out_bias]])
    return np.append(values, np.zeros(-len(values) % DIM)).reshape(-1, DIM)


def _set_dense(net: Network, values: np.ndarray) -> None:
    flat, low = values.ravel().astype(np.float32), 0
    for array in (*net.filters, net.bias, net.out):
        array[...] = flat[low:low + array.size].reshape(array.shape)
        low += array.size
    net.out_bias = float(values.ravel()[low])


def _epoch(model, epoch: int, positive: float):
    """Steps of gradient descent on a slice; the changes times their weights."""
    def learn(part: _Slice) -> pa.RecordBatch:
        start = Network(**model.value)
        net = Network(**{k: v.copy() if isinstance(v, np.ndarray) else v
                         for k, v in model.value.items()})
        net.filters = [x.copy() for x in start.filters]
        adam = _Adam(RATE)
        weights = np.where(part.labels > 0, 0.5 / positive, 0.5 / (1 - positive))
        order = np.random.default_rng([SEED, epoch, part.number]).permutation(part.train)
        for low in range(0, len(order), BATCH):
            chosen = order[low:low + BATCH]
            _learn(net, *_batch(part.rows, part.first, chosen), part.labels[chosen],
                   weights[chosen], adam)
        change = _dense(net) - _dense(start)
        names, rows = [np.full(len(change), 2)], [np.arange(len(change))]
        weight, changes = [np.full(len(change), len(order))], [change]
        for k in range(2):
            touches = adam.touches.get(("table", k), np.zeros(ROWS, np.int64))
            row = np.flatnonzero(touches)
            names.append(np.full(len(row), k))
            rows.append(row)
            weight.append(touches[row])
            changes.append((net.tables[k][row] - start.tables[k][row]).astype(np.float64))
        weight = np.concatenate(weight)
        whole = np.rint(np.concatenate(changes) * weight[:, None] * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(names), pa.int32()),
             pa.array(np.concatenate(rows), pa.int32()), pa.array(weight, pa.int64()),
             *(pa.array(whole[:, i]) for i in range(DIM))],
            names=["name", "row", "weight", *(f"c{i}" for i in range(DIM))])

    return learn


def _margins(model):
    """Held documents of both classes by guessed language and bin of the logit."""
    def count(part: _Slice) -> pa.RecordBatch:
        net = Network(**model.value)
        found = [np.zeros((3, 0), np.int64)]
        for low in range(0, len(part.held), BATCH):
            chosen = part.held[low:low + BATCH]
            rows, first = _batch(part.rows, part.first, chosen)
            values = np.clip(logits(net, rows, first), -FARTHEST, FARTHEST)
            found.append(np.stack((guessed_languages(net, rows, first),
                                   np.floor(values * BINS).astype(np.int64),
                                   (part.labels[chosen] > 0).astype(np.int64))))
        found = np.concatenate(found, axis=1)
        return _counted(found[0], found[1], found[2], 1 - found[2])

    return count


def _sums(slices: DataFrame, function, least: int = 1) -> pa.Table:
    counted = map_arrow(slices, _by_slice(function), _COUNTED)
    return counted.groupBy("name", "row").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter(
            F.col("yes") + F.col("no") >= least).toArrow()


def _labelled_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and texts that may train; text_key, toxic, lang and held of the labelled texts."""
    usable = (labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", 3) != 1))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    own = docs.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1)).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text",
        F.nullif(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    texts = own.select("doc_id", "text_key", "lang", F.coalesce(
        F.octet_length("text"), F.lit(0)).alias("size")).join(usable, "doc_id")
    held = (F.shiftright("text_key", 40).bitwiseAND(3) == 0).cast("int").alias("held")
    return own, settled(texts.groupBy("text_key").agg(
        F.max("toxic").alias("toxic"), F.min("lang").alias("lang"),
        F.max("size").cast("long").alias("size")).select("*", held), "labelled")


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on all labelled documents, whole texts."""
    own, known = _labelled_texts(docs, labels)
    groups = known.groupBy("toxic", "held").agg(
        F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    count = {(r.toxic, r.held): r.n for r in groups}
    if len({r.toxic for r in groups}) < 2:
        return None
    if len(count) < 4:
        # Too few to keep some apart: 2 stands for both uses.
        known = known.withColumn("held", F.lit(2))
        count = {(t, 0): count.get((t, 0), 0) + count.get((t, 1), 0) for t in (0, 1)}
    n_slices = max(1, -(-sum(r["size"] for r in groups) // SLICE_BYTES))
    dealt = F.pmod("text_key", F.lit(n_slices)).cast("int").alias("slice")
    features = map_arrow(own.select(dealt, "text_key", "text"), _features,
                         "slice int, text_key bigint, rows binary")
    slices = settled(features.groupBy("slice").cogroup(
        known.select("*", dealt).groupBy("slice")).applyInArrow(_pack, _SLICE), "slices")

    toxic, others = count[1, 0], count[0, 0]
    net = _initial(_sums(slices, _word_documents, MIN_DOCS), toxic, others)
    context = docs.sparkSession.sparkContext
    for epoch in range(EPOCHS):
        model = context.broadcast(vars(net))
        changed = map_arrow(slices, _by_slice(_epoch(model, epoch, toxic / (toxic + others))),
                            _CHANGED).groupBy("name", "row").agg(*(
                                (F.sum(f"c{i}") / F.sum("weight") / UNIT).cast("float")
                                .alias(f"c{i}") for i in range(DIM))).toArrow()
        model.destroy()
        name, row = changed["name"].to_numpy(), changed["row"].to_numpy()
        change = np.stack([changed[f"c{i}"].to_numpy() for i in range(DIM)], axis=1)
        for k in range(2):
            net.tables[k][row[name == k]] += change[name == k]
        dense = _dense(net)
        dense[row[name == 2]] += change[name == 2]
        _set_dense(net, dense)

    by_lang = known.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    number = {r.lang: r.n for r in by_lang.collect()}
    net.languages = sorted(number) or [""]
    words = _sums(slices, _language_words({x: i for i, x in enumerate(net.languages)}))
    net.language_rows = np.full((ROWS, len(net.languages)), 0.1, np.float32)
    net.language_rows[words["row"].to_numpy(), words["name"].to_numpy()] += words["yes"].to_numpy()
    net.language_rows /= net.language_rows.sum(axis=0, dtype=np.float64)
    np.log(net.language_rows, out=net.language_rows)
    texts = np.array([number.get(x, 0) for x in net.languages], np.float64)
    net.language_prior = np.log((texts + 1) / (texts.sum() + len(texts)))
    net.thresholds = np.zeros(len(net.languages))
    model = context.broadcast(vars(net))
    _calibrate(net, _sums(slices, _margins(model)))
    model.destroy()
    return net


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**model.value) if model.value else None
        for batch in batches:
            for part, texts in chunks(batch):
                n = len(texts)
                value, language = np.zeros(n), [None] * n
                if net is not None:
                    rows, first = bucket_pairs(texts)
                    value = scores(net, rows, first)
                    guess = guessed_languages(net, rows, first)
                    language = [net.languages[i] for i in guess]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(value),
                     pa.array((value >= DECISION).astype(np.int32)),
                     pa.array(language, pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "text_lang"])

    return score


def _trained(docs: DataFrame, labels: DataFrame):
    net = train(docs, labels)
    return docs.sparkSession.sparkContext.broadcast(vars(net) if net else None)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the guessed language of every document."""
    keyed = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return map_arrow(keyed, _scorer(_trained(docs, labels)),
                     "doc_id bigint, held_out boolean, score double, predicted int, "
                     "text_lang string")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that are not predicted toxic. Nothing is shuffled."""
    model = _trained(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**model.value) if model.value else None
        for batch in batches:
            for part, texts in chunks(batch):
                if net is not None:
                    part = part.filter(pa.array(scores(net, *bucket_pairs(texts)) < DECISION))
                yield part

    return map_arrow(docs, keep, docs.schema)
