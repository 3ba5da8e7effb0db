"""Language-model scores of texts from Elias-Fano n-gram tries, one trie a shard.

Tokens are words between white space, A-Z folded, and one end a text. Three tables go round:

1. Texts are packed into chunks: tokens as places in the chunk's list of words, and for each
   word its hash and training count. Word shards add the counts up over the corpus, number the
   words and send number and count back to every chunk that has the word.
2. Each chunk sends its distinct trigrams with training counts to the shard of the middle
   word. The shard builds a trie of its bigrams and trigrams with smoothed and quantised
   probabilities, maps it, looks up every trigram asked for, and sends one byte back for each.
3. Each chunk adds the log probabilities up by text.

The trigrams of a middle word with more training tokens than a shard should hold are dealt to
several shards by classes of the word before, its bigrams by classes of the word that follows.
These shards find in their sequences the counts of what is asked and send them back, and the
chunk makes of them the same probability, quantised in the same places, that the trie of one
shard would have: no score depends on what is split. Probabilities are interpolated after Witten and Bell; the lowest order is the base distribution, which travels
quantised as well. Repeated trigrams reach a shard once a chunk.

What a chunk, a shard or a blob holds is bounded by parameters, the number of chunks and
shards grows with the input. Null texts are empty, and an empty text is one end. Repeated rows
are texts of their own, each counted; a null id trains like remainder 0 (held out). Other
columns are ignored. Without training tokens every word has the probability 1 / (V + 1).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.elias_fano import EliasFano, Trie, build, quantised, restored
from tenantlake.llm.frame import map_arrow, remainder, settled
from tenantlake.llm.textkit import LOWER, SPACED, as_bytes, mixed, sums_by_text, words_of
from tenantlake.session import ship_package

CHUNK_BYTES = 6 << 20
SHARD_TOKENS = 600_000
LEAST_SHARDS = 24
END = np.uint64(0x656E64206F662074)
#: Numbers of words: no word, the start of a text, any word without training count, words.
NONE, START, UNKNOWN, FIRST = -1, 0, 1, 2
#: In place of the word before: a bigram of a split word. With NONE as its word it asks how
#: many words of its class follow.
PAIR = -2

_CHUNK = ("chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, "
          "tokens binary, words binary, counts binary, n_train bigint, n_train_texts bigint")
_LOOKUP = ("chunk bigint, shard int, places binary, ids binary, counts binary, "
           "n_types bigint, class_mass array<double>")
_GRAMS = "shard int, chunk bigint, grams binary"
_REPLY = "chunk bigint, shard int, codes binary, split binary"
_SCORED = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
           "base_score double, score double")


def packed(array: np.ndarray) -> bytes:
    """The array's bytes in planes, compressed."""
    import zstandard

    width = array.itemsize * array[:1].size
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), width).T
    return zstandard.ZstdCompressor(level=1).compress(
        len(array).to_bytes(8, "little") + planes.tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, n) if n else np.zeros((0, 0))
    return np.ascontiguousarray(planes.T).view(dtype).ravel() if n else np.zeros(0, dtype)


def shard_of(numbers: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(numbers.astype(np.uint64) + np.uint64(0x5A)) % np.uint64(shards)).astype(
        np.int64)


def class_of(ids: np.ndarray, classes: int) -> np.ndarray:
    """The class of a word by its number; the unknown word is in the first."""
    found = mixed(ids.astype(np.uint64) + np.uint64(0xC1)) & np.uint64(classes - 1)
    return np.where(ids == UNKNOWN, 0, found.astype(np.int64))


# --- texts to chunks ------------------------------------------------------------------------
def _chunk(ids: list, held: list, texts: list[bytes]) -> dict:
    words = words_of(texts, SPACED, LOWER)
    lengths = words.counts + 1
    hashes = np.insert(words.hashes(), words.first[1:], END)
    own, token = np.unique(hashes, return_inverse=True)
    train = np.repeat(~np.array(held, bool), lengths)
    counts = np.bincount(token[train], minlength=len(own))
    # The most frequent words first, so places are small numbers.
    order = np.argsort(-np.bincount(token, minlength=len(own)), kind="stable")
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    return {"chunk": uuid.uuid4().int & ((1 << 62) - 1), "doc_ids": ids, "held": held,
            "lengths": lengths.tolist(), "tokens": packed(place[token].astype(np.uint32)),
            "words": packed(own[order]), "counts": packed(counts[order].astype(np.uint32)),
            "n_train": int(train.sum()), "n_train_texts": len(held) - sum(held)}


def make_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
        ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()),
        ("n_train", pa.int64()), ("n_train_texts", pa.int64())])
    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(),
                   as_bytes(batch.column("text")), strict=True)
        for doc_id, out, text in rows:
            ids.append(doc_id)
            held.append(out)
            texts.append(text)
            size += len(text) + 1
            if size >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist([_chunk(ids, held, texts)], schema)
                ids, held, texts, size = [], [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([_chunk(ids, held, texts)], schema)


# --- words to numbers -----------------------------------------------------------------------
def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each shard, in their order."""
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    for s, at in zip(own, np.split(order, first[1:]), strict=True):
        yield int(s), at


def _words_to_shards(shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["chunk", "words", "counts"]).to_pylist():
                words = unpacked(row["words"], np.uint64)
                counts = unpacked(row["counts"], np.uint32)
                out = [(s, row["chunk"], packed(np.diff(at, prepend=0).astype(np.uint32)),
                        packed(words[at]), packed(counts[at]))
                       for s, at in _by_shard(shard_of(words, shards))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()),
                        strict=True)],
                    names=["shard", "chunk", "places", "words", "counts"])

    return send


def _number_words(shards: int, classes: int):
    def number(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        parts = [unpacked(w.as_py(), np.uint64) for w in table["words"]]
        bounds = np.cumsum([0, *map(len, parts)])
        counts = np.concatenate([unpacked(c.as_py(), np.uint32) for c in table["counts"]])
        own, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, counts, minlength=len(own)).astype(np.int64)
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(own))
        ids = np.where(total > 0, rank * shards + shard + FIRST, UNKNOWN)
        known = total > 0
        mass = np.bincount(class_of(ids[known], classes), total[known] + 0.1,
                           minlength=classes)
        rows = [(table["chunk"][i].as_py(), shard, table["places"][i].as_py(),
                 packed(ids[place[low:high]]), packed(total[place[low:high]]), 0, None)
                for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        rows.append((-1, shard, None, None, None, int(known.sum()), mass.tolist()))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(),
                 pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)],
                        names=["chunk", "shard", "places", "ids", "counts", "n_types",
                               "class_mass"])

    return number


class Corpus:
    """Totals: N tokens, V words, training texts, and the base mass of word classes."""

    def __init__(self, n: int, v: int, texts: int, mass: np.ndarray, shards: int):
        self.n, self.v, self.texts, self.shards = n, v, texts, shards
        self.floor = n + 0.1 * (v + 1)
        self.mass = mass

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / self.floor

    def splits(self, counts: np.ndarray) -> np.ndarray:
        """Over how many classes the trigrams around words with such counts are dealt."""
        wanted = np.maximum(1, -(-counts // SHARD_TOKENS))
        power = np.ceil(np.log2(wanted)).astype(np.int64)
        return np.minimum(1 << power, len(self.mass))


# --- a chunk's trigrams ---------------------------------------------------------------------
class Chunk:
    """A chunk with the numbers and corpus counts of its words. Words of the chunk are
    1, 2, ... in its list; 0 is the start of a text."""

    def __init__(self, row: dict, lookups: list[dict], corpus: Corpus):
        self.row, self.corpus = row, corpus
        places = [np.cumsum(unpacked(x["places"], np.uint32), dtype=np.int64) + 1
                  for x in lookups]
        size = 1 + sum(map(len, places))
        self.ids, self.counts = np.full(size, START), np.full(size, corpus.texts)
        for look, at in zip(lookups, places, strict=True):
            self.ids[at] = unpacked(look["ids"], np.int64)
            self.counts[at] = unpacked(look["counts"], np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.lengths)))
        self.tokens = unpacked(row["tokens"], np.uint32).astype(np.int64) + 1
        self._count_trigrams()

    def _count_trigrams(self) -> None:
        """Distinct (middle, class, before, word), in the order in which shards get them."""
        c, n = self.tokens, len(self.tokens)
        at = np.arange(n) - np.repeat(self.bounds[:-1], self.lengths)
        b = np.where(at >= 1, np.concatenate(([0], c[:-1])), 0)
        a = np.where(at >= 2, np.concatenate(([0, 0], c[:-2]))[:n], 0)
        size = len(self.ids)
        # A word that training has not seen is no context; `size` stands for none.
        unseen = self.counts == 0
        unseen[0] = False
        a = np.where(unseen[a] | unseen[b], size, a)
        size += 1
        pairs, pair = np.unique(b * size + a, return_inverse=True)
        keys, self.gram = np.unique(pair * size + c, return_inverse=True)
        train = np.repeat(~np.array(self.row["held"], bool), self.lengths)
        self.gram_train = np.bincount(self.gram[train], minlength=len(keys))
        pair, self.word = keys // size, keys % size
        self.middle, self.before = pairs[pair] // size, pairs[pair] % size
        split = self.corpus.splits(self.counts[self.middle])
        self.split = (split > 1) & ~unseen[self.middle]
        self.n_grams = len(keys)
        self.group_class = self._classes(self.before) & (split - 1)
        self._add_pairs()
        ids = self.ids[self.middle].astype(np.uint64)
        own = np.where(self.before == size, mixed(ids + np.uint64(0xB1)), ids)
        shard = shard_of(mixed(own) + self.group_class.astype(np.uint64), self.corpus.shards)
        # After such a word the base distribution holds; no shard is asked.
        shard[unseen[self.middle]] = -1
        self.parts = dict(_by_shard(shard))
        self.parts.pop(-1, None)

    def _classes(self, words: np.ndarray) -> np.ndarray:
        return class_of(np.append(self.ids, NONE), len(self.corpus.mass))[words]

    def _add_pairs(self) -> None:
        """Rows for the bigrams of split words, and one for each class of a split word."""
        none = len(self.ids)
        middle, word = self.middle[self.split], self.word[self.split]
        keys, self.pair = np.unique(middle * none + word, return_inverse=True)
        train = np.bincount(self.pair, self.gram_train[self.split], minlength=len(keys))
        owners = np.unique(middle)
        classes = self.corpus.splits(self.counts[owners])
        owner = np.repeat(owners, classes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(classes) - classes, classes)
        pair_class = self._classes(keys % none) & (self.corpus.splits(
            self.counts[keys // none]) - 1)
        added = len(keys) + len(owner)
        self.middle = np.concatenate((self.middle, keys // none, owner))
        self.before = np.append(self.before, np.full(added, none + 1))
        self.word = np.concatenate((self.word, keys % none, np.full(len(owner), none)))
        self.gram_train = np.concatenate((self.gram_train, train.astype(np.int64),
                                          np.zeros(len(owner), np.int64)))
        self.group_class = np.concatenate((self.group_class, pair_class, number))
        self.split = np.append(self.split, np.ones(added, bool))

    def blob(self, at: np.ndarray) -> bytes:
        ids, counts = np.append(self.ids, [NONE, PAIR]), np.append(self.counts, [0, 0])
        columns = (ids[self.middle[at]], counts[self.middle[at]], self.group_class[at],
                   ids[self.before[at]], ids[self.word[at]],
                   quantised(np.log10(self.corpus.base(counts[self.word[at]]))),
                   self.gram_train[at])
        return packed(np.stack(columns, axis=1).astype(np.int64))

    def logs(self, replies: list[dict]) -> np.ndarray:
        """The log probability of every trigram."""
        n = self.n_grams
        logs = np.log10(self.corpus.base(np.append(self.counts, 0)[self.word]))
        found = np.zeros((len(logs), 3), np.int64)
        for reply in replies:
            at = self.parts[reply["shard"]]
            split = self.split[at]
            logs[at[~split]] = restored(unpacked(reply["codes"], np.uint8))
            found[at[split]] = unpacked(reply["split"], np.int64).reshape(-1, 3)
        own = np.flatnonzero(self.split[:n])
        if len(own):
            last = n + self.pair.max() + 1
            kinds = np.bincount(self.middle[last:], found[last:, 2], minlength=len(self.ids))
            middle = self.middle[own]
            logs[own] = restored(quantised(interpolated(
                restored(quantised(logs[own])), found[n + self.pair, 0], self.counts[middle],
                kinds[middle], *found[own].T)))
        return logs[:n]


def _chunks_of(table: pa.Table, corpus: Corpus, lookups: list[dict]) -> Chunk:
    return Chunk(table.to_pylist()[0], lookups, corpus)


def _send_grams(model):
    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunks_of(left, Corpus(**model.value), right.to_pylist())
        number = key[0].as_py()
        rows = [(s, number, chunk.blob(at)) for s, at in chunk.parts.items()]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(
            columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)],
            names=["shard", "chunk", "grams"])

    return send


# --- a shard's trie -------------------------------------------------------------------------
def score_grams(corpus: Corpus, grams: np.ndarray) -> np.ndarray:
    """Codes of the log probability of every row; the trie is built from those with counts,
    which must be all of their middle words."""
    b, _, _, a, c, base, train = grams.T
    groups, group = np.unique(b, return_inverse=True)
    befores, before = np.unique(a, return_inverse=True)
    if len(befores) and befores[0] == NONE:
        before, befores = before - 1, befores[1:]
    words, word = np.unique(c, return_inverse=True)
    lower = np.minimum(1, 10 ** restored(base))

    keys = np.lexsort((word, before, group))
    new = np.ones(len(keys), bool)
    new[1:] = ((np.diff(group[keys]) != 0) | (np.diff(before[keys]) != 0)
               | (np.diff(word[keys]) != 0))
    row = np.cumsum(new) - 1
    count = np.bincount(row, train[keys])
    first = keys[new]
    seen = first[count > 0]
    with tempfile.TemporaryDirectory() as folder:
        build(folder, group[seen], before[seen], word[seen], count[count > 0], lower[seen],
              max(1, len(befores)), len(words))
        trie = Trie(folder)
        logs = trie.logs(group[first], before[first], word[first], lower[first])
        del trie
    out = np.empty(len(keys), np.uint8)
    out[keys] = quantised(logs)[row]
    return out


def _sequence(values: np.ndarray, universe: int) -> EliasFano:
    return EliasFano(len(values), universe, *EliasFano.parts(values, universe))


def split_counts(grams: np.ndarray) -> np.ndarray:
    """For every row of split words: its training count, that of its two first words, and how
    many different words follow these (for a bigram, of its class)."""
    b, _, klass, a, c, _, train = grams.T
    out = np.zeros((len(b), 3), np.int64)
    if not len(b):
        return out
    befores, before = np.unique(np.where(a == PAIR, PAIR - klass, a), return_inverse=True)
    middles, middle = np.unique(b, return_inverse=True)
    words, word = np.unique(c, return_inverse=True)
    context = middle * len(befores) + before
    key, seen = context * len(words) + word, train > 0
    keys, at = np.unique(key[seen], return_inverse=True)
    count = np.bincount(at, train[seen], minlength=len(keys))
    contexts, of = np.unique(keys // len(words), return_inverse=True)
    n_contexts = len(middles) * len(befores)
    place = _sequence(keys, n_contexts * len(words)).find(key)
    spot = _sequence(contexts, n_contexts).find(context)
    if len(keys):
        out[:, 0] = np.where(place >= 0, count[place], 0)
        out[:, 1] = np.where(spot >= 0, np.bincount(of, count)[spot], 0)
        out[:, 2] = np.where(spot >= 0, np.bincount(of)[spot], 0)
        out[a == NONE] = 0
    return out


def interpolated(base, pair, group, group_kinds, triple, context, context_kinds) -> np.ndarray:
    """log10 probabilities from counts as the trie has them; base: log10 of the lowest order."""
    def rounded(chance):
        return restored(quantised(np.log10(np.maximum(chance, 1e-300))))

    lower = np.minimum(1, 10 ** base)
    chance = (pair + group_kinds * lower) / (group + group_kinds)
    out = np.where(pair > 0, rounded(chance),
                   np.log10(lower) + rounded(group_kinds / (group + group_kinds)))
    deep = np.maximum(1, context + context_kinds)
    return np.where(context == 0, out, np.where(
        triple > 0, rounded((triple + context_kinds * chance) / deep),
        out + rounded(context_kinds / deep)))


def _score_shard(model):
    def score(table: pa.Table) -> pa.Table:
        corpus = Corpus(**model.value)
        parts = [unpacked(g.as_py(), np.int64).reshape(-1, 7)
                 for g in table["grams"]]
        grams = np.concatenate(parts)
        split = corpus.splits(grams[:, 1]) > 1
        codes = np.zeros(len(grams), np.uint8)
        if not split.all():
            codes[~split] = score_grams(corpus, grams[~split])
        counts = np.zeros((len(grams), 3), np.int64)
        counts[split] = split_counts(grams[split])
        ends = np.cumsum([len(p) for p in parts])
        own = [slice(high - len(p), high) for p, high in zip(parts, ends, strict=True)]
        return pa.table([
            table["chunk"], table["shard"],
            pa.array([packed(codes[x][~split[x]]) for x in own], pa.binary()),
            pa.array([packed(counts[x][split[x]]) for x in own], pa.binary())],
            names=["chunk", "shard", "codes", "split"])

    return score


def _add_up(model):
    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        corpus, rows = Corpus(**model.value), right.to_pylist()
        chunk = _chunks_of(left, corpus, [r for r in rows if r["codes"] is None])
        logs = chunk.logs([r for r in rows if r["codes"] is not None])
        count = chunk.counts[chunk.tokens]
        base = sums_by_text(np.log10(corpus.base(count)), chunk.bounds)
        return pa.table(
            [pa.array(chunk.row["doc_ids"], pa.int64()), pa.array(chunk.row["held"]),
             pa.array(chunk.lengths), pa.array(sums_by_text(count > 0, chunk.bounds)),
             pa.array(base), pa.array(sums_by_text(logs[chunk.gram], chunk.bounds))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return add


def text_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    ship_package()
    spark = docs.sparkSession
    keyed = docs.select("doc_id", (remainder("doc_id", 10) == 0).alias("held"), "text")
    chunks = settled(map_arrow(keyed, make_chunks, _CHUNK), "chunks")
    total = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"),
                       F.coalesce(F.sum("n_train_texts"), F.lit(0)).alias("texts"),
                       F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"),
                                                    lambda a, x: a + x)), F.lit(0)).alias("all")
                       ).first()
    shards = max(LEAST_SHARDS, -(-total["all"] // SHARD_TOKENS))
    classes = 1 << int(2 * shards - 1).bit_length()
    words = map_arrow(chunks.select("chunk", "words", "counts"), _words_to_shards(shards),
                      "shard int, chunk bigint, places binary, words binary, counts binary")
    lookups = settled(words.groupBy("shard").applyInArrow(
        _number_words(shards, classes), _LOOKUP), "lookups")
    stats = lookups.filter("chunk = -1")
    v = stats.agg(F.coalesce(F.sum("n_types"), F.lit(0))).first()[0]
    mass = np.zeros(classes)
    for row in (stats.select(F.posexplode("class_mass")).groupBy("pos")
                .agg(F.sum("col").alias("m")).collect()):
        mass[row.pos] = row.m
    model = spark.sparkContext.broadcast(
        {"n": total.n, "v": v, "texts": total.texts, "mass": mass, "shards": shards})

    own = chunks.drop("words", "counts", "n_train", "n_train_texts")
    looked = lookups.filter("chunk >= 0").select("chunk", "shard", "places", "ids", "counts")
    grams = own.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(
        _send_grams(model), _GRAMS)
    replies = grams.groupBy("shard").applyInArrow(_score_shard(model), _REPLY)
    none = F.lit(None).cast("binary")
    back = looked.withColumns({"codes": none, "split": none}).unionByName(
        replies.withColumns({"places": none, "ids": none, "counts": none}))
    scored = own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        _add_up(model), _SCORED)
    return scored.withColumn("train_tokens", F.lit(total.n).cast("bigint")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
