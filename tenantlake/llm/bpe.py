"""Exact byte-level BPE by dynamic programming over prefixes.

The text is cut by the tokenizer's own pattern. In a piece, an automaton of all tokens with
suffix links gives the tokens that end at each position, the longest first. The last token
of a prefix is the one that starts where an encoded prefix ends and is compatible with that
prefix's last token: no merge over their border comes before the merges that form them. It is
unique, so one token a prefix is stored, and following the lengths back gives exactly the ids
that applying the merges by rank would give.

The vocabulary file is a parameter; it is read on the driver and sent to the tasks, its size
being that of the vocabulary. Special tokens of the file are matched in the text first, as
the library does. Null texts are empty; an empty text has no ids and decodes to itself. Ids
that the vocabulary lacks are left out when decoding, and bytes that are not UTF-8 become
U+FFFD. Repeated rows give repeated rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow

#: The pattern that this kind of vocabulary splits texts with before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if printable, else the next
    free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizer:
    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        found = json.loads(vocabulary)
        letters, ids = byte_letters(), found["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()
                         if t not in self.special}
        self.born = dict.fromkeys(self.bytes_of, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(found["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole, pair = ids[left + right], (ids[left], ids[right])
            self.rank[pair] = rank
            self.born[whole], self.halves[whole] = rank, pair
        self.automaton = ahocorasick.Automaton()
        for i, token in self.bytes_of.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.known_pieces: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding both tokens' bytes together gives just these two.

        Going back in time, the pieces that touch the border are the tokens themselves, then
        the halves they were merged from. The border stays if no merge over it is due while
        both pieces exist; of merges of one rank the leftmost is done first.
        """
        due = len(self.rank)
        while True:
            if self.rank.get((left, right), due) < due:
                return False
            before_left, before_right = self.born[left], self.born[right]
            if before_left > before_right:
                due, left = before_left, self.halves[left][1]
            elif before_right >= 0:
                due, right = before_right + 1, self.halves[right][0]
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last: list = [None] * (len(spelled) + 1)
        pairs = self.known_pairs
        for end, (token, length) in self.automaton.iter(spelled):
            end += 1
            if last[end] is not None:
                continue
            before = end - length
            if before:
                pair = (last[before][0], token)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.compatible(*pair)
                if not fits:
                    continue
            last[end] = (token, length)
        ids, at = [], len(spelled)
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if self.specials is None:
            return self._encode_plain(text)
        ids: list[int] = []
        for i, part in enumerate(self.specials.split(text)):
            ids += [self.special[part]] if i % 2 else self._encode_plain(part)
        return ids

    def _encode_plain(self, text: str) -> list[int]:
        known, ids = self.known_pieces, []
        if len(self.known_pairs) > 2 * REMEMBERED:
            self.known_pairs.clear()
        for piece in self.pieces.findall(text):
            found = known.get(piece)
            if found is None:
                found = self.encode_piece(piece)
                if len(piece) <= 32:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _rows(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes."""
    step = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every document."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary.value)
        for batch in batches:
            for part in _rows(batch):
                ids = [tokenizer.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), encode, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that the ids decode to."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary.value)
        for batch in batches:
            for part in _rows(batch):
                ids = [tokenizer.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([tokenizer.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), both,
                     "doc_id bigint, ids array<int>, decoded string")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary.value)
        for batch in batches:
            for part in _rows(batch):
                texts = [tokenizer.decode(i.as_py() or []) for i in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string())],
                    names=["doc_id", "text"])

    return map_arrow(tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")),
                     decode, "doc_id bigint, text string")
