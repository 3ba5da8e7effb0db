"""Secrets in texts, judged by who owns them across the whole corpus.

Candidates are found by patterns and hashed by their value. For each hash the corpus gives
the number of distinct repositories and of distinct owners that hold it. A value held by many
owners is an example that was copied around; a value of few owners that looks random is a
live credential; the rest is weak. Kinds with a pattern of their own are always reported with
their verdict; random words, which have none, only where the corpus says live. Keys and tokens
of a fixed form are masked whatever their verdict, since copies of one leak look like owners.

Null and empty texts have no candidates; a null owner or repository counts as one. Spans are
code points, the end exclusive. Repeated rows of a document count as one repository and give
repeated rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow, row_key, settled

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "key_block", "service_token", "web_token", "random_word")

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]+-----END [A-Z ]+-----")
_SERVICE = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}"
                      r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
_WEB = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+")
_RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGITS = re.compile(r"[0-9]")

_FOUND = ("row_key bigint, doc_id bigint, owner string, repo string, "
          "found array<struct<kind:int,start:int,end:int,value:bigint,bits:double>>")


def entropy(value: str) -> float:
    """Bits a character, by the frequencies of the value itself."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _base(text: str) -> Iterator[tuple[int, int, int, str]]:
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                yield 0, m.start(), m.end(), m.group(2)
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield 1, m.start(), m.end(), m.group()
    for m in _HEX.finditer(text):
        yield 2, m.start(), m.end(), m.group()


def _further(text: str) -> Iterator[tuple[int, int, int, str]]:
    if "PRIVATE KEY-----" in text:
        for m in _KEY_BLOCK.finditer(text):
            yield 3, m.start(), m.end(), m.group()
    if "_" in text or "-" in text or "AIza" in text:
        for m in _SERVICE.finditer(text):
            yield 4, m.start(), m.end(), m.group()
    if "eyJ" in text:
        for m in _WEB.finditer(text):
            yield 5, m.start(), m.end(), m.group()
    for m in _RANDOM.finditer(text):
        word = m.group()
        if len(_DIGITS.findall(word)) >= 3 and re.search("[A-Za-z]", word):
            yield 6, m.start(), m.end(), word


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; further kinds only outside the base."""
    base = sorted(_base(text), key=lambda c: (c[1], c[0]))
    starts = [s for _, s, _, _ in base]
    reach = list(accumulate((e for _, _, e, _ in base), max, initial=0))
    more, last = [], 0
    for c in sorted(_further(text), key=lambda c: (c[1], c[0])):
        if c[1] >= last and reach[bisect_left(starts, c[2])] <= c[1]:
            more.append(c)
            last = c[2]
    return sorted(base + more, key=lambda c: (c[1], c[0]))


def _value_hash(value: str) -> int:
    digest = hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(digest.digest(), "big", signed=True)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                               ("value", pa.int64()), ("bits", pa.float64())]))
    for batch in batches:
        rows = [[{"kind": k, "start": s, "end": e, "value": _value_hash(v), "bits": entropy(v)}
                 for k, s, e, v in candidates(t)] if (t := text.as_py()) else []
                for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_key"), batch.column("doc_id"), batch.column("owner"),
             batch.column("repo"), pa.array(rows, kind)],
            names=["row_key", "doc_id", "owner", "repo", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over the whole corpus; a hot value is counted in steps."""
    each = found.select("owner", "repo", F.explode("found.value").alias("value"))
    return (each.distinct()
            .groupBy("value", "owner").agg(F.count("*").alias("repos"))
            .groupBy("value").agg(F.sum("repos").alias("n_repos"),
                                  F.count("*").alias("n_owners")))


def secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id",
            example_owners: int = 3, live_bits: float = 3.0) -> DataFrame:
    """row_key, doc_id and `spans` (kind, start, end, verdict, n_repos, n_owners).

    A value of `example_owners` owners or more is an example; of the others those with at
    least `live_bits` bits of entropy a character are live.
    """
    mark = F.lit("\u0000")
    keyed = docs.select(
        row_key("doc_id", owner, repo, "text").alias("row_key"), "doc_id",
        F.coalesce(F.col(owner).cast("string"), mark).alias("owner"),
        F.coalesce(F.col(repo).cast("string"), mark).alias("repo"), "text")
    found = settled(map_arrow(keyed, scan, _FOUND), "secrets")
    each = found.select("row_key", F.explode("found").alias("c")).distinct()
    verdict = (F.when(F.col("n_owners") >= example_owners, "example")
               .when(F.col("c.bits") >= live_bits, "live").otherwise("weak"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("c.kind") + 1)
    judged = (each.withColumn("value", F.col("c.value")).join(ownership(found), "value")
              .withColumn("verdict", verdict)
              .filter((F.col("c.kind") != KINDS.index("random_word"))
                      | (F.col("verdict") == "live"))
              .groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("c.start").alias("start"), F.col("c.kind").alias("rank"),
                  F.col("c.end").alias("end"), kind.alias("kind"), "verdict", "n_repos",
                  "n_owners"))).alias("spans")))
    none = F.array().cast(judged.schema["spans"].dataType)
    return (found.select("row_key", "doc_id").join(judged, "row_key", "left")
            .withColumn("spans", F.coalesce("spans", none)))


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, cuts = batch.column("doc"), batch.column("cut")
        names = [f.name for f in doc.type]
        spot, fields = names.index("text"), doc.flatten()
        texts = []
        for text, cut in zip(fields[spot], cuts):
            if not cut.is_valid:
                texts.append(text.as_py())
                continue
            whole, pieces, at = text.as_py(), [], 0
            for span in cut.as_py():
                if span["start"] >= at:
                    pieces += [whole[at:span["start"]], f"<{span['kind']}>"]
                at = max(at, span["end"])
            texts.append("".join([*pieces, whole[at:]]))
        fields[spot] = pa.array(texts, fields[spot].type)
        yield pa.RecordBatch.from_arrays(
            [pa.StructArray.from_arrays(fields, fields=list(doc.type))], names=["doc"])


def masked(docs: DataFrame, spans: DataFrame, owner: str = "source",
           repo: str = "doc_id") -> DataFrame:
    """The documents with every reported span replaced by its kind, but for examples of kinds
    without a fixed form."""
    fixed = [KINDS.index(k) for k in ("key_block", "service_token", "web_token")]
    wanted = spans.select("row_key", F.filter("spans", lambda s: (
        s["verdict"] != "example") | s["rank"].isin(fixed)).alias("cut"))
    wanted = wanted.filter(F.size("cut") > 0).dropDuplicates(["row_key"])
    keyed = docs.select(F.struct("*").alias("doc"),
                        row_key("doc_id", owner, repo, "text").alias("row_key"))
    joined = keyed.join(wanted, "row_key", "left").select("doc", "cut")
    return map_arrow(joined, _mask, joined.select("doc").schema).select("doc.*")
