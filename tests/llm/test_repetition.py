"""Runs, collocations and repeated passages against brute force on small inputs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenantlake.llm import phrases, repeats, runs
from tenantlake.llm.queries import with_planted_runs
from tests.llm.conftest import ODD


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()),
                  key=lambda r: [(x is None, str(x)) for x in r])


def words_in(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# --- 11: runs ------------------------------------------------------------------------------
def lyndon_by_suffixes(letters, descending):
    key = [-x if descending else x for x in letters]
    out = []
    for i, x in enumerate(letters):
        end = next((j for j in range(i, len(letters)) if letters[j] < 0), len(letters))
        own = key[i:end]
        out.append(0 if x < 0 else next(
            (k for k in range(1, len(own)) if own[k:] < own), len(own)))
    return out


def runs_by_periods(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def text_without(words, dropped):
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


PERIODIC = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9),
                              st.integers(1, 4)), max_size=6).map(
    lambda parts: [w for unit, n in parts for w in unit * n])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=3))
def test_lyndon_arrays_under_both_orders(texts):
    letters = [-1]
    for i, text in enumerate(texts):
        letters += text + [-2 - i]
    for descending in (False, True):
        got = runs.lyndon_lengths(letters, descending)
        assert got.tolist() == lyndon_by_suffixes(letters, descending)


@settings(max_examples=200, deadline=None)
@given(st.lists(PERIODIC, min_size=1, max_size=4))
def test_runs_of_many_texts_at_once(texts):
    found = runs.text_runs([" ".join(t).encode() for t in texts])
    for words, (got, collapsed, n) in zip(texts, found):
        assert [(r["start"], r["length"], r["period"]) for r in got] == runs_by_periods(words)
        dropped = {i for s, length, q in runs_by_periods(words) for i in range(s + q, s + length)}
        assert (collapsed.decode(), n) == (text_without(words, dropped), len(words))


def test_runs_of_odd_texts(odd):
    got = rows_of(runs.word_runs(odd), "doc_id", "n_words", "runs", "collapsed")
    assert len(got) == len(ODD)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:] == by_id[2][1:] == by_id[3][1:] == (0, [], "")
    assert [tuple(r) for r in by_id[6][2]] == [(0, 30_000, 1)] and by_id[6][3] == "word"
    assert by_id[8][3] == " ".join(words_in(ODD[-1][1]))
    assert runs.word_runs(odd.filter("false")).count() == 0


def test_planted_periods(docs):
    import zlib
    table = docs(*[(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(200)], (None, "a b"))
    for r in with_planted_runs(table).collect():
        words = [f"w{k}" for k in range(r.doc_id % 50)] if r.doc_id is not None else ["a", "b"]
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert words_in(r.text) == words


# --- 12: collocations ----------------------------------------------------------------------
def collocations_by_counting(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p))
                  for j in range(i + 2, len(p) + 1)
                  if p[i:j] != p and 100 * a >= 100 * own[p[i:j]]}
        scored = []
        for p, a in often.items():
            if p not in inside:
                score, _, left, right = min(
                    (1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]],
                     own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score)
                for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least, top", [(15, 20), (4, 10_000)])
def test_collocations_equal_counting(spark, docs, least, top):
    rnd = np.random.default_rng(7)
    vocabulary, gaps = ["a", "B", "é", "cat", "zz", "ßß"], [" ", "  ", "\t", ", ", "\n", ". "]
    rows = [(("en", "de", None, "")[rnd.integers(4)], "".join(
        vocabulary[rnd.integers(6)] + gaps[max(0, rnd.integers(12) - 6)]
        for _ in range(rnd.integers(40)))) for _ in range(150)]
    rows += [("en", "the big red dog barks loudly at")] * 20 + [("en", None), (None, "")]
    table = docs(*[(i, text, lang, "s") for i, (lang, text) in enumerate(rows)]).repartition(3)
    got = phrases.collocations(table, least, top, filter_bits=18)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == (
        collocations_by_counting(rows, least, top))


def test_a_full_filter_changes_nothing(docs):
    table = docs(*[(i, "x y z u v w a b c", "en", "s") for i in range(9)]).repartition(3)
    few, many = (rows_of(phrases.collocations(table, 2, 50, bits), *COLUMNS) for bits in (15, 22))
    assert few == many and len(few) == 5


def test_collocations_of_odd_texts(odd):
    got = rows_of(phrases.collocations(odd, 3, 5, 18), *COLUMNS)
    assert {r[0] for r in got} <= {"en", "und"} and "word word" in {r[2] for r in got}
    assert phrases.collocations(odd.filter("false"), 3, 5, 18).count() == 0


# --- 13: repeated passages -----------------------------------------------------------------
def kept_by_windows(rows):
    def place(doc, i):
        return (-(1 << 63) if doc is None else doc, i)

    first = {}
    for doc, text in rows:
        words = words_in(text)
        for i in range(len(words) - 19):
            key = tuple(words[i:i + 20])
            first[key] = min(first.get(key, place(doc, i)), place(doc, i))
    out = []
    for doc, text in rows:
        words = words_in(text)
        gone = {i + k for i in range(len(words) - 19) for k in range(20)
                if first[tuple(words[i:i + 20])] < place(doc, i)}
        out.append((doc, len(words), len(gone), text_without(words, gone)))
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def removed(cut):
    n = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return rows_of(cut.withColumn("n", n), "doc_id", "n_words", "n", "kept")


@pytest.mark.parametrize("bits", [15, 24])
def test_repeats_equal_windows(docs, bits):
    rnd = np.random.default_rng(5)

    def words(letters, low, high):
        return [letters[k] for k in rnd.integers(len(letters), size=rnd.integers(low, high))]

    pool = [words("abcdefghij", 15, 60) for _ in range(10)]
    rows = []
    for i in range(60):
        parts = [pool[rnd.integers(10)] if rnd.random() < 0.5 else words("abc", 1, 50)
                 for _ in range(rnd.integers(5))]
        doc = (i, i, i // 2, None)[rnd.integers(4)]
        rows.append((doc, " ".join(w for part in parts for w in part)))
    rows += [rows[3]] * 3 + [(500 + k, " ".join(["x"] * 50)) for k in range(30)] + [(7, None)]
    cut = repeats.without_repeats(docs(*rows).repartition(4), bits)
    assert removed(cut) == kept_by_windows(rows)


def test_a_passage_of_every_document_is_spread_over_slices(spark, docs):
    """One passage in all rows, more slices than different matches."""
    rows = [(i, " ".join(f"p{k}" for k in range(25)) + f" end{i}") for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = removed(repeats.without_repeats(docs(*rows).repartition(8)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == kept_by_windows(rows)


def test_repeats_of_odd_texts(odd):
    assert removed(repeats.without_repeats(odd)) == kept_by_windows(ODD)
    assert repeats.without_repeats(odd.filter("false")).count() == 0
