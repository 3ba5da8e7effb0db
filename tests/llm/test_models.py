"""Language model, tokenizer, language identification and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tenantlake.llm import bpe, langid, ngram_lm
from tenantlake.llm.elias_fano import EliasFano, Trie, build, quantised, restored
from tenantlake.llm.frame import table
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- 8: language model ---------------------------------------------------------------------
@given(st.lists(st.integers(0, 10 ** 12), unique=True, max_size=200), st.integers(0, 50))
@settings(max_examples=60, deadline=None)
def test_sequences_are_found_again(values, more):
    values = np.array(sorted(values), np.int64)
    universe = int(values.max(initial=0)) + 1 + more
    held = EliasFano(len(values), universe, *EliasFano.parts(values, universe))
    assert held.values(np.arange(len(values))).tolist() == values.tolist()
    places = {int(v): i for i, v in enumerate(values)}
    asked = np.concatenate((values, values - 1, values + 1))
    asked = asked[(asked >= 0) & (asked < universe)]
    assert held.find(asked).tolist() == [places.get(int(v), -1) for v in asked]


def test_trie_gives_the_smoothed_probabilities(tmp_path):
    rnd = random.Random(1)
    grams = Counter((rnd.randrange(6), rnd.randrange(5), rnd.randrange(8)) for _ in range(300))
    keys = sorted(grams)
    group, before, word = (np.array(c) for c in zip(*keys))
    count = np.array([grams[k] for k in keys])
    low = (np.arange(8) + 1) / 60
    build(str(tmp_path), group, before, word, count, low[word], 5, 8)
    trie = Trie(str(tmp_path))

    def chance(g, b, w):
        pair = {x: sum(n for k, n in grams.items() if k[0] == g and k[2] == x) for x in range(8)}
        kinds, total = sum(n > 0 for n in pair.values()), sum(pair.values())
        p = (pair[w] + kinds * low[w]) / (total + kinds) if total else low[w]
        own = {x: grams[(g, b, x)] for x in range(8)}
        kinds, total = sum(n > 0 for n in own.values()), sum(own.values())
        return (own[w] + kinds * p) / (total + kinds) if total else p

    every = [(g, b, w) for g in range(8) for b in range(5) for w in range(8)]
    g, b, w = (np.array(c) for c in zip(*every))
    got = trie.logs(g, b, w, low[w])
    wanted = np.log10([chance(*k) for k in every])
    assert np.abs(got - wanted).max() < 0.15
    assert np.abs(restored(quantised(wanted)) - wanted).max() <= 0.0301


def unigrams(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
             for _, t in rows]
    counts = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return [(len(w), sum(counts[x] > 0 for x in w), n, sum(
        math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in words]


@pytest.mark.parametrize("shard", [1_200_000, 40])
def test_scores_and_base_scores(docs, monkeypatch, shard):
    """With small shards the frequent words' successors are split by class."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 3000)
    rnd = random.Random(2)
    rows = [(i, " ".join(f"the w{i % 7} of {rnd.choice('abc')}{j % 4}" for j in range(
        rnd.randrange(1, 30)))) for i in range(80)] + [(100, "The"), (101, None), (102, "")]
    got = {r.doc_id: r for r in ngram_lm.text_scores(docs(*rows)).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, known, total, base) in zip(rows, unigrams(rows), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 20]
    assert held and all(r.score > 0.7 * r.base_score > r.base_score for r in held)


def test_probabilities_add_up_to_one():
    """Over all words and the unknown one, with split successors."""
    corpus = ngram_lm.Corpus(1000, 40, 10, np.full(8, 1004 / 8), 4)
    ids = np.append(np.arange(40) + ngram_lm.FIRST, ngram_lm.UNKNOWN)
    klass = ngram_lm.class_of(ids, 8)
    counts = np.array([25] * 40 + [0])
    codes = quantised(np.log10(corpus.base(counts)))
    corpus.mass = np.bincount(klass, corpus.base(counts), minlength=8)
    rows = []
    for w in range(41):
        rows.append((5, 0, klass[w] & 3, 7, ids[w], codes[w], 100 * (w % 3 == 0 and w < 40)))
    grams = np.array(rows, np.int64)
    total = sum(grams[:, 6])
    grams[:, 1] = total
    saved, ngram_lm.SHARD_TOKENS = ngram_lm.SHARD_TOKENS, -(-total // 4)
    try:
        logs = restored(ngram_lm.score_grams(corpus, grams))
    finally:
        ngram_lm.SHARD_TOKENS = saved
    assert abs((10 ** logs).sum() - 1) < 0.08


def test_scores_do_not_depend_on_what_is_split(docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 3000)
    rnd = random.Random(3)
    table = docs(*[(i, " ".join(rnd.choice(["the", "of", f"w{rnd.randrange(9)}", f"r{i}"])
                                for _ in range(rnd.randrange(1, 40)))) for i in range(120)])
    whole = {r.doc_id: r.score for r in ngram_lm.text_scores(table).collect()}
    for most in (40, 300):
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", most)
        got = {r.doc_id: r.score for r in ngram_lm.text_scores(table).collect()}
        assert all(abs(got[i] - x) < 1e-9 for i, x in whole.items())


def test_language_model_of_odd_texts(odd):
    assert ngram_lm.text_scores(odd).count() == len(ODD)
    assert ngram_lm.text_scores(odd.filter("false")).count() == 0
    held = odd.filter("doc_id is null")
    row = ngram_lm.text_scores(held).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0.0


# --- 9: BPE --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def both():
    return bpe.Tokenizer(bpe.read_vocabulary(PATH)), tokenizers.Tokenizer.from_file(PATH)


@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(
    ["<|endoftext|>", " the", "'s", "'LL", "aaaa", "  ", "\n\n", "123", "é", "\x00", "!!!"]))))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_library(both, parts):
    own, library = both
    text = "".join(parts)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_pair_of_a_sample_is_judged_like_encoding_it(both):
    own, library = both
    rnd = random.Random(3)
    plain = [i for i, b in own.bytes_of.items() if b.isascii() and b.isalpha()]
    for _ in range(3000):
        left, right = rnd.choice(plain), rnd.choice(plain)
        text = (own.bytes_of[left] + own.bytes_of[right]).decode()
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.compatible(left, right) == (ids == [left, right])


def test_round_trip_of_odd_texts(spark, odd, both):
    got = bpe.round_trip(odd, PATH).collect()
    texts = Counter((i, t or "") for i, t in ODD)
    assert Counter((r.doc_id, r.decoded) for r in got) == texts
    assert all(r.ids == both[1].encode(r.decoded, add_special_tokens=False).ids for r in got)
    back = bpe.decoded(bpe.encoded(odd, PATH), PATH)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == texts
    ids = spark.createDataFrame([(1, [999_999]), (2, None), (3, [128])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decoded(ids, PATH).collect()} == {
        1: "", 2: "", 3: "�"}
    assert bpe.encoded(odd.filter("false"), PATH).count() == 0


# --- 10: language identification -----------------------------------------------------------
def test_probabilities_of_letters_add_up():
    samples = {"a": [" abab ba "] * 3, "b": [" cdcd dc abc "] * 3}
    models = langid.fit(samples)
    letters = [ord(c) for c in " abcd?"]
    for context in ("  a", " ab", "dcd", "zzz"):
        rows = np.array([[*map(ord, context), x] for x in letters])
        each = np.exp(models.log_probabilities(rows))
        unseen = (round(1 / langid.FLOOR) - 5) * each[-1]
        assert np.allclose(each[:-1].sum(axis=0) + unseen, 1)


def test_languages_are_told_apart(spark, small):
    documents = table(spark, small, "documents")
    got = langid.languages(documents, 60).join(documents, "doc_id")
    held = got.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_languages_of_odd_texts(odd, docs):
    rows = {}
    for r in langid.languages(odd).collect():
        rows.setdefault(r.doc_id, r)
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[8].lang_pred == "en"
    none = langid.languages(docs((1, "some words", None, "s"), (2, "12 34", "en", "s")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    signs = langid.languages(docs(*[(i, "plain words of a text " * 3) for i in range(9)],
                                  (50, "½ ²"), (51, "Ⅷ ① 3.14"), (52, "x")), 60)
    found = {r.doc_id: r.lang_pred for r in signs.collect()}
    assert found[50] == found[51] == "und" and found[52] == "en"
    assert langid.languages(odd.filter("false")).count() == 0


# --- pipeline ------------------------------------------------------------------------------
def test_stages_follow_each_other(spark, small):
    documents = table(spark, small, "documents")
    kept, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, kept, small)
        if name != "bpe":
            assert result.columns == documents.columns
            assert result.schema.simpleString() == documents.schema.simpleString()
        seen[name] = {r.doc_id: r for r in result.collect()}
        kept = result
    order = [seen[n] for n, _ in corpus_pipeline.STAGES]
    assert all(set(b) <= set(a) for a, b in zip(order, order[1:]))
    assert set(seen["secrets"]) == set(seen["decontamination"])
    library = tokenizers.Tokenizer.from_file(PATH)
    for i, r in seen["bpe"].items():
        text = seen["secrets"][i].text
        assert r.ids == library.encode(text, add_special_tokens=False).ids
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {i: r.ids for i, r in seen["bpe"].items()}


def test_stages_take_odd_and_empty_documents(spark, small, odd):
    given_rows = odd.select("doc_id", "text", "lang", "source", "n_chars", "row_key", "winner")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, given_rows, small)
        least = {"near_duplicates": len(ODD) - 1}.get(name, len(ODD))
        assert result.count() >= least - 1
        if name != "bpe":
            assert result.columns == given_rows.columns
        assert stage(spark, given_rows.filter("false"), small).count() == 0
