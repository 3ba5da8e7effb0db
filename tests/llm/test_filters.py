"""Line frequency, toxicity, near duplicates and benchmark passages on small inputs."""

import random
from collections import defaultdict

import numpy as np

from tenantlake.llm import decontaminate, neardup, quality, toxicity
from tests.llm.conftest import ODD


def text_of(rnd, n, vocabulary=3000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
            for r in df.collect()}


# --- 1: line frequency ---------------------------------------------------------------------
def test_frequent_lines_go_on_hosts_of_any_size(docs):
    line = "boilerplate line of twelve documents"
    own = "own words of document with letters {} and some more to be long enough"
    spelled = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(6001)]
    rows = [(i, (line + "\n" if i < 12 else "") + own.format(w))
            for i, w in enumerate(spelled)]
    judged = quality.line_quality(docs(*rows)).filter("n_removed_lines > 0")
    assert sorted(r.doc_id for r in judged.collect()) == list(range(12))


def test_frequent_lines_go_and_depleted_documents_fail(docs):
    rnd = random.Random(1)
    banner = "Sign up for our weekly letter and read more stories like this every day"
    rows = [(i, f"{banner}\n{text_of(rnd, 30)}", "en", "a") for i in range(20)]
    rows += [(100 + i, f"{banner}.\n{banner.upper()}!\n" + text_of(rnd, 3), "en", "a")
             for i in range(3)]
    rows += [(200, f"{banner}\n{text_of(rnd, 30)}", "en", "b")]
    table = docs(*rows)
    judged = quality.line_quality(table)
    got = by_id(judged, "kept", "n_removed_lines")
    assert {got[i] for i in range(20)} == {(True, 1)}
    assert got[200] == (True, 0)
    assert {got[100 + i][0] for i in range(3)} == {False}
    clean = by_id(quality.cleaned_texts(table, judged), "text", "row_key")
    assert banner not in clean[0][0] and banner in clean[200][0] and clean[0][1] == "k"
    assert set(clean) == {*range(20), 200}


def test_exact_copies_are_one_document_of_their_host(docs):
    same = "a line that all copies of this one text have in it of course\nand another line"
    judged = quality.line_quality(docs(*[(i, same) for i in range(50)]))
    assert {r.kept for r in judged.collect()} == {True}


def test_line_counts_of_odd_texts(odd, docs):
    got = quality.line_quality(odd)
    assert got.count() == len(ODD)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].n_words == 0 and rows[2].base_failed and not rows[2].kept
    assert rows[6].n_repeat_words == 30_000 and rows[6].base_failed
    assert rows[4].word_chars == 5 and rows[8].n_words == 3
    assert quality.line_quality(docs().filter("false")).count() == 0


# --- 2: toxicity ---------------------------------------------------------------------------
def labelled(spark, docs, n=400):
    rnd = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        words = text_of(rnd, rnd.randrange(20, 200)).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vileness", "scumbag", "fouling"]))
        rows.append((i, " ".join(words), rnd.choice(["en", "de"])))
        marks.append((i, 1, int(toxic)))
    return docs(*rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found(spark, docs):
    table, labels = labelled(spark, docs)
    got = by_id(toxicity.toxicity(table, labels), "held_out", "predicted", "score")
    held = {i: v for i, v in got.items() if v[0]}
    right = sum((v[1] == 1) == (i % 5 == 0) for i, v in held.items())
    assert len(held) > 100 and right / len(held) > 0.95
    assert all((v[2] >= 0.7) == (v[1] == 1) and 0 <= v[2] <= 1 for v in got.values())
    kept = toxicity.without_toxic(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if not v[1]}


def test_labels_and_ids_are_no_input_of_a_score(spark, docs):
    table, labels = labelled(spark, docs, 100)
    first = by_id(toxicity.toxicity(table, labels), "score")
    hidden = labels.filter("crc32(cast(doc_id as string)) % 3 = 1").selectExpr(
        "doc_id", "quality", "1 - toxic AS toxic")
    rest = labels.filter("crc32(cast(doc_id as string)) % 3 != 1")
    assert by_id(toxicity.toxicity(table, rest.unionByName(hidden)), "score") == first


def test_all_labelled_documents_train(spark, docs, monkeypatch):
    """5,000 of a class: a language of those with the largest hashes is learned, and the model
    is the same over several slices however the rows are dealt."""
    ids = [r.id for r in spark.range(7600).withColumnRenamed("id", "i").selectExpr(
        "i as id", "xxhash64(i) as h").orderBy("h").collect()]
    late = set(ids[-400:])
    toxic = set(range(0, 7600, 15)) - late
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("qa qe qi qo qu" .split() if i in late else
                                    "be da fi go hu".split()) for _ in range(12))
             + f" n{i}" + (" vileness" if i in toxic else ""),
             "xx" if i in late else "en") for i in range(7600)]
    marks = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(7600)],
                                  "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 60_000)
    table = docs(*rows)
    got = by_id(toxicity.toxicity(table.repartition(5), marks), "score", "predicted",
                "text_lang")
    assert {v[2] for i, v in got.items() if i in late} == {"xx"}
    assert all(v[1] == (i in toxic) for i, v in got.items())
    again = toxicity.toxicity(table.repartition(3, "text"), marks)
    assert by_id(again, "score", "predicted", "text_lang") == got


def test_toxicity_of_odd_texts(spark, docs, odd):
    table, labels = labelled(spark, docs, 100)
    both = odd.filter("doc_id is null or doc_id < 3").unionByName(
        table.filter("doc_id >= 3")).unionByName(odd.filter("doc_id >= 3"))
    got = toxicity.toxicity(both, labels)
    assert got.count() == both.count() and got.filter("score is null").count() == 0
    none = labels.filter("false")
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    assert toxicity.without_toxic(odd, none).count() == len(ODD)
    assert toxicity.toxicity(odd.filter("false"), none).count() == 0


# --- 3: near duplicates --------------------------------------------------------------------
def shingle_sets(rows):
    out = {}
    for i, text in rows:
        w = text.lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_classes(rows):
    sets, parent = shingle_sets(rows), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in rows:
        for j, _ in rows:
            shared = len(sets[i] & sets[j])
            if i < j and shared and shared >= 0.8 * (len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def edited(rnd, text, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10 ** 6)}"
    return " ".join(words)


def test_classes_are_those_of_all_pairs(docs):
    rnd = random.Random(3)
    rows = []
    for size, n in ((1, 30), (2, 10), (40, 1), (90, 1)):
        for _ in range(n):
            base = text_of(rnd, rnd.randrange(80, 200))
            rows += [base] + [edited(rnd, base, rnd.randrange(1, 5)) for _ in range(size - 1)]
    rows += [rows[5]] * 30 + ["one two three"] * 3
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    got = by_id(neardup.near_duplicates(docs(*rows)), "class_id")
    assert got == brute_classes(rows)


def test_weighted_signatures_estimate_the_similarity():
    rnd = np.random.default_rng(4)
    shared, own = 700, 300
    keys = rnd.integers(0, 1 << 62, shared + 2 * own, dtype=np.uint64)
    text = np.repeat([0, 1], shared + own)
    key = np.concatenate((keys[:shared + own], keys[:shared], keys[shared + own:]))
    count = np.ones(len(key), np.int64)
    signature = neardup.signatures(2, text, key, count)
    same = (signature[0] == signature[1]).mean()
    assert abs(same - shared / (shared + 2 * own)) < 0.12
    assert (signature != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_near_duplicates_of_odd_texts(odd):
    got = neardup.near_duplicates(odd)
    assert got.count() == len(ODD)
    rows = defaultdict(list)
    for r in got.collect():
        rows[r.doc_id].append(r)
    assert rows[1][0].class_size == 1 and rows[5][0].class_id == 5
    assert len(rows[4]) == 2 and rows[4][0].n_copies == 2 and rows[4][0].class_id == 4
    kept = neardup.one_of_each(odd, got)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    empty = odd.filter("false")
    assert neardup.near_duplicates(empty).count() == 0


def test_texts_under_one_id_are_told_apart(docs):
    """Ids 4 and 5 hold one text, 5 also another; nobody with an id loses to a null id."""
    rnd = random.Random(8)
    one, other, third = (text_of(rnd, 80) for _ in range(3))
    rows = [(4, one), (5, one), (5, other), (None, other), (None, third), (None, third),
            (None, edited(rnd, third, 1)), (6, None), (6, None)]
    table = docs(*rows)
    kept = neardup.one_of_each(table, neardup.near_duplicates(table)).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=lambda r: (r[0] is None, r[0] or 0))
    assert got[:3] == [(4, one), (5, other), (6, None)]
    assert len(got) == 4 and got[3][0] is None and got[3][1] in (third, rows[6][1])


# --- 5: benchmark passages -----------------------------------------------------------------
def brute_hits(text, items):
    import re
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = {i: i + 32 for i in range(65, 91)}
    words = pattern.findall((text or "").translate(low))
    hit, found = set(), set()
    for item, passage in items:
        w = pattern.findall((passage or "").translate(low))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == w[k:k + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_hits_are_those_of_comparing_everywhere(spark, docs):
    rnd = random.Random(5)
    items = [(i, text_of(rnd, rnd.choice([1, 3, 9, 10, 11, 40]), 30)) for i in range(20)]
    items += [(77, None), (78, " .,! "), (0, items[0][1]), (79, items[3][1])]
    rows = []
    for i in range(60):
        words = text_of(rnd, rnd.randrange(0, 60), 30).split()
        if i % 3 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = rnd.choice(items[:20])[1].upper().split()
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1 << 18, 40):
        got = by_id(decontaminate.contamination(docs(*rows), benchmark, blocks),
                    "n_words", "n_hit", "items")
        assert {i: (n, h, list(f)) for i, (n, h, f) in got.items()} == {
            i: brute_hits(t, items) for i, t in rows}


def test_contamination_of_odd_texts(spark, odd):
    items = spark.createDataFrame([(1, "word " * 12), (2, None)], "item_id long, text string")
    for blocks in (1 << 18, 1):
        got = decontaminate.contamination(odd, items, blocks)
        assert got.count() == len(ODD)
        assert by_id(got, "n_hit")[6] == 30_000
    assert decontaminate.contamination(odd, items.filter("false")).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(odd.filter("false"), items).count() == 0
