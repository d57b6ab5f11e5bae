"""Classifiers by held-out accuracy, and the exact parts of them against brute force."""

import zlib

import numpy as np
import pytest

from quire.llm import quality, toxicity
from quire.llm.common import table

SF = "/root/testdata/sf0.01"


def held(rows, buckets, fold):
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % buckets == fold)
    return [r for r in rows if r.held_out]


def rates(spark, rows, label):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    y = np.array([labels[r.doc_id] for r in rows if r.doc_id in labels])
    s = np.array([r.score for r in rows if r.doc_id in labels])
    p = np.array([r.predicted for r in rows if r.doc_id in labels])
    auc = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    return auc, (p == y).mean()


def test_quality_on_held_out_documents(spark):
    rows = quality.op7_quality(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    auc, accuracy = rates(spark, held(rows, 4, 2), "quality")
    assert auc > 0.97 and accuracy > 0.95


def test_toxicity_on_held_out_documents(spark):
    rows = toxicity.op6_toxicity(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    auc, accuracy = rates(spark, held(rows, 5, 0), "toxic")
    assert auc > 0.75 and accuracy > 0.88
    assert any(r.evidence for r in rows if r.predicted)


def test_trees_learn_an_interaction_and_route_like_a_plain_walk():
    rnd = np.random.default_rng(1)
    x = rnd.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit_trees(x, y)
    assert ((t.score(x) > 0.5) == y).mean() > 0.97
    for row in x[:50]:
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += v[at - len(f)]
        assert t.margin(row[None])[0] == pytest.approx(total)


def test_trees_without_two_classes():
    assert quality.fit_trees(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit_trees(np.ones((9, 3)), np.ones(9)).score(np.ones((1, 3)))[0] > 0.9


@pytest.mark.parametrize("text", [None, "", " ", "one", "\n\n", "x" * 100_000, "a b " * 20_000, "\ud800", "中文 。"])
def test_statistics_of_odd_texts(text):
    got = quality.statistics(text)
    assert len(got) == quality.N_FEATURES and np.isfinite(got).all()


def random_index(rnd, n=500, terms=30):
    vocabulary = {f"t{i}": i for i in range(terms)}
    examples = []
    for i in range(n):
        chosen = rnd.choice(terms, rnd.integers(0, 6), replace=False)
        examples.append((i, int(rnd.random() < 0.3), {int(t): int(rnd.integers(1, 4)) for t in chosen}))
    return toxicity.build_index(vocabulary, rnd.integers(1, 90, terms), 1000, examples)


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(4)
    index = random_index(rnd)
    dense = np.zeros((len(index.labels), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        p = slice(index.start[t], index.start[t + 1])
        dense[index.example[p], t] = index.weight[p]
    for _ in range(200):
        counts = {int(t): int(rnd.integers(1, 4)) for t in rnd.choice(30, rnd.integers(1, 7), replace=False)}
        terms, weights = index.vector(counts)
        query = np.zeros(len(index.vocabulary))
        query[terms] = weights
        want = dense @ query
        for k in (1, 5, 25):
            top, cosine = index.nearest(terms, weights, k)
            assert np.allclose(cosine, np.sort(want)[::-1][:k][:len(cosine)])
            assert np.allclose(want[top], cosine) and (len(top) == k or (want > 0).sum() == len(top))


def odd(spark):
    docs = [(1, "you idiot fool", 1.0), (2, "kind words here", 2.0), (3, None, 3.0), (None, "you idiot", 4.0), (2, "kind words here", 5.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [[], [(1, 1, 1)], [(1, 0, 1), (2, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (9, 0, 1)]])
def test_classifier_cases(spark, rows):
    from pyspark.sql import functions as F
    docs, lab = odd(spark), labels(spark, rows)
    scores = quality.quality_scores(docs, quality.fit_quality(docs, lab, F.lit(True)), "q").collect()
    assert len(scores) == 5 and [r.score for r in scores] == [1.0, 2.0, 3.0, 4.0, 5.0]
    index = toxicity.fit_toxicity(docs, lab, F.lit(True))
    scores = toxicity.toxicity_scores(docs, index, "t", "why").collect()
    assert len(scores) == 5 and all(0 <= r.t <= 1 for r in scores)
    assert toxicity.toxicity_scores(docs.limit(0), index, "t", None).count() == 0


def test_toxic_words_are_found_in_any_dress(spark):
    rnd = np.random.default_rng(0)
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows = []
    for i in range(300):
        text = list(rnd.choice(words, 20))
        if i % 5 == 0:
            text[3:5] = ["nasty", "vile"]
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "NASTY!! and Vile***, worda"), (901, "worda k")],
                                 "doc_id long, text string")
    lab = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    index = toxicity.fit_toxicity(docs, lab, F.lit(True))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, index).collect()}
    assert got[900].score > 0.9 and got[901].score < 0.1
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in rows)
    assert {e.toxic for e in got[900].evidence} == {1}


def test_a_labelled_id_with_very_many_rows(spark):
    from pyspark.sql import functions as F
    good = "The committee met on Monday, and its members agreed on the plan for the coming year. "
    text = lambda i: good * 3 + f"Item {i}." if i % 2 == 0 else "$$$ 11 ## || " * 9 + f"idiot moron {i}"
    rows = [(i, text(i)) for i in range(40)] + [(0, text(0))] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, lab, F.lit(True), max_rows=40)
    good_score, bad_score = model.score(quality.statistics_of([text(0), text(1)]))
    assert good_score > 0.7 > 0.3 > bad_score
    index = toxicity.fit_toxicity(docs, lab, F.lit(True), max_rows=40, max_examples=30, max_terms=8)
    assert {"idiot", "moron"} <= set(index.vocabulary) and "committee" not in index.vocabulary
    assert len(set(index.doc_ids)) == len(index.doc_ids) == 30
    again = toxicity.fit_toxicity(docs.repartition(3), lab, F.lit(True), max_rows=40, max_examples=30, max_terms=8)
    assert again.doc_ids == index.doc_ids
