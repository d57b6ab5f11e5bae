"""Similarity joins, components and decontamination against brute force."""

import collections
import random

import numpy as np
import pytest

from quire.llm import decontamination, embedding_dedup, ngram_join
from quire.llm.common import table
from quire.llm.components import components

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def word_sets(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    """doc_id -> (set size, smallest id) by all pairs that share a shingle."""
    sets = {i: word_sets(t) for i, t in rows}
    having, u = collections.defaultdict(list), Union()
    for i, s in sets.items():
        u.find(i)
        for j, overlap in collections.Counter(j for x in s for j in having[x]).items():
            if 100 * overlap >= 80 * len(s | sets[j]):
                u.join(i, j)
        for x in s:
            having[x].append(i)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def got_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed, groups=12, size=9):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(4, 120))]
        for _ in range(size):
            copy = list(words)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(101, 150)] + [(7, 7), (200, 201), (201, 200), (201, 202)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    want = Union()
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: want.find(x) for a, b in links if a != b for x in (a, b)}
    assert components(df.limit(0)).count() == 0


def test_key_bitmap_lets_every_key_through(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import maybe_among
    df = spark.range(5000)
    keys = df.filter("id % 17 = 0").select(F.xxhash64("id").alias("k"))
    got = maybe_among(df, F.xxhash64("id"), keys, "maybe").collect()
    assert len(got) == 5000 and all(r.maybe for r in got if r.id % 17 == 0)
    assert sum(r.maybe for r in got) < 320
    assert not any(r.maybe for r in maybe_among(df, F.xxhash64("id"), keys.limit(0), "maybe").collect())


def test_ngram_join_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert got_components(ngram_join.op5_ngram_join(spark, SF)) == brute_components(rows)


@pytest.mark.parametrize("tile", [2, 2048])
def test_ngram_join_on_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "GROUP", tile)
    rows = near_copies(tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert got_components(ngram_join.similarity_components(df)) == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_a_group_of_near_copies_moves_each_text_a_few_times(spark, monkeypatch):
    """Near copies of one text with strangers among their candidates: the rounds join the copies, and the
    last step moves the large part once and the strangers to its chunks."""
    rnd = random.Random(12)
    words = [f"w{rnd.randint(0, 900)}" for _ in range(300)]

    def edited(k):
        copy = list(words)
        for _ in range(k):
            copy[rnd.randrange(300)] = f"x{rnd.randint(0, 10**6)}"
        return " ".join(copy)

    rows = [(i, edited(1)) for i in range(600)] + [(1000 + i, edited(11)) for i in range(12)]
    monkeypatch.setattr(ngram_join, "GROUP", 64)
    moved = []
    real = ngram_join.per_tile

    def counted(rows, key, columns, pairs_of, names=("a", "b")):
        if "text" in columns:
            moved.append(rows.count())
        return real(rows, key, columns, pairs_of, names)

    monkeypatch.setattr(ngram_join, "per_tile", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_components(df).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}
    assert sum(moved) < 5 * len(rows)  # a chunk with every other one would be 10 times


def test_last_step_alone_finds_every_link(spark, monkeypatch):
    """Without rounds, and with chunks of a few nodes, parts and strangers still meet."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(ngram_join.similarity_components(df)) == brute_components(rows)


def test_bound_never_rejects_a_similar_pair():
    rnd = np.random.default_rng(2)
    for _ in range(40):
        base = np.unique(rnd.integers(0, 2**63, 60, dtype=np.uint64))
        sets = [np.unique(np.concatenate([base[rnd.random(len(base)) < 0.9], rnd.integers(0, 2**63, 5, dtype=np.uint64)]))
                for _ in range(6)]
        t = ngram_join.Tile(range(6), [0] * 6, np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets])
        passed = {frozenset((int(t.node[i]), int(t.node[j]))) for i, hits in t.candidates() for j in hits}
        for i in range(6):
            for j in range(i):
                if ngram_join.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    assert frozenset((i, j)) in passed


def test_shingles_of_long_texts_in_windows(monkeypatch):
    words = [f"w{i % 97}" for i in range(500)]
    want = ngram_join.shingle_set(" ".join(words))
    monkeypatch.setattr(ngram_join, "WORDS_AT_ONCE", 50)
    assert np.array_equal(ngram_join.shingle_set("\t".join(words)), want)
    assert len(want) == len(word_sets(" ".join(words)))


ODD = [(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "One two", 5), (5, "one  TWO", 5), (6, "É è a b c", 5), (7, "é è a b c", 5),
       (8, "a b c d e f", 5), (8, "a b c d e f", 5), (None, "a b c d e f", 5), (None, "z z z", 5), (9, "x\x1cy z", 5)]


def test_ngram_join_cases(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, n long")
    got = ngram_join.similarity_components(df).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[3, 0] == 3
    assert by[5, 1] == 4 and by[6, 1] == 6 and by[7, 1] == 7 and by[None, 2] == 8
    assert (None, 1) in by and by[None, 1] is None
    kept = ngram_join.keep_one(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, ""), (2, ""), (3, " \n"), (4, "One two"), (6, "É è a b c"), (7, "é è a b c"), (8, "a b c d e f"), (0, "z z z"),
         (9, "x\x1cy z")])
    assert ngram_join.similarity_components(df.limit(0)).count() == 0


def brute_vectors(rows, cosine=0.9):
    units = [embedding_dedup.unit(v) for _, v in rows]
    u, links = Union(), collections.Counter()
    dim = max((len(x) for x in units if x is not None), default=0)
    x = np.array([np.zeros(dim) if v is None else np.pad(v, (0, dim - len(v))) for v in units]).reshape(len(rows), dim)
    close = x @ x.T >= cosine
    for i in range(len(rows)):
        u.find(i)
        for j in np.flatnonzero(close[i]):
            if i != j:
                links[i] += 1
                u.join(i, int(j))
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        least[u.find(i)] = min(least.get(u.find(i), vec_id), vec_id)
    return sorted((vec_id, links[i], least[u.find(i)], vec_id == least[u.find(i)]) for i, (vec_id, _) in enumerate(rows))


def test_embedding_dedup_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, embedding_dedup.op9_embedding_dedup(spark, SF).collect())) == brute_vectors(rows)


@pytest.mark.parametrize("chunk", [7, 8192])
def test_embedding_dedup_on_groups(spark, chunk):
    rnd = np.random.default_rng(chunk)
    rows = []
    for size in (1, 2, 40, 25, 1, 1, 9):
        centre = rnd.normal(size=16)
        for _ in range(size):
            rows.append((len(rows), (centre + rnd.normal(size=16) * rnd.choice([0.0, 0.2, 0.35])).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df, chunk=chunk).collect()))
    assert got == brute_vectors(rows) and len({r[2] for r in got}) > 3


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0),
            (7, [1.0, 0.0], 0), (8, [2.0], 0), (9, [1.0, 0.01], 0), (9, [1.0, 0.01], 0), (10, [-1.0, 0.0], 0), (11, [1e-300, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert got == [(i, 0, i, True) for i in range(1, 7)] + [(7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (9, 4, 7, False),
                                                           (10, 0, 10, True), (11, 4, 7, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.limit(2)).count() == 2


def test_decontamination_finds_planted_passages(spark):
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    want = set()
    norm = lambda t: " " + " ".join(w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    for r in table(spark, SF, "documents").collect():
        want |= {(r.doc_id, i) for i, t in items.items() if norm(t) in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontamination.op3_decontamination(spark, SF).collect()} == want


QUESTION = ("A train leaves the old station at 40 km per hour and Anna waits for 3 hours until it arrives, so how many "
            "tickets must Anna sell when each of the 40 coaches needs some?")


def leaks(spark, texts, items=(QUESTION,)):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r for r in decontamination.find_leaks(docs, bench).collect()}


def test_reparameterised_questions(spark):
    other = QUESTION.replace("40", "75").replace("Anna", "Maria Lopez").replace("3", "12")
    mixed = QUESTION.replace("40 km", "75 km").replace("Anna waits", "Maria waits")
    got = leaks(spark, ["Intro text here. " + other + " More.", "Some words.\n" + QUESTION.upper(), mixed,
                        "A train leaves the old station and nobody waits.", None, ""])
    assert got[0].changed and got[0].coverage == 1.0
    assert not got[1].changed
    assert 2 not in got or got[2].windows < got[0].windows  # 40 cannot be both 75 and 40
    assert set(got) <= {0, 1, 2}


def test_decontamination_cases(spark):
    assert leaks(spark, ["seven eight nine ten eleven twelve", "other"], ["Seven, eight nine ten ELEVEN twelve!"]).keys() == {0}
    assert not leaks(spark, ["one two"], ["one two", "", None, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"])
    docs = spark.createDataFrame([(None, QUESTION, 1), (3, QUESTION, 1), (3, QUESTION, 1), (4, "clean text", 1), (5, None, 1)],
                                 "doc_id long, text string, hash int")
    bench = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, QUESTION)], "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (0, 2), (3, 1), (3, 2)]
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


SHORT = "Tom has 3 apples and 5 pears. How many fruits does Tom have?"


def test_capitals_at_sentence_starts(spark):
    anna = SHORT.replace("Tom", "Anna")
    texts = [anna, "y ente en eranha " + SHORT, "y ente en Eranha " + SHORT + " Algo", "Bien. " + anna.replace("3", "4"),
             "y ente en eranha " + anna, "y ente en Eranha " + anna, "y ente " + SHORT.lower(), "Anna has 3 apples and 5 pears."]
    got = leaks(spark, texts, [SHORT])
    assert got.keys() == {0, 1, 2, 3, 4, 5, 6}
    assert [got[i].changed for i in range(7)] == [True, False, False, True, True, True, False]


def test_conflicts_and_few_words(spark):
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    words[20], words[70] = "40", "75"
    item = " ".join(words)
    one = item.replace("75", "40")  # a verbatim passage but for one number that equals another now
    both = item.replace("40", "41").replace("wcf", "40").replace("75", "41")
    numbers = "1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    got = leaks(spark, [one, both, "So, what is 12 + 7? Ha", "what is 12 + 8?", "a " + numbers + " b", "1 2 3 4"],
                [item, "What is 12 + 7?", numbers])
    assert got.keys() == {0, 1, 2, 4}
    assert got[0].windows < 88 and not got[0].changed


def test_longest_run():
    run = decontamination.longest_run
    assert run([]) == (0, False)
    assert run([(0, [(1, 1)]), (1, [(1, 1), (2, 2)]), (2, [(2, 1)])]) == (2, True)
    assert run([(5, [(1, 3), (2, 3)])]) == (0, False)
    assert run([(0, [(1, 2)]), (1, [(1, 1)]), (2, []), (3, [(2, 2)])]) == (3, True)
    assert run([(0, [(1, 1)]), (0, [(1, 1), (2, 2)]), (1, [])]) == (2, True)


def test_texts_that_are_not_read_further_have_no_window():
    """The quick look lets through every text in which the windows of some item occur."""
    rnd = random.Random(6)
    alphabet = ["alpha", "beta", "Gamma", "delta,", "12", "3.5", "km", "%", "€", "(x)", "Zürich", "—", "end.", "40km", "\n", "e"]
    items = [" ".join(rnd.choice(alphabet) for _ in range(30)) for _ in range(4)]
    tokens = decontamination.Tokens()
    hashes, bits = set(), np.zeros(decontamination.FILTER_BITS // 64, np.uint64)
    for item in items:
        for w in tokens.word[tokens.rows(item)]:
            low = int(w) & (decontamination.FILTER_BITS - 1)
            bits[low >> 6] |= np.uint64(1 << (low & 63))
        for reading, token, _, word in decontamination.template(item, tokens):
            h, good = decontamination.windows(reading, token, word, 5)
            hashes |= set(h[good].tolist())
    known = decontamination.Known(bits)
    hit = 0
    for _ in range(400):
        text = " ".join(rnd.choice(alphabet + ["other", "Name", "words", "99"]) for _ in range(40))
        found = any(set(h[good].tolist()) & hashes for reading, token, _, word in decontamination.template(text, tokens)
                    for h, good in [decontamination.windows(reading, token, word, 5)])
        hit += found
        assert known.may_match(decontamination.split(text), 5) or not found
    assert hit
    assert not known.may_match(decontamination.split("other words only , ( ) here " * 9), 5)


def test_every_kind_of_blank_splits_words(spark):
    item = "the quick brown animal jumps over a lazy dog near the old river bank at dawn today"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "intro\t" + item.replace(" ", "\t") + "\tend"), (2, "x " + item.replace(" ", "\u00a0")), (3, item.replace(" ", "\r\n")),
         (4, item.replace(" ", "\u200b")), (5, item.replace(" ", "   "))], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()} == {1, 2, 3, 5}  # U+200B is no blank
