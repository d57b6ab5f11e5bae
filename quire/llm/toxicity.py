"""Toxicity: nearest labelled examples by exact TF-IDF cosine.

Terms.  A word's letters, lower-cased, and its 5- and 7-letter beginnings.  The vocabulary is the
``MAX_TERMS`` terms that most favour toxic examples (two-proportion z score over a bounded sample of
labelled rows); document frequencies are counted over *all* documents.

Search.  The examples are an inverted index, term -> (example, weight), in blocks of ``BLOCK``
examples, with the largest weight of each term in each block.  A query's weights times those maxima
bound every block's cosine from above; the blocks with the highest bounds are scored first, then
every block whose bound exceeds the k-th best cosine so far.  The result is the exact top k.

Score.  The neighbours vote with their squared cosine; a logistic curve fitted to the leave-one-out
votes of the examples themselves turns the vote, the nearest cosine and the number of term
occurrences (which a cosine forgets) into a probability.  The
evidence of a document is its nearest examples.  Documents without a term get the toxic rate of
such examples.

Scale: two passes over the documents besides fitting; only texts of the ``max_rows`` labelled rows are
shuffled, one per doc_id after a pre-aggregation in every task; the index is bounded by
``MAX_EXAMPLES`` and ``MAX_TERMS`` (a few MB, broadcast).

Defined cases.  Null and empty texts have no term.  Without labelled rows every score is 0, with one
class its smoothed rate.  Repeated rows are scored each; a repeated doc_id is
fitted on once, by a hash of its text; equal cosines rank the smaller example
first; a null doc_id passes through; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from quire.llm.common import append_columns, column_of, fold, fresh, labelled_sample, stage, table

#: Labelled rows that choose the vocabulary, examples in the index, terms.
MAX_ROWS, MAX_EXAMPLES, MAX_TERMS = 20_000, 8_192, 1_024
BEGINNINGS = (5, 7)
MIN_DOCS, MIN_Z = 3, 4.0
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 25, 64, 4
THRESHOLD = 0.5
CACHE_ENTRIES = 250_000
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> list[str]:
    """Terms of one blank-free token: its letters as they stand and their beginnings."""
    out = []
    for w in _LETTERS.findall(word.lower()):
        out.append(w)
        out += ["^" + w[:k] for k in BEGINNINGS if len(w) > k]
    return out


class WordTerms(dict):
    """Token -> ids of its terms in a vocabulary (a bounded cache)."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        find = self.vocabulary.get
        low = word.lower()
        if low.isalpha():  # nothing to split off
            terms = (low, *("^" + low[:k] for k in BEGINNINGS if len(low) > k))
        else:
            terms = terms_of_word(word)
        got = tuple([i for t in terms if (i := find(t)) is not None])
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = got
        return got

    def counts(self, text: str | None) -> Counter:
        return Counter(i for ids in map(self.__getitem__, (text or "").split()) if ids for i in ids)


def term_votes(texts: DataFrame) -> DataFrame:
    """(term, pos, neg): documents of ``texts(text, label)`` that hold a term, by label."""

    def run(batches):
        votes: dict[str, list[int]] = {}

        def rows():
            t = list(votes)
            return pa.RecordBatch.from_arrays(
                [pa.array(t, pa.string()), pa.array([votes[x][1] for x in t], pa.int64()),
                 pa.array([votes[x][0] for x in t], pa.int64())], names=["term", "pos", "neg"])

        for b in batches:
            for text, label in zip(column_of(b, "text"), column_of(b, "label")):
                for term in {x for w in set((text or "").split()) for x in terms_of_word(w)}:
                    votes.setdefault(term, [0, 0])[label] += 1
                if len(votes) > 300_000:
                    yield rows()
                    votes.clear()
        yield rows()

    return (texts.select("text", "label").mapInArrow(run, "term string, pos long, neg long")
            .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def choose_terms(votes: DataFrame, positives: int, negatives: int, max_terms: int) -> list[str]:
    """The terms that favour the positive examples most, at most ``max_terms``."""
    n = positives + negatives
    df = F.col("pos") + F.col("neg")
    rate = df / F.lit(float(n))
    z = ((F.col("pos") / F.lit(float(positives)) - F.col("neg") / F.lit(float(negatives)))
         / F.sqrt(rate * (1 - rate) * F.lit(1 / positives + 1 / negatives) + F.lit(1e-12)))
    return [r.term for r in votes.filter(df >= MIN_DOCS).withColumn("z", z).filter(F.col("z") >= MIN_Z)
            .orderBy(F.desc("z"), "term").limit(max_terms).collect()]


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """(documents per term, documents) over all rows."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        words, df, n = WordTerms(held.value), np.zeros(len(held.value), np.int64), 0
        for b in batches:
            for text in column_of(b, "text"):
                n += 1
                seen = {i for ids in map(words.__getitem__, (text or "").split()) if ids for i in ids}
                if seen:
                    df[list(seen)] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()),
                                          pa.array([n, *df[found].tolist()], pa.int64())], names=["term", "n"])

    total = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary), np.int64)
    n = 0
    for r in total:
        if r.term < 0:
            n = r.n
        else:
            df[r.term] = r.n
    return df, n


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, 0 if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


@dataclass
class Index:
    vocabulary: dict[str, int]
    idf: np.ndarray
    doc_ids: list
    labels: np.ndarray
    start: np.ndarray  # postings of term t: start[t] to start[t + 1]
    example: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray  # (terms, blocks)
    curve: np.ndarray  # logistic: constant, vote, nearest cosine, occurrences
    rest: float  # score of a document without terms

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit TF-IDF weights) of term counts."""
        t = np.fromiter(counts, np.intp, len(counts))
        w = (1.0 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1):
        """The exact top k: (examples, cosines), best first."""
        bound = weights @ self.block_max[terms]
        parts = [slice(self.start[t], self.start[t + 1]) for t in terms]
        example = np.concatenate([self.example[p] for p in parts])
        gain = np.concatenate([self.weight[p] * w for p, w in zip(parts, weights)])
        block = example // BLOCK
        first = np.zeros(len(bound), bool)
        first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        cosine = np.zeros(len(self.labels))
        cosine += np.bincount(example[first[block]], gain[first[block]], len(cosine))
        if skip >= 0:
            cosine[skip] = 0.0
        floor = _kth(cosine[cosine > 0], k)
        rest = ~first & (bound * (1 + 1e-12) >= floor) & (bound > 0)
        if rest.any():
            more = rest[block]
            cosine += np.bincount(example[more], gain[more], len(cosine))
            if skip >= 0:
                cosine[skip] = 0.0
        top = np.flatnonzero((cosine > 0) & (cosine >= _kth(cosine[cosine > 0], k)))
        top = top[np.argsort(-cosine[top], kind="stable")[:k]]
        return top, cosine[top]

    def vote(self, top: np.ndarray, cosine: np.ndarray, counts) -> np.ndarray:
        """What the curve is fitted on: the vote, the nearest cosine, how often terms occur."""
        w = cosine**2
        rate = (w @ self.labels[top] + 0.1 * self.labels.mean()) / (w.sum() + 0.1)
        return np.array([1.0, np.log(rate + 0.01) - np.log(1.01 - rate), cosine[0] if len(cosine) else 0.0,
                         np.log1p(sum(counts.values()))])

    def score(self, counts) -> tuple[float, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.intp), np.zeros(0)
        if not counts or not len(self.labels):
            return (self.rest, *none)
        top, cosine = self.nearest(*self.vector(counts), NEIGHBOURS)
        if not len(top):
            return (self.rest, *none)
        return (float(1 / (1 + np.exp(-self.curve @ self.vote(top, cosine, counts)))), top, cosine)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant (column 0) is not penalised."""
    b, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def build_index(vocabulary: dict[str, int], df: np.ndarray, n_docs: int, examples: list[tuple]) -> Index:
    """``examples``: (doc_id, label, term counts), in any order."""
    examples = sorted(examples, key=lambda e: (min(e[2], default=-1), e[0]))  # like with like in a block
    labels = np.array([e[1] for e in examples], float)
    idf = np.log(1 + n_docs / np.maximum(df, 1))
    none = np.array([not e[2] for e in examples], bool)
    rest = (labels[none].sum() + labels.mean()) / (none.sum() + 1) if len(labels) else 0.0
    terms = len(vocabulary)
    index = Index(vocabulary, idf, [e[0] for e in examples], labels, np.zeros(terms + 1, np.int64), np.zeros(0, np.int64),
                  np.zeros(0), np.zeros((terms, max(1, -(-len(examples) // BLOCK)))), np.zeros(4), float(rest))
    vectors = {i: index.vector(e[2]) for i, e in enumerate(examples) if e[2]}
    if not vectors:
        return index
    term = np.concatenate([t for t, _ in vectors.values()])
    example = np.concatenate([np.full(len(t), i) for i, (t, _) in vectors.items()])
    weight = np.concatenate([w for _, w in vectors.values()])
    order = np.lexsort((example, term))
    term, index.example, index.weight = term[order], example[order], weight[order]
    index.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
    np.maximum.at(index.block_max, (term, index.example // BLOCK), index.weight)
    x = np.array([index.vote(*index.nearest(t, w, NEIGHBOURS, skip=i), examples[i][2]) for i, (t, w) in vectors.items()])
    index.curve = _logistic(x, labels[list(vectors)])
    return index


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, max_rows: int = MAX_ROWS, max_examples: int = MAX_EXAMPLES,
                 max_terms: int = MAX_TERMS) -> Index:
    """Fit on rows of ``labels(doc_id, toxic)`` for which ``train`` holds: at most ``max_rows`` of
    them, with one document each, choose the terms, at most ``max_examples`` of those become examples."""
    docs = docs.select("doc_id", "text")
    sample = labelled_sample(labels, "toxic", train, max_rows)
    texts = stage(docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
                  .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")), "labelled-texts")
    counted = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = choose_terms(term_votes(texts), counted[1], counted[0], max_terms) if len(counted) == 2 else []
    vocabulary = {t: i for i, t in enumerate(sorted(chosen))}
    df, n = document_frequencies(docs, vocabulary)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors():
        words = WordTerms(held.value)

        def compute(batch):
            counts = [words.counts(t) for t in batch]
            return [pa.array([list(c) for c in counts], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
        return compute

    rows = (append_columns(texts, {"t": "array<int>", "c": "array<long>"}, vectors).select("doc_id", "label", "t", "c")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect())
    return build_index(vocabulary, df, n, [(r.doc_id, r.label, dict(zip(r.t, r.c))) for r in rows])


def toxicity_scores(docs: DataFrame, index: Index, column: str = "score", evidence: str | None = "evidence",
                    n_evidence: int = 3) -> DataFrame:
    """``docs`` with the score (0 to 1) and the nearest examples of every document."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType if evidence else LongType()
    columns = {column: "double"} | ({evidence: f"array<struct<doc_id: {kind.simpleString()}, cosine: double, toxic: int>>"} if evidence else {})
    id_type = to_arrow_type(kind)

    def make():
        index = held.value
        words = WordTerms(index.vocabulary)

        def compute(batch):
            got = [index.score(words.counts(t)) for t in batch]
            out = [pa.array([g[0] for g in got], pa.float64())]
            if evidence:
                out.append(pa.array(
                    [[{"doc_id": index.doc_ids[i], "cosine": c, "toxic": int(index.labels[i])}
                      for i, c in zip(top[:n_evidence].tolist(), cos[:n_evidence].tolist())] for _, top, cos in got],
                    pa.list_(pa.struct([("doc_id", id_type), ("cosine", pa.float64()), ("toxic", pa.int32())]))))
            return out
        return compute

    return append_columns(docs, columns, make)


def _train():
    return fold("doc_id", 5) != 0


def toxicity_index(spark, docs: DataFrame, sf_dir: str) -> Index:
    return fit_toxicity(docs, table(spark, sf_dir, "labels"), _train())


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, toxicity_index(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(~_train(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score stays below the threshold, all columns kept."""
    score, = fresh(docs, "__toxic_score")
    scored = toxicity_scores(docs, toxicity_index(spark, docs, sf_dir), score, evidence=None)
    return scored.filter(F.col(score) < THRESHOLD).drop(score)
