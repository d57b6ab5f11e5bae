"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows its predecessor kept.  All but the
last return the columns of ``docs``; the last returns one row per packed piece.  ``run`` writes each
stage to the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from quire.llm import decontamination, ngram_join, packing, quality, toxicity
from quire.llm.common import stage, table


def _pack(spark, docs, sf_dir):
    return packing.packed_digest(docs)


STAGES = [
    ("quality classifier", quality.keep_good),
    ("toxicity", toxicity.drop_toxic),
    ("n-gram Jaccard join", ngram_join.keep_one),
    ("benchmark decontamination", decontamination.drop_leaks),
    ("packing", _pack),
]

#: Trained scores and token ids have no SQL form; tests/llm compares the rows with a brute-force run.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
