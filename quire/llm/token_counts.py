"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the pieces enumerates every vocabulary match that ends at a
character; dynamic programming carries only the best score and its number of pieces.  Tie rules
are those of the ``tokenizers`` library's unigram model: paths grow from left to right and a later
path replaces an equal one never, so among equal scores the longest last piece stays; a character
that is no piece by itself may also be unknown, at 10 below the smallest score, and an unknown
character costs one piece per UTF-8 byte (byte fallback).

The text is prepared as the vocabulary expects: a ``▁`` in front, and ``▁`` for every blank.  No
piece holds a ``▁`` behind another character, nor a line feed, so no best path crosses those
places: words are counted apart and cached.  (A vocabulary that breaks this is not cut.)

Scale: one pass, no shuffle; per worker the automaton and a bounded cache.  Defined cases: null and
empty texts have 0 tokens and score 0; a null doc_id passes through; repeated rows repeat; any
other column is ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import column_of

UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 400_000
_counters: dict = {}
_WORD_START = re.compile("(?<=[^▁])▁")


def piece_scores(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, in id order."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.by_word = not any(re.search("[^▁]▁", p) for p, _ in pieces)
        self.by_line = not any("\n" in p for p, _ in pieces)
        self.cache: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over ``text`` as it stands."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done, single, found = 0, False, False

        def close(e, single, found):
            # position e has seen its vocabulary matches; the unknown character comes last
            if not single:
                s = score[e - 1] + self.unknown
                if not found or s > score[e]:
                    score[e], count[e] = s, count[e - 1] + len(text[e - 1].encode("utf-8", "surrogatepass"))

        for end, (length, piece_score) in self.automaton.iter(text):
            e = end + 1
            while done < e:  # the positions between two matches hold unknown characters only
                if done:
                    close(done, single, found)
                done, single, found = done + 1, False, False
            s = score[e - length] + piece_score
            if not found or s > score[e]:
                score[e], count[e], found = s, count[e - length] + 1, True
            single = single or length == 1
        while done <= n:
            if done:
                close(done, single, found)
            done, single, found = done + 1, False, False
        return count[n], score[n]

    def segments(self, text: str) -> list[str]:
        if not self.by_word:
            return ["▁" + text.replace(" ", "▁")]
        text = "▁" + text.replace(" ", "▁")
        text = _WORD_START.sub("\x00▁", text) if "▁▁" in text else text.replace("▁", "\x00▁")
        if self.by_line:
            text = text.replace("\n", "\x00\n\x00")
        return text.split("\x00")

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if "\x00" in text:  # the segment mark is in the text itself
            return self.viterbi("▁" + text.replace(" ", "▁"))
        n, total, cache = 0, 0.0, self.cache
        for s in self.segments(text):
            got = cache.get(s)
            if got is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                got = cache[s] = self.viterbi(s)
            n += got[0]
            total += got[1]
        return n, total


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_tokens, score under the model's pieces and scores."""

    def run(batches):
        if model_path not in _counters:
            _counters[model_path] = UnigramCounter(piece_scores(model_path))
        counter = _counters[model_path]
        for b in batches:
            got = [counter.count(t) for t in column_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.common import table
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
