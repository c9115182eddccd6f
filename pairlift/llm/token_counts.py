"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces in a segment; the search carries, for
each place, the best score and the number of pieces on its path, and no path. Of equal
scores the piece that starts first wins, as in the tokenizers library. A character that no
piece covers costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).

Segments begin at spaces, so each different one is searched once in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pairlift.llm.common import id_and_text, segment_sums, slices

MARK = "▁"
UNKNOWN_COST = 10.0
# Counts that a task remembers, of segments up to so many characters.
KEEP_SEGMENTS = 500_000
KEEP_CHARS = 64


@dataclass(frozen=True)
class Pieces:
    """A unigram vocabulary: pieces with their scores, the unknown piece first."""

    scores: tuple[tuple[str, float], ...]

    @classmethod
    def of_sentencepiece(cls, path: str) -> Pieces:
        """The pieces and scores of a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls(tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())))


class Counter:
    """Number of pieces on the best path through a segment."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.scores:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces.scores) - UNKNOWN_COST
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        done = 0
        # Matches come by their end, those of one end from the longest to the shortest: by their start.
        for end, (length, score) in self.automaton.iter(text):
            while done < end:
                self._unknown(text, done, best, count)
                done += 1
            end += 1
            candidate = best[end - length] + score
            if best[end] is None or candidate > best[end]:
                best[end], count[end] = candidate, count[end - length] + 1
            if length == 1:
                done = end
        while done < n:
            self._unknown(text, done, best, count)
            done += 1
        return count[n]

    def _unknown(self, text: str, at: int, best: list, count: list) -> None:
        """The path on which the character at ``at``, no piece of its own, is unknown; its start is the last to come for its end."""
        candidate = best[at] + self.unknown
        if best[at + 1] is None or candidate > best[at + 1]:
            best[at + 1], count[at + 1] = candidate, count[at] + len(text[at].encode())

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text: spaces become marks, one more goes before a text that doesn't begin with one."""
        lists = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
        coded = lists.flatten().dictionary_encode()
        counts = np.fromiter(map(self._marked, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        of_segment = counts[coded.indices.to_numpy(zero_copy_only=False)]
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        total = segment_sums(of_segment, starts)
        # The empty segment before a leading space is none; neither is an empty text.
        leading = (pc.utf8_length(texts).to_numpy(zero_copy_only=False) == 0) | pc.starts_with(pc.replace_substring(texts, MARK, " "), " ").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(leading)
        total[first] -= of_segment[starts[first]] if len(first) else 0
        return total

    def _marked(self, segment: str) -> int:
        found = self.known.get(segment)
        if found is None:
            found = self.segment(MARK + segment)
            if len(segment) <= KEEP_CHARS:
                if len(self.known) >= KEEP_SEGMENTS:
                    self.known.clear()
                self.known[segment] = found
        return found


def _count(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in slices(batches):
            counter = counter or Counter(Pieces.of_sentencepiece(model_path))
            counts = counter.texts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row's whole text under the vocabulary of a sentencepiece file every executor can open.

    Null and empty texts have no tokens. Repeated rows come as often as they do in ``docs``.
    No rows: no rows. Other columns are not looked at.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_count(model_path), "doc_id long, n_tokens long")
