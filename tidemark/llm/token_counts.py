"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton finds all pieces of the vocabulary in a text; dynamic
programming over the ends of the matches carries only the best score and its
number of pieces. Rules on ties are those of the tokenizers that make the
tokens: at each end the piece that begins first stays unless a later one is
strictly better; a character no piece covers alone costs the least score less
ten and, with byte fallback, counts one token a byte.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.blocks import arrow_rows, texts_only

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments whose count a task remembers.
REMEMBERED = 400_000
_NEVER = float("-inf")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores from a sentencepiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


@dataclass
class Counter:
    """Counts tokens of texts. `vocabulary` are pieces with their scores."""

    vocabulary: list[tuple[str, float]]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.vocabulary:
            self.automaton.add_word(piece, (len(piece), score, 1))
        self.automaton.make_automaton()
        self.alone = {p for p, _ in self.vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in self.vocabulary), default=0.0) - UNKNOWN_PENALTY
        # If no piece goes on behind a space into another word, words are
        # independent and may be counted one by one.
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        apart = not any(inner.search(p) for p, _ in self.vocabulary)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s).+", re.S)

    def segment(self, text: str) -> tuple[int, float]:
        """(tokens, score) of the best division into pieces."""
        n = len(text)
        best, count = [0.0] + [_NEVER] * n, [0] * (n + 1)
        matches = self.automaton.iter(text)
        if not self.alone.issuperset(text):
            matches = self._with_unknown(text, matches)
        # Of one end, the longest match comes first.
        for end, (length, score, pieces) in matches:
            end += 1
            value = best[end - length] + score
            if value > best[end]:
                best[end], count[end] = value, count[end - length] + pieces
        return count[n], best[n]

    def _with_unknown(self, text: str, matches):
        """The matches, and for a character that no piece covers alone an unknown one."""
        at = 0
        for end, match in matches:
            while at < end:
                yield from self._unknown(text, at)
                at += 1
            yield end, match
        for i in range(at, len(text)):
            yield from self._unknown(text, i)

    def _unknown(self, text: str, at: int):
        if text[at] not in self.alone:
            yield at, (1, self.unknown, len(text[at].encode()))

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a text; a space goes before it and spaces are pieces."""
        if not text:
            return 0, 0.0
        tokens, total, known = 0, 0.0, self.known
        for segment in self.segments.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(segment)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[segment] = self.segment(segment)
            tokens += found[0]
            total += found[1]
        return tokens, total


RESULT = "doc_id long, n_tokens long, score double"


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """Number of tokens of each document, and the score of its best division.

    Takes doc_id and text, returns a row per input row. A null or empty text has
    no tokens and score 0. Repeated rows and rows without doc_id are rows like
    others. An empty table gives no rows. The vocabulary goes to the tasks; its
    size is that of the tokenizer, whatever the number of documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(sent.value)
        for batch in batches:
            found = [counter.text(t) if t else (0, 0.0) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            ) if found else arrow_rows(RESULT, [])

    return texts_only(docs).mapInArrow(run, RESULT)
