"""Token counts without tokens: Aho-Corasick enumerates vocabulary matches, a Viterbi pass carries score and count.

The tokenizer is a unigram one: the pieces and scores of a vocabulary file, white space marked by U+2581, a word being
everything from one mark up to the next. Of the segmentations of a word the one with the greatest sum of scores wins.
Ties follow the exact tokenizer: an end keeps the candidate that starts first, that is the longest last piece; a character
that is no piece by itself may stand as unknown, at the least score less 10, only if that is strictly better than any
match that ends there, and it counts as many tokens as it has UTF-8 bytes.

The automaton gives an end's matches longest first, so a strict comparison keeps these rules, and no lattice is stored:
a word needs two numbers a position. Counts of words are remembered, in a bounded memory.

Defined cases: a null or empty text has no tokens; a leading mark or blank isn't doubled; repeated rows give repeated
rows; an empty table gives an empty one; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain
from typing import Any

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.bpe import Memory
from ravelin.llm.common import map_chunks, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 400_000


class Counter:
    """Counts the tokens of words under pieces with scores."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.of_word = Memory(CACHE_ENTRIES)

    def best(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of one marked word."""
        n = len(word)
        score = [float("-inf")] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        done = 0  # ends up to here have met all their candidates
        single, unknown = self.single, self.unknown
        for last, (length, own) in self.automaton.iter(word):
            while done < last:
                if word[done] not in single and score[done] + unknown > score[done + 1]:
                    score[done + 1] = score[done] + unknown
                    count[done + 1] = count[done] + len(word[done].encode("utf-8"))
                done += 1
            start = last + 1 - length
            if score[start] + own > score[last + 1]:
                score[last + 1] = score[start] + own
                count[last + 1] = count[start] + 1
        while done < n:
            if word[done] not in single and score[done] + unknown > score[done + 1]:
                score[done + 1] = score[done] + unknown
                count[done + 1] = count[done] + len(word[done].encode("utf-8"))
            done += 1
        return count[n], score[n]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Numbers of words and tokens of each text."""
        words = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        for own in words:
            if len(own) > 1 and not own[0]:
                del own[0]  # the text begins with a mark
        of_word = self.of_word
        long = set()
        for word in of_word.missing(set(chain.from_iterable(words))):
            of_word[word] = self.best(MARK + word)[0]
            if len(word) > 64:
                long.add(word)
        counts = [(len(own), sum(map(of_word.__getitem__, own))) for own in words]
        for word in long:
            del of_word[word]
        return counts


def read_pieces(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, n_words and n_tokens of each document: one narrow pass over whole texts."""

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        import public_tokenizers

        own = counter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        return lambda keys, texts: [(k, *n) for k, n in zip(keys, own.count([t or "" for t in texts]))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_chunks(docs, [id_col, text_col], start, f"{id_col} {kind}, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
