"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

An Aho-Corasick automaton over the vocabulary yields every piece that ends at a place,
longest first; the best path to a place carries only its score and its number of pieces.
Tie rules are those of the tokenizers library's unigram model behind a metaspace splitter:
scores are added in double precision from left to right, a later candidate replaces an
earlier one only if its score is higher, so of equal paths the one whose last piece is
longest stays; a character that no piece of length one covers costs ten below the lowest
score and counts as its UTF-8 bytes (byte fallback).

No piece reaches over the start of a word, so equal words have equal counts and each is
worked out once per task, within a bounded cache. A piece never holds a character that the
vocabulary lacks, so words are cut there too.

Defined cases: null and empty texts have 0 tokens.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.frames import map_batches, texts_of

SPACE = "▁"
CACHE_WORDS = 300_000
UNKNOWN_PENALTY = 10.0


def pieces_of(model: bytes) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file."""
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(loaded.id_to_piece(k), float(loaded.get_score(k))) for k in range(loaded.vocab_size())]


class Counter(dict):
    """Word to number of pieces; words not seen yet are worked out."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = count = self.viterbi(word)
        return count

    def viterbi(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        at, single = 0, False  # the place last reached, and whether a piece of one character ends there
        unknown = self.unknown

        def close(place: int) -> None:
            # Without a piece of one character the last character alone is unknown; it starts
            # later than any other candidate, so it wins only with a higher score.
            score = best[place - 1] + unknown
            if best[place] is None or score > best[place]:
                best[place] = score
                count[place] = count[place - 1] + len(word[place - 1].encode("utf-8"))

        for last, (length, score) in self.machine.iter(word):
            end = last + 1
            while at + 1 < end:  # places that no piece ends at
                if at and not single:
                    close(at)
                at += 1
                single = False
            if at < end:
                if at and not single:
                    close(at)
                at, single = end, False
            total = best[end - length] + score
            if best[end] is None or total > best[end]:
                best[end] = total
                count[end] = count[end - length] + 1
            single = single or length == 1
        while at < n:
            if at and not single:
                close(at)
            at += 1
            single = False
        if n and not single:
            close(n)
        return count[n]


def word_splitter(pieces: list[tuple[str, float]], probe: str = "\n\t\r") -> re.Pattern | None:
    """Cuts at white space that no piece holds, and keeps it as a word of its own."""
    free = "".join(c for c in probe if not any(c in p for p, _ in pieces))
    return re.compile(f"([{re.escape(free)}])") if free else None


def count_text(text: str, counts: Counter, cut: re.Pattern | None) -> int:
    if not text:
        return 0
    spaced = text.replace(" ", SPACE)
    if not spaced.startswith(SPACE):
        spaced = SPACE + spaced
    if cut is None:
        words = [SPACE + w for w in spaced[1:].split(SPACE)]
    else:
        words = [p for w in spaced[1:].split(SPACE) for p in cut.split(SPACE + w) if p]
    return sum(map(counts.__getitem__, words))


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], name: str = "n_tokens") -> DataFrame:
    """``docs`` without its text, with the number of tokens as a long column ``name``."""
    own = [f for f in docs.schema if f.name not in ("text", name)]
    schema = T.StructType(own + [T.StructField(name, T.LongType(), False)])
    slim = docs.select(*[F.col(f"`{f.name}`") for f in own], F.col("text").alias("_text"))
    counter: list[Counter] = []
    cut = word_splitter(pieces)

    def job(batch: pa.RecordBatch):
        if not counter:
            counter.append(Counter(pieces))
        kept = {f.name: batch.column(k) for k, f in enumerate(own)}
        return kept | {name: [count_text(t, counter[0], cut) for t in texts_of(batch, "_text")]}

    return map_batches(slim, schema, job)
