"""Toxicity by a weighted lexicon, matched after folding disguised letters.

Texts are folded (case, look-alike letters, digits that stand for letters), the lexicon
is matched by one Aho-Corasick pass on word boundaries, matches inside an exception
phrase do not count, and the summed weights are normalised by the length of the text.
The lexicon, its weights, the exception phrases and the two numbers that turn the
normalised weight into a probability are learned from labelled rows.

Defined cases: a null text counts as empty; an empty text has no match and gets the score
of a text without matches; without labelled rows the lexicon is empty and every score is 0;
a document labelled twice counts once, as toxic if any label says so.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.frames import bounded_rows, column_of, map_batches, texts_of
from stationlake.sources.shared import staged

#: Bounds of what is fitted: labelled documents, candidate terms, phrases. Independent of the input.
SAMPLE, CANDIDATES, PHRASES = 12_000, 400, 2_000

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ᴏ": "o", "ѐ": "e", "ё": "e",
}
# Digits written for letters. "1" stands for i and l, so those two fold together.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g"}
ACCENTS = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
INVISIBLE = "­​‌‍⁠﻿"


def fold_table() -> dict[int, str | None]:
    """Translation of one character to what it folds to, after lower-casing."""
    table: dict[int, str | None] = {ord(a): b for a, b in {**HOMOGLYPHS, **DIGITS}.items()}
    table.update({ord(a): b for a, b in zip(ACCENTS, PLAIN)})
    table.update({0xFF41 + k: chr(97 + k) for k in range(26)})  # full-width letters
    table.update({ord(c): None for c in INVISIBLE})
    merged = {k: ("i" if v == "l" else v) for k, v in table.items()}
    return merged | {ord("l"): "i"}


def fold(text: str, table: dict[int, str | None]) -> str:
    return text.lower().translate(table)


WORD = re.compile(r"[^\W_]+")


@dataclass
class Lexicon:
    """Folded terms with weights, phrases that cancel a term, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -50.0
    slopes: tuple[float, float] = (0.0, 0.0)


def automaton(lexicon: Lexicon):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in lexicon.weights:
        found.add_word(term, (term, False))
    for phrase in lexicon.exceptions:
        found.add_word(phrase, (phrase, True))
    if len(found):
        found.make_automaton()
    return found


def matches(folded: str, machine) -> list[tuple[int, int, str]]:
    """(start, end, term) on word boundaries, outside exception phrases."""
    if not len(machine):
        return []
    terms, covered = [], []
    n = len(folded)
    for last, (term, exception) in machine.iter(folded):
        start, end = last + 1 - len(term), last + 1
        if (start and folded[start - 1].isalnum()) or (end < n and folded[end].isalnum()):
            continue
        (covered if exception else terms).append((start, end, term))
    if covered and terms:
        terms = [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b, _ in covered)]
    return terms


def features(total: float, words: int) -> tuple[float, float]:
    """Logarithms of the weight per hundred words and of the whole weight."""
    return math.log1p(100.0 * total / max(words, 1)), math.log1p(total)


def probability(lexicon: Lexicon, total: float, words: int) -> float:
    x, y = features(total, words)
    z = lexicon.intercept + lexicon.slopes[0] * x + lexicon.slopes[1] * y
    return 1.0 / (1.0 + math.exp(-z)) if z > -500 else 0.0


def in_training(doc_id="doc_id"):
    """Labels of every fifth document (by checksum of its id) are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Folded texts (doc_id, folded, toxic) of at most ``size`` labelled training documents.

    Which ones is decided by the hash of the id, so that it does not depend on the layout.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    table = fold_table()

    def job(batch: pa.RecordBatch):
        return {
            "doc_id": column_of(batch, "doc_id"),
            "folded": [fold(t, table) for t in texts_of(batch)],
            "toxic": column_of(batch, "toxic"),
        }

    folded = map_batches(texts, "doc_id bigint, folded string, toxic int", job)
    # Copies would let the words around a term count as evidence.
    return folded.groupBy("folded").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))


def candidate_terms(sample: DataFrame, least: int = 4, most: int = CANDIDATES) -> list[str]:
    """Words whose share of toxic documents is most surely above the average."""

    def job(batch: pa.RecordBatch):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(texts_of(batch, "folded"), column_of(batch, "toxic").to_pylist()):
            for word in set(WORD.findall(text)):
                if 3 <= len(word) <= 40:
                    counts.setdefault(word, [0, 0])[toxic] += 1
        return {
            "word": list(counts),
            "clean": [c[0] for c in counts.values()],
            "toxic": [c[1] for c in counts.values()],
        }

    totals = sample.agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")
    ).first()
    toxic, n = totals["toxic"] or 0, totals["n"]
    if not 0 < toxic < n:
        return []
    counted = map_batches(sample.select("folded", "toxic"), "word string, clean bigint, toxic bigint", job)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic + 1.0 - a)) - F.log(b / (n - toxic + 1.0 - b))
    sure = odds / F.sqrt(1.0 / a + 1.0 / b)
    best = (
        counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= least)
        .withColumn("sure", sure).where(F.col("sure") >= 2.5)
        .orderBy(F.desc("sure"), "word").limit(most)
    )
    return [r["word"] for r in best.select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Lexicon:
    """Learn a lexicon from labelled training documents.

    Only the bounded sample is fitted: candidate terms are counted in Spark, their
    presence per sampled document reaches the driver (at most ``size`` short rows), terms
    are chosen one by one, each on the documents that no chosen term explains (so words that
    merely stand beside a term are passed over), and the curve is a logistic regression.
    """
    sample = staged(labelled_sample(docs, labels, size), "toxicity-sample")
    terms = candidate_terms(sample)
    if not terms:
        totals = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
        share = ((totals["t"] or 0) + 0.0) / totals["n"] if totals["n"] else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Lexicon(intercept=math.log(share / (1 - share)) if totals["n"] else -1000.0)
    machine = automaton(Lexicon(weights={t: 1.0 for t in terms}))
    place = {t: k for k, t in enumerate(terms)}

    def job(batch: pa.RecordBatch):
        hits, times, words, near = [], [], [], []
        for text in texts_of(batch, "folded"):
            found = matches(text, machine)
            counts: dict[int, int] = {}
            for _, _, t in found:
                counts[place[t]] = counts.get(place[t], 0) + 1
            hits.append(list(counts))
            times.append(list(counts.values()))
            words.append(len(WORD.findall(text)))
            near.append(sorted({x for s, e, t in found for x in neighbours(text, s, e)}))
        return {"toxic": column_of(batch, "toxic"), "hits": hits, "times": times, "words": words, "near": near}

    rows = bounded_rows(
        map_batches(sample, "toxic int, hits array<int>, times array<int>, words int, near array<string>", job), size
    )
    return learn(terms, rows)


def neighbours(text: str, start: int, end: int) -> list[str]:
    """The match with the word before it, and with the word after it."""
    before = re.search(r"[^\W_]+[ -]$", text[max(0, start - 40):start])
    after = re.match(r"[ -][^\W_]+", text[end:end + 40])
    return [x for x in (
        before and before.group() + text[start:end], after and text[start:end] + after.group()
    ) if x]


def learn(terms: list[str], rows: list) -> Lexicon:
    y = np.array([r["toxic"] for r in rows], dtype=bool)
    has = np.zeros((len(rows), len(terms)), dtype=bool)
    for k, r in enumerate(rows):
        has[k, r["hits"]] = True
    n, toxic = len(y), int(y.sum())
    left = np.ones(n, dtype=bool)
    weights: dict[str, float] = {}
    least = max(3, round(0.005 * toxic))
    while True:
        a = (has & (left & y)[:, None]).sum(0)
        b = (has & (left & ~y)[:, None]).sum(0)
        rest_a, rest_b = (left & y).sum() - a, (left & ~y).sum() - b
        odds = np.log((a + 0.5) / (rest_a + 0.5)) - np.log((b + 0.5) / (rest_b + 0.5))
        sure = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        sure[a < least] = -np.inf
        best = int(np.argmax(sure))
        if not sure[best] >= 3.0:
            break
        weights[terms[best]] = float(odds[best])
        left &= ~has[:, best]
        has[:, best] = False
    # A phrase around a term that stands in clean documents, and hardly in toxic ones, cancels it.
    seen: dict[str, list[int]] = {}
    for r, label in zip(rows, y):
        for phrase in set(r["near"]):
            seen.setdefault(phrase, [0, 0])[int(label)] += 1
    exceptions = sorted(
        (p for p, (clean, bad) in seen.items() if clean >= 3 and bad <= 0.1 * clean),
        key=lambda p: (-seen[p][0], p),
    )[:PHRASES]
    lexicon = Lexicon(weights=weights, exceptions=exceptions)
    wanted = [weights.get(t, 0.0) for t in terms]
    cancelled = set(exceptions)
    x = []
    for r in rows:
        total = 0.0 if cancelled & set(r["near"]) else sum(wanted[k] * n for k, n in zip(r["hits"], r["times"]))
        x.append([1.0, *features(total, r["words"])])
    beta = logistic(np.array(x), y.astype(float))
    lexicon.intercept, lexicon.slopes = float(beta[0]), (float(beta[1]), float(beta[2]))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps of a lightly penalised logistic regression."""
    beta = np.zeros(x.shape[1])
    beta[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1), ``toxic_weight`` and ``toxic_terms`` (distinct).

    One map over the texts: no shuffle. Columns of ``docs`` with those names are replaced.
    """
    own = [f for f in docs.schema if f.name not in ("toxic_score", "toxic_weight", "toxic_terms")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in own])
    machine, table = automaton(lexicon), fold_table()
    added = "toxic_score double, toxic_weight double, toxic_terms array<string>"
    schema = T.StructType(own + T.StructType.fromDDL(added).fields)
    names = [f.name for f in own]

    def job(batch: pa.RecordBatch):
        score, weight, terms = [], [], []
        for text in texts_of(batch):
            folded = fold(text, table)
            found = matches(folded, machine)
            total = sum(lexicon.weights[t] for _, _, t in found)
            # The length matters only where something matched.
            words = len(WORD.findall(folded)) if total else 1
            weight.append(total)
            score.append(probability(lexicon, total, words))
            terms.append(sorted({t for _, _, t in found}))
        kept = {c: batch.column(k) for k, c in enumerate(names)}
        return kept | {"toxic_score": score, "toxic_weight": weight, "toxic_terms": terms}

    return map_batches(docs, schema, job)
