"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are words of letters (with their marks) in lower case. A word is a sequence of events: each
letter, and the end, given up to four signs before (the start of the word among them). Per
language, probabilities of one to five signs are interpolated Kneser-Ney: the longest count as
they occur, shorter ones by the number of different signs before them (as they occur at the
start of a word), less a discount, plus the share of the discount times the probability with one sign
less. The models are sorted arrays of 64-bit hashes, one for each length, with a column of
logarithms for each language, looked up by binary search. The language of the lowest cross-entropy
an event is chosen.

Fitting. Counts are summed in Spark over every labelled text that may be learned from; only the
counts of grams reach the driver, so the models grow with the number of different grams of up to
five letters, not with the documents. A fifth of the texts (by hash, so copies stay together) calibrates:
models of the other four fifths score them, as whole texts and as runs of 1 to 64 words; a
logistic curve, fitted by Newton steps of one aggregate each, turns the lead over the second
language into the score, and the spread of cross-entropies gives, per language, the limit beyond which
a text counts as none of the languages (``rejected``). The models that are used then count all five
fifths. Asked for by ``rows`` and ``chars``, a bounded sample is learned from instead.

Scoring. Every distinct token between white space is scored once a task and kept in a table
bounded in size; a document adds up its tokens. One map over the texts, no shuffle.

Defined cases: a null text, or one without a letter, has no language (``und``, score 0, no
entropy); so has every text when nothing was learned. With one learned language its score is 1.
Equal cross-entropies go to the language first in order. A null id is neither learned from nor held
out; copies of a text count as often as they stand; a text of any length is read whole, in pieces cut
between words. Columns named as the added ones are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stationlake.llm.frames import column_of, map_batches, mapped, texts_of
from stationlake.llm.shingles import mix
from stationlake.operators.ordering import exact_quantiles
from stationlake.sources.shared import staged

ORDER = 5
UNKNOWN = "und"
#: Words in the runs that calibrate, beside whole texts.
RUNS = (1, 2, 4, 8, 16, 64)
#: Share of a language's own texts beyond its limit.
REJECTED = 0.005
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BETWEEN = regex.compile(r"[^\p{L}\p{M}]")
PIECE, KEPT_TOKENS, KEPT_LENGTH, BLOCK = 1 << 20, 400_000, 48, 1 << 18
#: Different tokens and bytes of words that a task of the fit holds before it passes on their counts.
TOKENS_COUNTED, WORDS_GATHERED = 200_000, 2 << 20
_START, _END = 1, 2
ADDED = "lang_pred string, score double, entropy double, rejected boolean"


def tokens_of(text: str) -> Iterator[list[str]]:
    """The tokens of a text between white space, in lower case, piece by piece."""
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def words_in(token: str) -> list[str]:
    return [token] if token.isascii() and token.isalpha() else WORD.findall(token)


@dataclass
class Signs:
    """Signs of a list of words, each between a start and an end sign."""

    codes: np.ndarray
    depth: np.ndarray  # signs of the word up to here
    word: np.ndarray  # number of the word
    events: np.ndarray  # places that are events: all but the starts

    @staticmethod
    def of(words: list[str]) -> Signs:
        lengths = np.array([len(w) for w in words], np.int64) + 2
        last = np.cumsum(lengths) - 1
        codes = np.zeros(int(lengths.sum()), np.uint64)
        inner = np.ones(len(codes), bool)
        inner[last] = inner[last - lengths + 1] = False
        codes[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + 3
        codes[last], codes[last - lengths + 1] = _END, _START
        word = np.repeat(np.arange(len(words)), lengths)
        depth = np.arange(len(codes)) - (last - lengths + 1)[word] + 1
        return Signs(codes, depth, word, np.flatnonzero(depth > 1))

    def hashes(self) -> list[np.ndarray]:
        """Per length 0 to ``ORDER``: hash of the signs that end at each place (0 where there are fewer)."""
        out = [np.full(len(self.codes), 7, np.uint64)]
        for k in range(1, ORDER + 1):
            older = np.zeros_like(self.codes)
            older[k - 1:] = self.codes[: len(self.codes) - k + 1]
            h = mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + older * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
            out.append(np.where(self.depth >= k, h, np.uint64(0)))
        return out


def place_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of hashes in a sorted array."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Order:
    """One length of grams: sorted hashes with a column of log probabilities a language, and their contexts."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_share: np.ndarray  # 0 where a language never saw the context: all goes to the shorter gram


def interpolated(counts: list[dict[str, np.ndarray]], languages: int) -> tuple[list[Order], float]:
    """Orders, shortest first, and the log probability of a sign that no language knows.

    ``counts`` holds per order ``gram``, ``context``, ``suffix``, ``lang`` and ``n``. A gram that a
    language never saw has its interpolated probability all the same.
    """
    size = len(np.unique(counts[0]["gram"])) + 1.0
    shorter_keys, shorter = np.full(1, 7, np.uint64), np.full((1, languages), 1.0 / size)
    orders = []
    for c in counts:
        keys, first, row = np.unique(c["gram"], return_index=True, return_inverse=True)
        contexts, context_of = np.unique(c["context"], return_inverse=True)
        share, seen = np.ones((len(contexts), languages)), np.zeros((len(keys), languages))
        for k in range(languages):
            own = np.flatnonzero(c["lang"] == k)
            n, at = c["n"][own], context_of[own]
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            discount = once / (once + 2.0 * twice) if once and twice else 0.75
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            some = total > 0
            share[some, k] = discount * kinds[some] / total[some]
            seen[row[own], k] = (n - discount) / total[at]
        below, _ = place_in(shorter_keys, c["suffix"][first])
        p = seen + share[context_of[first]] * shorter[below]
        orders.append(Order(keys, np.log(p).astype(np.float32), contexts, np.log(share).astype(np.float32)))
        shorter_keys, shorter = keys, p
    return orders, -float(np.log(size))


@dataclass
class Identifier:
    """The models, the score's curve, and the usual cross-entropies with the limit."""

    languages: list[str] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    unseen: float = 0.0
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # mean, spread, limit

    def log_probabilities(self, signs: Signs) -> np.ndarray:
        """(events, languages): the longest known gram, after the back-off shares above it."""
        hashes = signs.hashes()
        out = np.zeros((len(signs.events), len(self.languages)))
        left = np.arange(len(signs.events))
        for k in range(len(self.orders), 0, -1):
            order, at = self.orders[k - 1], signs.events[left]
            place, found = place_in(order.grams, hashes[k][at])
            out[left[found]] += order.log_p[place[found]]
            left, at = left[~found], at[~found]
            context, known = place_in(order.contexts, hashes[k - 1][at - 1])
            known &= signs.depth[at] >= k
            out[left[known]] += order.log_share[context[known]]
        out[left] += self.unseen
        return out

    def word_scores(self, tokens: list[str]) -> np.ndarray:
        """(tokens, languages + 1): log probability by language of a token's words, and their events."""
        out = np.zeros((len(tokens), len(self.languages) + 1))
        for a, b in _blocks(tokens):
            words = [words_in(t) for t in tokens[a:b]]
            token = np.repeat(np.arange(a, b), [len(w) for w in words])
            signs = Signs.of([w for some in words for w in some])
            if not len(token):
                continue
            owner = token[signs.word[signs.events]]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first], :-1] = np.add.reduceat(self.log_probabilities(signs), first, axis=0)
            out[owner[first], -1] = np.diff(np.concatenate([first, [len(owner)]]))
        return out

    def judged(self, sums: np.ndarray) -> tuple[list, list, list, list]:
        """(language, score, entropy, rejected) from the sums of documents."""
        n = sums[:, -1]
        known = (n > 0) & bool(self.languages)
        if not known.any():
            none = [None] * len(sums)
            return [UNKNOWN] * len(sums), [0.0] * len(sums), none, none
        entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        lowest = entropy[np.arange(len(best)), best]
        score = probability(self.curve, lead(entropy), n) if len(self.languages) > 1 else np.ones(len(n))
        mean, spread, limit = self.usual[best].T
        rejected = (lowest - mean) * np.sqrt(n) > limit * spread
        return (
            [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)],
            np.where(known, np.round(score, 6), 0.0).tolist(),
            [float(e) if ok else None for e, ok in zip(lowest, known)],
            [bool(r) if ok else None for r, ok in zip(rejected, known)],
        )


def _blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words of about ``BLOCK`` signs."""
    start, held = 0, 0
    for k, w in enumerate(words):
        held += len(w) + 2
        if held >= BLOCK:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(words):
        yield start, len(words)


def lead(entropy: np.ndarray) -> np.ndarray:
    """By how much the second lowest cross-entropy is above the lowest."""
    two = np.partition(entropy, 1, axis=1)
    return two[:, 1] - two[:, 0]


def probability(curve: tuple[float, float, float], ahead: np.ndarray, n: np.ndarray) -> np.ndarray:
    z = curve[0] + curve[1] * np.log1p(ahead * n) + curve[2] * ahead
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class TokenTable:
    """Scores of tokens met before, bounded in number and length of the tokens."""

    def __init__(self, identifier: Identifier):
        self.identifier = identifier
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.identifier.languages) + 1))

    def sums(self, texts: list[str]) -> np.ndarray:
        """(texts, languages + 1): sums over the tokens of each text."""
        total = np.zeros((len(texts), self.scores.shape[1]))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for tokens in tokens_of(text):
                if not tokens:
                    continue
                held.append((k, tokens))
                size += sum(map(len, tokens))
                if size > 4 * BLOCK:
                    self._add(total, held)
                    held, size = [], 0
        if held:
            self._add(total, held)
        return total

    def _add(self, total: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        coded = pa.array(chain.from_iterable(tokens for _, tokens in held), pa.large_string()).dictionary_encode()
        known = coded.dictionary.to_pylist()
        new = sorted((t for t in known if t not in self.place), key=len)  # the long ones, which go again, are last
        size = len(self.place)
        need = size + len(new)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(need, size), self.scores.shape[1]))])
        self.scores[size:need] = self.identifier.word_scores(new)
        self.place.update(zip(new, range(size, need)))
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        first = np.cumsum([0, *[len(tokens) for _, tokens in held[:-1]]])
        np.add.at(total, [k for k, _ in held], np.add.reduceat(self.scores[at], first, axis=0))
        for token in reversed(new):
            if len(token) <= KEPT_LENGTH:
                break
            del self.place[token]
        if need > KEPT_TOKENS:
            self._clear()


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from (by checksum of the id)."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def labelled(docs: DataFrame) -> DataFrame:
    """(lang, text, calibrates): every text that may be learned from, copies of a text on one side."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    return train.select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("calibrates"))


def labelled_sample(docs: DataFrame, rows: int, chars: int) -> DataFrame:
    """(lang, text, calibrates): distinct labelled texts, the first by hash in each language."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return docs.select("lang", "text", F.lit(False).alias("calibrates")).limit(0)
    # A hash below the language's share of all hashes; twice the rows wanted, so that copies leave enough.
    draw = F.xxhash64("text")
    limits = F.create_map(*[
        F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, 2.0 * rows / n) * 2**62))
    ])
    drawn = (
        train.select("lang", "text", draw.alias("draw"))
        .where(F.shiftrightunsigned("draw", 2) <= F.try_element_at(limits, F.col("lang")))
        .groupBy("lang", "draw").agg(F.min("text").alias("text"))
    )
    order = Window.partitionBy("lang").orderBy("draw")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        drawn.withColumns({
            "at": F.row_number().over(order), "before": F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)),
        })
        .where((F.col("at") <= rows) & (F.col("before") < chars))
        .select("lang", "text", (F.col("at") % 5 == 0).alias("calibrates"))
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, calibrates, word, n) of (lang, text, calibrates), added up in Spark."""

    want = pa.schema([("lang", pa.string()), ("calibrates", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, calibrates, text in zip(
                column_of(batch, "lang").to_pylist(), column_of(batch, "calibrates").to_pylist(), texts_of(batch)
            ):
                for piece in tokens_of(text):
                    tokens[lang, calibrates].update(piece)
            if sum(map(len, tokens.values())) > TOKENS_COUNTED:
                yield from summed(tokens)
                tokens.clear()
        yield from summed(tokens)

    def summed(tokens: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, calibrates), counted in tokens.items():
            found: Counter = Counter()
            for token, n in counted.items():
                for word in words_in(token):
                    found[word] += n
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(found), pa.string()), pa.array([calibrates] * len(found), pa.bool_()),
                pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()),
            ], schema=want)

    counted = mapped(texts.select("lang", "calibrates", "text"), run, "lang string, calibrates boolean, word string, n bigint")
    return counted.groupBy("lang", "calibrates", "word").agg(F.sum("n").alias("n"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, size, gram, context, suffix, n) with Kneser-Ney counts of (lang, text)."""
    return grams_of(word_counts(texts.withColumn("calibrates", F.lit(False))))


def grams_of(words: DataFrame) -> DataFrame:
    """(lang, size, gram, context, suffix, n, rest): Kneser-Ney counts of (lang, calibrates, word, n), added up in Spark.

    ``n`` counts all words, ``rest`` those of the texts that do not calibrate; 0 where these lack the gram.
    """
    schema = "lang string, size int, gram bigint, context bigint, suffix bigint, first boolean, n bigint, rest bigint"
    want = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= WORDS_GATHERED:
                yield from grams(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from grams(pa.Table.from_batches(held))

    def grams(table: pa.Table) -> Iterator[pa.RecordBatch]:
        signs = Signs.of(table.column("word").to_pylist())
        langs = table.column("lang").combine_chunks().dictionary_encode()
        hashes, lang = signs.hashes(), langs.indices.to_numpy().astype(np.uint64)
        n, rest = (table.column(c).to_numpy().astype(float) for c in ("n", "rest"))
        for k in range(1, ORDER + 1):
            at = signs.events[signs.depth[signs.events] >= k]
            word = signs.word[at]
            # Equal grams of a language are added up here: far fewer rows leave the task.
            _, once, which = np.unique(
                mix(hashes[k][at] + lang[word] * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True
            )
            one = at[once]
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(lang[word[once]].astype(np.int64))),
                pa.array(np.full(len(one), k, np.int32)), pa.array(hashes[k][one].view(np.int64)),
                pa.array(hashes[k - 1][one - 1].view(np.int64)), pa.array(hashes[k - 1][one].view(np.int64)),
                pa.array(signs.depth[one] == k),
                *[pa.array(np.bincount(which, v[word], len(one)).astype(np.int64)) for v in (n, rest)],
            ], schema=want)

    counted = words.groupBy("lang", "word").agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.col("calibrates"), F.col("n")).otherwise(0)).alias("rest")
    )
    all_grams = staged(
        mapped(counted, run, schema).groupBy("lang", "size", "gram", "context", "suffix", "first")
        .agg(F.sum("n").alias("n"), F.sum("rest").alias("rest")),
        "language-grams",
    )
    before = all_grams.groupBy("lang", (F.col("size") - 1).alias("size"), F.col("suffix").alias("gram")).agg(
        F.count("*").alias("before_n"), F.count_if(F.col("rest") > 0).alias("before_rest")
    )
    as_it_occurs = F.col("first") | (F.col("size") == ORDER)
    return all_grams.join(before, ["lang", "size", "gram"], "left").select(
        "lang", "size", "gram", "context", "suffix",
        *[F.when(as_it_occurs, F.col(c)).otherwise(F.col(f"before_{c}")).alias(c) for c in ("n", "rest")],
    )


def fit(docs: DataFrame, rows: int | None = None, chars: int | None = None) -> Identifier:
    """Learn from all of (doc_id, text, lang); with ``rows`` and ``chars`` from a sample of each language."""
    bounded = rows is not None and chars is not None
    texts = staged(labelled_sample(docs, rows, chars), "language-sample") if bounded else labelled(docs)
    words = staged(word_counts(texts), "language-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        return Identifier()
    counts = grams_of(words).toArrow()
    found = modelled(counts, "n", languages)
    found.curve, found.usual = calibration(modelled(counts, "rest", languages), texts)
    return found


def modelled(counts: pa.Table, count: str, languages: list[str]) -> Identifier:
    """Models of the counts in one column of ``grams_of``, without a curve or limits."""
    counts = counts.filter(pc.greater(counts.column(count), 0))
    codes = pc.index_in(counts.column("lang"), pa.array(languages)).to_numpy()
    size = counts.column("size").to_numpy()
    columns = {c: counts.column(c).to_numpy() for c in ("gram", "context", "suffix")}
    n = counts.column(count).to_numpy().astype(float)
    by_size = []
    for s in range(1, ORDER + 1):
        own = np.flatnonzero(size == s)
        part = {c: columns[c][own].view(np.uint64) for c in ("gram", "context", "suffix")}
        by_size.append(part | {"lang": codes[own], "n": n[own]})
    orders, unseen = interpolated(by_size, len(languages))
    return Identifier(languages, orders, unseen, usual=np.tile([0.0, 1.0, np.inf], (len(languages), 1)))


def runs_of(text: str) -> list[str]:
    """The text, and one run of words of each length, from a place drawn by the text's hash."""
    words = text.split()
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    starts = [(int(rng.integers(0, max(len(words) - n, 0) + 1)), n) for n in RUNS if n < len(words)]
    return [text, *[" ".join(words[a:a + n]) for a, n in starts]]


def calibration(found: Identifier, texts: DataFrame) -> tuple[tuple[float, float, float], np.ndarray]:
    """The score's curve and the limits, from the texts that gave no counts and from runs of their words."""
    k = len(found.languages)

    def job(batch: pa.RecordBatch):
        truth, runs = [], []
        for lang, text in zip(column_of(batch, "lang").to_pylist(), texts_of(batch)):
            some = runs_of(text)
            truth += [found.languages.index(lang) if lang in found.languages else -1] * len(some)
            runs += some
        sums = TokenTable(found).sums(runs)
        some = sums[:, -1] > 0
        n = sums[some, -1]
        entropy = -sums[some, :-1] / n[:, None]
        best = entropy.argmin(1)
        ahead = lead(entropy) if k > 1 else np.zeros(len(n))
        return {
            "best": best, "correct": best == np.array(truth)[some], "events": n, "entropy": entropy[np.arange(len(best)), best],
            "grown": np.log1p(ahead * n), "ahead": ahead,
        }

    rows = staged(map_batches(
        texts.where("calibrates").select("lang", "text"),
        "best int, correct boolean, events double, entropy double, grown double, ahead double", job,
    ), "language-calibration")
    curve, usual = found.curve, found.usual.copy()
    if k > 1 and not rows.isEmpty():
        beta = logistic(rows, ["grown", "ahead"], "correct")
        curve = float(beta[0]), max(float(beta[1]), 0.0), max(float(beta[2]), 0.0)
    right = rows.where("correct")
    e, m = F.col("entropy"), F.col("events")
    means = {r["best"]: r["mean"] for r in right.groupBy("best").agg((F.sum(e * m) / F.sum(m)).alias("mean")).collect()}
    if not means:
        return curve, usual
    # (language, value) pairs: as many as there are languages.
    by_language = lambda values: F.element_at(F.create_map(*[F.lit(x) for v in values.items() for x in v]), F.col("best"))
    off = e - by_language(means)
    spreads = {
        r["best"]: max(r["spread"], 1e-9)
        for r in right.groupBy("best").agg(F.sqrt(F.avg(off * off * m)).alias("spread")).collect()
    }
    far = staged(right.select("best", (off * F.sqrt(m) / by_language(spreads)).alias("distance")), "language-distances")
    most = {r["best"]: r for r in far.groupBy("best").agg(F.count("*").alias("n"), F.max("distance").alias("most")).collect()}
    limits = {r["best"]: r["limit"] for r in exact_quantiles(far, "distance", {"limit": 1 - REJECTED}, ["best"]).collect()}
    for lang, r in most.items():
        if r["n"] >= 5:
            # Beyond the farthest seen by half, as long as the share asked for is less than one of them.
            limit = limits[lang] if r["n"] * REJECTED >= 1 else 1.5 * max(r["most"], 1.0)
            usual[lang] = means[lang], spreads[lang], limit
    return curve, usual


def logistic(rows: DataFrame, columns: list[str], hit: str, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps of a lightly penalised logistic regression, each one aggregate over the rows."""
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    y = F.col(hit).cast("double")
    n, hits = rows.agg(F.count("*"), F.sum(y)).first()
    beta = np.zeros(len(x))
    beta[0] = math.log((hits + 0.5) / (n - hits + 0.5))
    keep = ridge * np.diag([0.0] + [1.0] * len(columns)) + 1e-9 * np.eye(len(x))
    pairs = [(a, b) for a in range(len(x)) for b in range(a, len(x))]
    for _ in range(steps):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        given = rows.select(*[c.alias(f"x{a}") for a, c in enumerate(x)], (y - p).alias("off"), (p * (1 - p)).alias("w"))
        sums = given.agg(
            *[F.sum(F.col(f"x{a}") * F.col("off")) for a in range(len(x))],
            *[F.sum(F.col(f"x{a}") * F.col(f"x{b}") * F.col("w")) for a, b in pairs],
        ).first()
        gradient, curved = np.array(sums[: len(x)]), np.zeros((len(x), len(x)))
        for (a, b), v in zip(pairs, sums[len(x):]):
            curved[a, b] = curved[b, a] = v
        step = np.linalg.solve(curved + keep, gradient - keep @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def identified(docs: DataFrame, found: Identifier) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``entropy`` (nats an event) and ``rejected``.

    ``lang_pred`` is the nearest language even where ``rejected`` says that the text is unlike all.
    """
    added = T.StructType.fromDDL(ADDED).fields
    own = [f for f in docs.schema if f.name not in {a.name for a in added}]
    schema = T.StructType(own + added)
    names = [f.name for f in own]
    tables: list[TokenTable] = []

    def job(batch: pa.RecordBatch):
        if not tables:
            tables.append(TokenTable(found))
        values = found.judged(tables[0].sums(texts_of(batch)))
        return {c: batch.column(k) for k, c in enumerate(names)} | dict(zip([a.name for a in added], values))

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in names]), schema, job)
