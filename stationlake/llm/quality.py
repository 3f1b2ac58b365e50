"""Quality rules: counts within a document, and lines that too many documents of a host share.

Lines are normalised (case, white space, digits) and hashed; for each host the distinct
documents holding a line are counted, copies of a text among them. A line above the limit
of its host is removed everywhere on that host, and a document that loses too much is
rejected. The limit is the larger of a number of documents and a share of the host's.

Defined cases: a null text has no words and no lines; a null host is a host of its own;
repeated rows (of one id and text) are one document, each row stays; documents failing the base rules are
rejected whatever their lines; an empty table gives none; columns named as the added ones are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.frames import map_batches, texts_of
from stationlake.sources.shared import staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]")
SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(r"\d+")
WINDOW = 5

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
LINES = "line_hash array<bigint>, line_words array<int>"


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def normalised(line: str) -> str:
    """Lower case, runs of digits as one 0, runs of white space as one space."""
    line = " ".join(line.lower().split())
    return DIGITS.sub("0", line) if any(c.isdigit() for c in line) else line


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += bool(WORD.search(line))
        else:
            seen.add(line)
    return (
        len(words), len(text) - len(SPACES.findall(text)), len(SYMBOLS.findall(text)), repeats,
        repeated_words(words),
    )


def lines_of(text: str) -> tuple[list[int], list[int]]:
    """Hashes of the distinct normalised lines that hold a word, and the words lost with each."""
    found: dict[int, int] = {}
    for line in text.split("\n"):
        words = len(WORD.findall(line))
        if words:
            key = line_key(line)
            found[key] = found.get(key, 0) + words
    return list(found), list(found.values())


def profiled(docs: DataFrame) -> DataFrame:
    """``docs`` without texts, with the counts of each document and its lines' hashes."""
    added = T.StructType.fromDDL(f"{COUNTS}, text_hash bigint, {LINES}")
    own = [f for f in docs.schema if f.name not in ("text", *added.names)]
    slim = docs.select(*[F.col(f"`{f.name}`") for f in own], F.col("text").alias("_text"))

    def job(batch: pa.RecordBatch):
        import xxhash

        out = {f.name: batch.column(k) for k, f in enumerate(own)}
        texts = texts_of(batch, "_text")
        for name, column in zip(added.names[:5], zip(*map(counts_of, texts))):
            out[name] = list(column)
        out["text_hash"] = [
            int.from_bytes(xxhash.xxh64_digest(t.encode("utf-8")), "big", signed=True) for t in texts
        ]
        pairs = [lines_of(t) for t in texts]
        out["line_hash"], out["line_words"] = [p[0] for p in pairs], [p[1] for p in pairs]
        return out

    return map_batches(slim, T.StructType(own + added.fields), job)


def common_lines(profiles: DataFrame, host: str, least: int, share: float, document: str = "doc_id") -> DataFrame:
    """(host, line_hash, n_docs) of the lines above the limit of their host.

    Lines of equal texts are taken apart once, weighted by the documents of that text. Their
    number per host is at most the lines of a document divided by ``share``, or their
    occurrences by ``least``.
    """
    once = profiles.groupBy(host, "text_hash").agg(F.first("line_hash").alias("line_hash"))
    copies = (
        profiles.select(F.col(host).alias("_on"), F.col("text_hash").alias("_text"), document).distinct()
        .groupBy("_on", "_text").agg(F.count("*").alias("docs"))
    )
    sizes = copies.groupBy(F.col("_on").alias(host)).agg(F.sum("docs").alias("host_docs"))
    weighted = once.join(copies, once[host].eqNullSafe(copies["_on"]) & (F.col("text_hash") == F.col("_text")))
    counted = (
        weighted.select(host, "docs", F.explode("line_hash").alias("line_hash"))
        .groupBy(host, "line_hash").agg(F.sum("docs").alias("n_docs"))
        .where(F.col("n_docs") > least)
    )
    return (
        counted.join(sizes, counted[host].eqNullSafe(sizes[host]))
        .where(F.col("n_docs") > F.col("host_docs") * share)
        .select(counted[host], "line_hash", "n_docs")
    )


ADDED = ("base_failed", "n_lost_words", "kept")
_ROW, _HOST = "_quality_row", "_quality_host"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` without columns named as the added ones, with a number for each row."""
    return docs.drop(*ADDED).withColumn(_ROW, F.monotonically_increasing_id())


def _lost_lines(profiles: DataFrame, host: str, least: int, share: float) -> DataFrame:
    """(row, line_hash, line_words): the lines of each document that stand above the limit of its host."""
    common = staged(common_lines(profiles, host, least, share), "quality-common-lines")
    lines = profiles.select(
        _ROW, F.col(f"`{host}`").alias(_HOST), F.explode(F.arrays_zip("line_hash", "line_words")).alias("line"),
    )
    return lines.join(
        common, lines[_HOST].eqNullSafe(common[host]) & (F.col("line.line_hash") == common["line_hash"])
    ).select(_ROW, "line.line_hash", "line.line_words")


def _verdicts(
    profiles: DataFrame, lost: DataFrame, deplete: float, min_words: int, max_repeat_pct: int
) -> DataFrame:
    """Profiles with the added columns."""
    words = lost.groupBy(_ROW).agg(F.sum("line_words").alias("n_lost_words"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")
    )
    left = F.col("n_words") - F.col("n_lost_words")
    depleted = (left < min_words) | (left < deplete * F.col("n_words"))
    return (
        profiles.drop("line_hash", "line_words", "text_hash").join(words, _ROW, "left")
        .withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(failed | ((F.col("n_lost_words") > 0) & depleted)))
    )


def judged(
    docs: DataFrame, host: str = "source", least: int = 10, share: float = 0.02, deplete: float = 0.5,
    min_words: int = 10, max_repeat_pct: int = 20,
) -> DataFrame:
    """``docs`` without texts, with the counts, ``base_failed``, ``n_lost_words`` and ``kept``."""
    profiles = staged(profiled(_numbered(docs)), "quality-profiles")
    lost = _lost_lines(profiles, host, least, share)
    return _verdicts(profiles, lost, deplete, min_words, max_repeat_pct).drop(_ROW)


def cleaned(
    docs: DataFrame, host: str = "source", least: int = 10, share: float = 0.02, deplete: float = 0.5,
    min_words: int = 10, max_repeat_pct: int = 20,
) -> DataFrame:
    """The documents that are kept, with the lines above the limit of their host removed from ``text``.

    The other columns are those of ``docs``. The rows are staged with their numbers; what joins
    them are the hashes of each document's own removed lines.
    """
    numbered = staged(_numbered(docs), "quality-documents")
    profiles = staged(profiled(numbered), "quality-profiles")
    lost = staged(_lost_lines(profiles, host, least, share), "quality-lost-lines")
    kept = _verdicts(profiles, lost, deplete, min_words, max_repeat_pct).where("kept").select(_ROW)
    removed = lost.groupBy(_ROW).agg(F.collect_list("line_hash").alias("_quality_removed"))
    left = numbered.join(kept, _ROW).join(removed, _ROW, "left").drop(_ROW)
    own = [f for f in numbered.schema if f.name != _ROW]

    def job(batch: pa.RecordBatch):
        out = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in own}
        removed = batch.column(batch.schema.get_field_index("_quality_removed")).to_pylist()
        out["text"] = [cleaned_text(t, set(r)) if r else t for t, r in zip(out["text"].to_pylist(), removed)]
        return out

    return map_batches(left, T.StructType(own), job)


def line_key(line: str) -> int:
    """Hash of a normalised line."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(normalised(line).encode("utf-8")), "big", signed=True)


def cleaned_text(text: str, common: set[int]) -> str:
    """A text without the lines whose normalised hash is in ``common``."""
    return "\n".join(x for x in text.split("\n") if not WORD.search(x) or line_key(x) not in common)
