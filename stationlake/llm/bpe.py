"""BPE encoding and decoding that reuses chunks shared between documents.

A rolling hash over the bytes cuts each text into chunks, so the same passage gives the
same chunks wherever it stands. A chunk is encoded once and reused for every document of
the task that has it; documents are first dealt out by their smallest line hash, which
brings copies and near copies into one task (Spark splits a task that gets too many).

Joins are repaired by re-encoding. A cut falls anywhere, so the ids beside it can be wrong;
the text around it is re-encoded from the last agreed place before the cut to the first one
after it. An agreed place is the start of white space after a visible ASCII character. No
piece of the byte-level pattern holds a visible character followed by white space, no
pattern looks back, and the only lookahead is within white space, so every encoding that
reaches such a place starts afresh there: ids on its two sides never depend on each other.
A chunk without such a place is re-encoded with its neighbours, up to the next one.

Defined cases: a null text counts as empty and gives no ids; special tokens written out in
a text are encoded as special tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.frames import map_batches, texts_of

CHUNK_BITS = 11
CACHE_BYTES = 48_000_000


def rolling_cuts(raw: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places where the hash of the 16 bytes before ends in ``bits`` zeros."""
    h = raw.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    h ^= h >> np.uint32(15)
    for step, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F), (8, 0x165667B1)):
        if len(h) > step:
            older = h[:-step].copy()
            h *= np.uint32(factor)
            h[step:] += older
    h ^= h >> np.uint32(13)
    return np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1


def agreed_places(raw: np.ndarray) -> np.ndarray:
    """Starts of white space after a visible ASCII character."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    visible = (raw > 32) & (raw < 127)
    return np.flatnonzero(space[1:] & visible[:-1]) + 1


def segments(raw: np.ndarray, cuts: np.ndarray, agreed: np.ndarray) -> list[int]:
    """Bounds of the pieces to encode: chunk interiors, and the joins between them."""
    n = len(raw)
    if not len(cuts) or not len(agreed):
        return [0, n]
    at = np.searchsorted(agreed, cuts, side="left")
    before = np.where(at > 0, agreed[np.maximum(at - 1, 0)], 0)
    after = np.where(at < len(agreed), agreed[np.minimum(at, len(agreed) - 1)], n)
    return np.unique(np.concatenate([[0], before, after, [n]])).tolist()


class Coder:
    """Encodes texts by segments, with a cache bounded in bytes."""

    def __init__(self, vocabulary: bytes, pattern: str, special: dict[str, int]):
        import tiktoken

        if not all(s.startswith("<|") for s in special):
            raise ValueError("special tokens must begin with <|")
        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in vocabulary.splitlines() if line)
        }
        self.encoding = tiktoken.Encoding(
            "byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special
        )
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0

    def segment(self, raw: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, decoded bytes)."""
        found = self.cache.get(raw)
        if found is None:
            text = raw.decode("utf-8")
            if b"<|" in raw:  # all special tokens begin so; the plain way is faster
                ids = self.encoding.encode(text, allowed_special="all")
            else:
                ids = self.encoding.encode_ordinary(text)
            found = np.array(ids, dtype="<u4").tobytes(), self.encoding.decode_bytes(ids)
            if self.held > CACHE_BYTES:
                self.cache.clear()
                self.held = 0
            self.cache[raw] = found
            self.held += 2 * len(raw) + len(found[0]) + 200
        return found

    def text(self, raw: bytes, cuts: np.ndarray, agreed: np.ndarray) -> tuple[bytes, bytes]:
        if not raw:
            return b"", b""
        bounds = segments(np.frombuffer(raw, np.uint8), cuts, agreed)
        parts = [self.segment(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        return b"".join(p[0] for p in parts), b"".join(p[1] for p in parts)


def nearness(text: str):
    """The smallest line hash of a text: equal for copies, and for most near copies."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return F.array_min(F.transform(lines, lambda x: F.xxhash64(x)))


def encoded(
    docs: DataFrame, vocabulary: bytes, pattern: str, special: dict[str, int], keep: list[str]
) -> DataFrame:
    """Columns ``keep`` of the documents with ``ids`` and ``decoded``.

    ``ids`` is binary, four little-endian bytes an id; ``decoded`` is the text that the
    ids decode to (bytes that are no UTF-8 become the replacement character).
    """
    fields = [f for f in docs.schema if f.name in keep]
    schema = T.StructType(fields + T.StructType.fromDDL("ids binary, decoded string").fields)
    slim = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))
    # A rebalancing hint, not a repartition: a group too large for one task is split.
    dealt = slim.withColumn("_near", nearness("_text")).hint("rebalance", "_near").drop("_near")
    coder: list[Coder] = []

    def job(batch: pa.RecordBatch):
        if not coder:
            coder.append(Coder(vocabulary, pattern, special))
        raws = [t.encode("utf-8") for t in texts_of(batch, "_text")]
        ids, decoded = [], []
        for raw in raws:
            data = np.frombuffer(raw, np.uint8)
            a, b = coder[0].text(raw, rolling_cuts(data), agreed_places(data))
            ids.append(a)
            decoded.append(b.decode("utf-8", "replace"))
        names = batch.schema.names
        return {k: batch.column(names.index(k)) for k in keep} | {"ids": ids, "decoded": decoded}

    return map_batches(dealt, schema, job)
