"""Exact top-k inner products, pruned by segment means and deviations.

Vectors are cut into segments. For a segment of m components with means a, b and
deviations s, t of the two vectors, its share of the inner product is at most
m (a b + s t) (Cauchy-Schwarz on the parts about the means); summed over the segments this
bounds the score from above, which is the same as bounding the squared distance
|q|^2 + |x|^2 - 2 q.x from below. Bounds are taken coarse to fine, each level only for the pairs
that the level before could not rule out against the query's k-th best score so far, and
exact scores are computed for what is left. A pair is ruled out only when its bound lies
below that score by more than the rounding of the bound, so results are exact.

Work is dealt out as pairs of a block of candidates and a block of queries; every task keeps
k rows a query, with its score to beat over all blocks that the task meets, and a ranking over those
gives the result. Blocks of candidates move once for every group of queries: all pairs are
asked for, so the work grows with queries times candidates, and what moves with their blocks.

Defined cases: vectors that are null, or hold a null or a number that is not finite, take
no part; vectors of different lengths are never compared. Every row has a number of its own: a query meets
every row but its own one, so rows that share its id are candidates, a repeated id is one candidate a
row, and a query id that stands twice has two results. A null id is a candidate like others, last
among ties. A query with fewer candidates than k gets them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stationlake.llm.frames import bounded_batches, column_of, map_batches
from stationlake.sources.shared import staged

ROW_BLOCK, QUERY_BLOCK, SPREAD, LEVELS = 4096, 512, 8, (2, 4, 8, 16)
#: Single pairs scored at a time.
PAIRS = 1 << 15
#: Groups of queries that a task keeps at a time.
GROUPS_HELD = 64


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector as doubles, row) of the vectors that take part; staged, so that rows keep their numbers."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return staged(kept.select(
        F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"), F.monotonically_increasing_id().alias("row")
    ), "vectors")


def scaled(vectors: DataFrame, by: float) -> DataFrame:
    """Components as floor(by * x), still held as doubles (whole numbers)."""
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(by)).cast("double")))


def packed(vectors: DataFrame, size: int, group: str) -> DataFrame:
    """Rows packed into blocks (group, dim, kind, ids, data) of about ``size`` rows.

    A block holds rows of one partition, one dimension and one value of ``group``, in the
    smallest number type (``kind``) that holds its components. ``ids`` holds, for each row, whether its id is
    null, the id, and its number.
    """

    def job(batch: pa.RecordBatch):
        given = column_of(batch, "vec_id")
        ids = np.stack([
            given.is_null().to_numpy(zero_copy_only=False).astype(np.int64), given.fill_null(0).to_numpy(),
            column_of(batch, "row").to_numpy(),
        ], axis=1)
        groups = column_of(batch, group).to_numpy(zero_copy_only=False)
        column = column_of(batch, "vector")
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        out: dict[str, list] = {group: [], "dim": [], "kind": [], "ids": [], "data": []}
        for value, dim in sorted(set(zip(groups.tolist(), lengths.tolist()))):
            part = np.flatnonzero((lengths == dim) & (groups == value))
            data = flat[starts[part][:, None] + np.arange(dim)[None, :]]
            largest = np.abs(data).max(initial=0.0)
            kind = next((k for k, most in (("<i1", 127), ("<i2", 32767)) if largest <= most), "<f8")
            out[group].append(value)
            out["dim"].append(dim)
            out["kind"].append(kind)
            out["ids"].append(ids[part].astype("<i8").tobytes())
            out["data"].append(np.ascontiguousarray(data.astype(kind)).tobytes())
        return out

    return map_batches(
        vectors, f"`{group}` bigint, dim int, kind string, ids binary, data binary", job, size
    )


def segment_features(x: np.ndarray, parts: int) -> np.ndarray:
    """Per segment sqrt(m) times mean and deviation: their inner product is the bound."""
    out = []
    for piece in np.array_split(x, parts, axis=1):
        m = piece.shape[1]
        if m:
            mean = piece.mean(axis=1)
            deviation = np.sqrt(np.maximum((piece * piece).mean(axis=1) - mean * mean, 0.0))
            out += [np.sqrt(m) * mean, np.sqrt(m) * deviation]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def in_machine_numbers(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether inner products of whole numbers, and all sums on the way, are exact as doubles."""
    largest = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * max(q.shape[-1], 1)
    return largest < 2.0**53


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as Python or machine integers without rounding."""
    if in_machine_numbers(q, x):
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q, row)) for row in x], dtype=object)


class Best:
    """The k best candidates so far of each query of one block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k  # ids as in ``packed``: null, id, row
        self.levels = [p for p in LEVELS if p <= max(q.shape[1] // 2, 1)] or [1]
        self.features = [segment_features(q, p) for p in self.levels]
        self.norms = np.sqrt((q * q).sum(1))
        self.beat = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [
            (np.zeros((0, 3), np.int64), np.zeros(0, np.int64)) for _ in ids
        ]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Meet a block of candidates."""
        features = [segment_features(x, p) for p in self.levels]
        norms = np.sqrt((x * x).sum(1))
        # Rounding of a bound is far below this share of the product of the norms.
        slack = 1e-9 * (self.norms[:, None] * norms[None, :] + 1.0)
        bounds = self.features[0] @ features[0].T + slack
        free = self.ids[:, None, 2] != ids[None, :, 2]
        new = np.flatnonzero(self.beat == -np.inf)
        if len(new) and len(x) > 4 * self.k:
            # The most promising ones first: they give the score to beat.
            most = np.argpartition(-np.where(free[new], bounds[new], -np.inf), 4 * self.k, axis=1)[:, : 4 * self.k]
            first = np.zeros_like(free)
            first[new[:, None], most] = True
            first &= free
            self._take(ids, x, first)
            free &= ~first
        left = free & (bounds >= self.beat[:, None])
        for own, theirs in zip(self.features[1:], features[1:]):
            if not left.any():
                break
            left &= own @ theirs.T + slack >= self.beat[:, None]
        self._take(ids, x, left)

    def _take(self, ids: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> None:
        """Score the ``wanted`` pairs of a block, all queries together while machine numbers hold the scores."""
        queries = np.flatnonzero(wanted.any(1))
        if not len(queries):
            return
        if not in_machine_numbers(self.q, x):
            for a in queries:
                rows = np.flatnonzero(wanted[a])
                self._keep(a, ids[rows], exact_scores(self.q[a], x[rows]))
            return
        if wanted.sum() * 8 > wanted.size:
            scores = self.q[queries] @ x.T
            a, b = np.nonzero(wanted[queries] & (scores >= self.beat[queries, None]))
            scores, a = scores[a, b], queries[a]
        else:
            a, b = np.nonzero(wanted)
            scores = np.concatenate([
                np.einsum("ij,ij->i", self.q[a[s:s + PAIRS]], x[b[s:s + PAIRS]]) for s in range(0, len(a), PAIRS)
            ])
            good = scores >= self.beat[a]
            a, b, scores = a[good], b[good], scores[good]
        scores = scores.astype(np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else []
        for s, e in zip(bounds, bounds[1:]):
            self._keep(a[s], ids[b[s:e]], scores[s:e])

    def _keep(self, a: int, ids: np.ndarray, scores: np.ndarray) -> None:
        had_ids, had = self.found[a]
        all_ids = np.concatenate([had_ids, ids])
        scores = np.concatenate([had, scores])
        if scores.dtype == object:
            order = sorted(range(len(scores)), key=lambda r: (-scores[r], *all_ids[r]))[: self.k]
        else:
            order = np.lexsort((*all_ids.T[::-1], -scores))[: self.k]
        self.found[a] = all_ids[order], scores[order]
        if len(order) == self.k:
            self.beat[a] = float(scores[order[-1]])

    def rows(self):
        for (none, qid, row), (ids, scores) in zip(self.ids.tolist(), self.found):
            for (null, i, number), s in zip(ids.tolist(), scores):
                yield None if none else qid, row, None if null else i, number, int(s)


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    Both inputs are (vec_id, vector, row) of whole numbers; a row is no candidate for itself; ties
    go to the smaller id. A block of candidates is sent once to every group of queries, by
    an equi-join on the group's number and a salt.
    """
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    at = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")
    asked = packed(
        queries.withColumn("asked", at).repartition(F.col("asked")), QUERY_BLOCK, "asked"
    ).select(
        "asked", "dim", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"),
        *[F.col(c).alias(f"q_{c}") for c in ("kind", "ids", "data")],
    )
    rows = packed(
        candidates.withColumn("salt", F.lit(0).cast("long")), ROW_BLOCK, "salt"
    ).drop("salt").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SPREAD)).cast("int")).withColumn(
        "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    )
    pairs = rows.join(asked, ["dim", "asked", "salt"])

    def run(batches):
        met: dict[tuple, Best] = {}
        for batch in batches:
            for asked_at, dim, kind, ids, data, q_kind, q_ids, q_data in zip(*(
                column_of(batch, c).to_pylist()
                for c in ("asked", "dim", "kind", "ids", "data", "q_kind", "q_ids", "q_data")
            )):
                if (asked_at, dim, q_ids) not in met:
                    if len(met) >= GROUPS_HELD:
                        yield as_batch(met)
                        met = {}
                    qi = np.frombuffer(q_ids, "<i8").reshape(-1, 3)
                    q = np.frombuffer(q_data, q_kind).reshape(len(qi), dim).astype(float)
                    met[asked_at, dim, q_ids] = Best(qi, q if dim else np.zeros((len(qi), 1)), k)
                i = np.frombuffer(ids, "<i8").reshape(-1, 3)
                x = np.frombuffer(data, kind).reshape(len(i), dim).astype(float)
                met[asked_at, dim, q_ids].add(i, x if dim else np.zeros((len(i), 1)))
        yield as_batch(met)

    names = ["query_id", "query_row", "vec_id", "row", "score"]

    def as_batch(met: dict) -> pa.RecordBatch:
        out = list(zip(*[r for best in met.values() for r in best.rows()])) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in out], names=names)

    bounded_batches(pairs.sparkSession)
    found = pairs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
