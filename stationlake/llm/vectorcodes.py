"""Compression of vectors to codes of parts, by Lloyd's rounds over cover trees.

Components become whole numbers, a vector is cut into parts, and every part position has a
codebook. A round assigns each part to its nearest entry (squared Euclidean distance, ties to the
lower index) and replaces each entry by the floor of its parts' mean; entries without parts stay.

Vectors are packed once into blocks; a task builds, for each part position of a block, a cover
tree: a node is a point with the points around it, a child lies within half of its parent's reach
(a power of two), and the points of siblings are farther apart than that. Points are put in
the order of the tree, so a node is a run of points and cumulative sums along the order give the sum of any
subtree by one subtraction. The blocks are staged with their trees and read in every round.

Assignment goes down from the roots. A node at distance d of its nearest entry, with its farthest point
at r, needs only the entries within d + 2r (triangle inequality); its children are compared
with these alone. A node with one entry left is assigned whole, with its sums; so is a node of
equal points. Nodes that stay ambiguous down to a few points are compared point by point, in whole numbers.
Roots of the distance are widened by far more than their rounding, so results are exact.

What moves: per task and round one row an entry and component (at most parts x entries x width
rows, added up in Spark), never points; the codebooks, of that same fixed size, reach the driver.

Defined cases: vectors that are null, or hold a null or a number that is not finite, take no part;
nor do those of another length than the vector of the smallest id (null ids last). A length that is no multiple of
the parts gives parts of sizes that differ by one. Repeated rows are coded each; rows with equal or null ids
begin codebooks in the order of their components. With fewer rows than entries the codebooks
are as small. Whole numbers beyond 2^27 raise an error: their squared distances may not
fit a long. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.llm.frames import bounded_batches, column_of, map_batches
from stationlake.sources.shared import staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK_ROWS, LEAF = 4096, 4
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, by: float, vector: str) -> DataFrame:
    """``vectors`` that take part, with ``whole``: floor(by * x) of every component."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(by)))
    too_large = F.exists(v, lambda x: F.abs(x * F.lit(by)) > LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component is beyond {LARGEST} when scaled"))).otherwise(scaled)
    return vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False))).withColumn("whole", checked)


def bounds_of(width: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part: equal, or larger by one at the front."""
    small, more = divmod(width, parts)
    ends = np.cumsum([small + (k < more) for k in range(parts)]).tolist()
    return list(zip([0, *ends], ends))


@dataclass
class Trees:
    """Cover trees over the points of several groups, as runs of one order.

    Nodes are numbered level by level; the children of a node follow one another. ``reach`` is the
    largest squared distance of a node's points from its first one.
    """

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    reach: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @staticmethod
    def over(points: np.ndarray, groups: int) -> Trees:
        """``points`` holds the groups one after another, all of one size."""
        n = len(points) // groups
        order = np.arange(len(points))
        start = np.arange(groups) * n
        end = start + n
        own = np.repeat(start, n)
        reach = np.maximum.reduceat(_squared(points, points[own]), start)
        nodes: list[tuple[np.ndarray, ...]] = []
        made = groups
        while len(start):
            split = (reach > 0) & (end - start > LEAF)
            child, children = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            runs = _split(points, order, start[split], end[split], reach[split])
            child[split] = made + np.concatenate([[0], np.cumsum(runs[3])])[:-1]
            children[split] = runs[3]
            nodes.append((start, end, reach, child, children))
            start, end, reach = runs[:3]
            made += len(start)
        whole = [np.concatenate(c) for c in zip(*nodes)]
        return Trees(order, *whole)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _split(points, order, start, end, reach) -> tuple[np.ndarray, ...]:
    """Cut runs of ``order`` into children (start, end, reach), and count them by run.

    In turn the first point of a run that no child covers becomes a child, in all runs at once, and
    covers what lies within half of the run's reach: siblings are farther apart than that.
    """
    sizes = end - start
    if not len(sizes):
        return start, end, reach, sizes
    run = np.repeat(np.arange(len(start)), sizes)
    at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[run]
    item = order[at]
    # The largest power of two below the reach: 4 to the power of its exponent, squared.
    exponent = np.ceil(np.log2(reach) / 2).astype(np.int64) - 1
    cover = np.where(exponent >= 0, 4 ** np.maximum(exponent, 0), 0)
    child, far = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
    left, turn = np.arange(len(run)), 0
    while len(left):
        first = np.flatnonzero(np.concatenate([[True], run[left][1:] != run[left][:-1]]))
        centre = item[left][first].repeat(np.diff(np.concatenate([first, [len(left)]])))
        d = _squared(points[item[left]], points[centre])
        near = d <= cover[run[left]]
        child[left[near]], far[left[near]] = turn, d[near]
        left, turn = left[~near], turn + 1
    key = run * turn + child
    sorting = np.argsort(key, kind="stable")
    order[at] = item[sorting]
    begin = np.flatnonzero(np.concatenate([[True], key[sorting][1:] != key[sorting][:-1]]))
    of = run[sorting][begin]
    stop = np.concatenate([begin[1:], [len(run)]])
    shift = at[begin] - begin
    return begin + shift, stop + shift, np.maximum.reduceat(far[sorting], begin), np.bincount(of, minlength=len(start))


class Block:
    """The vectors of a block, by part, in the order of their trees."""

    def __init__(self, whole: np.ndarray, parts: int, trees: Trees | None = None):
        self.rows, self.parts = len(whole), parts
        self.bounds = bounds_of(whole.shape[1], parts)
        width = max(*(b - a for a, b in self.bounds), 1)
        self.points = np.zeros((parts * self.rows, width), np.int64)
        for k, (a, b) in enumerate(self.bounds):
            self.points[k * self.rows:(k + 1) * self.rows, :b - a] = whole[:, a:b]
        self.trees = trees or Trees.over(self.points, parts)
        self.ordered = self.points[self.trees.order]
        self.part = np.repeat(np.arange(parts), self.rows)

    def assigned(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, entry): runs of the order with their nearest entry; ``books`` is (parts, entries, width)."""
        trees, entries = self.trees, books.shape[1]
        node = np.arange(self.parts).repeat(entries)
        entry = np.tile(np.arange(entries), self.parts)
        while len(node):
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            count = np.diff(np.concatenate([first, [len(node)]]))
            at = node[first]
            d = self._distances(trees.start[node], entry, books)
            least = np.minimum.reduceat(d, first)
            # Entries that may be the nearest of some point of the node.
            limit = (np.sqrt(least.astype(float)) + 2.0 * np.sqrt(trees.reach[at].astype(float))) * (1 + 1e-9)
            kept = np.sqrt(d.astype(float)) * (1 - 1e-9) <= limit.repeat(count)
            best = _lowest(d, least.repeat(count), entry, first)
            options = np.add.reduceat(kept.astype(np.int64), first)
            done = (options == 1) | (trees.reach[at] == 0)
            yield trees.start[at[done]], trees.end[at[done]], best[done]
            open_pairs = kept & ~done.repeat(count)
            node, entry = node[open_pairs], entry[open_pairs]
            leaf = trees.children[node] == 0
            yield from self._by_point(node[leaf], entry[leaf], books)
            node, entry = self._children(node[~leaf], entry[~leaf])

    def _distances(self, place: np.ndarray, entry: np.ndarray, books: np.ndarray) -> np.ndarray:
        return _squared(self.ordered[place], books[self.part[place], entry])

    def _children(self, node: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the children with the entries of their parents, ordered by child and entry."""
        n = self.trees.children[node]
        first = np.repeat(self.trees.child[node], n)
        child = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((np.repeat(entry, n), child))
        return child[order], np.repeat(entry, n)[order]

    def _by_point(self, node: np.ndarray, entry: np.ndarray, books: np.ndarray):
        if not len(node):
            return
        n = self.trees.end[node] - self.trees.start[node]
        place = np.repeat(self.trees.start[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(entry, n)
        order = np.lexsort((entry, place))
        place, entry = place[order], entry[order]
        d = self._distances(place, entry, books)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [len(place)]]))
        best = _lowest(d, np.minimum.reduceat(d, first).repeat(count), entry, first)
        yield place[first], place[first] + 1, best

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts by entry, component sums by entry) over the block."""
        total = np.concatenate([np.zeros((1, self.ordered.shape[1]), np.int64), np.cumsum(self.ordered, axis=0)])
        count = np.zeros(books.shape[:2], np.int64)
        added = np.zeros(books.shape, np.int64)
        for start, end, entry in self.assigned(books):
            np.add.at(count, (self.part[start], entry), end - start)
            np.add.at(added, (self.part[start], entry), total[end] - total[start])
        return count, added

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes by row and part, squared distance by row)."""
        code = np.zeros(len(self.points), np.int64)
        for start, end, entry in self.assigned(books):
            n = end - start
            place = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            code[self.trees.order[place]] = np.repeat(entry, n)
        error = _squared(self.points, books[self.part, code])
        return code.reshape(self.parts, -1).T, error.reshape(self.parts, -1).sum(0)


def _lowest(d: np.ndarray, least: np.ndarray, entry: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The lowest entry at the least distance, by group."""
    return np.minimum.reduceat(np.where(d == least, entry, np.iinfo(np.int64).max), first)


_TREE = ("order", "start", "end", "reach", "child", "children")


def blocks(vectors: DataFrame, keep: list[str], width: int, parts: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``vectors``: (kept, whole, tree): kept columns as arrays, numbers and trees as bytes."""
    own = T.StructType([f for f in vectors.schema if f.name in keep])
    packed = vectors.where(F.size("whole") == width).select(F.struct(*[F.col(f"`{k}`") for k in own.names]).alias("kept"), "whole")
    tree = T.StructType([T.StructField(c, T.BinaryType()) for c in _TREE])
    schema = T.StructType([
        T.StructField("kept", T.ArrayType(own)), T.StructField("whole", T.BinaryType()), T.StructField("tree", tree),
    ])

    def job(batch: pa.RecordBatch):
        out: dict[str, list] = {"kept": [], "whole": [], "tree": []}
        flat = column_of(batch, "whole").flatten().to_numpy().reshape(batch.num_rows, width)
        kept = column_of(batch, "kept")
        for a in range(0, len(flat), rows):
            part = flat[a:a + rows].astype("<i4")
            trees = Block(part, parts).trees
            out["kept"].append(kept[a:a + rows].to_pylist())
            out["whole"].append(part.tobytes())
            out["tree"].append({c: getattr(trees, c).astype("<i8" if c == "reach" else "<i4").tobytes() for c in _TREE})
        return out

    return map_batches(packed, schema, job, rows)


def _read(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[int, Block]]:
    whole, tree = column_of(batch, "whole"), column_of(batch, "tree")
    for k in range(batch.num_rows):
        held = tree[k].as_py()
        arrays = [np.frombuffer(held[c], "<i8" if c == "reach" else "<i4").astype(np.int64) for c in _TREE]
        numbers = np.frombuffer(whole[k].as_py(), "<i4").reshape(len(arrays[0]) // parts, width).astype(np.int64)
        yield k, Block(numbers, parts, Trees(*arrays))


def entry_sums(held: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, at, n, total): parts and component sums of each entry; one set of rows a task."""
    parts = len(books)

    def run(batches):
        count, added = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, block in _read(batch, width, parts):
                c, a = block.sums(books)
                count += c
                added += a
        part, entry, at = np.nonzero(np.broadcast_to((count > 0)[:, :, None], added.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()),
             pa.array(count[part, entry]), pa.array(added[part, entry, at])], names=["part", "entry", "at", "n", "total"],
        )

    bounded_batches(held.sparkSession)
    found = held.select("whole", "tree").mapInArrow(run, "part int, entry int, at int, n bigint, total bigint")
    return found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@dataclass(frozen=True)
class Codebooks:
    """(parts, entries, width) whole numbers; parts narrower than the widest end in zeros."""

    numbers: np.ndarray
    bounds: list[tuple[int, int]]

    def digest(self) -> str:
        """Hash of all components in decimal, by part, entry and place, with commas between."""
        flat = [str(x) for k, (a, b) in enumerate(self.bounds) for e in self.numbers[k] for x in e[:b - a].tolist()]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def first_books(vectors: DataFrame, id_column: str, entries: int, parts: int) -> Codebooks | None:
    """Codebooks of the parts of the vectors with the smallest ids."""
    v = vectors.select(F.col(f"`{id_column}`").alias("id"), "whole")
    order = [F.asc_nulls_last("id"), "whole"]
    first = v.orderBy(*order).first()
    if first is None:
        return None
    width = len(first["whole"])
    rows = v.where(F.size("whole") == width).orderBy(*order).limit(entries).collect()
    bounds = bounds_of(width, parts)
    numbers = np.zeros((parts, len(rows), max(*(b - a for a, b in bounds), 1)), np.int64)
    for e, r in enumerate(rows):
        for k, (a, b) in enumerate(bounds):
            numbers[k, e, :b - a] = r["whole"][a:b]
    return Codebooks(numbers, bounds)


def compressed(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    by: float = 256.0, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, codes, error) of the vectors that take part, and the final codebooks.

    ``codes`` is binary, a byte a part; ``error`` is the squared distance from the entries.
    """
    if entries > 256:
        raise ValueError("a code is a byte")
    keep = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    whole = whole_numbers(keep, by, "vector").select("id", "label", "whole")
    books = first_books(whole, "id", entries, parts)
    result = T.StructType([
        T.StructField(id_column, keep.schema["id"].dataType), T.StructField(label, keep.schema["label"].dataType),
        T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType()),
    ])
    if books is None:
        return vectors.sparkSession.createDataFrame([], result), None
    width = books.bounds[-1][1]
    held = staged(blocks(whole, ["id", "label"], width, parts), "vector-blocks")
    for _ in range(rounds):
        numbers = books.numbers.copy()
        for r in entry_sums(held, books.numbers, width).collect():
            numbers[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        books = Codebooks(numbers, books.bounds)
    final = books.numbers
    schema = T.StructType([
        T.StructField("coded", T.ArrayType(T.StructType.fromDDL("codes binary, error bigint"))), held.schema["kept"],
    ])

    def job(batch: pa.RecordBatch):
        out = []
        for _, block in _read(batch, width, parts):
            codes, error = block.codes(final)
            raw = codes.astype(np.uint8)
            out.append([{"codes": raw[k].tobytes(), "error": int(e)} for k, e in enumerate(error)])
        return {"kept": column_of(batch, "kept"), "coded": out}

    rows = map_batches(held, schema, job).select(F.explode(F.arrays_zip("kept", "coded")).alias("r"))
    return rows.select(
        F.col("r.kept.id").alias(id_column), F.col("r.kept.label").alias(label), "r.coded.codes", "r.coded.error"
    ), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over rows of an equal label, nulls together.

    Errors are added up per label before anything is joined; a hot label is one row of the sums.
    """
    sums = coded.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded[label].eqNullSafe(sums["_of"])).drop("_of")


def _round(k: int, last: bool) -> str:
    """Assignment to the codebooks of round ``k``, and (but for the last) the next codebooks."""
    near = f"""
near{k} AS (
    SELECT p.r, p.part, arg_min(b.entry, b.d * 1000 + b.entry) AS entry, min(b.d) AS d
    FROM parts p, LATERAL (
        SELECT c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM book{k} c WHERE c.part = p.part
    ) b GROUP BY p.r, p.part
)"""
    if last:
        return near
    return near + f""", book{k + 1} AS (
    SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM book{k} c LEFT JOIN (
        SELECT part, entry, list(x ORDER BY place) AS v FROM (
            SELECT n.part, n.entry, i AS place, CAST(floor(sum(p.v[i])::DOUBLE / count(*)) AS BIGINT) AS x
            FROM near{k} n JOIN parts p USING (r, part), generate_series(1, len(p.v)) g(i) GROUP BY ALL
        ) GROUP BY part, entry
    ) m USING (part, entry)
)"""


ORACLE = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
    SELECT row_number() OVER (ORDER BY vec_id, w) AS r, * FROM kept
), parts AS (
    SELECT r, k AS part, w[k * len(w) // {PARTS} + 1:(k + 1) * len(w) // {PARTS}] AS v
    FROM numbered, generate_series(0, {PARTS - 1}) g(k)
), book0 AS (
    SELECT part, r - 1 AS entry, v FROM parts WHERE r <= {ENTRIES}
), {", ".join(_round(k, k == ROUNDS) for k in range(ROUNDS + 1))}, coded AS (
    SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY r
)
SELECT n.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY n.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM numbered n JOIN coded c USING (r)
"""
