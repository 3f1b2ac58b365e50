"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

Words are the parts between ASCII white space, in lower case; shingles are five words. A
shingle weighs its count in the text times a damped inverse document frequency,
1 + ln((1 + n) / (1 + df)) / (2 ln(2 + n)), from 1 to 1.5: undamped, the edits of a copy would
outweigh what it shares with a large group of copies, for all its words are common there.
Document frequencies cover all documents; they are kept in a table of fixed size by hash,
so what is sent to the tasks never grows (shingles that share a slot share the sum).

1. Texts with equal words are one node; only distinct ones go on.
2. Improved consistent weighted sampling gives each node 36 samples, equal in two texts with
   the probability of their weighted Jaccard similarity; 12 bands of 3 make buckets.
3. Buckets are salted into groups of bounded size. In each group a maximum spanning
   forest over the share of equal samples proposes links, one fewer than members; the
   centres of a bucket's groups are joined the same way. No bucket emits all its pairs.
4. Proposed links are verified by exact weighted Jaccard similarity of the texts: first
   each node's best one, then, in two rounds, the best ones between any two classes not joined yet.
   Classes are the connected components of the verified links.
5. Buckets that still hold more than one class are compared whole, large ones block against block, in two
   passes. The first compares samples and names the members that have a likely partner of another
   class; the second gets the texts of these alone, verifies the likely pairs exactly inside the task, and
   puts out only links that join two classes there: fewer than the classes it holds. A pair is
   looked at in the first bucket that it shares. So no likely pair of a bucket is passed over because its
   forest, or its group, lacks it, and no list of pairs ever leaves a task.

A pair is likely if at least ``LEAST_AGREEMENT`` of its samples are equal: at a similarity of 0.8 fewer
are with a chance of 1e-5. ``GROUP`` and ``BLOCK`` only decide which way finds a pair, not whether it is found.

Two texts of similarity s meet in a bucket with probability 1 - (1 - s^3)^12, 0.9998 at 0.8.

Defined cases: texts without words are linked to nothing; a text of one to four words is one
shingle, so it is linked to equal words only; the class is named by its smallest doc_id
(null ids last); repeated rows are copies of each other.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stationlake.llm import shingles
from stationlake.llm.frames import bounded_batches, bounded_rows, column_of, lean_shuffles, map_batches, mapped, texts_of
from stationlake.llm.links import components
from stationlake.sources.shared import staged

SLOT_BITS, MARK_BITS, SLICES, SALTS = 20, 23, 64, 16
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
THRESHOLD = 0.8
GROUP = 400
#: A pair whose share of equal samples is lower is not proposed: below a chance of 1e-5 at 0.8.
LEAST_AGREEMENT = 0.5
#: Members of a bucket in a block of those that are compared whole.
BLOCK = 200
#: Rounds in which links of the forests are tried; what they leave is found in the open buckets.
ROUNDS_OF_LINKS = 2


def prepared(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t.lower().encode("utf-8") for t in texts_of(batch, column)]


def node_of(raw: bytes) -> bytes | None:
    """128-bit hash of the words of a text; null without words."""
    import xxhash

    words = raw.split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(shingles.HASH_BITS - SLOT_BITS)).astype(np.int64)


def frequency_table(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequencies by slot, in hundredths (one byte each), and the documents.

    Every task counts into a table of its own; the tables are added slice by slice in two
    steps, and only the finished table, of a fixed megabyte, reaches the driver.
    """

    def count(batches):
        total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            raws = prepared(batch)
            for a, b in shingles.groups(raws):
                _, hashes, _ = shingles.sorted_by_text(*shingles.shingle_hashes(raws[a:b]))
                np.add.at(total, slots(hashes), 1)
            n += batch.num_rows
        if n:
            yield from pieces(total, n)

    def pieces(total: np.ndarray, n: int):
        for k, part in enumerate(np.split(total, SLICES)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([n if k == 0 else 0], pa.int64()),
                 pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())],
                names=["slice", "n", "counts"],
            )

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for k, n, counts in zip(*(column_of(batch, c).to_pylist() for c in ("slice", "n", "counts"))):
                part = np.frombuffer(zlib.decompress(counts), "<i8")
                if k in held:
                    held[k][0] += n
                    held[k][1] += part
                else:
                    held[k] = [n, part.copy()]
        for k, (n, part) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "n", "counts"],
            )

    bounded_batches(docs.sparkSession)
    schema = "slice int, n bigint, counts binary"
    tables = mapped(docs.select("text"), count, schema)
    salted = tables.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(SALTS))).repartition("slice", "salt")
    added = mapped(mapped(salted.drop("salt"), add, schema).repartition("slice"), add, schema)
    parts = {r["slice"]: r for r in bounded_rows(added, SLICES)}
    n = parts[0]["n"] if parts else 0
    df = np.concatenate([
        np.frombuffer(zlib.decompress(bytes(parts[k]["counts"])), "<i8") if parts
        else np.zeros((1 << SLOT_BITS) // SLICES, "<i8") for k in range(SLICES)
    ])
    idf = 1.0 + np.log((1.0 + n) / (1.0 + np.minimum(df, n))) / (2.0 * np.log(2.0 + n))
    return np.round(idf * 100).astype(np.uint8), n


class Sampler:
    """Improved consistent weighted sampling with random numbers from fixed pools.

    A shingle draws Gamma(2, 1), uniform and Gamma(2, 1) numbers for each sample by its
    hash, so equal shingles draw equal numbers in every task.
    """

    POOL = 1 << 16

    def __init__(self):
        rng = np.random.default_rng(20240607)
        self.r = rng.gamma(2.0, 1.0, self.POOL).astype(np.float32)
        self.per_r = (1.0 / self.r).astype(np.float32)
        self.beta = rng.random(self.POOL).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, self.POOL)).astype(np.float32)
        self.factors = rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, owner: np.ndarray, hashes: np.ndarray, log_weight: np.ndarray, n: int) -> np.ndarray:
        """(texts with shingles, SAMPLES) 64-bit samples; ``owner`` is sorted, ``n`` texts."""
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(owner)]]))
        out = np.zeros((len(starts), SAMPLES), np.uint64)
        for j, factor in enumerate(self.factors):
            drawn = hashes * factor
            a = (drawn >> np.uint64(48)).astype(np.intp)
            b = ((drawn >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)
            beta = self.beta[a]
            t = np.floor(log_weight * self.per_r[a] + beta)
            key = self.log_c[b] - self.r[a] * (t - beta + np.float32(1))
            least = np.minimum.reduceat(key, starts)
            hit = np.flatnonzero(key == np.repeat(least, lengths))
            _, first = np.unique(owner[hit], return_index=True)
            chosen = hit[first]
            out[:, j] = shingles.mix(
                hashes[chosen] ^ (t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            )
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] = keys[:, b] * np.uint64(0xD6E8FEB86659FD93) + samples[:, b * ROWS + r]
    return shingles.mix(keys).view(np.int64)


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, node, bands, signature): the node of each text, its bucket keys and samples."""
    sampler: list[Sampler] = []

    def job(batch: pa.RecordBatch):
        if not sampler:
            sampler.append(Sampler())
        raws = prepared(batch)
        bands: list = [[]] * len(raws)
        signatures: list = [None] * len(raws)
        for a, b in shingles.groups(raws):
            owner, hashes, times = shingles.sorted_by_text(*shingles.shingle_hashes(raws[a:b]))
            if not len(hashes):
                continue
            weight = np.log(times * idf[slots(hashes)]).astype(np.float32)
            samples = sampler[0].samples(owner, hashes, weight, b - a)
            short = (samples & np.uint64(0xFFFFFFFF)).astype("<u4")
            keys = band_keys(samples)
            for k, text in enumerate(np.unique(owner)):
                signatures[a + text] = short[k].tobytes()
                bands[a + text] = keys[k]
        return {
            "doc_id": column_of(batch, "doc_id"), "node": [node_of(r) for r in raws],
            "bands": bands, "signature": signatures,
        }

    return map_batches(
        docs.select("doc_id", "text"), "doc_id bigint, node binary, bands array<bigint>, signature binary", job
    )


def spanning_links(signatures: np.ndarray, least: float = LEAST_AGREEMENT) -> tuple[list[tuple[int, int, float]], int]:
    """Maximum spanning forest over agreements of at least ``least``; and the most central member."""
    n = len(signatures)
    agree = np.zeros((n, n), np.float32)
    for j in range(signatures.shape[1]):
        column = signatures[:, j]
        agree += column[:, None] == column[None, :]
    agree /= signatures.shape[1]
    centre = int(np.argmax(agree.sum(1)))
    links: list[tuple[int, int, float]] = []
    inside = np.zeros(n, bool)
    best, origin = np.full(n, -1.0, np.float32), np.zeros(n, int)
    at = centre
    for _ in range(n):
        inside[at] = True
        closer = (agree[at] > best) & ~inside
        best[closer], origin[closer] = agree[at][closer], at
        best[at] = -2.0
        if inside.all():
            break
        nxt = int(np.argmax(np.where(inside, -2.0, best)))
        if best[nxt] >= least:
            links.append((int(origin[nxt]), nxt, float(best[nxt])))
        at = nxt
    return links, centre


def proposed(nodes: DataFrame) -> DataFrame:
    """(a, b, agree): links worth verifying, a linear number of them in each bucket."""
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    found = []
    while True:
        shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
        dealt = members.join(shared, ["band", "key"]).select(
            "band", "key", "node",
            F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / F.lit(GROUP)).cast("bigint")).alias("salt"),
            (F.col("n") > GROUP).alias("split"),
        )
        groups = staged(linked_groups(dealt.join(nodes.select("node", "signature"), "node")), "near-groups")
        found.append(groups.where("a is not null").select("a", "b", "agree"))
        # The centres of the groups of a split bucket make the next, smaller bucket.
        members = groups.where("centre is not null and split").select(F.col("centre").alias("node"), "band", "key")
        if members.isEmpty():
            break
    ordered = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (
        reduce(DataFrame.unionByName, found).select(ordered.alias("l"), "agree")
        .groupBy("l").agg(F.max("agree").alias("agree")).select("l.a", "l.b", "agree")
    )


def linked_groups(members: DataFrame) -> DataFrame:
    """Per group the links of its spanning forest, and one row with its centre.

    ``members`` is (band, key, salt, split, node, signature). Groups are read from sorted
    partitions; only one is held at a time, of about ``GROUP`` members (dealt by hash).
    """
    bounded_batches(members.sparkSession)
    schema = T.StructType.fromDDL("band int, key bigint, split boolean, a binary, b binary, agree float, centre binary")
    want = to_arrow_schema(schema)

    def rows_of(key: tuple, held: list[tuple]) -> list[tuple]:
        if len(held) < 2:
            return []
        signatures = np.frombuffer(b"".join(h[1] for h in held), "<u4").reshape(len(held), -1)
        links, centre = spanning_links(signatures)
        band, bucket, _, split = key
        rows = [(band, bucket, split, held[a][0], held[b][0], w, None) for a, b, w in links]
        return rows + [(band, bucket, split, None, None, None, held[centre][0])]

    def run(batches):
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = (column_of(batch, c).to_pylist() for c in ("band", "key", "salt", "split", "node", "signature"))
            for *group, node, signature in zip(*columns):
                if tuple(group) != key:
                    out += rows_of(key, held)
                    key, held = tuple(group), []
                held.append((node, signature))
            yield as_batch(out)
        yield as_batch(rows_of(key, held))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(want)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, want)], schema=want)

    dealt = members.repartition("band", "key", "salt").sortWithinPartitions("band", "key", "salt", "node")
    return mapped(dealt, run, schema)


def open_buckets(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, band, key, others, most, top): members of buckets of more than one class.

    ``top`` is the largest class of the bucket with ``most`` members; ``others`` are not in it.
    """
    members = (
        nodes.select("node", F.posexplode("bands").alias("band", "key")).join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    sizes = members.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    found = sizes.groupBy("band", "key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes")
    ).where("classes > 1").select(
        "band", "key", (F.col("n") - F.col("top.n")).alias("others"), F.col("top.n").alias("most"),
        F.col("top.label").alias("top"),
    )
    return members.join(found, ["band", "key"])


def block_jobs(members: DataFrame) -> DataFrame:
    """(band, key, kind, x, y, side, node, label): members dealt to the jobs that compare them.

    A bucket of up to two blocks is one job (kind 0). Of a larger one the largest class
    and the other members are cut into blocks; other blocks meet each other (kind 2) and
    all blocks of the largest class (kind 1), whose own blocks need no comparison.
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    in_top = F.col("label") == F.col("top")
    dealt = members.withColumns({"o": blocks("others"), "d": blocks("most"), "in_top": in_top}).withColumn(
        "block", F.pmod(F.xxhash64("node", "band"), F.when(F.col("in_top"), F.col("d")).otherwise(F.col("o"))).cast("int")
    )

    def job(kind: int, x, y):
        return F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    block, first = F.col("block"), F.lit(0)
    others = F.sequence(first, F.col("o") - 1)
    jobs = (
        F.when(F.col("others") + F.col("most") <= 2 * BLOCK, F.array(job(0, first, first)))
        .when(F.col("in_top"), F.transform(others, lambda i: job(1, i, block)))
        .otherwise(F.concat(
            F.transform(others, lambda i: job(2, F.least(i, block), F.greatest(i, block))),
            F.transform(F.sequence(first, F.col("d") - 1), lambda j: job(1, block, j)),
        ))
    )
    side = F.when(F.col("job.kind") == 1, F.col("in_top").cast("int")).otherwise(F.col("block"))
    return dealt.withColumn("job", F.explode(jobs)).select("band", "key", "job.*", side.alias("side"), "node", "label")


JOB = ["band", "key", "kind", "x", "y"]


class Members:
    """The members of one job, and the pairs of them that are to be looked at."""

    def __init__(self, key: tuple, rows: list[dict]):
        self.band, _, kind, x, y = key
        self.rows = rows
        self.apart = kind == 1 or x < y
        codes: dict[bytes, int] = {}
        self.label = np.array([codes.setdefault(r["label"], len(codes)) for r in rows])
        self.labels = list(codes)
        self.side = np.array([r["side"] for r in rows])
        self.signature = np.frombuffer(b"".join(r["signature"] for r in rows), "<u4").reshape(len(rows), -1)
        self.bands = np.array([r["bands"] for r in rows], np.int64)[:, :self.band]

    def likely(self, i: int, classes: np.ndarray) -> np.ndarray:
        """Later members of other classes that agree with member ``i``, and share no earlier bucket with it."""
        other = classes[i + 1:] != classes[i]
        if self.apart:
            other &= self.side[i + 1:] != self.side[i]
        js = np.flatnonzero(other) + i + 1
        js = js[~(self.bands[js] == self.bands[i]).any(1)]
        return js[(self.signature[js] == self.signature[i]).mean(1) >= LEAST_AGREEMENT]


def by_job(rows: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """Apply ``work(key, rows)`` to the rows of each job; one job is held at a time."""
    bounded_batches(rows.sparkSession)
    want = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            names = batch.schema.names
            for row in batch.to_pylist():
                now = tuple(row[c] for c in JOB)
                if now != key:
                    out += work(key, held) if len(held) > 1 else []
                    key, held = now, []
                held.append({c: row[c] for c in names if c not in JOB})
            yield pa.RecordBatch.from_pylist(out, schema=want)
            out = []
        yield pa.RecordBatch.from_pylist(work(key, held) if len(held) > 1 else [], schema=want)

    dealt = rows.select(*JOB, *columns).repartition(*JOB).sortWithinPartitions(*JOB)
    return mapped(dealt, run, schema)


def with_partner(jobs: DataFrame) -> DataFrame:
    """(job, side, node, label) of the members that have a likely partner of another class."""

    def work(key: tuple, rows: list[dict]) -> list[dict]:
        members, some = Members(key, rows), np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            js = members.likely(i, members.label)
            some[js] = True
            some[i] |= len(js) > 0
        job = dict(zip(JOB, key))
        return [job | {c: rows[k][c] for c in ("side", "node", "label")} for k in np.flatnonzero(some)]

    return by_job(
        jobs, ["side", "node", "label", "signature", "bands"],
        "band int, key bigint, kind int, x int, y int, side int, node binary, label binary", work,
    )


def joining_links(jobs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(label_a, label_b): links between classes by exact weighted Jaccard similarity, verified in the jobs.

    ``jobs`` is (job, side, node, label, signature, bands, text). A job puts out fewer links than it has classes.
    """

    def work(key: tuple, rows: list[dict]) -> list[dict]:
        members = Members(key, rows)
        weights = Weights([(r["text"] or "").lower().encode("utf-8") for r in rows], idf)
        classes, out = members.label.copy(), []
        for i in range(len(rows) - 1):
            js = members.likely(i, classes)
            js = js[weights.may_reach(i, js, threshold)]
            if len(js):
                for j in js[weights.similarity(i, js) >= threshold - 1e-9]:
                    if classes[j] != classes[i]:
                        out.append({"label_a": rows[i]["label"], "label_b": rows[j]["label"]})
                        classes[classes == classes[j]] = classes[i]
        return out

    return by_job(
        jobs, ["side", "node", "label", "signature", "bands", "text"], "label_a binary, label_b binary", work
    )


class Weights:
    """Shingle weights of the texts of a job, for similarities of one text with many."""

    def __init__(self, raws: list[bytes], idf: np.ndarray):
        parts = []
        for a, b in shingles.groups(raws):
            owner, hashes, times = shingles.sorted_by_text(*shingles.shingle_hashes(raws[a:b]))
            parts.append((owner + a, hashes, times * idf[slots(hashes)].astype(np.int64)))
        owner, hashes, self.weight = (np.concatenate(c) for c in zip(*parts))
        kinds, self.kind = np.unique(hashes, return_inverse=True)
        self.start = np.searchsorted(owner, np.arange(len(raws) + 1))
        self.total = np.bincount(owner, self.weight, len(raws)).astype(np.int64)
        self.own = np.zeros(len(kinds), np.int64)

    def may_reach(self, i: int, js: np.ndarray, threshold: float) -> np.ndarray:
        """What is shared is at most the smaller sum, and the union at least the larger."""
        small, large = np.minimum(self.total[i], self.total[js]), np.maximum(self.total[i], self.total[js])
        return small >= (threshold - 1e-9) * large

    def similarity(self, i: int, js: np.ndarray) -> np.ndarray:
        mine = slice(self.start[i], self.start[i + 1])
        self.own[self.kind[mine]] = self.weight[mine]
        n = self.start[js + 1] - self.start[js]
        at = np.repeat(self.start[js], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least = np.minimum(self.own[self.kind[at]], self.weight[at])
        shared = np.bincount(np.repeat(np.arange(len(js)), n), least, len(js))
        self.own[self.kind[mine]] = 0
        union = self.total[i] + self.total[js] - shared
        return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def jaccard(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two prepared texts."""
    owner, hashes, times = shingles.sorted_by_text(*shingles.shingle_hashes([a, b]))
    weight = times * idf[slots(hashes)].astype(np.int64)
    left, right = owner == 0, owner == 1
    shared, i, j = np.intersect1d(hashes[left], hashes[right], assume_unique=True, return_indices=True)
    both = np.minimum(weight[left][i], weight[right][j]).sum()
    total = weight.sum() - both
    return float(both) / float(total) if total else 0.0


def marks_of(nodes: DataFrame) -> np.ndarray:
    """A table of fixed size (one megabyte of bits) with a mark for every node.

    It only spares texts that no link needs from the shuffle: a text whose mark is set by
    another node is sent in vain and falls out of the join. A table that fills up spares none.
    """

    def mark(batches):
        table = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            for at in column_of(batch, "node").to_pylist():
                table[mark_of(at)] = True
        yield from packed(table)

    def packed(table: np.ndarray):
        for k, part in enumerate(np.split(table, SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())],
                    names=["slice", "bits"],
                )

    def either(batches):
        table = np.zeros((SLICES, (1 << MARK_BITS) // SLICES), bool)
        for batch in batches:
            for k, bits in zip(column_of(batch, "slice").to_pylist(), column_of(batch, "bits").to_pylist()):
                table[k] |= np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8)).astype(bool)
        yield from packed(table.reshape(-1))

    bounded_batches(nodes.sparkSession)
    marks = mapped(nodes, mark, "slice int, bits binary")
    rows = bounded_rows(mapped(marks.repartition("slice"), either, "slice int, bits binary"), SLICES)
    table = np.zeros((SLICES, (1 << MARK_BITS) // SLICES), bool)
    for r in rows:
        table[r["slice"]] = np.unpackbits(np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)).astype(bool)
    return np.packbits(table.reshape(-1))


def mark_of(node: bytes) -> int:
    return int.from_bytes(node[:4], "little") >> (32 - MARK_BITS)


def texts_of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one text each."""
    marks = marks_of(nodes)

    def job(batch: pa.RecordBatch):
        keys = [node_of(r) for r in prepared(batch)]
        kept = [k for k, key in enumerate(keys) if key and marks[mark_of(key) >> 3] >> (7 - mark_of(key) % 8) & 1]
        return {"node": [keys[k] for k in kept], "text": column_of(batch, "text").take(pa.array(kept, pa.int64()))}

    noded = map_batches(docs.select("text"), "node binary, text string", job)
    return noded.groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node", "left_semi")


def verified(
    links: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, many: bool = False
) -> DataFrame:
    """(a, b, similar) of the links, by the texts of their nodes: each text moves once a link."""
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    # Many links mean a join by shuffle at any size; few ones may be sent to the texts.
    pairs = (ends.hint("merge") if many else ends).join(texts, "node").groupBy("a", "b").agg(
        F.min_by("text", "node").alias("text_a"), F.max_by("text", "node").alias("text_b")
    )

    def job(batch: pa.RecordBatch):
        scores = [
            jaccard(x, y, idf) for x, y in zip(prepared(batch, "text_a"), prepared(batch, "text_b"))
        ]
        return {
            "a": column_of(batch, "a"), "b": column_of(batch, "b"),
            "similar": [s >= threshold - 1e-9 for s in scores], "score": scores,
        }

    return map_batches(pairs, "a binary, b binary, similar boolean, score double", job)


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between them: only the labels that these links touch are relabelled."""
    moves = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(
        F.col("node").alias("label"), F.col("label").alias("lower")
    )
    known = labels.join(moves, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    # A node without links so far was its own label.
    fresh = moves.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(
        F.col("label").alias("node"), F.col("lower").alias("label")
    )
    return staged(known.unionByName(fresh), "near-labels")


def wanted_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    return staged(texts_of_nodes(docs, staged(nodes, "near-wanted")), "near-texts")


def joined(labels: DataFrame, rest: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Labels after the best links of ``rest`` between any two classes are tried.

    Each round tries eight times as many as before: one in each share of the links between two classes, dealt
    by hash. Links within a class are dropped untried.
    """
    tries = 1
    for _ in range(ROUNDS_OF_LINKS):
        label = lambda side: labels.select(  # noqa: B023, E731
            F.col("node").alias(side), F.col("label").alias(f"label_{side}")
        )
        rest = staged(
            rest.drop("label_a", "label_b").join(label("a"), "a", "left").join(label("b"), "b", "left").withColumns({
                "label_a": F.coalesce("label_a", "a"), "label_b": F.coalesce("label_b", "b"),
            }).where("label_a <> label_b"),
            "near-open",
        )
        between = F.array_sort(F.array("label_a", "label_b"))
        share = F.pmod(F.xxhash64("a", "b"), F.lit(tries))
        chosen = staged(
            rest.groupBy(between.alias("between"), share.alias("share")).agg(
                F.max(F.struct("agree", "a", "b", "label_a", "label_b")).alias("m")
            ).select("m.*"),
            "near-chosen",
        )
        if chosen.isEmpty():
            return labels
        done = staged(verified(chosen, texts, idf, threshold), "near-verified")
        accepted = staged(chosen.join(done.where("similar"), ["a", "b"], "left_semi"), "near-accepted")
        if not accepted.isEmpty():
            labels = merged_labels(labels, accepted)
        rest = rest.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        tries *= 8
    return labels


def linked_in_buckets(
    docs: DataFrame, nodes: DataFrame, labels: DataFrame, idf: np.ndarray, threshold: float
) -> DataFrame:
    """Labels after every likely pair of different classes in any bucket is verified."""
    members = staged(open_buckets(nodes, labels), "near-open-buckets")
    if members.isEmpty():
        return labels
    marks = nodes.select("node", "signature", "bands")
    likely = staged(with_partner(block_jobs(members).join(marks, "node")), "near-likely")
    if likely.isEmpty():
        return labels
    texts = wanted_texts(docs, likely.select("node").distinct())
    links = staged(
        joining_links(likely.join(marks, "node").join(texts, "node"), idf, threshold).distinct(), "near-joining"
    )
    return labels if links.isEmpty() else merged_labels(labels, links)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, label): the class of every document; ``label`` is null without links.

    ``docs`` is (doc_id, text). Documents of one node, or of one label, are one class.
    """
    lean_shuffles(docs.sparkSession)
    idf, _ = frequency_table(docs)
    signatures = staged(signed(docs, idf), "near-signatures")
    nodes = staged(
        signatures.where("node is not null").groupBy("node").agg(
            F.first(F.struct("bands", "signature")).alias("s")
        ).select("node", "s.bands", "s.signature"),
        "near-nodes",
    )
    links = staged(proposed(nodes), "near-links")
    texts = wanted_texts(docs, links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    # First the best link of every node.
    ends = links.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
    best = ends.groupBy("end").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    done = staged(verified(best, texts, idf, threshold, many=True), "near-verified")
    labels = components(done.where("similar").select("a", "b"))
    rest = links.join(done.select("a", "b"), ["a", "b"], "left_anti")
    # Then the best links between any two classes, and last what the buckets hold besides.
    labels = joined(labels, rest, texts, idf, threshold)
    labels = linked_in_buckets(docs, nodes, labels, idf, threshold)
    return signatures.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", "label")


def named(found: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size): one row a document; its class by its smallest doc_id.

    Documents without words are classes of their own.
    """
    member = F.coalesce("label", "node")
    own = found.withColumn("member", member)
    sizes = own.where("member is not null").groupBy("member").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    return own.join(sizes, "member", "left").select(
        "doc_id", F.when(F.col("member").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id.

    Documents without words all stay. Of equal rows with that id one stays.
    """
    found = staged(classes(docs.select("doc_id", "text"), threshold), "near-classes")
    member = F.coalesce("label", "node")
    keepers = staged(
        found.where("node is not null").withColumn("member", member).groupBy("member").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("k")
        ).select("k.doc_id", "k.node"),
        "near-keepers",
    )
    counted = found.join(keepers, (found["node"] == keepers["node"]) & found["doc_id"].eqNullSafe(keepers["doc_id"]),
                         "left_semi").groupBy("doc_id", "node").agg(F.count("*").alias("rows"))
    names = docs.columns
    node, own_id, own_node, rows = (_fresh(c, names) for c in ("_node", "_id", "_n", "_rows"))
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())])

    def job(batch: pa.RecordBatch):
        kept = {c: batch.column(k) for k, c in enumerate(names)}
        return kept | {node: [node_of(r) for r in prepared(batch)]}

    noded = map_batches(docs, schema, job)
    wordless = noded.where(F.col(node).isNull()).drop(node)
    k = counted.select(F.col("doc_id").alias(own_id), F.col("node").alias(own_node), F.col("rows").alias(rows))
    kept = noded.join(k, (noded[node] == k[own_node]) & noded["doc_id"].eqNullSafe(k[own_id]))
    columns = [F.col(f"`{c}`") for c in names]
    single = kept.where(F.col(rows) == 1).select(*columns)
    repeated = kept.where(F.col(rows) > 1).dropDuplicates([own_node, own_id]).select(*columns)
    return single.unionByName(repeated).unionByName(wordless)


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name
