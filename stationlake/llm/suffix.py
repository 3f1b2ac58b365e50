"""Repeated passages by a distributed difference-cover suffix array, exact to the byte.

Matches of ``LENGTH`` bytes are looked for. Texts are cut into chunks at anchors (the
smallest hash of every window of ``WINDOW`` places), so two equal strings of 400 bytes agree
in the anchor of their first window, in that of their last one and in all between; the whole
chunks they share measure at least ``NEED`` bytes. So the suffix array is built over chunks:

1. Chunks that stand once cannot be inside a match. Runs of other chunks of ``NEED`` bytes and
   more are the strings to sort.
2. Difference cover modulo 3: the triples of chunks at places 1 and 2 (mod 3) are sorted and
   named by their order, short ones with the triple after them; where a name is neither alone nor
   long enough, the names are strings themselves and the step recurs on them. The other suffixes are merged by two
   sorts, with samples of one kind each: (chunk, rank of the next place) and (two chunks,
   rank of the one after); every suffix counts those before it, which gives its place. A sample's name tells the
   samples before it, so samples are not sorted again among themselves.
3. Neighbours in suffix order are compared; a suffix that shares ``NEED`` bytes with a
   neighbour is a candidate, no other one can start a match.
4. Exact check: the 400-byte strings whose first anchor is a candidate are hashed (64 bits)
   and counted in hash buckets; bytes covered by a string that starts twice are removed.

Sorts are range partitioned with the place as the last key, so equal strings spread over tasks;
partitions pass on their counts only. Nothing but one row a partition reaches the driver.

Defined cases: a null text is empty; texts are bytes of UTF-8 and matches never cross
documents; copies of a text of 400 bytes or more are removed whole; shorter texts stay.

Runs of ``WORDS`` equal words can be looked for as well (``without_repeats(..., words=True)``), in the same
passes over the texts: every run holds an anchor, so its ``WORD_GRAM`` words from there on stand twice if the run
does. Anchors whose words stand once are dropped, the runs of the others take the exact check of step 4 as
strings of word hashes. There are few of them, so nothing is sorted. White space between
words does not count; what goes is all from the first byte of the first word to the last byte of the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stationlake.llm import shingles
from stationlake.llm.frames import bounded_batches, bounded_rows, column_of, lean_shuffles, map_batches, mapped, texts_of
from stationlake.sources.shared import staged

LENGTH, WINDOW, GRAM = 400, 128, 16
NEED = LENGTH - 2 * WINDOW - GRAM + 2
WORDS, WORD_WINDOW, WORD_GRAM = 51, 32, 16
BUCKET_ROWS, BLOCK_BYTES, GROUP_BYTES = 2_000_000, 1_500_000, 1 << 16
MOST_PARTITIONS = 1_000_000


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` 64-bit symbols from each place on."""
    h = symbols * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < gram:
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    return h


def smallest(key: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while width < window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return key


def anchors_of_grams(grams: np.ndarray) -> np.ndarray:
    """For each window of words its anchor: the last of the smallest hashes in it."""
    low = np.uint64(0xFFFFFFFF)
    key = smallest((grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64)), WORD_WINDOW)
    return (low - (key & low)).astype(np.int64)


def first_anchors(data: np.ndarray) -> np.ndarray:
    """For each window of bytes its anchor: the last of the smallest hashes in it.

    Hash and place share 32 bits, so a piece has at most 65,536 places. Equal hashes do not harm: the place decides.
    """
    low, step = np.uint32(0xFFFF), (1 << 16) - WINDOW + 1
    out = [np.zeros(0, np.int64)]
    for at in range(0, max(len(data) - WINDOW - GRAM + 2, 0), step):
        h = data[at:at + step + WINDOW + GRAM - 2].astype(np.uint32) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        width = 1
        while width < GRAM:
            h = h[:-width] * np.uint32(0x85EBCA6B + 2 * width) + h[width:]
            h ^= h >> np.uint32(13)
            width *= 2
        key = smallest((h & ~low) | (low - np.arange(len(h), dtype=np.uint32)), WINDOW)
        out.append(at + (low - (key & low)).astype(np.int64))
    return np.concatenate(out)


def changes(sorted_values: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array; anchors of windows never go back, so they are sorted."""
    return sorted_values[np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)]]


@cache
def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(codes * shingles.powers(shingles._BASE, len(codes)))])


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from ``start`` to ``end``, the same wherever they stand."""
    back = shingles.powers(shingles._INVERSE, len(sums) + 1)
    return shingles.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def bytes_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


class Bytes:
    """Some texts end to end: for each window of places its anchor (``first``), for each text where it begins."""

    def __init__(self, raws: list[bytes], seed: int):
        data = bytes_of(b"".join(raws))
        self.begin = np.cumsum([0, *map(len, raws)])
        self.first = first_anchors(data)
        self.sums = prefix_sums(byte_codes(seed).take(data))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` begin and end."""
    data = bytes_of(raw)
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(gap)
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


class Words:
    """The hashed words of some texts, end to end, and the runs of ``WORDS`` of them within a text.

    ``run`` is where each run begins, ``anchor`` its anchor; ``owner`` is the text of each word, ``begin`` where
    the words of each text begin.
    """

    def __init__(self, raws: list[bytes]):
        self.hashes, counts = shingles.word_hashes(raws)
        self.counts = counts
        ends = np.cumsum(counts)
        self.begin = ends - counts
        self.owner = np.repeat(np.arange(len(raws)), counts)
        self.grams, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.hashes) >= WORDS:
            self.grams = gram_hashes(self.hashes, WORD_GRAM)
            first = anchors_of_grams(self.grams)
        at = np.arange(len(first))
        self.run = at[at + WORDS <= ends[self.owner[: len(first)]]]
        self.anchor = first[self.run]

    def run_hashes(self, run: np.ndarray) -> np.ndarray:
        return span_hashes(prefix_sums(shingles.mix(self.hashes + np.uint64(23))), run, run + WORDS)


def key_of(text: str):
    """128 bits that stand for a text, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def raws_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t.encode("utf-8") for t in texts_of(batch, column)]


def chunked(docs: DataFrame, words: bool = False) -> DataFrame:
    """(key, copies, tid, units, starts, hashes): distinct texts long enough for a match, by their chunks.

    With ``words`` also (n_words, places, grams): the anchors among the words and the hash of the words from there on.
    """

    def job(batch: pa.RecordBatch):
        out: dict[str, list] = {"key": [], "units": [], "starts": [], "hashes": [], "n_words": [], "places": [], "grams": []}
        keys, raws = column_of(batch, "key").to_pylist(), raws_of(batch)
        for a, b in shingles.groups(raws, GROUP_BYTES):
            add(out, keys[a:b], raws[a:b])
        return out

    def add(out: dict[str, list], keys: list[bytes], raws: list[bytes]) -> None:
        whole, found = Bytes(raws, 11), Words(raws if words else [])
        anchors = changes(found.anchor)
        bounds = np.searchsorted(anchors, np.concatenate([found.begin, [len(found.hashes)]]))
        grams = found.grams[anchors].view(np.int64)
        for k, (key, raw, begin) in enumerate(zip(keys, raws, whole.begin)):
            n_words = int(found.counts[k]) if words else 0
            if len(raw) < LENGTH and n_words < WORDS:
                continue
            starts, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(raw) >= LENGTH:
                starts = changes(whole.first[begin:begin + len(raw) - WINDOW - GRAM + 2])
                # Positive numbers: 0 stands for the end of a string, below every chunk.
                hashes = np.maximum(span_hashes(whole.sums, starts[:-1], starts[1:]) >> np.uint64(1), 1)
                starts = starts - begin
            out["key"].append(key)
            out["units"].append(len(raw))
            out["starts"].append(starts.astype(np.int32))
            out["hashes"].append(hashes.astype(np.int64))
            if words:
                own = slice(bounds[k], bounds[k + 1])
                out["n_words"].append(n_words)
                out["places"].append((anchors[own] - found.begin[k]).astype(np.int32))
                out["grams"].append(grams[own])

    fields = ["units int", "starts array<int>", "hashes array<bigint>"]
    fields += ["n_words int", "places array<int>", "grams array<bigint>"] if words else []
    names = [f.split()[0] for f in fields]
    found = map_batches(docs.select("key", "text"), ", ".join(["key binary", *fields]), job)
    distinct = found.groupBy("key").agg(F.count("*").alias("copies"), F.first(F.struct(*names)).alias("c"))
    return distinct.select("key", "copies", F.monotonically_increasing_id().alias("tid"), *[f"c.{n}" for n in names])


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(seq, tid, starts, syms, sizes): runs of chunks that stand elsewhere too."""
    flat = texts.select("tid", "starts", F.posexplode("hashes").alias("pos", "hash")).select(
        "tid", "hash", F.element_at("starts", F.col("pos") + 1).alias("start"),
        F.element_at("starts", F.col("pos") + 2).alias("end"),
    )
    often = staged(
        flat.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "suffix-chunks"
    )
    kept = flat.join(often, "hash").groupBy("tid").agg(F.collect_list(F.struct("start", "end", "hash")).alias("c"))

    def job(batch: pa.RecordBatch):
        out: dict[str, list] = {"tid": [], "starts": [], "syms": [], "sizes": []}
        chunks = column_of(batch, "c")
        flat = chunks.flatten()
        bounds = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy())])
        start, end, sym = (flat.field(k).to_numpy() for k in range(3))
        for tid, a, b in zip(column_of(batch, "tid").to_pylist(), bounds, bounds[1:]):
            order = a + np.argsort(start[a:b])
            s, e = start[order], end[order]
            cut = np.concatenate([[0], np.flatnonzero(s[1:] != e[:-1]) + 1, [len(order)]])
            for x, y in zip(cut, cut[1:]):
                if e[y - 1] - s[x] >= NEED:
                    out["tid"].append(tid)
                    out["starts"].append(s[x:y])
                    out["syms"].append(sym[order[x:y]])
                    out["sizes"].append(e[x:y] - s[x:y])
        return out

    runs = map_batches(kept, "tid bigint, starts array<int>, syms array<bigint>, sizes array<int>", job)
    return runs.withColumn("seq", F.monotonically_increasing_id())


def whole_partition(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def counted_before(rows: DataFrame, keys: list[str], tie: list[str], keep: list[str] | None = None) -> DataFrame:
    """``rows`` (with a 0/1 column ``kind``) in the order of ``keys``, with ``before0`` and
    ``before1``: the rows of each kind whose keys are smaller; and ``alone``: no equal key.

    Rows are dealt by range of keys and ``tie``, so equal keys may span partitions; each
    partition reports its totals, its first and last key and how many rows share the last.
    Columns ``keep`` (all, if None) are given back; a key that is not among them is written for those ends only.
    """
    import pyarrow.compute as pc

    bounded_batches(rows.sparkSession)
    dealt = rows.repartitionByRange(*keys, *tie).sortWithinPartitions(*keys, *tie)
    names = rows.columns if keep is None else keep
    kept = [rows.schema[c] for c in names]
    ends = [T.StructField(f"end_{k}", rows.schema[k].dataType) for k in keys]
    added = T.StructType.fromDDL(
        "before0 bigint, before1 bigint, alone boolean, part int, part_first boolean, part_last boolean, "
        "edge int, n0 bigint, n1 bigint"
    )
    schema = T.StructType([*kept, *added.fields, *ends])
    want = to_arrow_schema(schema)

    def count(batches):
        from pyspark import TaskContext

        table = whole_partition(batches)
        if table is None:
            return
        n = table.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        kind = table.column("kind").to_numpy().astype(np.int64)
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        ones = np.concatenate([[0], np.cumsum(kind)])
        edge = np.zeros(n, np.int32)
        edge[0] += 1
        edge[-1] += 2
        inner = edge == 0
        whole = lambda v: pa.array(np.full(n, v), mask=inner)
        columns = [table.column(c) for c in names]
        columns += [
            pa.array((at - ones[at])[group]), pa.array(ones[at][group]),
            pa.array(np.diff(np.concatenate([at, [n]]))[group] == 1),
            pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(group == 0),
            pa.array(group == group[-1]), pa.array(edge), whole(n - int(ones[-1])), whole(int(ones[-1])),
        ]
        columns += [pc.if_else(pa.array(~inner), table.column(k), pa.scalar(None, table.column(k).type)) for k in keys]
        for batch in pa.table(columns, names=want.names).to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([batch.column(k).cast(f.type) for k, f in enumerate(want)], schema=want)

    local = staged(mapped(dealt, count, schema), "suffix-order")
    ends_of = bounded_rows(
        local.where("edge > 0").select("part", "edge", "before0", "before1", "n0", "n1", *[f.name for f in ends]),
        2 * MOST_PARTITIONS,
    )
    key_of_end = lambda r: tuple(r[f.name] for f in ends)
    first = {r["part"]: key_of_end(r) for r in ends_of if r["edge"] & 1}
    final = {r["part"]: r for r in ends_of if r["edge"] & 2}
    order = sorted(first)
    offsets = []
    total0 = total1 = 0
    tail, tail0, tail1 = None, 0, 0  # the key that ended the partitions so far, and its rows
    for k, part in enumerate(order):
        p = final[part]
        last_key = key_of_end(p)
        goes_on = first[part] == tail
        # A key that goes on in the next partition is not alone; its last row cannot know.
        more = k + 1 < len(order) and first[order[k + 1]] == last_key
        offsets.append((part, total0, total1, tail0 if goes_on else 0, tail1 if goes_on else 0, more))
        within0, within1 = p["n0"] - p["before0"], p["n1"] - p["before1"]
        single = goes_on and first[part] == last_key
        tail0, tail1 = (tail0 + within0, tail1 + within1) if single else (within0, within1)
        tail = last_key
        total0, total1 = total0 + p["n0"], total1 + p["n1"]
    moved = rows.sparkSession.createDataFrame(
        offsets, "part int, off0 bigint, off1 bigint, tail0 bigint, tail1 bigint, more boolean"
    )
    out = local.join(F.broadcast(moved), "part")
    first, last = F.col("part_first"), F.col("part_last")
    return out.select(
        *names,
        (F.col("before0") + F.col("off0") - F.when(first, F.col("tail0")).otherwise(0)).alias("before0"),
        (F.col("before1") + F.col("off1") - F.when(first, F.col("tail1")).otherwise(0)).alias("before1"),
        (F.col("alone") & ~(first & ((F.col("tail0") + F.col("tail1")) > 0)) & ~(last & F.col("more"))).alias("alone"),
    )


class Flat:
    """The strings of a batch, end to end: symbols, and for each its string, place and what follows."""

    def __init__(self, batch: pa.RecordBatch):
        syms = column_of(batch, "syms")
        lengths = syms.value_lengths().to_numpy()
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.syms = syms.flatten().to_numpy()
        self.sizes = column_of(batch, "sizes").flatten().to_numpy().astype(np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.seq = column_of(batch, "seq").to_numpy()[self.owner] if len(lengths) else np.zeros(0, np.int64)
        self.i = np.arange(len(self.syms)) - self.starts[self.owner]
        self.left = lengths[self.owner] - self.i  # symbols from here to the end of the string
        self.weight = np.concatenate([[0], np.cumsum(self.sizes)])

    def after(self, values: np.ndarray, k: int) -> np.ndarray:
        """Values ``k`` places on, 0 past the end of the string."""
        moved = np.concatenate([values[k:], np.zeros(min(k, len(values)), values.dtype)])
        return np.where(self.left > k, moved, 0)


def sampled_triples(seqs: DataFrame) -> DataFrame:
    """(seq, i, a to f, size, cover, kind): triples at places 1 and 2 modulo 3; 0 past the end, size -1 there.

    A triple of less than ``NEED`` bytes goes on to the next one (d, e, f, else 0), which spares most
    strings the recursion; ``cover`` is the size of what is named, -1 if it reaches the end.
    """

    def job(batch: pa.RecordBatch):
        f = Flat(batch)
        at = np.flatnonzero(f.i % 3 != 0)
        end = np.minimum(np.arange(len(f.syms)) + 3, len(f.syms))
        size = np.where(f.left >= 3, f.weight[end] - f.weight[:-1], -1)
        short = (size >= 0) & (size < NEED)
        twice = np.where(f.left >= 6, f.weight[np.minimum(end + 3, len(f.syms))] - f.weight[:-1], -1)
        more = {c: np.where(short, f.after(f.syms, k), 0)[at] for k, c in ((3, "d"), (4, "e"), (5, "f"))}
        return {
            "seq": f.seq[at], "i": f.i[at], "a": f.syms[at], "b": f.after(f.syms, 1)[at],
            "c": f.after(f.syms, 2)[at], "size": size[at], "cover": np.where(short, twice, size)[at],
            "kind": np.zeros(len(at), np.int64),
        } | more

    symbols = ", ".join(f"{c} bigint" for c in "abcdef")
    return map_batches(seqs, f"seq bigint, i int, {symbols}, size int, cover int, kind int", job)


def place_lists(rows: DataFrame, values: list[str]) -> DataFrame:
    """Values of the places of each string, in any order (a string is one row)."""
    return rows.groupBy("seq").agg(F.collect_list(F.struct("i", *values)).alias("places"))


def ranked(seqs: DataFrame, depth: int = 0) -> DataFrame:
    """(seq, i, rank, prefix): how many suffixes are smaller, for every place of every string.

    ``seqs`` is (seq, syms, sizes), all symbols above 0. Suffixes that agree in ``NEED`` bytes may share a rank;
    ``prefix`` is the hash of the symbols by which these have gone by, null if the string ends before.
    """
    triples = counted_before(sampled_triples(seqs), [*"abcdef"], ["seq", "i"], ["seq", "i", "size", "cover"])
    named = staged(
        triples.select("seq", "i", (F.col("before0") + 1).alias("name"), "size",
                       (~F.col("alone") & F.col("cover").between(0, NEED - 1)).alias("unsure")),
        "suffix-names",
    )
    if named.where("unsure").isEmpty():
        samples = named.select("seq", "i", "name")
    else:
        # Strings with an unsure name recur: the names at places 1, then those at places 2.
        again = named.join(named.where("unsure").select("seq").distinct(), "seq", "left_semi")
        lists = again.withColumn("j", F.struct(F.col("i") % 3, "i")).groupBy("seq").agg(
            F.array_sort(F.collect_list(F.struct("j", "name", "size"))).alias("p")
        )
        split = F.expr("size(filter(p, x -> x.j.col1 = 1))")
        # An end mark keeps the two lists apart; no name is 0.
        def with_mark(field: str, mark):
            part = lambda k: F.transform(F.filter("p", lambda x: x["j"]["col1"] == k), lambda x: x[field])
            return F.concat(part(1), F.array(mark), part(2))

        inner = staged(
            lists.select("seq", with_mark("name", F.lit(0).cast("bigint")).alias("syms"),
                         with_mark("size", F.lit(0)).alias("sizes"), split.alias("n1")),
            "suffix-inner",
        )
        deeper = ranked(inner.select("seq", "syms", F.transform("sizes", lambda x: F.greatest(x, F.lit(1))).alias("sizes")),
                        depth + 1)
        at = deeper.join(inner.select("seq", "n1"), "seq").where("i <> n1").select(
            "seq", F.when(F.col("i") < F.col("n1"), 3 * F.col("i") + 1)
            .otherwise(3 * (F.col("i") - F.col("n1") - 1) + 2).cast("int").alias("i"),
            (F.col("rank") + 1).alias("sub"),
        )
        # Places of one name lie together among the inner suffixes, the first of them at ``base``.
        inner_order = staged(named.where("unsure").select("seq", "i", "name").join(at, ["seq", "i"]), "suffix-unsure")
        base = inner_order.groupBy("name").agg(F.min("sub").alias("base"))
        settled = inner_order.join(base, "name").select("seq", "i", (F.col("name") + F.col("sub") - F.col("base")).alias("name"))
        samples = staged(named.where("not unsure").select("seq", "i", "name").unionByName(settled), "suffix-samples")
    parts = seqs.select("seq", "syms", "sizes").join(place_lists(samples, ["name"]), "seq", "left")
    keyed = staged(merge_keys(parts), "suffix-merge")
    # The two sorts run as one, with the pair as the first key; what the earlier pair holds is taken off.
    counted = counted_before(
        keyed, ["pair", "s", "t", "n"], ["seq", "i"], ["pair", "kind", "seq", "i", "samples", "prefix"]
    )
    held = {r["kind"]: r["n"] for r in keyed.where("pair = 0").groupBy("kind").agg(F.count("*").alias("n")).collect()}

    def own(kind: int):
        return F.col(f"before{kind}") - F.when(F.col("pair") == 1, F.lit(held.get(kind, 0))).otherwise(0)

    # Kind 0 is place 0: a sample adds only those to the smaller samples, which its name tells; a place
    # 0 counts its own once (in the first pair) and the samples of either pair.
    share = F.when(F.col("kind") == 1, own(0) + F.col("samples")).when(F.col("pair") == 0, own(0) + own(1)).otherwise(own(1))
    shares = counted.select("seq", "i", "kind", share.alias("rank"), "prefix")
    both = shares.where("kind = 0").groupBy("seq", "i").agg(F.sum("rank").alias("rank"), F.max("prefix").alias("prefix"))
    return staged(shares.where("kind = 1").select("seq", "i", "rank", "prefix").unionByName(both), "suffix-ranks")


def merge_keys(parts: DataFrame) -> DataFrame:
    """(pair, kind, seq, i, s, t, n, samples, prefix): the keys of the two sorts that merge all suffixes.

    ``samples`` are the samples before a sample; ``prefix`` is told in the first row of a place.
    """

    def job(batch: pa.RecordBatch):
        f = Flat(batch)
        places = column_of(batch, "places")
        name = np.zeros(len(f.syms), np.int64)
        flat = places.flatten()
        counts = places.value_lengths().fill_null(0).to_numpy()
        at = np.repeat(f.starts[:-1], counts) + flat.field(0).to_numpy()
        name[at] = flat.field(1).to_numpy()
        long, prefix = prefixes(f)
        none, kind = np.zeros(len(f.syms), np.int64), f.i % 3
        one = (f.syms, none, f.after(name, 1))
        two = (f.syms, f.after(f.syms, 1), f.after(name, 2))
        out: list[list[np.ndarray]] = [[] for _ in range(10)]
        for pair, second, keys in ((0, 1, one), (1, 2, two)):
            rows = np.flatnonzero((kind == 0) | (kind == second))
            sample = kind[rows] == second
            told = long[rows] & (sample | (pair == 0))
            columns = (np.full(len(rows), pair), sample.astype(np.int64), f.seq[rows], f.i[rows],
                       np.where(sample, name[rows] - 1, 0), prefix[rows], told)
            for held, v in zip(out, (*columns, *(k[rows] for k in keys))):
                held.append(v)
        names = ("pair", "kind", "seq", "i", "samples", "prefix", "told", "s", "t", "n")
        done = {k: np.concatenate(v) for k, v in zip(names, out)}
        return done | {"prefix": pa.array(done["prefix"], mask=~done.pop("told"))}

    schema = "pair int, kind int, seq bigint, i int, s bigint, t bigint, n bigint, samples bigint, prefix bigint"
    return map_batches(parts, schema, job)


def prefixes(f: Flat) -> tuple[np.ndarray, np.ndarray]:
    """For each place whether ``NEED`` bytes follow in its string, and the hash of the symbols by which they have gone by."""
    sums = prefix_values(f.syms)
    end = np.searchsorted(f.weight, f.weight[:-1] + NEED)
    at = np.arange(len(f.syms))
    long = end <= at + f.left
    end = np.where(long, end, at)
    back = shingles.powers(shingles._INVERSE, len(sums) + 1)
    key = shingles.mix((sums[end] - sums[:-1]) * back[: len(at)] + (end - at).astype(np.uint64))
    return long, key.view(np.int64)


def candidates(runs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(tid, anchors): anchors whose suffix shares ``NEED`` bytes with a neighbour in suffix order."""

    rows = ranks.where("prefix is not null")
    dealt = rows.repartitionByRange("rank", "seq", "i").sortWithinPartitions("rank", "seq", "i")
    schema = "seq bigint, i int, prefix bigint, near boolean, part int, edge int"
    want = to_arrow_schema(T.StructType.fromDDL(schema))

    def compare(batches):
        from pyspark import TaskContext

        table = whole_partition(batches)
        if table is None:
            return
        n = table.num_rows
        p = table.column("prefix").to_numpy()
        same = p[1:] == p[:-1]
        near = np.zeros(n, bool)
        near[1:] |= same
        near[:-1] |= same
        edge = np.zeros(n, np.int32)
        edge[0] += 1
        edge[-1] += 2
        at = np.flatnonzero(near | (edge > 0))
        yield from pa.table(
            [table.column("seq").take(pa.array(at)), table.column("i").take(pa.array(at)), pa.array(p[at]), pa.array(near[at]),
             pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)), pa.array(edge[at])], schema=want,
        ).to_batches(max_chunksize=50_000)

    bounded_batches(runs.sparkSession)
    compared = staged(mapped(dealt, compare, schema), "suffix-neighbours")
    ends = bounded_rows(compared.where("edge > 0").select("part", "edge", "prefix"), 2 * MOST_PARTITIONS)
    ends = sorted(ends, key=lambda r: (r["part"], r["edge"]))
    first = {r["part"]: r["prefix"] for r in ends if r["edge"] & 1}
    last = {r["part"]: r["prefix"] for r in ends if r["edge"] & 2}
    order = sorted(first)
    joined = [(a, 2) for a, b in zip(order, order[1:]) if last[a] == first[b]]
    joined += [(b, 1) for a, b in zip(order, order[1:]) if last[a] == first[b]]
    across = runs.sparkSession.createDataFrame(joined, "part int, side int")
    found = compared.where("near").select("seq", "i").unionByName(
        compared.where("edge > 0 and not near").join(F.broadcast(across), "part")
        .where(F.col("edge").bitwiseAND(F.col("side")) > 0).select("seq", "i")
    )
    lists = found.groupBy("seq").agg(F.collect_set("i").alias("hits"))
    anchors = lists.join(runs.select("seq", "tid", "starts"), "seq").select(
        "tid", F.explode(F.transform("hits", lambda k: F.element_at("starts", k + 1))).alias("anchor")
    )
    return anchors.groupBy("tid").agg(F.collect_set("anchor").alias("anchors"))


def repeated_grams(texts: DataFrame) -> DataFrame:
    """(tid, word_anchors): anchors among the words whose words stand elsewhere too."""
    flat = texts.select("tid", F.inline(F.arrays_zip("places", "grams"))).toDF("tid", "place", "gram")
    often = staged(
        flat.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "suffix-grams"
    )
    return flat.join(often, "gram").groupBy("tid").agg(F.collect_list("place").alias("word_anchors"))


def prefix_values(syms: np.ndarray) -> np.ndarray:
    spread = shingles.mix(syms.view(np.uint64)) * shingles.powers(shingles._BASE, len(syms))
    return np.concatenate([[np.uint64(0)], np.cumsum(spread)])


def windows(texts: DataFrame, buckets: int, told: bool) -> DataFrame:
    """Candidate strings of (block, tid, text, anchors, word_anchors), block by block.

    (block, bucket, data) rows hold the hashes of one bucket, in the order of the block;
    with ``told`` the rows are (block, -1, data) and say which strings a block holds, and in which
    bucket each is. Both are worked out from the text, as the hashes are large to keep.
    """
    import io

    def blocks(batches):
        block, held = None, []
        for batch in batches:
            for row in zip(
                column_of(batch, "block").to_pylist(), column_of(batch, "tid").to_pylist(), raws_of(batch),
                column_of(batch, "anchors").to_pylist(), column_of(batch, "word_anchors").to_pylist(),
            ):
                if row[0] != block:
                    if held:
                        yield block, held
                    block, held = row[0], []
                held.append(row[1:])
        if held:
            yield block, held

    shift = np.uint64(64 - buckets.bit_length() + 1)
    # Numbers of at most 16 bits are sorted by counting.
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for block, rows in blocks(batches):
            # Texts are told as strings of bytes first, then as strings of words.
            tids, texts_at, starts, hashes = [], [], [], []
            matched = [row for row in rows if row[2]]
            for a, b in shingles.groups([row[1] for row in matched], GROUP_BYTES):
                whole = Bytes([raw for _, raw, _, _ in matched[a:b]], 23)
                wanted = np.zeros(whole.begin[-1], bool)
                for begin, (tid, raw, anchors, _) in zip(whole.begin, matched[a:b]):
                    wanted[begin + np.array(anchors)] = True
                    i = np.flatnonzero(wanted[whole.first[begin:begin + len(raw) - LENGTH + 1]])
                    texts_at.append(np.full(len(i), len(tids), np.int32))
                    tids.append(tid)
                    starts.append(i.astype(np.int32))
                    hashes.append(span_hashes(whole.sums, begin + i, begin + i + LENGTH))
            of_bytes, worded = len(tids), [row for row in rows if row[3]]
            for a, b in shingles.groups([row[1] for row in worded], GROUP_BYTES):
                words = Words([raw for _, raw, _, _ in worded[a:b]])
                wanted = np.zeros(len(words.hashes), bool)
                for begin, (_, _, _, places) in zip(words.begin, worded[a:b]):
                    wanted[begin + np.array(places)] = True
                run = words.run[wanted[words.anchor]]
                texts_at.append((len(tids) + words.owner[run]).astype(np.int32))
                tids += [tid for tid, _, _, _ in worded[a:b]]
                starts.append((run - words.begin[words.owner[run]]).astype(np.int32))
                hashes.append(words.run_hashes(run))
            h = np.concatenate(hashes)
            bucket = (h >> shift).astype(kind)
            if told:
                at, start = np.concatenate(texts_at), np.concatenate(starts)
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)])[: len(at)])
                kept = io.BytesIO()
                np.savez(  # buckets of hashes look random: packing them takes long and saves little
                    kept, tids=np.array(tids, np.int64), of_bytes=of_bytes, at=at[cut], start=start[cut],
                    length=np.diff(np.concatenate([cut, [len(at)]])), bucket=bucket,
                )
                out = [(-1, kept.getvalue())]
            else:
                order = np.argsort(bucket, kind="stable")
                bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
                out = [(int(b), h[order[bounds[b]:bounds[b + 1]]].astype("<u8").tobytes()) for b in np.unique(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(out), pa.int64()), pa.array([r[0] for r in out], pa.int32()),
                 pa.array([r[1] for r in out], pa.binary())], names=["block", "bucket", "data"],
            )

    bounded_batches(texts.sparkSession)
    dealt = texts.repartition("block").sortWithinPartitions("block", "tid")
    return mapped(dealt, run, "block bigint, bucket int, data binary")


def repeated_bits(hashes: DataFrame) -> DataFrame:
    """(block, bucket, bits): for each hash of a row whether it stands twice in its bucket."""

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for block, b, data in zip(*(column_of(batch, c).to_pylist() for c in ("block", "bucket", "data"))):
                if b != bucket:
                    yield from answered(bucket, held)
                    bucket, held = b, []
                held.append((block, np.frombuffer(data, "<u8")))
        yield from answered(bucket, held)

    def answered(bucket, held):
        if not held:
            return
        every = np.sort(np.concatenate([h for _, h in held]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        blocks, bits = [], []
        for block, h in held:
            at = np.searchsorted(twice, h)
            hit = np.zeros(len(h), bool)
            ok = at < len(twice)
            hit[ok] = twice[at[ok]] == h[ok]
            blocks.append(block)
            bits.append(np.packbits(hit).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array(bits, pa.binary())],
            names=["block", "bucket", "bits"],
        )

    bounded_batches(hashes.sparkSession)
    dealt = hashes.repartition("bucket").sortWithinPartitions("bucket")
    return mapped(dealt, run, "block bigint, bucket int, bits binary")


def removed_spans(told: DataFrame, bits: DataFrame) -> DataFrame:
    """(tid, begins, ends, first, last): the maximal removed runs of each text, of bytes and of words."""
    answers = bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))

    def job(batch: pa.RecordBatch):
        import io

        out: dict[str, list] = {"tid": [], "begins": [], "ends": [], "first": [], "last": []}
        for data, answers in zip(column_of(batch, "data").to_pylist(), column_of(batch, "answers").to_pylist()):
            block = np.load(io.BytesIO(data))
            bucket = block["bucket"]
            hit = np.zeros(len(bucket), bool)
            order = np.argsort(bucket, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket))])
            for answer in answers or []:
                a, b = bounds[answer["bucket"]:answer["bucket"] + 2]
                hit[order[a:b]] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
            many = block["length"]
            at = np.repeat(block["at"], many)
            first = np.repeat(block["start"] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(many) else at
            start = first + np.arange(len(at))
            at, start = at[hit], start[hit]
            if not len(at):
                continue
            length = np.where(at < block["of_bytes"], LENGTH, WORDS)
            fresh = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) > length[1:])])
            cut = np.flatnonzero(fresh)
            last = np.concatenate([cut[1:], [len(at)]]) - 1
            begin, end = start[cut], start[last] + length[last]
            owner = at[cut]
            edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            found: dict[int, dict[str, np.ndarray]] = {}
            for a, b in zip(edges, [*edges[1:], len(owner)]):
                names = ("begins", "ends") if owner[a] < block["of_bytes"] else ("first", "last")
                found.setdefault(int(block["tids"][owner[a]]), {}).update(zip(names, (begin[a:b], end[a:b])))
            for tid, spans in found.items():
                out["tid"].append(tid)
                for name in ("begins", "ends", "first", "last"):
                    out[name].append(spans.get(name))
        return out

    joined = told.join(answers, "block", "left").select("data", "answers")
    lists = ", ".join(f"{c} array<int>" for c in ("begins", "ends", "first", "last"))
    return map_batches(joined, f"tid bigint, {lists}", job)


def repeats(docs: DataFrame, words: bool = False) -> DataFrame:
    """(key, begins, ends, first, last): what to remove of each distinct text that loses something.

    Bytes from ``begins`` to ``ends`` and, with ``words``, words from ``first`` to ``last``, else null; a text with
    copies loses all of it that is long enough.
    """
    lean_shuffles(docs.sparkSession)
    docs = docs.select("text", key_of("text").alias("key"))
    texts = staged(chunked(docs, words), "suffix-texts")
    runs = staged(repeated_runs(texts.select("tid", "starts", "hashes")), "suffix-runs")
    found = candidates(runs, ranked(runs.select("seq", "syms", "sizes")))
    if words:
        found = found.join(repeated_grams(texts.select("tid", "places", "grams")), "tid", "full")
    else:
        found = found.withColumn("word_anchors", F.lit(None).cast("array<int>"))
    places = texts.select("tid", "key").join(found, "tid")
    once = docs.groupBy("key").agg(F.first("text").alias("text"))
    whole = staged(once.join(places, "key").select("tid", "text", "anchors", "word_anchors"), "suffix-windows")
    many = lambda c: F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0))
    size = whole.agg(
        (many(F.coalesce("anchors", F.array())) * WINDOW + many(F.coalesce("word_anchors", F.array())) * WORD_WINDOW).alias("strings"),
        F.sum(F.octet_length("text").cast("long")).alias("bytes"),
    ).first()
    buckets = 64
    while buckets * BUCKET_ROWS < size["strings"] // 2:
        buckets *= 2
    block = F.pmod(F.xxhash64("tid"), F.lit(1 + (size["bytes"] or 0) // BLOCK_BYTES))
    blocked = whole.select(block.alias("block"), "tid", "text", "anchors", "word_anchors")
    bits = staged(repeated_bits(windows(blocked, buckets, told=False)), "suffix-bits")
    spans = removed_spans(windows(blocked, buckets, told=True), bits)

    def or_whole(begin: str, end: str, size, least: int):
        whole = (F.col("copies") > 1) & (size >= least)
        return [F.when(whole, F.array(at)).otherwise(F.col(c)).alias(c) for c, at in ((begin, F.lit(0)), (end, size))]

    every = texts.join(spans, "tid", "left").select(
        "key", *or_whole("begins", "ends", F.col("units"), LENGTH),
        *or_whole("first", "last", F.col("n_words") if words else F.lit(0), WORDS),
    )
    return staged(every.where("begins is not null or first is not null"), "suffix-spans")


def joined_spans(raw: bytes, begins: list, ends: list, first: list, last: list) -> tuple[list, list]:
    """Spans of bytes, and of words from ``first`` to before ``last`` each, as maximal spans of bytes."""
    start, end = word_bounds(raw)
    spans = sorted([*zip(begins, ends), *((int(start[a]), int(end[b - 1])) for a, b in zip(first, last))])
    out = [[], []]
    for b, e in spans:
        if out[1] and b <= out[1][-1]:
            out[1][-1] = max(out[1][-1], e)
        else:
            out[0].append(b)
            out[1].append(e)
    return out[0], out[1]


def without_repeats(
    docs: DataFrame, keep: list[str], shape: Callable[[dict[str, list]], dict[str, list]] | None = None,
    shaped: str = "kept binary, begins array<int>, ends array<int>", words: bool = False,
) -> DataFrame:
    """Columns ``keep`` of the documents with ``kept`` (the bytes left), ``begins`` and ``ends``.

    ``shape`` makes columns ``shaped`` of these in the same map: a map of its own would take a second
    Python worker for each task. With ``words`` repeated runs of ``WORDS`` words go as well, however short; ``shape``
    is then also told what goes without them, as ``byte_kept``, ``byte_begins`` and ``byte_ends``.
    """
    spans = ["_begins", "_ends", "_first", "_last"]
    found = repeats(docs, words).toDF("_key", *spans)
    fields = [f for f in docs.schema if f.name in keep]
    names = [f.name for f in fields]
    slim = docs.select(*[F.col(f"`{n}`") for n in names], F.col("text").alias("_text"), key_of("text").alias("_key"))
    joined = slim.join(found, "_key", "left").drop("_key")
    out_schema = T.StructType(fields + T.StructType.fromDDL(shaped).fields)

    def left(raw: bytes, begins: list, ends: list) -> bytes:
        return b"".join(raw[x:y] for x, y in zip([0, *ends], [*begins, len(raw)])) if begins else raw

    def cut(batch: pa.RecordBatch):
        out = {n: batch.column(k) for k, n in enumerate(names)}
        columns = ("kept", "begins", "ends", "byte_kept", "byte_begins", "byte_ends")
        found: dict[str, list] = {c: [] for c in columns}
        for raw, b, e, first, last in zip(raws_of(batch, "_text"), *(column_of(batch, c).to_pylist() for c in spans)):
            plain = both = (left(raw, b or [], e or []), b or [], e or [])
            if first:
                b, e = joined_spans(raw, b or [], e or [], first, last)
                both = (left(raw, b, e), b, e)
            for c, value in zip(columns, (*both, *plain)):
                found[c].append(value)
        return out | (shape(found) if shape else found)

    return map_batches(joined, out_schema, cut)
