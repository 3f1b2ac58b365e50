"""Mixing sources to target weights by budgets passed down a tree.

Columns of the documents name the levels of the tree, such as domain, language and source.
A budget of tokens is split among the children of a node by their weights; what a child
cannot use (all its leaves' tokens in all allowed epochs) goes to its siblings first, by
their weights, and only what a whole subtree cannot use reaches the siblings of its
ancestors. A leaf repeats its documents for as many whole epochs as its budget holds, and
then takes the prefix of one more epoch. Every epoch has its own seeded order of the
documents (a hash); the prefix ends before the first hash whose documents go over the budget.

The prefix is found without ordering a leaf: token sums by the leading bits of the
hash name the bucket where the budget ends, then sums by the next bits within that
bucket, and only the rows of the last bucket are added up one by one.

Defined cases: a null text has 0 tokens, and such documents belong to every epoch prefix
that reaches their hash; null level values are a node of their own; weights of absent nodes
are passed to the present ones; nodes without a weight get the default; a negative weight is
an error; rows that agree in id and text share a hash, and are taken or left together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from stationlake.llm.frames import bounded_rows
from stationlake.sources.shared import staged

#: Most leaves of a tree: they are the configured mixture, not the data.
MOST_LEAVES = 50_000
BITS = 12

Path = tuple[str | None, ...]


def word_tokens(text: str = "text") -> Column:
    """Tokens as runs of characters that are not white space; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


@dataclass
class Node:
    children: dict[str | None, Node]
    supply: int = 0


def tree_of(leaves: Mapping[Path, int]) -> Node:
    root = Node({})
    for path, tokens in leaves.items():
        node = root
        node.supply += tokens
        for step in path:
            node = node.children.setdefault(step, Node({}))
            node.supply += tokens
    return root


def shares(total: int, weights: Sequence[float], capacities: Sequence[int]) -> list[int]:
    """Split ``total`` by weight, no more than its capacity to each; whole numbers.

    What a full one leaves goes to the others by their weights, until all is given or all
    are full. Fractions go to the largest remainders, the first of equals.
    """
    given = [0] * len(weights)
    left = min(total, sum(c for w, c in zip(weights, capacities) if w > 0))
    open_ = [k for k, w in enumerate(weights) if w > 0 and capacities[k] > 0]
    while left and open_:
        whole = sum(weights[k] for k in open_)
        wanted = {k: left * weights[k] / whole for k in open_}
        full = [k for k in open_ if wanted[k] >= capacities[k]]
        if full:
            for k in full:
                given[k] = capacities[k]
                left -= capacities[k]
            open_ = [k for k in open_ if k not in full]
            continue
        for k in open_:
            given[k] = int(wanted[k])
        rest = left - sum(given[k] for k in open_)
        for k in sorted(open_, key=lambda k: (int(wanted[k]) - wanted[k], k)):
            if rest <= 0:
                break
            if given[k] < capacities[k]:
                given[k] += 1
                rest -= 1
        break
    return given


def budgets(
    leaves: Mapping[Path, int], weights: Mapping[Path, float], total: int, max_epochs: int,
    default: float = 1.0,
) -> dict[Path, int]:
    """Tokens for each leaf of the tree: its part of ``total``."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    out: dict[Path, int] = {}

    def usable(path: Path, node: Node) -> int:
        """What a subtree can take; nothing below a weight of zero."""
        if not node.children:
            return node.supply * max_epochs
        return sum(
            usable(path + (k,), c) for k, c in node.children.items() if weights.get(path + (k,), default) > 0
        )

    def give(path: Path, node: Node, amount: int) -> None:
        if not node.children:
            out[path] = amount
            return
        names = sorted(node.children, key=lambda k: (k is not None, k or ""))
        parts = shares(
            amount, [weights.get(path + (k,), default) for k in names],
            [usable(path + (k,), node.children[k]) for k in names],
        )
        for k, part in zip(names, parts):
            give(path + (k,), node.children[k], part)

    root = tree_of(leaves)
    if root.children:
        give((), root, total)
    return out


def same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & a[n].eqNullSafe(b[n])
    return condition


def plan(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[Path, float], total: int | None,
    max_epochs: int, seed: int, tokens: Column, default: float = 1.0,
) -> DataFrame:
    """One row a leaf: the levels, ``budget``, ``full`` epochs and the last hash of the next one.

    ``total`` of None is the number of tokens there are. ``last_hash`` is null where the
    further epoch takes nothing.
    """
    spark = docs.sparkSession
    levels = list(levels)
    sized = staged(docs.select(*levels, "doc_id", F.xxhash64("text").alias("text_hash"), tokens.alias("tokens")),
                   "mixing-sizes")
    leaf_rows = bounded_rows(sized.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), MOST_LEAVES)
    supply = {tuple(r[n] for n in levels): int(r["tokens"]) for r in leaf_rows}
    amounts = budgets(supply, weights, sum(supply.values()) if total is None else total, max_epochs, default)
    schema = T.StructType(
        [T.StructField(n, docs.schema[n].dataType) for n in levels]
        + T.StructType.fromDDL("leaf int, budget bigint, full int, rest bigint").fields
    )
    rows = []
    for k, (path, tokens_) in enumerate(supply.items()):
        budget = amounts.get(path, 0)
        full = min(budget // tokens_, max_epochs) if tokens_ else 0
        rest = budget - full * tokens_ if full < max_epochs else 0
        rows.append((*path, k, budget, int(full), int(rest)))
    leaves = spark.createDataFrame(rows, schema)

    epoch_rows = sized.join(F.broadcast(leaves), same(sized, leaves, levels)).where(F.col("rest") > 0)
    keyed = epoch_rows.select(
        "leaf", "tokens",
        F.xxhash64(F.lit(seed), F.col("full"), F.col("doc_id"), F.col("text_hash")).alias("hash"),
    )
    # Unsigned order of the leading bits is kept by shifting the sign away first.
    keyed = keyed.withColumns({
        "b1": F.shiftrightunsigned("hash", 64 - BITS),
        "b2": F.shiftrightunsigned(F.shiftleft("hash", BITS), 64 - BITS),
    })
    limits = leaves.where(F.col("rest") > 0).select("leaf", "rest")
    for step in ("b1", "b2"):
        near = keyed.join(F.broadcast(limits), "leaf")
        if step == "b2":
            near = near.where(F.col("b1") == F.col("cut_b1"))
        sums = near.groupBy("leaf", step).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
        so_far = F.sum("tokens").over(Window.partitionBy("leaf").orderBy(step))
        ends = (
            sums.withColumn("so_far", so_far).where(F.col("so_far") > F.col("rest")).groupBy("leaf")
            .agg(F.min_by(
                F.struct(F.col(step).alias("cut"), (F.col("rest") - F.col("so_far") + F.col("tokens")).alias("rest")),
                F.col(step),
            ).alias("end"))
        )
        before = [c for c in limits.columns if c.startswith("cut_")]
        found = ends.select("leaf", F.col("end.cut").alias(f"cut_{step}"), F.col("end.rest").alias("rest"))
        limits = staged(limits.select("leaf", *before).join(found, "leaf"), f"mixing-{step}")
    near = keyed.join(F.broadcast(limits), "leaf").where(
        (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2"))
    )
    sums = near.groupBy("leaf", "hash").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    # Within one bucket the leading bits agree, so the signed order is the unsigned one.
    so_far = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("hash"))
    first_over = (
        sums.withColumn("so_far", so_far).where(F.col("so_far") > F.col("rest"))
        .groupBy("leaf").agg(F.min("hash").alias("end_hash"))
    )
    return staged(leaves.join(first_over, "leaf", "left"), "mixing-plan")


def unsigned_before(a: Column, b: Column) -> Column:
    """a < b as unsigned 64-bit numbers."""
    return F.when((a < 0) == (b < 0), a < b).otherwise(b < 0)


def mixed(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[Path, float], total: int | None = None,
    max_epochs: int = 4, seed: int = 17, tokens: Column | None = None, default: float = 1.0,
) -> DataFrame:
    """``docs`` with a row for every epoch that takes a document, numbered from 0 in ``epoch``.

    One pass sizes the documents, one pass selects them; only sums and one row a leaf move.
    """
    docs = docs.drop("epoch") if "epoch" in docs.columns else docs
    leaves = plan(docs, levels, weights, total, max_epochs, seed, word_tokens() if tokens is None else tokens, default)
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    condition = F.lit(True)
    for n in levels:
        condition = condition & F.col(f"d.`{n}`").eqNullSafe(F.col(f"l.`{n}`"))
    joined = docs.alias("d").join(F.broadcast(leaves.alias("l")), condition)
    order = F.xxhash64(F.lit(seed), F.col("l.full"), F.col("d.doc_id"), F.xxhash64("d.text"))
    further = (F.col("l.rest") > 0) & (
        F.col("l.end_hash").isNull() | unsigned_before(order, F.col("l.end_hash"))
    )
    copies = F.col("l.full") + F.when(further, 1).otherwise(0)
    return joined.withColumn("_copies", copies).where(F.col("_copies") > 0).select(
        *own, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch")
    )
