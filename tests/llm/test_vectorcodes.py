"""Vector codes against plain rounds over all points, and the trees against their own rules."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from stationlake.llm import vectorcodes as vc


def plain_version(rows, parts=16, entries=64, rounds=2, by=256):
    """{(id, code, error, label_error)} as a sorted list, and the digest."""
    kept = [(i, [math.floor(by * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept.sort(key=order)
    if not kept:
        return [], None
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    bounds = vc.bounds_of(len(kept[0][1]), parts)
    cut = lambda v: [v[a:b] for a, b in bounds]
    pieces = [cut(r[1]) for r in kept]
    books = [[pieces[e][k] for e in range(min(entries, len(pieces)))] for k in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda k, p: min((distance(p, e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            held = {}
            for p in pieces:
                held.setdefault(near(k, p[k])[1], []).append(p[k])
            for j, members in held.items():
                books[k][j] = [sum(c) // len(members) for c in zip(*members)]
    found, by_label = [], {}
    for (i, _, label), p in zip(kept, pieces):
        best = [near(k, p[k]) for k in range(parts)]
        error = sum(d for d, _ in best)
        found.append([i, "".join(f"{j:02x}" for _, j in best), error, label])
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for k in books for e in k for x in e).encode()).hexdigest()
    return sorted(str((i, c, e, by_label[x])) for i, c, e, x in found), digest


def run(spark, rows, n=3, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(n)
    coded, books = vc.compressed(df, **more)
    got = vc.with_label_error(coded).collect()
    return sorted(str((g["vec_id"], g["codes"].hex(), g["error"], g["label_error"])) for g in got), books and books.digest()


def f32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("width", [16, 64, 37, 8])
def test_random_vectors_with_ties_and_copies(spark, width):
    r = random.Random(width)
    grid = [f32(r.randrange(-4, 5) / 256) for _ in range(7)]
    rows = [(k, [r.choice(grid) for _ in range(width)], k % 5 or None) for k in range(250)]
    rows += [(1000 + k, [f32(r.gauss(0, 0.3)) for _ in range(width)], r.choice([None, 1, 2])) for k in range(250)]
    rows += [(5000 + k, rows[400][1], 9) for k in range(200)]  # a hot vector
    assert run(spark, rows) == plain_version(rows)


def test_defined_cases(spark):
    r = random.Random(2)
    v = lambda: [f32(r.gauss(0, 1)) for _ in range(16)]
    a = v()
    rows = [(3, v(), 1), (3, v(), 1), (3, a, 1), (3, a, None), (None, v(), 2), (None, a, 2), (4, None, 1), (5, [None] * 16, 1),
            (6, [float("nan")] * 16, 1), (7, [float("inf")] * 16, 1), (8, [0.5] * 15, 1), (9, [], 1), (-2, v(), None)]
    assert run(spark, rows) == plain_version(rows)
    assert run(spark, []) == ([], None)
    assert run(spark, [(1, None, 1)]) == ([], None)
    assert run(spark, [(1, [], 1), (2, [], 1)])[0] == [str((k, "00" * 16, 0, 0)) for k in (1, 2)]


def test_components_too_large_for_a_long(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [3e38] * 16, 1)])


def test_other_parameters_and_clashing_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=12).astype(np.float32)], 1) for k in range(300)]
    assert run(spark, rows, parts=3, entries=200, rounds=4, by=1000.0) == plain_version(rows, 3, 200, 4, 1000)
    df = spark.createDataFrame(rows, "whole long, kept array<float>, coded int").withColumnRenamed("kept", "codes")
    coded, _ = vc.compressed(df, id_column="whole", vector="codes", label="coded")
    assert coded.columns == ["whole", "coded", "codes", "error"] and coded.count() == 300


def test_trees_are_cover_trees_and_spare_comparisons(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (20, 4))
    points = np.repeat(centres, 100, axis=0) + rng.integers(-6, 7, (2000, 4))
    whole = np.concatenate([points, points[rng.permutation(2000)]], axis=1)
    block = vc.Block(whole, 2)
    t = block.trees
    assert sorted(t.order.tolist()) == list(range(4000))
    for k in range(len(t.start)):
        run = block.ordered[t.start[k]:t.end[k]]
        d = ((run - run[0]) ** 2).sum(1)
        assert d.max() == t.reach[k]
        if t.children[k]:
            own = range(t.child[k], t.child[k] + t.children[k])
            assert [t.start[c] for c in own] == [t.start[k], *[t.end[c] for c in own][:-1]] and t.end[own[-1]] == t.end[k]
            cover = 4 ** (math.ceil(math.log2(t.reach[k]) / 2) - 1) if t.reach[k] > 1 else 0
            heads = block.ordered[[t.start[c] for c in own]]
            apart = ((heads[:, None] - heads[None]) ** 2).sum(2)[np.triu_indices(len(heads), 1)]
            assert all(t.reach[c] <= cover for c in own) and (not len(apart) or apart.min() > cover)
            assert cover < t.reach[k]
    compared = []
    whole_work = vc.Block._distances
    monkeypatch.setattr(vc.Block, "_distances", lambda self, place, *a: compared.append(len(place)) or whole_work(self, place, *a))
    books = np.stack([centres, centres])
    count, added = block.sums(books)
    assert count.sum() == 4000 and sum(compared) < 0.2 * 4000 * 20
    near = ((block.points[:2000, None] - books[0][None]) ** 2).sum(2).argmin(1)
    assert (np.bincount(near, minlength=20) == count[0]).all()
    assert (np.stack([block.points[:2000][near == e].sum(0) for e in range(20)]) == added[0]).all()


def test_query_equals_sql(spark):
    from stationlake.llm.queries import ORACLES, QUERIES
    from tests import compare

    folder = "/root/testdata/sf0.001"
    problem, n = compare.difference(
        spark, compare.connect(folder), QUERIES["op11_vector_codes"], ORACLES["op11_vector_codes"], folder
    )
    assert problem is None and n > 0
