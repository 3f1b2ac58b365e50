"""Near duplicates against all pairs, and components against a plain union-find."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import links, neardup, shingles


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(1000 + k, 1001 + k) for k in range(60)]
    pairs += [(2000, 2001 + k) for k in range(50)]
    got = dict(links.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    pairs = [(a, b) for a, b in pairs if a != b]
    assert got == union(pairs, {x for p in pairs for x in p})


def test_shingles_equal_plain_ones():
    r = random.Random(1)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 30))) + r.choice(["", " ", "\n"]) for _ in range(200)]
    hashes, counts = shingles.shingle_hashes([t.encode() for t in texts])
    at, seen = 0, {}
    for text, n in zip(texts, counts):
        w = text.split()
        plain = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
        assert len(plain) == n
        for s, h in zip(plain, hashes[at:at + n]):
            assert seen.setdefault(s, int(h)) == int(h)
        at += n
    assert len(set(seen.values())) == len(seen)


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    sampler = neardup.Sampler()
    same = total = 0
    for _ in range(60):
        h = np.sort(rng.integers(0, 1 << 53, 400, dtype=np.uint64))
        w = rng.integers(1, 60, 400)
        a, b = h[:300], h[100:]
        s = [sampler.samples(np.zeros(len(x), int), x, np.log(v).astype(np.float32), 1)[0]
             for x, v in ((a, w[:300]), (b, w[100:]))]
        same += (s[0] == s[1]).sum()
        total += neardup.SAMPLES * w[100:300].sum() / w.sum()
    assert abs(same - total) < 0.05 * 60 * neardup.SAMPLES


def near_copies(r, n_base=25):
    vocabulary = ["".join(r.choice("bcdfgaeiou") for _ in range(6)) for _ in range(3000)]
    texts = []
    for _ in range(n_base):
        base = [r.choice(vocabulary) for _ in range(r.choice((60, 150, 400)))]
        texts.append(" ".join(base))
        for _ in range(r.choice((0, 1, 5, 20))):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
    return texts


def test_classes_equal_all_pairs(documents):
    r = random.Random(6)
    texts = near_copies(r) + [None, "", " \n", "only four words here", "only FOUR  words here", "a b", "c d"]
    texts += ["long " * 20000, "long " * 20001]
    docs = documents(texts).withColumn("label", F.lit("clash"))
    idf, n = neardup.frequency_table(docs)
    assert n == len(texts)
    raws = [(t or "").lower().encode() for t in texts]
    pairs = []
    for i in range(len(raws)):
        for j in range(i):
            if raws[i].split() and raws[i].split() == raws[j].split():
                pairs.append((i, j))
            elif raws[i] and raws[j] and neardup.jaccard(raws[i], raws[j], idf) >= 0.8:
                pairs.append((i, j))
    want = union(pairs, range(len(texts)))
    got = {x["doc_id"]: x["class_id"] for x in neardup.named(neardup.classes(docs)).collect()}
    assert got == want
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    wordless = {k for k, t in enumerate(texts) if not (t or "").split()}
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()) | wordless)


def test_split_buckets_stay_one_class(documents, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 6)
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        w = list(base)
        w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    got = neardup.named(neardup.classes(documents(texts))).collect()
    assert {x["class_id"] for x in got} == {0} and all(x["class_size"] == 120 for x in got)


def plain_classes(texts, idf):
    """Classes of all pairs by exact similarity."""
    raws = [t.lower().encode() for t in texts]
    pairs = [(i, j) for i in range(len(raws)) for j in range(i) if neardup.jaccard(raws[i], raws[j], idf) >= 0.8]
    return pairs, union(pairs, range(len(texts)))


def edited(r, base, n):
    """``base`` with ``n`` words changed, far enough apart that each changes five shingles."""
    w = list(base)
    for k in r.sample(range(len(w) // 6), n):
        w[6 * k + 3] = f"x{r.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [8, 200])
def test_hub_with_more_spokes_than_ten_groups(documents, monkeypatch, block):
    monkeypatch.setattr(neardup, "GROUP", 6)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)] + [edited(r, base, 7) for _ in range(90)]
    docs = documents(texts)
    idf, _ = neardup.frequency_table(docs)
    pairs, want = plain_classes(texts, idf)
    assert len(pairs) == 90 and all(j == 0 for _, j in pairs)  # only the hub links the spokes
    got = {x["doc_id"]: x["class_id"] for x in neardup.named(neardup.classes(docs)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [9, 200])
def test_pairs_among_many_texts_just_under_the_threshold(documents, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    put_out, work = [], neardup.joining_links

    def counted(jobs, *more):
        out = work(jobs, *more)
        put_out.append((jobs.select(*neardup.JOB, "label").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "joining_links", counted)
    r = random.Random(9)
    page = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(100):
        own = [f"t{r.randrange(10**9)}" for _ in range(42)]
        texts.append(" ".join(page + own))
        if k % 10 == 0:  # a pair of its own, a little nearer than the page makes all others
            texts.append(" ".join(page + own[:20] + [f"t{r.randrange(10**9)}" for _ in range(22)]))
    docs = documents(texts)
    idf, _ = neardup.frequency_table(docs)
    pairs, want = plain_classes(texts, idf)
    assert len(pairs) == 10
    got = {x["doc_id"]: x["class_id"] for x in neardup.named(neardup.classes(docs)).collect()}
    assert got == want
    # Thousands of pairs are looked at; what leaves the jobs is a part of their classes.
    assert all(links < classes for classes, links in put_out)


def test_weights_equal_single_comparisons():
    r = random.Random(4)
    raws = [" ".join(r.choice("abcde") for _ in range(r.randrange(0, 60))).encode() for _ in range(40)]
    idf = np.random.default_rng(0).integers(100, 151, 1 << neardup.SLOT_BITS).astype(np.uint8)
    weights = neardup.Weights(raws, idf)
    for i in range(40):
        js = np.array([j for j in range(40) if j != i])
        want = np.array([neardup.jaccard(raws[i], raws[j], idf) for j in js])
        assert np.allclose(weights.similarity(i, js), want)
        assert weights.may_reach(i, js, 0.8)[want >= 0.8].all()


def test_columns_that_clash(documents):
    docs = documents(["one two three four five six", "one two three four five six", "", "other words that stand alone here"])
    for c in ("node", "_node", "_id", "_n", "_rows", "label", "bands"):
        docs = docs.withColumn(c, F.lit("x"))
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_no_documents_and_repeated_rows(documents):
    assert neardup.named(neardup.classes(documents(["x"]).limit(0))).count() == 0
    rows = [(5, "same words in every row of these"), (5, "same words in every row of these"), (None, "same words in every row of these")]
    docs = documents(rows)
    assert [x["class_size"] for x in neardup.named(neardup.classes(docs)).collect()] == [3, 3, 3]
    assert [x["doc_id"] for x in neardup.one_of_each(docs).collect()] == [5]
