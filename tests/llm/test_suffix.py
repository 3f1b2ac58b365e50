"""Repeated passages against all 400-byte strings, suffix ranks against plain sorting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import suffix


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length - len(r) - 1 if i + length > len(r) else i + length] -= 1
        hit = np.concatenate([[0], np.cumsum(gone)[:-1] > 0, [0]]).astype(int)
        edges = np.diff(hit)
        begins, ends = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
        kept = b"".join(r[a:b] for a, b in zip([0, *ends], [*begins, len(r)]))
        out.append((kept, begins, ends))
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 8))) for _ in range(n))


def passages(r):
    shared = [words(r, k) for k in (70, 75, 80, 90, 120, 200, 400)]
    texts = [words(r, r.randint(20, 300)) for _ in range(20)]
    for k in range(30):
        texts.append(words(r, r.randint(0, 60)) + " " + r.choice(shared) + " " + words(r, r.randint(0, 60)))
    base = words(r, 400)
    for _ in range(12):  # near copies with a few words changed
        w = base.split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
        texts.append(" ".join(w))
    exact = words(r, 100)[:460]
    for extra in (400, 401, 399, 410, 455):  # matches of nearly the least length
        texts += [words(r, 30) + exact[:extra] + words(r, 30), words(r, 20) + "Z" + exact[:extra] + "Q" + words(r, 9)]
    texts += [None, "", "x" * 399, "x" * 400, "y" * 401, "ab" * 1000, "Shti " * 700, "Shti " * 90 + "end", "short", "short"]
    texts += [exact] * 3 + [words(r, 80) + "zz" * 300, "漢字" * 300 + words(r, 5), "w " * 20000]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(documents, seed):
    texts = passages(random.Random(seed))
    docs = documents(texts, 4).withColumn("kept", F.lit("clash"))
    got = suffix.without_repeats(docs.drop("kept"), ["doc_id"]).collect()
    assert len(got) == len(texts)
    want = brute(texts)
    for row in got:
        assert (bytes(row["kept"]), row["begins"], row["ends"]) == want[row["doc_id"]], row["doc_id"]


def test_ranks_equal_plain_sorting(spark):
    r = random.Random(4)
    rows = []
    for k in range(40):
        n = r.choice((1, 2, 3, 7, 30, 90))
        rows.append((k, [r.choice((5, 7, 9)) for _ in range(n)], [r.choice((20, 60)) for _ in range(n)]))
    sizes = {5: 30, 7: 41, 9: 55}
    rows = [(k, s, [sizes[x] for x in s]) for k, s, _ in rows]
    got = {(x["seq"], x["i"]): x["rank"] for x in suffix.ranked(
        spark.createDataFrame(rows, "seq bigint, syms array<bigint>, sizes array<int>")).collect()}
    assert len(got) == sum(len(s) for _, s, _ in rows)
    prefix = {}
    for k, s, w in rows:
        for i in range(len(s)):
            total, j = 0, i
            while j < len(s) and total < suffix.NEED:
                total += w[j]
                j += 1
            if total >= suffix.NEED:
                prefix[k, i] = tuple(s[i:j])
    # Ranks order the prefixes of the needed length as plain comparison does.
    ordered = sorted(prefix, key=lambda p: got[p])
    assert [prefix[p] for p in ordered] == sorted(prefix.values())


def test_short_triples_do_not_recur(spark, monkeypatch):
    plain, depths = suffix.ranked, []
    monkeypatch.setattr(suffix, "ranked", lambda seqs, depth=0: (depths.append(depth), plain(seqs, depth))[1])
    # Triples of 90 bytes are below the needed length, two of them are above it.
    rows = [(k, [5, 7, 9, 11, 13, 15, 17, 19, 21], [30] * 9) for k in range(4)]
    rows += [(4, [5, 7, 9, 11, 13, 15, 16, 19, 21], [30] * 9)]
    got = suffix.ranked(spark.createDataFrame(rows, "seq bigint, syms array<bigint>, sizes array<int>")).collect()
    assert len(got) == 45 and depths == [0]
    at = {(x["seq"], x["i"]): x["rank"] for x in got}
    assert at[4, 2] < min(at[k, 2] for k in range(4))


def test_ranks_of_strings_that_recur(spark, monkeypatch):
    plain, depths = suffix.ranked, []
    monkeypatch.setattr(suffix, "ranked", lambda seqs, depth=0: (depths.append(depth), plain(seqs, depth))[1])
    r, sizes = random.Random(6), {5: 9, 7: 14, 9: 17}
    rows = []
    for k in range(24):
        s = [r.choice((5, 5, 5, 7, 9)) for _ in range(r.choice((1, 2, 3, 30, 60)))]
        rows.append((k, s, [sizes[x] for x in s]))
    rows += [(24, *rows[3][1:]), (25, [5] * 50, [9] * 50)]
    got = {(x["seq"], x["i"]): x for x in suffix.ranked(
        spark.createDataFrame(rows, "seq bigint, syms array<bigint>, sizes array<int>")).collect()}
    assert max(depths) > 0 and len(got) == sum(len(s) for _, s, _ in rows)
    prefix = {}
    for k, s, w in rows:
        for i in range(len(s)):
            ends = [j for j in range(i, len(s)) if sum(w[i:j + 1]) >= suffix.NEED]
            assert (got[k, i]["prefix"] is not None) == bool(ends)
            if ends:
                prefix[k, i] = tuple(s[i:ends[0] + 1])
    ordered = sorted(prefix, key=lambda p: got[p]["rank"])
    assert [prefix[p] for p in ordered] == sorted(prefix.values())
    assert len({got[p]["prefix"] for p in prefix}) == len(set(prefix.values()))


def test_samples_are_sorted_once(spark):
    rows = [(0, [5, 7, 9, 11, 13, 15, 17], [90] * 7, [(1, 1), (2, 2), (4, 3), (5, 4)])]
    parts = spark.createDataFrame(
        rows, "seq bigint, syms array<bigint>, sizes array<int>, places array<struct<i int, name bigint>>")
    got = [x["i"] for x in suffix.merge_keys(parts).collect()]
    assert sorted(got) == [0, 0, 1, 2, 3, 3, 4, 5, 6, 6]


def test_only_empty_texts_in_a_fresh_worker(monkeypatch):
    monkeypatch.setattr(suffix.shingles, "_POWERS", {})
    assert len(suffix.Bytes([b"", b""], 11).first) == 0


def test_order_counts_across_partitions(spark, conf):
    r = random.Random(5)
    rows = [(k, r.choice((1, 2, 2, 2, 2, 3, 9)), r.randint(0, 1)) for k in range(500)]
    df = spark.createDataFrame(rows, "id bigint, key bigint, kind int")
    got = suffix.counted_before(df, ["key"], ["id"]).collect()
    for x in got:
        assert x["before0"] == sum(1 for _, k, d in rows if k < x["key"] and d == 0)
        assert x["before1"] == sum(1 for _, k, d in rows if k < x["key"] and d == 1)
        assert x["alone"] == (sum(1 for _, k, _ in rows if k == x["key"]) == 1)


def test_nothing_to_remove(documents):
    got = suffix.without_repeats(documents(["a b c", None]), ["doc_id"]).collect()
    assert sorted((x["doc_id"], bytes(x["kept"])) for x in got) == [(0, b"a b c"), (1, b"")]
    assert suffix.without_repeats(documents(["a"]).limit(0), ["doc_id"]).count() == 0


def brute_words(texts, length=51):
    """Bytes in runs of ``length`` words that start twice, from the first word to the last, and in 400-byte strings."""
    raws = [(t or "").encode() for t in texts]
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raws]
    lists = [[r[a:b] for a, b in w] for r, w in zip(raws, found)]
    seen = Counter(tuple(w[i:i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for r, w, at, (_, begins, ends) in zip(raws, lists, found, brute(texts)):
        hit = np.zeros(len(r) + 2, int)
        for b, e in zip(begins, ends):
            hit[b + 1:e + 1] = 1
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                hit[at[i][0] + 1:at[i + length - 1][1] + 1] = 1
        edges = np.diff(hit)
        begins, ends = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
        out.append((b"".join(r[x:y] for x, y in zip([0, *ends], [*begins, len(r)])), begins, ends))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_short_passages_of_many_words(documents, seed):
    r = random.Random(seed)
    texts = passages(r)
    for n in (50, 51, 52, 60):  # of under 400 bytes, in other white space
        short = [w[:4] for w in words(r, n).split()]
        for gap in (" ", "\n", " \t"):
            texts.append(words(r, r.randint(0, 40)) + " " + gap.join(short) + " " + words(r, r.randint(0, 40)))
    texts += ["a " * 51, "a " * 50, " b\x0bc" * 26, " b\x0bc" * 26, words(r, 70) + " é" * 80, "q " * 51 + "end", "\x1c" + "q " * 51]
    got = suffix.without_repeats(documents(texts, 4), ["doc_id"], words=True).collect()
    assert len(got) == len(texts)
    want, plain = brute_words(texts), brute(texts)
    for row in got:
        assert (bytes(row["kept"]), row["begins"], row["ends"]) == want[row["doc_id"]], row["doc_id"]
    assert sum(a != b for a, b in zip(want, plain)) >= 9


def test_one_short_passage_in_many_texts(documents):
    r = random.Random(6)
    short = " ".join(w[:4] for w in words(r, 55).split())
    texts = [words(r, 12) + " " + short + " " + words(r, 12) for _ in range(900)]
    got = suffix.without_repeats(documents(texts, 4), ["doc_id"], words=True).collect()
    assert len(short) < 400 and all(short not in bytes(x["kept"]).decode() and x["begins"] for x in got)


def test_query_tells_short_passages_of_many_words(spark, documents, tmp_path):
    from stationlake.llm import queries

    r = random.Random(7)
    short = [" ".join(w[:4] for w in words(r, n).split()) for n in (50, 51, 55)]
    texts = [words(r, 12) + " " + p + " " + words(r, 12) for p in short for _ in range(3)]
    texts += [words(r, 30) + " " + words(random.Random(8), 120) + " " + words(r, 30) for _ in range(2)]
    texts += [words(r, 90), None, "", *["q " * 51] * 2]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op9_repeated_passages(spark, str(tmp_path)).collect(), key=lambda x: x["doc_id"])
    assert max(map(len, short)) < 400

    def told(kept, begins, ends):
        return sum(ends) - sum(begins), len(begins), hashlib.sha256(kept).hexdigest()

    for x, text, plain, more in zip(got, texts, brute(texts), brute_words(texts), strict=True):
        assert x["n_bytes"] == len((text or "").encode())
        assert (x["n_removed"], x["n_spans"], x["kept_sha256"]) == told(*plain)
        assert (x["with_words_n_removed"], x["with_words_n_spans"], x["with_words_kept_sha256"]) == told(*more)
    assert [x["with_words_n_spans"] - x["n_spans"] for x in got] == [0] * 3 + [1] * 6 + [0] * 5 + [1] * 2
