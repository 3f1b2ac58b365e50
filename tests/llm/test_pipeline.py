"""The pipeline against plain versions of its stages, each on the stage's own input."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stationlake.llm import mixing, neardup, queries, toxicity
from stationlake.sources.shared import staged
from tests.llm.test_native_ops import brute_mix
from tests.llm.test_neardup import union
from tests.llm.test_suffix import brute, words

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: toxic ones, near copies, shared passages, nulls, repeated rows."""
    from tests.llm.conftest import DOCS

    r = random.Random(12)
    shared = words(r, 90)
    texts = [words(r, r.randint(5, 120)) for _ in range(220)]
    toxic = set(range(0, 220, 4))
    for k in toxic:
        w = texts[k].split()
        w[r.randrange(len(w))] = r.choice(["stinker", "buffoon"])
        texts[k] = " ".join(w)
    texts += [words(r, 30) + " " + shared + " " + words(r, 30) for _ in range(6)]
    base = words(r, 150).split()
    for _ in range(8):
        w = list(base)
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [None, "", "twice the same row"]
    rows = [(k, t, r.choice(["en", "de"]), f"src{k % 7}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows.append(rows[-1])
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(k, 1, int(k in toxic)) for k in range(220)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    return folder


def texts_by_id(df):
    return {x["doc_id"]: x["text"] for x in df.collect()}


def test_passages_take_one_worker_a_task(spark, corpus):
    docs = queries.table(spark, corpus, "documents")
    cut = corpus_pipeline.repeated_passages(spark, docs, corpus)
    # Keys before the join and texts after it: a second map after it would start a second worker.
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_stages_equal_plain_versions(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]
    given = queries.table(spark, corpus, "documents")
    columns = given.columns
    docs, results = given, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, corpus), f"test-{name}")
        results[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == columns

    before, after = results["toxicity"]
    score = {x["doc_id"]: x["toxic_score"] for x in toxicity.scored(
        before, toxicity.fit(before, queries.table(spark, corpus, "labels"))).collect()}
    assert sorted(x["doc_id"] for x in after.collect()) == sorted(
        x["doc_id"] for x in before.collect() if score[x["doc_id"]] < 0.5)
    assert set(range(0, 220, 4)).isdisjoint(texts_by_id(after)) and set(range(220, 234)) <= set(texts_by_id(after))

    before, after = results["near_duplicates"]
    idf, _ = neardup.frequency_table(before)
    raws = {k: (t or "").lower().encode() for k, t in texts_by_id(before).items()}
    ids = sorted(raws)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
             if raws[a].split() and raws[b].split() and neardup.jaccard(raws[a], raws[b], idf) >= 0.8]
    label = union(pairs, ids)
    assert sorted(x["doc_id"] for x in after.collect()) == sorted(set(label.values()))

    before, after = results["repeated_passages"]
    own = texts_by_id(before)
    left = {k: kept.decode("utf-8", "ignore") for k, (kept, b, _) in zip(own, brute(list(own.values())))}
    lost = {k for k, (_, b, _) in zip(own, brute(list(own.values()))) if b}
    want = {k: t for k, t in left.items() if not (k in lost and not t.strip(" \n\t\r"))}
    assert {k: t or "" for k, t in texts_by_id(after).items()} == want and lost

    before, after = results["source_mix"]
    levels = ["domain", "lang", "source"]
    tree = queries.with_domain(before).select(
        "doc_id", *levels, mixing.word_tokens().alias("tokens"),
        F.array(*[F.xxhash64(F.lit(17), F.lit(e), F.col("doc_id"), F.xxhash64("text")) for e in range(3)]).alias("hashes"),
    ).collect()
    rows = [{**x.asDict(), "path": tuple(x[c] for c in levels)} for x in tree]
    plain = brute_mix(rows, levels, queries.mix_weights(), None, 2, 17, spark)
    assert sorted(str(x["doc_id"]) for x in after.collect()) == sorted(str(k) for k, _ in plain)

    before, after = results["token_ids"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    texts = texts_by_id(before)
    assert after.count() == before.count()
    for x in after.collect():
        ids = library.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(x["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and x["n_tokens"] == len(ids)


def test_passages_of_over_50_words_go_however_short(spark, corpus, documents):
    r = random.Random(7)
    passage, fewer = (" ".join(w[:5] for w in words(r, n).split()) for n in (51, 50))
    own = [words(r, 20) for _ in range(8)]
    texts = [f"{a} {passage} {b}" for a, b in zip(own[:2], own[2:4])] + [f"{a} {fewer} {b}" for a, b in zip(own[4:6], own[6:])]
    texts += [passage, own[0]]
    assert len(passage) < 400
    cut = texts_by_id(corpus_pipeline.repeated_passages(spark, documents(texts), corpus))
    assert cut == {0: f"{own[0]}  {own[2]}", 1: f"{own[1]}  {own[3]}", 2: texts[2], 3: texts[3], 5: own[0]}


def test_no_documents(spark, corpus, tmp_path):
    queries.table(spark, corpus, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, corpus, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
