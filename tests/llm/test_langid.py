"""Language identification: probabilities against a plain version, held-out accuracy, defined cases."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stationlake.llm import langid, toxicity

SAMPLE = "/root/testdata/sf0.01"


def plain_model(words: list[str], alphabet: int):
    """p(sign, context) of one language, straight from the definition."""
    n = langid.ORDER
    raw = defaultdict(Counter)  # by size: (first?, gram) -> count
    for w in words:
        signs = ("^", *w, "$")
        for end in range(1, len(signs)):
            for k in range(1, n + 1):
                if end - k + 1 >= 0:
                    raw[k][(end - k + 1 == 0, signs[end - k + 1:end + 1])] += 1
    counts = {}
    for k in range(1, n + 1):
        before = Counter(g[1:] for _, g in {x for x in raw[k + 1]}) if k < n else {}
        counts[k] = {g: (c if first or k == n else before[g]) for (first, g), c in raw[k].items()}

    def p(sign, context):
        if context is None:
            return 1.0 / alphabet
        k = len(context) + 1
        own = {g: c for g, c in counts[k].items() if g[:-1] == context}
        shorter = p(sign, context[1:] if context else None)
        if not own:
            return shorter
        once, twice = (sum(1 for c in counts[k].values() if c == x) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        total = sum(own.values())
        return max(own.get(context + (sign,), d) - d, 0) / total + d * len(own) / total * shorter

    return lambda w: sum(
        math.log(p(s[-1], s[:-1]))
        for end in range(1, len(w) + 2) for s in [("^", *w, "$")[max(0, end - n + 1):end + 1]]
    )


def trained(id_from=0):
    """Ids that are learned from."""
    return [k for k in range(id_from, id_from + 4000) if zlib.crc32(str(k).encode()) % 3 != 1]


def test_probabilities_equal_the_definition(spark):
    r = random.Random(3)
    words = {lang: ["".join(r.choice(signs) for _ in range(r.randrange(1, 6))) for _ in range(60)]
             for lang, signs in (("x", "abç"), ("y", "bcd"))}
    rows = [(lang, " ".join(w)) for lang, w in words.items()]
    sample = spark.createDataFrame(rows, "lang string, text string")
    counts = langid.gram_counts(sample).toPandas()
    by_size = []
    for k in range(1, langid.ORDER + 1):
        own = counts[counts["size"] == k]
        by_size.append({c: own[c].to_numpy().view(np.uint64) for c in ("gram", "context", "suffix")}
                       | {"lang": own["lang"].map({"x": 0, "y": 1}).to_numpy(), "n": own["n"].to_numpy(float)})
    orders, unseen = langid.interpolated(by_size, 2)
    found = langid.Identifier(["x", "y"], orders, unseen)
    tested = words["x"][:20] + words["y"][:20] + ["abcdabcd", "zzz", "a", "ßab", "cç"]
    got = found.word_scores(tested)
    alphabet = len({c for w in words["x"] + words["y"] for c in w} | {"$"}) + 1
    for k, lang in enumerate("xy"):
        plain = plain_model(words[lang], alphabet)
        assert np.allclose(got[:, k], [plain(w) for w in tested], rtol=1e-5, atol=1e-4)
    assert got[:, -1].tolist() == [len(w) + 1 for w in tested]


def test_token_table_adds_up_like_single_words(spark):
    found = fitted(spark, [("en", "the cat and the hat"), ("de", "der hund und die katze")])
    texts = ["The cat, the CAT!! the-cat x1y2 and" * 3, "", "123 %%", "katze " * 5000, "a" * 300 + " hund"]
    table = langid.TokenTable(found)
    for got, text in zip(table.sums(texts), texts):
        words = langid.WORD.findall(text.lower())
        want = found.word_scores(words).sum(0) if words else np.zeros(3)
        assert np.allclose(got, want)
    assert np.allclose(table.sums(texts), langid.TokenTable(found).sums(texts))


def fitted(spark, texts):
    ids = iter(trained())
    rows = [(next(ids), t, lang) for lang, t in texts for _ in range(1)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_small_tables_split_pieces(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)
    monkeypatch.setattr(langid, "BLOCK", 20)
    monkeypatch.setattr(langid, "KEPT_TOKENS", 3)
    found = fitted(spark, [("en", "the cat and the hat"), ("de", "der hund und die katze")])
    text = "the quick brown-fox jumps, over 12 lazy dogs; the fox"
    a = langid.TokenTable(found).sums([text, text])
    want = found.word_scores(langid.WORD.findall(text)).sum(0)
    assert np.allclose(a, [want, want])


def test_defined_cases(spark):
    r = random.Random(1)
    spell = {"en": "the and of to in house water bread", "de": "der und die das haus wasser brot zu"}
    ids = iter(trained())
    rows = [(next(ids), " ".join(r.choice(w.split()) for _ in range(30)), lang) for lang, w in spell.items() for _ in range(60)]
    rows += [(next(ids), "the same text again", "en")] * 30 + [(None, "das wasser", "en"), (next(ids), None, "de")]
    asked = [(1, None, None), (2, "", "en"), (3, "12 %% 34 \n", "en"), (4, "the water and the bread of the house", None),
             (None, "das haus und das wasser", None), (6, "́́", "de"), (7, "x" * 3_000_000, "en"), (7, "x" * 3_000_000, "en"),
             (8, "жжжж щщщщ ыыыы юююю эээээ жжжж щщщщ ыыыы юююю" * 20, None)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string").withColumns(
        {"score": langid.F.lit("clash"), "lang_pred": langid.F.lit(1), "sums": langid.F.lit(2)})
    found = langid.fit(df)
    assert found.languages == ["de", "en"]
    got = langid.identified(df, found)
    assert got.columns == ["doc_id", "text", "lang", "sums", "lang_pred", "score", "entropy", "rejected"]
    got = got.collect()
    assert len(got) == len(rows) + len(asked)
    by_text = {g["text"]: g for g in got}
    for t in (None, "", "12 %% 34 \n", "́́"):
        g = by_text[t]
        assert (g["lang_pred"], g["score"], g["entropy"], g["rejected"]) == ("und", 0.0, None, None)
    assert by_text[asked[3][1]]["lang_pred"] == "en" and by_text[asked[4][1]]["lang_pred"] == "de"
    assert not by_text[asked[3][1]]["rejected"] and by_text[asked[8][1]]["rejected"]
    assert all(0 <= g["score"] <= 1 for g in got)


def test_nothing_or_one_language_learned(spark):
    schema = "doc_id long, text string, lang string"
    nothing = langid.fit(spark.createDataFrame([], schema))
    asked = spark.createDataFrame([(1, "some words", None)], schema)
    g = langid.identified(asked, nothing).first()
    assert (g["lang_pred"], g["score"], g["entropy"], g["rejected"]) == ("und", 0.0, None, None)
    assert langid.identified(asked.limit(0), nothing).count() == 0
    one = langid.fit(spark.createDataFrame([(k, f"words {k}", "en") for k in trained()[:20]], schema))
    g = langid.identified(asked, one).first()
    assert (g["lang_pred"], g["score"]) == ("en", 1.0)


def test_every_labelled_text_is_learned_from(spark):
    letters = "abcdefghij"
    spelt = lambda k: "".join(letters[int(d)] for d in f"{k * 7919 % 100000:05d}")
    ids = trained()[:2400]
    rows = [(k, spelt(k), ("en", "de")[k % 2]) for k in ids]
    rows += [(k, "жщыюэ", "en") for k in range(4000) if k not in set(trained())]
    found = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = lambda words: np.isin(langid.Signs.of(words).hashes()[-1], found.orders[-1].grams)
    own = langid.Signs.of([spelt(k) for k in ids])
    assert known([spelt(k) for k in ids])[own.depth >= langid.ORDER].all()
    assert not known(["жщыюэ"]).any()


def test_calibration_follows_every_text(spark):
    r = random.Random(5)
    spell = {"en": "the and of to in house water bread", "de": "der und die das haus wasser brot the of"}
    rows = [(k, " ".join(r.choice(spell[lang].split()) for _ in range(3)) + f" {k}", lang)
            for k in trained()[:1500] for lang in spell]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.grams_of(langid.word_counts(langid.labelled(df))).toArrow()
    curve, usual = langid.calibration(langid.modelled(counts, "rest", ["de", "en"]), langid.labelled(df))
    assert curve[1] + curve[2] > 0 and np.isfinite(usual).all() and (usual[:, 1:] > 0).all()
    points = [(r.gauss(0, 1), r.gauss(0, 2)) for _ in range(300)]
    hits = [bool(r.random() < 1 / (1 + math.exp(-(0.4 + a - 0.5 * b)))) for a, b in points]
    given = spark.createDataFrame([(a, b, h) for (a, b), h in zip(points, hits)], "a double, b double, hit boolean")
    x = np.array([(1.0, a, b) for a, b in points])
    assert np.allclose(langid.logistic(given, ["a", "b"], "hit"), toxicity.logistic(x, np.array(hits, float)), atol=1e-6)


def test_sample_is_bounded_and_does_not_depend_on_layout(spark):
    ids = trained()[:3000]
    rows = [(k, f"text number {k} of many", ("en", "de")[k % 7 == 0]) for k in ids] + [(k, "copy", "en") for k in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    take = lambda d: sorted(map(tuple, langid.labelled_sample(d, 50, 10_000).collect()))
    a = take(df)
    assert a == take(df.repartition(7)) and len(a) <= 100 and {x[0] for x in a} == {"en", "de"}
    assert len(langid.labelled_sample(df, 50, 100).collect()) <= 10


@pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="tables not supplied")
def test_held_out_accuracy(spark):
    from stationlake.llm.queries import op13_language_id

    got = op13_language_id(spark, SAMPLE)
    truth = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert got.count() == truth.count() and len(rows) > 200
    right = sum(g["lang"] == g["lang_pred"] for g in rows)
    assert right / len(rows) > 0.985
