"""Token counts, BPE, quality counts and toxicity against plain versions."""

from __future__ import annotations

import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from stationlake.llm import bpe, quality, queries, toxicity, unigram

P = pytest.importorskip("public_tokenizers")

EDGE = [
    None, "", " ", "\n", "  two  spaces ", "a", "naïve café ▁ 漢字 😀", "x" * 5000, "word " * 3000,
    "tab\tnew\r\nline\x0b\x0c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "'s 'll don't we'", "  wide",
    "no_white_space_" * 900, "é" * 3000, "123 456 $$$ ***", "dup", "dup",
]


def random_texts(n: int, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    alphabet = "abc the lo \n\t'sé漢😀$.,  <|>" + "aeiou" * 3
    return ["".join(r.choice(alphabet) for _ in range(r.choice((5, 80, 900, 6000)))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return queries.unigram_pieces(queries.tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def unigram_library(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return library


def test_unigram_counts_equal_the_library(documents, pieces, unigram_library):
    texts = EDGE + random_texts(60)
    got = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(documents(texts), pieces).collect()}
    want = {k: len(unigram_library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert got == want


def test_unigram_ties_keep_the_longer_last_piece():
    counter = unigram.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    assert counter["▁aa"] == 2  # ▁ + aa, ▁a + a and ▁ + a + a all score -3


def test_unigram_keeps_other_columns_and_empty_tables(spark, documents, pieces):
    docs = documents(["a b"]).withColumnRenamed("lang", "n_tokens")
    assert set(unigram.token_counts(docs, pieces).columns) == {"doc_id", "source", "n_chars", "n_tokens"}
    assert unigram.token_counts(documents(["x"]).limit(0), pieces).count() == 0


@pytest.fixture(scope="module")
def bpe_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))


def test_bpe_equals_the_library(documents, bpe_library):
    texts = EDGE + random_texts(120) + [" ".join(random_texts(40, 9))] * 3
    vocabulary, pattern, special = queries.byte_bpe()
    coded = bpe.encoded(documents(texts), vocabulary, pattern, special, keep=["doc_id"]).collect()
    assert len(coded) == len(texts)
    for r in coded:
        ids = bpe_library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["decoded"] == bpe_library.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_depend_on_content_only():
    body = " ".join(random_texts(30)).encode()
    a = np.frombuffer(body, np.uint8)
    b = np.frombuffer(b"some other beginning " + body, np.uint8)
    shifted = set((bpe.rolling_cuts(a) + 21).tolist())
    assert len(shifted) > 5 and shifted - set(bpe.rolling_cuts(b).tolist()) <= {c for c in shifted if c < 60}


def test_bpe_agreed_places_split_exactly(bpe_library):
    """Encoding the two sides of an agreed place apart changes nothing."""
    for text in random_texts(40, 3):
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = bpe_library.encode(text, add_special_tokens=False).ids
        for at in bpe.agreed_places(raw)[:6]:
            parts = [text.encode()[:at].decode(), text.encode()[at:].decode()]
            assert [i for p in parts for i in bpe_library.encode(p, add_special_tokens=False).ids] == whole


def brute_counts(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated)


def test_quality_counts_equal_brute_force(documents):
    r = random.Random(2)
    texts = EDGE + random_texts(40) + [
        " ".join(r.choice("ab") for _ in range(60)) + "\n" + "x y z\n" * r.randint(0, 4) for _ in range(40)
    ]
    for row in quality.judged(documents(texts)).collect():
        want = brute_counts(texts[row["doc_id"]] or "")
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_removes_lines_above_the_limit(documents):
    r = random.Random(4)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(7)) for _ in range(4000)]

    def body(n):
        return " ".join(r.sample(words, n))

    rows = [(k, f"Menu {k}: home about contact us here\n{body(40)}", "en", "a") for k in range(30)]
    rows += [(100 + k, f"Menu 7: home about contact us here\nlegal notice all rights kept by us\n{body(2)}", "en", "a")
             for k in range(12)]
    rows += [(200 + k, f"menu {k}:  HOME about contact us here\n{body(40)}", "en", None) for k in range(5)]
    rows += [(300, "same text " + body(30), "en", "b")] * 40  # copies are one document
    got = quality.judged(documents(rows), least=10, share=0.02).collect()
    by = {(x["doc_id"], x["source"]): x for x in got}
    assert len(got) == len(rows)
    assert all(by[k, "a"]["n_lost_words"] == 7 and by[k, "a"]["kept"] for k in range(30))
    assert all(not by[100 + k, "a"]["kept"] for k in range(12))
    assert all(by[200 + k, None]["n_lost_words"] == 0 and by[200 + k, None]["kept"] for k in range(5))
    assert by[300, "b"]["kept"] and by[300, "b"]["n_lost_words"] == 0


def test_quality_counts_documents_not_texts(documents):
    r = random.Random(6)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(7)) for _ in range(4000)]
    bodies = [" ".join(r.sample(words, 40)) for _ in range(40)]
    legal = "legal notice all rights kept by us"
    rows = [(k, f"{legal}\n{bodies[k % 2]}", "en", "c") for k in range(16)]  # two texts, sixteen documents
    rows += [(0, f"{legal}\n{bodies[0]}", "en", "c")] * 5
    rows += [(100 + k, f"{legal}\n{bodies[k + 2]}", "en", "d") for k in range(11)]
    rows += [(200 + k, bodies[30], "en", "d") for k in range(600)]  # copies count for the size of a host
    rows += [(900 + k, f"{legal}\n{bodies[k % 2]}", "en", None) for k in range(16)]
    got = quality.judged(documents(rows), least=10, share=0.02).collect()
    assert len(got) == len(rows)
    lost = {(x["doc_id"], x["source"]): x["n_lost_words"] for x in got}
    assert all(lost[k, "c"] == 7 and lost[900 + k, None] == 7 for k in range(16))
    assert all(lost[100 + k, "d"] == 0 for k in range(11))


def plain_quality(rows, least, share, deplete=0.5):
    """{row number: (lost words, kept, text without the lines)} straight from the rules."""
    parts = lambda t: (t or "").split("\n")
    holders, hosts = {}, {}
    for i, text, _, host in rows:
        hosts.setdefault(host, set()).add((i, text or ""))
        for line in parts(text):
            if quality.WORD.search(line):
                holders.setdefault((host, quality.normalised(line)), set()).add((i, text or ""))
    common = {k for k, d in holders.items() if len(d) > least and len(d) > share * len(hosts[k[0]])}
    out = []
    for i, text, _, host in rows:
        gone = [x for x in parts(text) if quality.WORD.search(x) and (host, quality.normalised(x)) in common]
        lost = sum(len(quality.WORD.findall(x)) for x in gone)
        n, *_, repeats = brute_counts(text or "")
        failed = n < 10 or 100 * repeats > 20 * n
        kept = not failed and not (lost and (n - lost < 10 or n - lost < deplete * n))
        out.append((i, host, lost, kept, "\n".join(x for x in parts(text) if x not in gone)))
    return out


def test_quality_verdicts_and_cleaned_texts_equal_the_rules(documents):
    r = random.Random(12)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(7)) for _ in range(3000)]
    common = [" ".join(r.sample(words, r.randint(3, 9))) for _ in range(6)]
    rows = []
    for k in range(300):
        lines = [" ".join(r.sample(words, r.randint(1, 15))) for _ in range(r.randint(0, 4))]
        lines += [r.choice((x, x.upper(), f"  {x}")) for x in r.sample(common, r.randint(0, 4))] + ["", " "] * r.randint(0, 1)
        r.shuffle(lines)
        rows.append((k, r.choice(("\n".join(lines), "\n".join(lines), None if k % 50 == 0 else "")), "en", r.choice(("a", "a", "b", None))))
    rows += r.choices(rows, k=60) + [(None, rows[3][1], "en", "a")] * 2
    docs = documents(rows).withColumns({c: queries.F.lit("x") for c in ("n_lost_words", "_row", "kept", "_host", "removed")})
    want = plain_quality(rows, 10, 0.02)
    assert any(w[2] for w in want) and len({w[3] for w in want}) == 2
    got = quality.judged(docs, least=10, share=0.02).collect()
    assert sorted(map(str, ((x["doc_id"], x["source"], x["n_lost_words"], x["kept"]) for x in got))) == sorted(str(w[:4]) for w in want)
    clean = quality.cleaned(docs, least=10, share=0.02)
    assert clean.columns == [c for c in docs.columns if c not in ("n_lost_words", "kept")]
    assert sorted(str((x["doc_id"], x["source"], x["text"])) for x in clean.collect()) == sorted(
        str((w[0], w[1], w[4])) for w in want if w[3])


def test_quality_and_bpe_of_no_documents(documents):
    none = documents(["x"]).limit(0)
    assert quality.judged(none).count() == quality.cleaned(none).count() == 0
    assert bpe.encoded(none, *queries.byte_bpe(), keep=["doc_id"]).count() == 0


def test_toxicity_learns_terms_disguises_and_exceptions(spark, documents):
    r = random.Random(1)
    plain = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = k % 3 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["stinker", "buffoon"])
        elif k % 3 == 1 and r.random() < 0.3:
            words.insert(1, "stinker beetle")  # harmless
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    disguised = ["you Bυff00n", "a ＳＴＩＮＫＥＲ here", "st1nker!", "bú­ffoon", "stinkers all", "the stinker beetle", None, ""]
    rows += [(2000 + k, t) for k, t in enumerate(disguised)]
    docs = documents(rows)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labelled)
    assert set(lexicon.weights) == {"stinker", "buffoon"}
    got = {x["doc_id"]: x["toxic_score"] for x in toxicity.scored(docs, lexicon).collect()}
    held = [(got[d], t) for d, _, t in labels if __import__("zlib").crc32(str(d).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.98 * len(held)
    assert [got[2000 + k] >= 0.5 for k in range(8)] == [True, True, True, True, False, False, False, False]


def test_toxicity_without_labels_or_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(["a", None]).withColumnRenamed("lang", "toxic_score")
    lexicon = toxicity.fit(docs, labels)
    assert [r["toxic_score"] for r in toxicity.scored(docs, lexicon).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0
