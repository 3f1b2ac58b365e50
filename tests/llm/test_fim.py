"""Fill-in-middle against a plain version over single texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from stationlake.llm import fim

WS = r"\x20\x09-\x0D"
UNIT = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", text, None, None
    if h4 % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def check(spark, rows, schema="doc_id long, text string", parts=3):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    got = fim.restored(fim.filled(df)).collect()
    at_once = fim.filled(df, with_restored=True).select(*got[0].asDict() if got else ["text"]).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    want = sorted((str((r[0], r[1], *plain_version(r[0], r[1]), r[1] or "")) for r in rows))
    assert sorted(str((g["doc_id"], g["text"], g["n_units"], g["form"], g["output"], g["prefix_chars"],
                       g["middle_chars"], g["restored"])) for g in got) == want
    return got


def test_random_texts_of_awkward_characters(spark):
    r = random.Random(5)
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x01", "\x01a", "\x01b", "\x00", "a", "b", "é", "漢", "😀", "<", "<P", "S>",
             " ", " ", "\x85", "\\1", "<M", ">"]
    rows = [(k, "".join(r.choice(signs) for _ in range(r.randrange(0, 40)))) for k in range(1500)]
    rows += [(9000 + k, w) for k, w in enumerate(["", " ", "\n\n", "a", " a", "a ", "<P>", "x <S> y", "a<M>b", "<", "a <"])]
    got = check(spark, rows)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}


def test_nulls_repeated_rows_and_negative_ids(spark):
    rows = [(None, "a b c d"), (None, None), (3, None), (7, "one two three"), (7, "one two three"), (-5, "x y z w")]
    check(spark, rows * 2)


def test_very_long_text_and_one_without_spaces(spark):
    rows = [(k, t) for k, t in enumerate(["word " * 400_000, "x" * 2_000_000, " " * 500_000, "é\n" * 300_000] * 4)]
    check(spark, rows)


def test_empty_table(spark):
    assert check(spark, []) == []


def test_clashing_columns_are_replaced_and_others_kept(spark):
    names = ["row", "drawn", "filled", "d0", "output", "form", "n_units", "prefix_chars", "middle_chars"]
    df = spark.range(40).selectExpr("id AS doc_id", "concat('a b c ', id) AS text", *[f"'x' AS `{n}`" for n in names])
    got = fim.restored(fim.filled(df))
    assert sorted(got.columns) == sorted(["doc_id", "text", "restored", *names])
    for g in got.collect():
        n, form, output, p, m = plain_version(g["doc_id"], g["text"])
        assert (g["n_units"], g["form"], g["output"], g["prefix_chars"], g["middle_chars"]) == (n, form, output, p, m)
        assert g["row"] == g["drawn"] == g["filled"] == g["d0"] == "x" and g["restored"] == g["text"]


def test_other_rates_and_seed(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "'a b c d e f' AS text")
    all_psm = fim.filled(df, rates=fim.Rates(100, 0)).groupBy("form").count().collect()
    assert [tuple(r) for r in all_psm] == [("psm", 300)]
    a = [r["output"] for r in fim.filled(df, seed=1).orderBy("doc_id").collect()]
    assert a != [r["output"] for r in fim.filled(df, seed=2).orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["op12_fill_in_middle"])
def test_query_equals_sql(spark, name):
    from stationlake.llm.queries import ORACLES, QUERIES
    from tests import compare

    folder = "/root/testdata/sf0.001"
    problem, n = compare.difference(spark, compare.connect(folder), QUERIES[name], ORACLES[name], folder)
    assert problem is None and n > 0
