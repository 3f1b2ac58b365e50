"""Quotation links and licence scans against their SQL, mixing against a plain version."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from stationlake.llm import chat, licenses, mixing, queries
from tests import compare


def table_against_sql(got, sql: str, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    names = sorted(got.columns)
    ours = sorted(tuple(compare._cell(r[c]) for c in names) for r in got.collect())
    want = con.sql(sql)
    assert sorted(want.columns) == names
    place = [want.columns.index(c) for c in names]
    assert ours == sorted(tuple(compare._cell(r[k]) for k in place) for r in want.fetchall())


CHAT = [
    (1, 0, "user", "Where shall we\nmeet?\n\nI am free on Monday."),
    (1, 1, "assistant", "> where  shall we\n> Meet?\n\nAt the station."),
    (1, 2, "user", "On Tuesday Ann wrote:\n>> Where shall we\n>> meet?\n> At the station.\nWhich one?"),
    (1, 3, "user", "> I am free on Monday.\nSo am I."),
    (1, 4, "assistant", "> Which one?\n> unknown words\nThe old one.\n> So am I.\ngood"),
    (1, 5, "user", "> The old one.\nok"),
    (1, 6, "user", "> ok\n> later words\nfine"),
    (1, 7, "user", "later words"),
    (1, 8, "user", "> a quote that nobody wrote"),
    (2, 0, "user", "At the station."),
    (2, 0, "user", "At the station."),
    (2, 1, "user", "> At the station.\nyes"),
    (2, 1, "user", "> At the station.\nyes"),
    (2, 2, None, None), (2, 3, "user", ""), (None, 1, "user", "> x\ny"), (3, None, "user", "> x\n"),
    (4, 0, "user", "> quoting first"), (4, 1, "user", "> > deep\n>> deep"), (4, 2, "user", ">\n>\n"),
    (5, 0, "a", "Thanks"), (5, 1, "a", "> Thanks\nThanks"), (5, 2, "a", "> Thanks\nThanks"), (5, 3, "a", "x" * 20000),
]


def chat_frame(spark, rows=CHAT):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_equals_sql(spark):
    df = chat_frame(spark)
    table_against_sql(chat.conversations(df), chat.ORACLE, conversations=df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))


def test_chat_links_and_order(spark):
    got = [r for r in chat.conversations(chat_frame(spark)).collect() if r["conv_id"] == 1]
    by = {r["turn"]: r for r in got}
    assert [by[k]["parent_turn"] for k in range(9)] == [None, 0, 1, 0, 3, 4, 5, None, None]
    assert (by[6]["root_turn"], by[6]["depth"], by[6]["n_quotes"], by[6]["n_linked"]) == (0, 4, 1, 1)
    assert by[2]["text"] == "Which one?" and by[4]["text"] == "The old one.\ngood"
    place = {r["turn"]: k for k, r in enumerate(got)}
    assert all(place[r["parent_turn"]] < place[r["turn"]] for r in got if r["parent_turn"] is not None)


def test_chat_deep_chain_and_extra_columns(spark):
    rows = [(9, 0, "u", "line 0")] + [(9, k, "u", f"> line {k - 1}\nline {k}") for k in range(1, 40)]
    df = chat_frame(spark, rows).withColumn("depth", F.lit("own")).withColumn("extra", F.lit(1))
    got = {r["turn"]: (r["root_turn"], r["depth"]) for r in chat.conversations(df).collect()}
    assert got == {k: (0, k) for k in range(40)}
    assert chat.conversations(chat_frame(spark, [])).count() == 0


FILES = [
    ("a/LICENSE", "MIT\n\nReleased under the MIT License."),
    ("a/b/x.txt", "some text about nothing"),
    ("a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
    ("a/b/c/y.txt", "nothing here either"),
    ("a/b/c/z.txt", "code\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
    ("d/e.txt", "no licence at all"), ("top.txt", "Released under the MIT licence by some people far away in the hills"),
    ("LICENSE", None), ("a/b/c/y.txt", "nothing here either"), (None, "Released under the MIT License."), (None, ""),
    ("d/long.txt", "filler words " * 5000 + "\nLicensed under CC BY-NC 4.0."),
    ("d/f/COPYING", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    ("ab/other.txt", "a directory whose name only starts alike"),
]


def files_frame(spark, rows=FILES):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, path string, text string")


def test_licenses_equal_sql(spark):
    df = files_frame(spark)
    pandas = df.toPandas()
    got = licenses.scanned(df).withColumn("own_score", F.round("own_score", 6))
    table_against_sql(got.where("path IS NOT NULL"), f"SELECT * FROM ({licenses.oracle('path')}) WHERE path IS NOT NULL",
                      documents=pandas)


def test_licenses_found_and_inherited(spark):
    got = {r["path"]: r for r in licenses.scanned(files_frame(spark)).collect() if r["path"]}
    assert got["a/b/x.txt"]["license"] == "Apache-2.0" and got["a/b/x.txt"]["inherited_from"] == "a/b"
    assert got["a/b/c/y.txt"]["license"] == "Apache-2.0"
    assert got["a/b/c/z.txt"]["own_license"] == "GPL-3.0" and got["a/b/c/z.txt"]["license"] == "GPL-3.0"
    assert got["a/LICENSE"]["own_license"] == "MIT" and got["d/long.txt"]["own_license"] == "CC-BY-NC-4.0"
    assert got["d/e.txt"]["license"] is None and got["ab/other.txt"]["license"] is None
    assert got["d/f/COPYING"]["own_license"] in {"CC-BY-NC-4.0", "MIT"}


def wrapped(text, width, before="", after=""):
    import textwrap

    return "\n".join(f"{before}{line}{after}" for line in textwrap.wrap(text, width))


def full_texts():
    """(path, text, licence): licence files and headers as they usually stand, in several comment styles."""
    by = {}
    for name, text in licenses.TEMPLATES:
        if len(text) > len(by.get(name, "")):
            by[name] = text
    as_is = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"
    code = "\n\nint main() {\n  return call(1, 2);\n}\n" * 20
    rows = [
        ("m/LICENSE", f"MIT License\n\nCopyright (c) 2020 Some Body\n\n{wrapped(by['MIT'], 78)}\n\nThe above copyright notice shall be "
                      f"included in all copies.\n\n{wrapped(as_is, 70)}\n", "MIT"),
        ("m/src/deep/file.c", f"no header here{code}", "MIT"),
        ("b/COPYING", f"Copyright 2019 Some Body\nAll rights reserved.\n\n{wrapped(by['BSD-3-Clause'], 60)}\n\n1. Redistributions of source "
                      f"code must retain the notice.\n\n{wrapped(as_is, 70)}", "BSD-3-Clause"),
        ("a/LICENSE.txt", "                                 Apache License\n                           Version 2.0, January 2004\n"
                          "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE\n\n   1. Definitions.\n\n"
                          + wrapped(as_is * 6, 70, "      "), "Apache-2.0"),
        ("g/LICENSE", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n\n"
                      + wrapped(as_is * 6, 70), "GPL-3.0"),
    ]
    styles = {"c": (" * ", "", "/*\n", "\n */"), "sh": ("# ", "", "#!/bin/sh\n#\n", ""), "js": ("// ", "", "", ""), "sql": ("-- ", "", "", ""),
              "html": ("   ", "", "<!--\n\n", "\n-->"), "box": ("/* ", " */", "", ""), "lisp": (";; ", "", "", ""), "tex": ("% ", "", "", "")}
    for k, (style, (before, after, head, tail)) in enumerate(styles.items()):
        for name in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "MIT", "MPL-2.0", "ISC", "LGPL-2.1"):
            body = wrapped(by[name], 50 + 4 * k, before, after)
            more = wrapped(as_is, 60, before, after)
            blank = f"\n{before.strip()}{after}\n"
            rows.append((f"x/{style}/{name}.src", f"{head}{body}{blank}{more}{tail}{code}", name))
    return rows + [("x/none.c", code + "use of this copy is free to any person and the rights are yours", None)]


def test_licenses_of_wrapped_headers_and_full_texts(spark):
    rows = full_texts()
    df = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: r for r in licenses.scanned(df).collect()}
    assert {p: got[p]["license"] for p, _, _ in rows} == {p: want for p, _, want in rows}
    assert got["m/src/deep/file.c"]["inherited_from"] == "m" and got["m/src/deep/file.c"]["own_license"] is None
    table_against_sql(licenses.scanned(df).withColumn("own_score", F.round("own_score", 6)).drop("text"),
                      licenses.oracle("path"), documents=df.toPandas())


def test_licenses_keep_rows_and_clashing_columns(spark):
    df = files_frame(spark).withColumn("license", F.lit("x")).withColumn("square", F.lit(1))
    assert licenses.scanned(df).count() == len(FILES)
    assert licenses.scanned(files_frame(spark, [])).count() == 0


def test_shares_pass_shortages_to_siblings():
    assert mixing.shares(100, [1, 1, 2], [100, 100, 100]) == [25, 25, 50]
    assert mixing.shares(100, [1, 1, 2], [10, 100, 100]) == [10, 30, 60]
    assert mixing.shares(100, [1, 1, 2], [10, 10, 10]) == [10, 10, 10]
    assert mixing.shares(10, [1, 0, 1, 1], [100, 100, 100, 100]) == [4, 0, 3, 3]
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    got = mixing.budgets(leaves, {("a",): 1, ("b",): 1}, 200, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}  # x's shortage stays within a
    got = mixing.budgets(leaves, {("a",): 3, ("b",): 1}, 400, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}  # then goes to a's sibling
    with pytest.raises(ValueError):
        mixing.budgets(leaves, {("a",): -1}, 1, 1)


def brute_mix(rows, levels, weights, total, max_epochs, seed, spark):
    """rows: (doc_id, text, levels..., tokens); the order hash is Spark's, the rest is plain."""
    supply = {}
    for r in rows:
        supply[r["path"]] = supply.get(r["path"], 0) + r["tokens"]
    amounts = mixing.budgets(supply, weights, sum(supply.values()) if total is None else total, max_epochs)
    out = []
    for path, tokens in supply.items():
        own = [r for r in rows if r["path"] == path]
        full = min(amounts[path] // tokens, max_epochs) if tokens else 0
        rest = amounts[path] - full * tokens if full < max_epochs else 0
        out += [(r["doc_id"], e) for r in own for e in range(full)]
        if rest > 0:
            order = {}
            for r in own:
                order.setdefault(r["hashes"][full] % 2**64, []).append(r)
            used = 0
            for h in sorted(order):
                used += sum(r["tokens"] for r in order[h])
                if used > rest:
                    break
                out += [(r["doc_id"], full) for r in order[h]]
    return sorted(out, key=str)


@pytest.mark.parametrize("total", [None, 300, 9000])
def test_mix_equals_brute_force(spark, documents, total):
    import random

    r = random.Random(8)
    rows = []
    for k in range(400):
        source = "src0" if k % 3 == 0 else f"src{r.randint(1, 6)}"
        rows.append((k, " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), source))
    rows += [rows[5], (1000, None, "en", "src0"), (None, "a b c", "en", None), (1001, "", "es", "src9")]
    docs = documents(rows).withColumn("epoch", F.lit("clash"))
    levels = ["lang", "source"]
    weights = {("en",): 0.5, ("de",): 0.4, (None,): 0.1, ("en", "src1"): 0.0}
    got = sorted(((x["doc_id"], x["epoch"]) for x in
                  mixing.mixed(docs, levels, weights, total, max_epochs=3, seed=5).collect()), key=str)
    hashed = docs.select(
        "doc_id", *levels, mixing.word_tokens().alias("tokens"),
        F.array(*[F.xxhash64(F.lit(5), F.lit(e), F.col("doc_id"), F.xxhash64("text")) for e in range(4)]).alias("hashes"),
    ).collect()
    plain = [{**x.asDict(), "path": (x["lang"], x["source"])} for x in hashed]
    assert got == brute_mix(plain, levels, weights, total, 3, 5, spark)
    assert got


def test_mix_of_nothing(documents):
    assert mixing.mixed(documents(["a"]).limit(0), ["lang"], {}).count() == 0


@pytest.mark.parametrize("name", [k for k in queries.ORACLES])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    problem, n = compare.difference(spark, compare.connect(folder), queries.QUERIES[name], queries.ORACLES[name], folder)
    assert problem is None and n > 0
