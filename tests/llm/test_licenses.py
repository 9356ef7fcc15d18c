"""License scan against rules run one by one, without gate, on words found one by one."""

import re

import pytest

from tests.llm.helpers import empty, odd
from tidegrid.llm import licenses
from tidegrid.llm.license_rules import BASE, rules

TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-2.0-or-later\ncode", "gnu  GENERAL\tpublic\nLicense v2",
    "GNU Lesser General Public Licence, version 2.1, not the GNU General Public License", "mit licence", "er kommt mit der Bahn",
    "the mit license the mit license the mit license", "cc by cc by-sa 4.0 cc-by", "permit license", "apache license", "apache license2",
    "you should have received a copy of the GNU General Public License", "BSD 3-Clause License; BSD-2-Clause", "gplv3 and LGPL-3.0 and cc0",
    "https://creativecommons.org/licenses/by-sa/4.0/ https://www.gnu.org/licenses/gpl-3.0.html", "All rights reserved. This is strictly confidential",
    "Neither the name of the Acme Corp nor the names of its contributors may be used", "This is free and unencumbered software released into the public domain.",
    "released under the terms of the Mozilla Public License, v. 2.0 or MPL 2.0", "Zero-Clause BSD", "Creative Commons Attribution-ShareAlike 3.0 Unported",
    "İapache license", "apache \x7f license", "a" * 50, "license " * 3000, "x" * 200000 + " mit license",
]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_by_hand(words):
    out = []
    for phrase, label in BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i: i + len(p)] == p]
    return sorted(out)


def places_by_hand(text, table):
    words = words_of(text)
    line = " " + " ".join(words) + " "
    found = []
    for k, r in enumerate(table):
        for m in re.finditer(r.pattern.pattern.decode(), line):
            found.append((line.count(" ", 0, m.start()) - 1, line.count(" ", 0, m.end()) - 1, k))
    keep = []
    for a, b, k in found:
        rank = table[k].rank
        inside = any(
            c <= a and b <= d and table[j].rank and table[j].rank <= rank and
            ((c, d) != (a, b) or (table[j].rank, j) < (rank, k)) for c, d, j in found)
        if not rank or not inside:
            keep.append((table[k].label, table[k].form, a, b))
    return sorted(keep)


@pytest.fixture(scope="module")
def table():
    return rules()


def test_there_are_hundreds_of_rules(table):
    assert len(table) > 300 and len({r.label for r in table}) > 100


def test_places_equal_those_of_rules_run_one_by_one(spark, sf_dir, table):
    cited = [f"released under the {r.label.replace('-', ' ')} license and {r.label}" for r in table[::5]]
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = TEXTS + cited + docs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_words"] == len(words_of(t))
        assert sorted((p["label"], p["form"], p["first"], p["last"]) for p in got[i]["found"]) == places_by_hand(t, table), t[:200]


def test_summary_of_base_places(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(df)).collect()}
    for i, t in enumerate(TEXTS):
        base, r = base_by_hand(words_of(t)), got[i]
        assert r["n_base"] == len(base)
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({b[1] for b in base}))
        assert {b[1] for b in base} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("under the GNU Lesser General Public License 2.1", "lgpl-2.1"),
    ("GNU General Public License, version 3", "gpl,gpl-3.0"), ("Released under the MIT License.", "mit"), ("er kommt mit der Bahn", ""),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("the eclipse public licence v 2.0", "epl-2.0"),
])
def test_labels(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert licenses.summary(licenses.scan(df)).first()["labels"] == labels


def test_odd_and_empty_tables(spark):
    rows = licenses.summary(licenses.scan(odd(spark))).collect()
    assert len(rows) == odd(spark).count()
    none = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert all((r["n_words"], r["n_base"], r["base_labels"], r["labels"], r["score"]) == (0, 0, "", "", 0.0) for r in none)
    assert licenses.summary(licenses.scan(empty(spark))).count() == 0
