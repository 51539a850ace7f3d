import itertools

import pytest

from chronoloom.llm.skeleton import add_skeleton, same_look_pairs, skeleton

SAME = [
    ("Café", "Café"), ("ABC 12", "ＡＢＣ １２"), ("pass word", "pa​ss wo­rd"), ("paypal", "раураl"), ("HOPE", "НОРЕ"),
    ("Ωμέγα", "Ωμέγα"), ("a b", "a　b"), ("x﻿", "x"), ("a\r\nb", "a\nb"), ("й", "й"), ("ok👍", "ok⁠👍"),
]
OTHER = [
    ("Cafe", "Café"), ("x2", "x²"), ("a", "A"), ("a.", "a"), ("a\nb", "a b"), ("a–b", "a-b"), ("…", "..."), ("“a”", '"a"'), ("a  b", "a b"), ("🧑🏽‍🚀", "🧑🏽🚀"),
    ("1", "l"), ("½", "1/2"), ("ﬁ", "fi"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert skeleton(a) != skeleton(b)


def test_idempotent_and_null():
    for a, b in SAME + OTHER:
        assert skeleton(skeleton(a)) == skeleton(a) and skeleton(skeleton(b)) == skeleton(b)
    assert skeleton(None) is None and skeleton("") == "" and skeleton("​") == ""


def brute(rows):
    out = set()
    rows = [(i, t) for i, t, *_ in rows if t is not None and skeleton(t).strip()]
    for (i, a), (j, b) in itertools.combinations(sorted(set(rows)), 2):
        if i != j and a != b and skeleton(a) == skeleton(b):
            out.add((min(i, j), max(i, j)))
    return out


def test_pairs_of_rows(spark):
    """Copies, repeats, nulls, blank and undrawn texts, a long text, clashing columns."""
    long = "word " * 40_000
    rows = [(1, "Café", 0), (2, "Café", 0), (3, "Café", 0), (3, "Café", 0), (4, None, 0), (5, "", 0), (6, "​", 0), (7, " ", 0), (8, " ", 0), (9, long, 0), (10, long.replace("o", "о"), 0), (11, "Cafe", 0), (12, "Ca​fé", 0)]
    df = spark.createDataFrame(rows, "i bigint, x string, k int")
    got = same_look_pairs(df, id="i", text="x").collect()
    assert {tuple(r) for r in got} == brute(rows) == {(1, 2), (1, 3), (1, 12), (2, 12), (3, 12), (9, 10)}
    assert len(got) == 6 and got[0].__fields__ == ["i_a", "i_b"]
    assert same_look_pairs(df.limit(0), id="i", text="x").count() == 0
    assert [r.skeleton for r in add_skeleton(df.filter("i IN (1, 4)").orderBy("i"), "x").collect()] == ["Café", None]


def test_pairs_against_brute_force(spark):
    from chronoloom.llm.queries import p9_found

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in p9_found(spark, sf).collect()} == brute(rows)


def test_further_scripts_and_what_a_reader_tells_apart():
    assert skeleton("ꓮꓐ ᎪᏴ 𝐀𝒃 ᴄᴏ ᴀ") == skeleton("AB AB Ab co A")
    assert skeleton("ı") != skeleton("i") and skeleton("x²") != skeleton("x2") and skeleton("Ａ") != skeleton("a")
    assert skeleton("a\rb\r\nc") == "a\nb\nc" and skeleton("é\rb") == skeleton("e\u0301\nb")
    assert skeleton("\uf8ff é") != skeleton("\u200d é") and "\uf8ff" in skeleton("\uf8ff é")
    assert skeleton("👩\u200d🚀 a\u200db") == "👩\u200d🚀 ab"


def test_groups(spark):
    rows = [(1, "no op"), (2, "nо op"), (3, "no op"), (4, "other"), (5, "other"), (6, None), (7, " "), (2, "nо op"), (8, "ｎo op")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "i bigint, t string, group_id int, k string")
    from chronoloom.llm.skeleton import same_look_groups

    got = same_look_groups(df, id="i", text="t").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (8, 1, 3)]
    assert same_look_groups(df.limit(0), id="i", text="t").count() == 0
