from itertools import combinations

from chronoloom.llm.names import identity_pairs, lcs_length, name_identities, name_parts

ENT = "id string, name string, entity_type string, record int"
AL = "alias_id string, canonical_id string, alias_name string, words int"
KW = dict(entity_id="id", entity_name="name", entity_type="entity_type", alias_id="alias_id", canonical_id="canonical_id", alias_name="alias_name")


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        return row[-1]

    for a in ("kouckotipello", "abc", "", "aaaa", "zousobulmastey"):
        for b in ("kouckotipeollo", "abc", "", "aba", "zuosobulmasty"):
            assert lcs_length(a, b) == slow(a, b)


def test_parts():
    assert name_parts("Prof. Katherine L. Rorvazalzoxau") == (["katherine", "l", "rorvazalzoxau"], False)
    assert name_parts("The X  Water Technologies P.L.C.") == (["x", "water", "technologies"], True)
    assert name_parts("Zeim S/W Dev Ltd.") == (["zeim", "software", "dev"], True)
    assert name_parts(None) == ([], False) and name_parts(" ,. ") == ([], False)


GROUPS = [
    ["Katherine Rorvazalzoxau", "RORVAZALZOXAU, KATHY", "Katherine L. Rorvazalzoxau", "Katherine Roavazalzoxau", "K. Rorvazalzoxau", "Dr. Rorvazalzoxau Katherine", "Katherlne Rorvazalzoxau"],
    ["Priya Rorvazalzoxau"],
    ["Andre Steiskefiremo", "Andre T. Steiskefiremo", "steiskefiremo, andre"],
    ["Andrea Steiskefiremo", "Andrea Steiskefirmo"],
    ["Andre Kouckotipello", "Andre Kouckotipello "], ["Andrea Kouckotipello"], ["Andre Thimatorvanin"], ["Andrea Thimatorvanin"],
    ["Katherine Steiskefiremo"], ["Katherine Kouckotipello"],
]
ORGS = [
    ["Marebirremo Foods International PLC", "MAREBIRREMO FOODS INTERNATIONAL", "The Marebirremo FI P.L.C.", "Mrebirremo Foods Int. plc", "Marebirremo PLC (Foods International)"],
    ["Marebirremo Water Technologies Limited", "Marebirremo WT Ltd"],
    ["Kirvokolhorvau Power and Light Limited", "The Kirvokolhorvau Power & Light"], ["Kirvokolhorvau Foods International Limited"], ["Beimeberthiro Water Technologies GmbH", "Water Technologies Beimeberthiro"],
]


def test_identities(spark):
    """Typos, initials, titles, order, short forms, near given names, trades, untyped aliases, nulls, repeats, clashing columns."""
    ents, als, want, n = [], [], set(), 0
    for kind, groups in (("Person", GROUPS), ("ORGANIZATION", ORGS)):
        for g in groups:
            ids = []
            for k, name in enumerate(g):
                n += 1
                i = f"r{n:03}"
                ids.append(i)
                (als.append((i, None, name, 1)) if k == 1 and len(g) > 2 else ents.append((i, name, kind, 1)))
            want |= set(combinations(sorted(ids), 2))
    ents += ents[:5] + [("n1", None, "Person", 1), ("n2", " ", "Person", 1), (None, "Katherine Rorvazalzoxau", "Person", 1), ("n3", "Katherine Rorvazalzoxau", "Service", 1), ("n4", "Katherine Rorvazalzoxau", None, 1)]
    als += [("a1", None, None, 1), ("a2", None, "", 1), ("a3", "r001", "Kathy Rorvazalzoxau", 1), ("a4", "r001", None, 1)]
    e, a = spark.createDataFrame(ents, ENT), spark.createDataFrame(als, AL)
    got = identity_pairs(name_identities(e, a, **KW)).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_ambiguous_initial_links_nothing(spark):
    e = [("1", "Katherine Rorvazalzoxau", "Person", 0), ("2", "Kwame Rorvazalzoxau", "Person", 0), ("3", "K. Rorvazalzoxau", "Person", 0)]
    got = name_identities(spark.createDataFrame(e, ENT), spark.createDataFrame([], AL), **KW)
    assert {r.record for r in got.collect()} == {"1", "2"}


def test_empty(spark):
    e, a = spark.createDataFrame([], ENT), spark.createDataFrame([], AL)
    assert identity_pairs(name_identities(e, a, **KW)).count() == 0


def test_suffix_candidates_miss_no_single_edit(spark):
    """Any two words with one letter wrong, missing, added or swapped meet, also through crowded suffixes."""
    import random

    from chronoloom.llm.names import suffix_candidates

    r = random.Random(6)
    words = {"".join(r.choice("abc") for _ in range(r.randint(4, 7))) for _ in range(400)}
    for w in list(words)[:60]:
        i = r.randrange(len(w))
        words |= {w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "y" + w[i:]}
    words = sorted(w for w in words if len(w) >= 4)

    def one_edit(a, b):
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    df = spark.createDataFrame([("p", w, 1) for w in words] + [("o", w + "a", 1) for w in words], "kind string, w string, n bigint")
    for common in (2, 60):
        got = {(x.t, x.u) for x in suffix_candidates(df, common=common).filter("kind = 'p'").collect()}
        want = {(a, b) for a, b in combinations(words, 2) if one_edit(a, b)}
        assert want <= got and all({a, b} <= set(words) for a, b in got)


def test_crowded_suffixes_lose_no_pair(spark):
    """Words that all share their ends, of which every suffix counts as crowded: each pair of an LCS distance up to three meets."""
    import random

    from chronoloom.llm.names import suffix_candidates

    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(7, 9))) for _ in range(12)]
    words = set(base)
    for w in base:
        for edits in (1, 2, 3, 3):
            x = w
            for _ in range(edits):
                i = r.randrange(len(x))
                x = r.choice((x[:i] + r.choice("xyz") + x[i:], x[:i] + x[i + 1 :], x[:i] + r.choice("xyz") + x[i + 1 :]))
            words.add(x)
    words = sorted({f"so{w}key" for w in words})
    near = {(a, b) for a, b in combinations(words, 2) if (d := len(a) + len(b) - 2 * lcs_length(a, b)) <= 3 and 1 - d / (len(a) + len(b)) >= 0.85}
    df = spark.createDataFrame([("p", w, 1) for w in words], "kind string, w string, n bigint")
    got = {(x.t, x.u) for x in suffix_candidates(df, common=0).collect()}
    assert len(near) > 20 and near <= got


def test_short_form_of_several_names(spark):
    """Sam is the Samuel or the Samantha of the family that has one only; with neither the usual one."""
    e = [
        ("1", "Samuel Rorvazalzoxau", "Person", 0), ("2", "Sam Rorvazalzoxau", "Person", 0), ("3", "Samantha Kouckotipello", "Person", 0), ("4", "Kouckotipello, Sam", "Person", 0),
        ("5", "Samuel Thimatorvanin", "Person", 0), ("6", "Samantha Thimatorvanin", "Person", 0), ("7", "Sam Thimatorvanin", "Person", 0),
    ]
    got = {tuple(r) for r in identity_pairs(name_identities(spark.createDataFrame(e, ENT), spark.createDataFrame([], AL), **KW)).collect()}
    assert got == {("1", "2"), ("3", "4"), ("6", "7")}


def test_misspelt_words_stay_off_the_driver(spark, monkeypatch):
    """30,000 misspelt words are neither fetched nor broadcast; by broadcast or by shuffle the identities are the same."""
    from pyspark.sql import functions as F

    from chronoloom.common import bounded_side, table
    from chronoloom.llm import names

    many = spark.range(30_000).select(F.lit("p").alias("kind"), F.concat(F.lit("mis"), "id").alias("w"), F.lit("thimatorvanin").alias("c"))
    most, fetch = [0], type(many).collect

    def collect(df):
        got = fetch(df)
        most[0] = max(most[0], len(got))
        return got

    e = [("1", "Andre Mis7", "Person", 0), ("2", "Mis29999, Andre", "Person", 0), ("3", "Andre Thimatorvanin", "Person", 0), ("4", "Andre Mis30000", "Person", 0)]
    found = []
    for bound in (names.BROADCAST, 50_000):
        made = table(many, "canonical")
        with monkeypatch.context() as m:
            m.setattr(names, "BROADCAST", bound)
            m.setattr(names, "canonical_words", lambda words, made=made: made)
            m.setattr(type(made), "collect", collect)
            got = name_identities(spark.createDataFrame(e, ENT), spark.createDataFrame([], AL), **KW)
        assert most[0] <= 1000
        found.append({tuple(r) for r in identity_pairs(got).collect()})
    assert found == [{("1", "2"), ("1", "3"), ("2", "3")}] * 2
    hinted = [bounded_side(made, n)._jdf.queryExecution().analyzed().toString() for n in (names.BROADCAST, 30_000)]
    assert ["broadcast" in x for x in hinted] == [False, True]
