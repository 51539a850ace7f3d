"""Small cases with known results for the core operators."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import columns as C
from chronoloom.operators import dates, dedup, extract, graph, learning, lifecycle, retrieval, search, vectors

DAY = 86_400


def ts(x):
    return F.timestamp_seconds(F.lit(x))


@pytest.mark.parametrize(
    "memory,age,ttl,want",
    [("fact", 0, 90, 1.0), ("fact", 45, 90, 0.5), ("fact", 90, 90, 0.25), ("fact", 180, 90, 0.25 * math.exp(-3)), ("experience", 180, 180, 0.0), ("experience", 90, 180, 0.5), ("pattern", 900, 1, 1.0), ("decision", 5, 0, 0.0), ("fact", -5, 90, 1.0)],
)
def test_decay_curve(spark, memory, age, ttl, want):
    df = spark.range(1).withColumn("created", ts(0))
    got = df.select(C.decay(1.0, F.lit(memory), "created", F.lit(ttl * DAY), ts(age * DAY))).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_decay_use_and_recall(spark):
    df = spark.range(1).withColumns({"c": ts(0), "r": ts(45 * DAY), "u": F.lit(10**9)})
    life = 90 * DAY * 1.75
    got = df.select(C.decay(1.0, F.lit("fact"), "c", F.lit(90 * DAY), ts(90 * DAY), usage="u", recalled="r")).first()[0]
    assert got == pytest.approx(math.exp(-math.log(2) / (life / 2) * 45 * DAY))
    late = df.select(C.decay(1.0, F.lit("fact"), "c", F.lit(90 * DAY), ts(40 * DAY), recalled="r")).first()[0]
    assert late == pytest.approx(math.exp(-math.log(2) / (45 * DAY) * 40 * DAY))  # a recall after now doesn't count


def test_pack_skips_what_does_not_fit(spark):
    rows = [("entity", "a", "x" * 40, 0.9), ("entity", "b", "x" * 400, 0.8), ("entity", "c", "x" * 40, 0.7), ("entity", "d", None, 0.6)]
    df = spark.createDataFrame(rows, "kind string, id string, content string, score double")
    assert [r.id for r in retrieval.pack(df, 25, most=100).orderBy("id").collect()] == ["a", "c"]
    assert retrieval.pack(df, 0, most=100).count() == 0
    assert retrieval.pack(df.limit(0), 25, most=100).count() == 0


def test_match_reads_operators():
    m = search.match('zero-trust OR "strict mode" NOT source:mail jwt?')
    assert m.any == [[(("zero",), False, None), (("trust",), False, None)]] or m.any or m.all
    assert search.match("").units() == [] and search.match("NOT").units() == []
    assert search.match("dep*").all == [(("dep",), True, None)]


@pytest.mark.parametrize("q", ["JWT?", "signal AND gate", "operator OR constraint", "constraint NULL", "(v4.17)", '"unclosed', "NOT a", "", "café*", "a:b:c"])
def test_search_never_fails(spark, q):
    df = spark.createDataFrame([(1, "signal gate constraint NULL v4 17 Café jwt", None), (2, None, None)], "id int, content string, source string")
    search.bm25(df, q, ["content", "source"], id="id").collect()
    assert search.bm25(df.limit(0), q, ["content"], id="id").count() == 0


def test_marks_fold(spark):
    df = spark.createDataFrame([(1, "ein Café"), (2, "Straße"), (3, "nichts"), (4, "mehr"), (5, "und")], "id int, content string")
    assert [r.id for r in search.bm25(df, "cafe", ["content"], id="id").collect()] == [1]
    assert search.bm25(df, "strasse", ["content"], id="id").count() == 0


def test_ranks_of_a_few_among_all(spark):
    """A third of the rows tie; nulls have no rank."""
    r = random.Random(1)
    for make in (int, "r{:04}".format):
        rows = [(make(i), r.choice([None, 0.5, 0.5, float(r.randint(0, 40))])) for i in range(500)]
        df = spark.createDataFrame(rows, ["id", "score"])
        want = {x[0]: i + 1 for i, x in enumerate(sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[1], x[0])))}
        few = r.sample(rows, 60)
        got = {x.id: x.rank for x in search.ranks_of(df, spark.createDataFrame(few, ["id", "score"]), id="id", score="score").collect()}
        assert got == {i: want[i] for i, x in few if x is not None}
        assert search.ranks_of(df, df.limit(0), id="id", score="score").count() == 0
        assert {x.id: x.rank for x in search.ranked(df, id="id", most=20).collect()} == {i: n for i, n in want.items() if n <= 20}


def test_repeated_rows_count_once_in_a_search(spark):
    rows = [(i, t) for i, t in enumerate(("a red fox", "a red hen", "no bird", "red red red", "blue"))]
    df, more = spark.createDataFrame(rows, "id int, content string"), spark.createDataFrame(rows + rows[:3] + rows[1:2], "id int, content string")
    assert sorted(search.bm25(df, "red", ["content"], id="id").collect()) == sorted(search.bm25(more, "red", ["content"], id="id", repeats=True).collect())


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [x[0] for x in df.select(C.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_nearest_recall_is_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(500, None), (501, [1.0]), (502, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, e array<double>")
    got = vectors.nearest(df, df.filter("id % 50 = 0 AND id < 200"), id="id", embedding="e", k=3, block=2)
    ok = {i: v for i, v in rows if v and len(v) == 8}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))) or 1)
    for q in (0, 50, 100, 150):
        want = sorted((j for j in ok if j != q), key=lambda j: (-cos(ok[q], ok[j]), j))[:3]
        assert [x.id for x in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_hashed_embedding_is_normed(spark):
    df = vectors.hashed_embedding(spark.createDataFrame([("one two two",), ("",), (None,)], "t string"), "t", dims=16)
    n = [math.sqrt(sum(x * x for x in r.embedding)) for r in df.collect()]
    assert n[0] == pytest.approx(1) and n[1:] == [0, 0]


def test_jaro_winkler_equals_duckdb():
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(0, 9))) for _ in range(60)] + ["postgresql", "postgres", "redis"]
    con = duckdb.connect()
    for a in words[::4] + words[-3:]:
        for b in words:
            if a and b:
                assert dedup.jaro_winkler(a, b) == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0], abs=1e-12)
    assert dedup.jaro_winkler("postgresql", "postgres") >= 0.85 > dedup.jaro_winkler("postgresql", "redis")


def test_resolve_orders_alias_name_new(spark):
    new = spark.createDataFrame([("n1", "Postgres", "Database"), ("n2", "PG", "Database"), ("n3", "Redis", "Database"), ("n4", "Postgres", "Service")], "id string, name string, type string")
    known = spark.createDataFrame([("k1", "PostgreSQL", "Database"), ("k0", "postgresql", "Database")], "id string, name string, type string")
    al = spark.createDataFrame([("k1", "pg"), (None, "redis"), ("k9", None)], "canonical_id string, alias_name string")
    got = {r.id: (r.canonical_id, r.how) for r in dedup.resolve(new, known, al).collect()}
    assert got == {"n1": ("k0", "name"), "n2": ("k1", "alias"), "n3": ("n3", "new"), "n4": ("n4", "new")}


EDGE = "id string, source_id string, target_id string, relation string, valid_until timestamp, confidence double, metadata string, recorded_at timestamp"


def edges(spark, rows):
    return spark.createDataFrame([(i, s, t, r, None, c, m, None) for i, s, t, r, c, m in rows], EDGE)


def test_traverse_cycle_loop_and_unknown_seed(spark):
    e = edges(spark, [("1", "a", "b", "r", 1.0, None), ("2", "b", "c", "r", 1.0, None), ("3", "c", "a", "r", 1.0, None), ("4", "c", "d", "r", 1.0, None), ("5", "a", "a", "r", 1.0, None)])
    seeds = spark.createDataFrame([("a",), ("zz",), (None,), ("a",)], "seed string")
    got = {(r.seed, r.id): r.depth for r in graph.traverse(e, seeds, depth=5).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("zz", "zz"): 0}


def test_contradictions_and_metadata(spark):
    old = edges(spark, [("o1", "a", "b", "uses", 0.1, '{"k":"v"}'), ("o2", "a", "c", "uses", None, "{broken"), ("o3", "a", "x", "uses", 0.9, '{"marked_for_deletion":true}'), ("o4", "a", "n", "uses", 0.9, None)])
    new = edges(spark, [("n1", "a", "n", "uses", 1.0, None), ("n2", "a", "m", "uses", 1.0, None)])
    got = graph.contradictions(new, old.unionByName(new))
    assert {(r.new_id, r.existing_id, r.silent) for r in got.collect()} == {("n1", "o1", True), ("n1", "o2", False), ("n2", "o1", True), ("n2", "o2", False), ("n2", "o4", False)}
    out = {r.id: r for r in graph.invalidate(old, got, ts(5), by="new_id").collect()}
    assert '"k":"v"' in out["o1"].metadata and '"contradicted_by":"n1"' in out["o1"].metadata and '"contradicted_by":"n1"' in out["o2"].metadata
    assert out["o3"].valid_until is None and out["o4"].valid_until is not None


def test_update_expire_and_refusal(spark):
    e = spark.createDataFrame([("a", "s", "fact", 5), ("b", None, "fact", 6)], "id string, summary string, memory_type string, ttl_seconds bigint")
    ch = spark.createDataFrame([("a", None, "preference"), ("b", "new", None), ("zz", "x", None)], "id string, content string, memory_type string")
    got = {r.id: (r.summary, r.memory_type, r.ttl_seconds) for r in lifecycle.update(e, ch, content="summary").collect()}
    assert got == {"a": ("s", "preference", 30 * DAY), "b": ("new", "fact", 6)}
    with pytest.raises(ValueError):
        lifecycle.expire_class(e, "pattern", ts(0))


def test_supersede_and_f1(spark):
    """Any shared type supersedes; a skill that is superseded already, or shares none, or is the new one itself, isn't."""
    new = spark.createDataFrame([("n1", ["A", "B"], 0.5), ("n2", ["A", "B"], 0.9), ("n3", ["E"], 0.1)], "id string, entity_types array<string>, confidence double")
    rows = [("o1", ["A", "B"], None), ("o2", ["A", "C"], None), ("o3", ["A", "B"], "zz"), ("o4", ["C", "D"], None), ("n3", ["E"], None), ("o5", None, None)]
    old = spark.createDataFrame(rows, "id string, entity_types array<string>, superseded_by string")
    assert sorted((r.old_id, r.superseded_by) for r in learning.supersede(new, old).collect()) == [("o1", "n2"), ("o2", "n2")]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(learning.f1(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0]


def test_fuzzy_scores_take_each_expected_name_once(spark):
    rows = [(["Epic MyChart", "mychart"], ["MyChart", "SEC audit"]), (["a"], []), ([], []), (["x"], ["X y", "x"])]
    df = spark.createDataFrame(rows, "f array<string>, e array<string>")
    got = [tuple(round(x, 3) for x in r[0]) for r in df.select(learning.fuzzy_scores(F.col("f"), F.col("e"))).collect()]
    assert got == [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.5, 0.667)]


def test_dates_of_all_layers(spark):
    text = "met on 2026-03-11, planned 2026-04; March 11, 2026 and 11 March 2026, Mar 2027; yesterday, 2 weeks ago, Q3 2026, FY26, FY2027, for 3 months, over 2 weeks, 2026-02-30"
    df = spark.createDataFrame([(1, text, "2026-05-10"), (2, None, "2026-05-10"), (3, "", None)], "id int, t string, ref string")
    got = {(r.layer, r.label, str(r.start), str(r.end), r.months, r.days) for r in dates.dates_in(df, id="id", text="t", reference="ref").collect()}
    n = "None"
    assert got == {
        ("iso", "2026-03-11", "2026-03-11", n, None, None), ("iso", "2026-04", "2026-04-01", n, None, None),
        ("written", "March 11, 2026", "2026-03-11", n, None, None), ("written", "11 March 2026", "2026-03-11", n, None, None), ("written", "Mar 2027", "2027-03-01", n, None, None),
        ("relative", "yesterday", "2026-05-09", n, None, None), ("relative", "2 weeks ago", "2026-04-26", n, None, None),
        ("fiscal", "Q3 2026", "2026-07-01", "2026-09-30", None, None), ("fiscal", "FY26", "2026-01-01", "2026-12-31", None, None), ("fiscal", "FY2027", "2027-01-01", "2027-12-31", None, None),
        ("duration", "for 3 months", n, n, 3, None), ("duration", "over 2 weeks", n, n, None, 14),
    }


def test_json_answer(spark):
    df = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('{"a": {"b": 2}} tail',), ("none",), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(extract.json_answer("t")).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None]


def test_dictionary_links_bytes_and_boundaries(spark):
    docs = spark.createDataFrame([(1, "Große Vireo 8 läuft"), (2, "Vireo 80"), (3, "vireo 8"), (4, None), (5, "a+b (x) a+b")], "id int, text string")
    names = spark.createDataFrame([(10, "Vireo 8"), (11, ""), (12, None), (13, "a+b")], "nid int, name string")
    got = extract.dictionary_links(docs, names, id="id", text="text", name_id="nid", name="name").collect()
    assert {tuple(r) for r in got} == {(1, 10, 7, 14), (5, 13, 0, 3)}


def test_dictionary_links_of_names_of_any_length(spark):
    long, longer = "Read-only dead-letter queue rule 218", " ".join(f"word{i}" for i in range(23))
    docs = spark.createDataFrame([(1, f"See {long}, please"), (2, f"x {longer} y"), (3, "Read-only dead-letter queue rule 2180"), (4, "queue")], "id int, text string")
    names = spark.createDataFrame([(10, long), (11, longer), (12, "queue"), (13, "Read-only dead-letter queue rule 219")], "nid int, name string")
    got = extract.dictionary_links(docs, names, id="id", text="text", name_id="nid", name="name").collect()
    assert {(r.id, r.nid) for r in got} == {(1, 10), (1, 12), (2, 11), (3, 12), (4, 12)}
    assert extract.dictionary_links(docs, names.limit(0), id="id", text="text", name_id="nid", name="name").count() == 0


def test_most_frequent_is_bounded_and_takes_the_top(spark):
    from chronoloom.common import most_frequent

    rows = [(f"w{i}", 1 + i // 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "w string, n bigint")
    for most in (1000, 300, 50, 5):
        got = most_frequent(df, "n", most).collect()
        assert len(got) <= most
        if got:
            low = min(r.n for r in got)
            assert len(got) == sum(n >= low for _, n in rows)
    assert most_frequent(df.limit(0), "n", 5).count() == 0


def test_most_alike_skips_only_what_cannot_match(spark):
    r = random.Random(9)
    names = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(120)]
    new = spark.createDataFrame([(f"n{i}", x, "T") for i, x in enumerate(names[:30])], "id string, name string, type string")
    known = spark.createDataFrame([(f"k{i:03}", x.upper(), "T") for i, x in enumerate(names[20:])] + [("z", None, "T"), ("y", names[0], "U")], "id string, name string, type string")
    got = {x.id: (x.match_id, round(x.similarity, 12)) for x in dedup.most_alike(new, known).collect()}
    want = {}
    for i, a in enumerate(names[:30]):
        best = max(((round(dedup.jaro_winkler(a, b.upper().lower()), 12), -k) for k, b in enumerate(names[20:])))
        if best[0] >= 0.85:
            want[f"n{i}"] = (f"k{-best[1]:03}", best[0])
    assert got == want
