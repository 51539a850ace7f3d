import pytest

from chronoloom.operators.relations import typed_mentions, typed_relations

NAMES = [("PayService", "Service"), ("Mossdb", "Database"), ("OldStore", "Component"), ("NewStore", "Component"), ("New", "Pattern"), ("Ann Lee", "Person"), ("Mossdb", None), (None, "Service"), (" ", "Service"), ("p99 latency", "Metric")]
SCHEMA = "id string, content string, mention string, at int"


def run(spark, *texts):
    docs = spark.createDataFrame([(f"d{i}", t, "x", 1) for i, t in enumerate(texts)] + [("d0", texts[0], "x", 1)], SCHEMA)
    names = spark.createDataFrame(NAMES, "name string, type string")
    named = typed_mentions(docs, names, id="id", text="content", name="name", type="type")
    return named, typed_relations(docs, named, id="id", text="content")


@pytest.mark.parametrize(
    "text,want",
    [
        ("We replaced OldStore with NewStore.", ("NewStore", "replaced", "OldStore")),
        ("NewStore replaced OldStore.", ("NewStore", "replaced", "OldStore")),
        ("We migrated from OldStore to the NewStore.", ("NewStore", "replaced", "OldStore")),
        ("Mossdb is used by PayService.", ("PayService", "depends_on", "Mossdb")),
        ("Mossdb: PayService reads from it.", ("PayService", "depends_on", "Mossdb")),
        ("Ann Lee chose Mossdb for us.", ("Ann Lee", "chose", "Mossdb")),
        ("This is about OldStore. It broke p99 latency again.", ("OldStore", "caused", "p99 latency")),
    ],
)
def test_direction(spark, text, want):
    assert [(r.head, r.relation, r.tail) for r in run(spark, text)[1].collect()] == [want]


def test_overlaps_nulls_and_spans(spark):
    """The name of the table before the form, the longer stays out, bytes of the first mention, nothing from nulls."""
    named, rel = run(spark, "Ünder NewStore and lark-cache; NewStore again", None, "", "Ann Lee and Ann Lee rejected nothing")
    assert {(r.id, r.mention, r.type, r.span_start, r.span_end) for r in named.collect()} == {
        ("d0", "NewStore", "Component", 7, 15), ("d0", "lark-cache", "Infrastructure", 20, 30), ("d3", "Ann Lee", "Person", 0, 7)}
    assert rel.count() == 0


def test_pronouns_and_merge(spark):
    from chronoloom.operators.relations import merged, pronoun_mentions

    docs = spark.createDataFrame([("a", "Ann Lee chose Mossdb. It broke; she fixed it and they slept. Éh, this."), ("b", "It is nothing."), ("c", None)], "id string, content string")
    named = typed_mentions(docs, spark.createDataFrame(NAMES, "name string, type string"), id="id", text="content", name="name", type="type")
    got = [(r.pronoun, r.span_start, r.mention) for r in pronoun_mentions(docs, named, id="id", text="content").orderBy("span_start").collect()]
    assert got == [("It", 22, "Mossdb"), ("she", 32, "Ann Lee"), ("it", 42, "Mossdb"), ("they", 49, "Mossdb"), ("this", 66, "Mossdb")]
    rel = lambda *rows: spark.createDataFrame(list(rows), "id string, head string, relation string, tail string")
    one, two = rel(("a", "x", "chose", "y"), ("a", "x", "chose", "y")), rel(("a", "y", "fixed", "x"), ("a", "x", "fixed", "z"), ("b", "x", "fixed", "y"))
    assert sorted(map(tuple, merged(one, two, id="id").collect())) == [("a", "x", "chose", "y"), ("a", "x", "fixed", "z"), ("b", "x", "fixed", "y")]
