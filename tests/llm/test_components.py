import random

import pytest

from chronoloom.llm import components as C


def union(pairs):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(p)}


@pytest.mark.parametrize("case", ["random", "chain", "hub", "mixed"])
def test_against_union_find(spark, monkeypatch, case):
    r = random.Random(4)
    if case == "chain":
        pairs = [(i, i + 1) for i in range(300)]
        r.shuffle(pairs)
    elif case == "hub":  # one node with nearly all edges takes the way for hubs
        pairs = [(500, i) for i in range(1500)] + [(9000, 9001)]
    else:
        pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)]
    if case == "mixed":
        pairs += [(b, a) for a, b in pairs[:50]] + pairs[:30] + [(None, 1), (2, None), (777, 777), (5, 5)]
    df = spark.createDataFrame([(*p, "x") for p in pairs], "u bigint, m bigint, v string")
    got = C.components(df, a="u", b="m").collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.component for x in got} == union(pairs)


def test_groups_by_shared_value(spark):
    rows = [("b", "x"), ("a", "x"), ("a", "y"), ("c", "y"), ("d", "z"), (None, "x"), ("e", None), ("b", "x"), ("f", "w"), ("g", "w")]
    got = C.groups_by_shared_value(spark.createDataFrame(rows, "node string, s string"), node="node", value="s").collect()
    assert {(r.node, r.group_id) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("f", "f"), ("g", "f")}


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert C.components(df, a="a", b="b").count() == 0
    assert C.groups_by_shared_value(df, node="a", value="b").count() == 0


def test_query_against_sql(spark):
    from compare import compare

    from chronoloom.llm import queries

    assert compare(spark, queries.QUERIES["p5_found"], queries.SQL["p5_found"], "/root/testdata/sf0.001") > 0
