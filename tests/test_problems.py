import random
from datetime import datetime, timedelta, timezone

import pytest
from compare import compare
from pyspark.sql import functions as F

from chronoloom.operators.asof import as_known
from chronoloom.operators.intervals import periods_and_gaps
from chronoloom.plans import problems

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_against_sql(spark, name):
    assert compare(spark, problems.QUERIES[name], problems.SQL[name], SF) > 0


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EDGES = "id string, src string, rel string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, event string, k0 int"
RECALLS = "recall_id bigint, ent string, rel string, at timestamp, lo int, fact string"


def at(x):
    return None if x is None else T0 + timedelta(seconds=x)


def brute(events, facts):
    out = {}
    for rid, ent, rel, t, *_ in events:
        if ent is None or rel is None or t is None:
            continue
        best = [
            (e[5], e[3] or datetime.min.replace(tzinfo=timezone.utc), e[0])
            for e in facts
            if e[1] == ent and e[2] == rel and e[5] and e[5] <= t and (e[3] is None or e[3] <= t) and (e[4] is None or e[4] > t)
        ]
        if best:
            out[rid] = max(best)[2]
    return out


@pytest.mark.parametrize("per_period", [1, 3, 1000])
def test_as_known_replays(spark, per_period):
    """Hot key, null bounds, ties in recorded_at, repeats, ends before starts, clashing extra columns."""
    r = random.Random(5)
    some = lambda p, lo, hi: None if r.random() < p else r.randint(lo, hi)
    facts = [
        (f"e{i:03}", r.choice(["a", "a", "a", "b", None]), r.choice(["x", "x", "y", None]), at(some(0.2, 0, 300)), at(some(0.3, 50, 400)), at(some(0.05, 0, 300) and r.randint(0, 30) * 10), "c", 1)
        for i in range(300)
    ]
    facts += facts[:40]
    events = [(i, r.choice(["a", "a", "b", None]), r.choice(["x", "x", "y", None]), at(some(0.1, 0, 400)), 1, "q") for i in range(300)]
    events += events[:30]
    out = as_known(
        spark.createDataFrame(events, RECALLS), spark.createDataFrame(facts, EDGES),
        event_id="recall_id", event_keys=["ent", "rel"], event_time="at", fact_keys=["src", "rel"], fact_id="id", changes_per_period=per_period,
    ).collect()
    assert len(out) == len({x.recall_id for x in out})
    assert {x.recall_id: x.id for x in out} == brute(events, facts)


def test_as_known_empty(spark):
    ev, fa = spark.createDataFrame([], RECALLS), spark.createDataFrame([], EDGES)
    assert as_known(ev, fa, event_id="recall_id", event_keys=["ent", "rel"], event_time="at", fact_keys=["src", "rel"], fact_id="id").count() == 0


def merged(rows):
    out, by = set(), {}
    for a, s, e in rows:
        if s is not None and e is not None and s < e:
            by.setdefault(a, []).append((s, e))
    for a, iv in by.items():
        per = []
        for s, e in sorted(iv):
            if per and s <= per[-1][1]:
                per[-1][1] = max(per[-1][1], e)
            else:
                per.append([s, e])
        out |= {(a, "period", s, e) for s, e in per} | {(a, "gap", p[1], q[0]) for p, q in zip(per, per[1:])}
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("per_shard", [2, 7, 10000])
def test_periods_shards(spark, seed, per_shard):
    """Shards narrower than intervals, touching bounds, far outliers, repeats, null keys and bounds."""
    r = random.Random(seed)
    rows = []
    for _ in range(150):
        s = r.randint(0, 400) * r.choice([1, 5])
        rows.append((r.choice(["h", "h", "h", None]), s, s + r.choice([-3, 0, 1, 2, 5, r.randint(1, 300) if seed % 2 else 3])))
    rows += [("h", 0, 3), ("h", 10**15, 10**15 + 5), ("z", 1, 2), ("h", None, 5), ("h", 5, None)] + rows[:20]
    if seed % 3 == 0:
        rows += [("h", 0, 10**12)]
    df = spark.createDataFrame(rows, "ent string, s bigint, e bigint").withColumns({"lo": F.lit(1), "shard": F.lit("x"), "first": F.lit(1)})
    out = periods_and_gaps(df, keys=["ent"], start="s", end="e", rows_per_shard=per_shard).collect()
    assert len(out) == len(set(out))
    assert {tuple(x) for x in out} == merged(rows)


def test_periods_empty(spark):
    df = spark.createDataFrame([], "ent string, s bigint, e bigint")
    assert periods_and_gaps(df, keys=["ent"], start="s", end="e").count() == 0


def test_many_keys_take_the_shuffle_join(spark, monkeypatch):
    """Beyond the bound of the broadcast the grids are joined by shuffle, with the same result."""
    from chronoloom.common import keyed_side
    from chronoloom.operators import asof, intervals

    r = random.Random(11)
    rows = [(f"k{r.randint(0, 5)}" if r.random() < 0.9 else None, s, s + r.randint(1, 40)) for s in (r.randint(0, 2000) for _ in range(300))]
    df = spark.createDataFrame(rows, "ent string, s bigint, e bigint")
    for module in (intervals, asof):
        monkeypatch.setattr(module, "keyed_side", lambda side, keys: keyed_side(side, keys, most=0, salts=3))
    out = periods_and_gaps(df, keys=["ent"], start="s", end="e", rows_per_shard=5).collect()
    assert {tuple(x) for x in out} == merged(rows)
    facts = [(f"e{i:03}", f"k{i % 4}", "x", at(r.randint(0, 300)), at(r.randint(100, 400)), at(r.randint(0, 200)), "c", 1) for i in range(200)]
    events = [(i, f"k{i % 5}", "x", at(r.randint(0, 400)), 1, "q") for i in range(150)]
    got = as_known(
        spark.createDataFrame(events, RECALLS), spark.createDataFrame(facts, EDGES),
        event_id="recall_id", event_keys=["ent", "rel"], event_time="at", fact_keys=["src", "rel"], fact_id="id", changes_per_period=4,
    ).collect()
    assert {x.recall_id: x.id for x in got} == brute(events, facts)


def test_hot_key_among_many_busy_ones_is_spread(spark):
    """50,000 busy keys beside one with a third of all rows: none of four tasks gets much more than a quarter."""
    from chronoloom.common import keyed_side

    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(60_000)))
    df = spark.range(600_000).withColumn("k", key)
    side = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("x"))
    assert side.count() > 50_000
    out = keyed_side(side, ["k"])(df, "n")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600_000 and max(sizes) < 0.35 * 600_000
    want = df.join(side, "k", "left").select("id", "k", "n", "x")
    assert out.select("id", "k", "n", "x").exceptAll(want).isEmpty() and out.filter("x IS NULL").isEmpty()


def test_small_side_has_a_bound(spark):
    from chronoloom.common import small_side

    df = spark.range(30).withColumn("x", F.lit("a"))
    assert "Hint" in small_side(df, 30)._jdf.queryExecution().logical().toString()
    assert small_side(df, 29) is df
