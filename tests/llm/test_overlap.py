import collections

import pytest

from chronoloom.llm.overlap import cross_split_overlaps, overlap_pairs, overlap_report
from chronoloom.llm.words import folded

SCHEMA = "id bigint, text string, split string, source string, k int"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


def brute(rows, least=0.66, order=0.8):
    out = set()
    bags = [(i, s.strip().lower(), collections.Counter(w), w) for i, t, s, *_ in rows if t and s and (w := folded(t))]
    for i, s, a, x in bags:
        for j, z, b, y in bags:
            if s == "train" and z in ("val", "test", "dev"):
                n = sum((a & b).values())
                if n / (len(x) + len(y) - n) >= least and (x == y or x == y[: len(x)] or 2 * common(x, y) >= order * (len(x) + len(y))):
                    out.add((min(i, j), max(i, j)))
    return out


BASE = "[E1]alpha[/E1] replaced [E2]beta[/E2] in the west zone because nobody trusted the old dashboard any more"


def rows():
    long = " ".join(f"w{i}" for i in range(30_000))
    return [
        (1, BASE, "train", "a", 0), (2, BASE.upper().replace("[E1]", "<head>").replace("[/E1]", "</head>"), "val", "b", 0), (3, BASE.replace("west", "east"), "Test ", None, 0),
        (4, "alpha replaced beta in another town for reasons that no reader of this text will ever learn", "dev", "b", 0), (5, BASE, None, "b", 0), (6, None, "train", "b", 0), (7, "", "val", "b", 0),
        (8, "...", "train", "b", 0), (9, "!!!", "val", "b", 0), (10, long, "train", "c", 0), (11, long + " more", "dev", "c", 0), (12, BASE, "train", "a", 0), (12, BASE, "train", "a", 0), (13, "ｏｋ", "train", "a", 0), (14, "ok", "val", "a", 0), (15, BASE, "val", "b", 0),
        (16, "one two three four five six. seven eight nine ten eleven twelve", "train", "d", 0), (17, "seven eight nine ten eleven twelve. one two three four five six", "val", "d", 0),
    ]


def test_pairs(spark):
    """Markers, case, one changed word, nulls, wordless and long texts, copies, repeats, odd split names."""
    df = spark.createDataFrame(rows(), SCHEMA)
    links, members = cross_split_overlaps(df, id="id", text="text", split="split", source="source")
    got = overlap_pairs(links, members).collect()
    assert {tuple(r) for r in got} == brute(rows()) >= {(1, 2), (1, 3), (10, 11), (13, 14), (1, 15), (12, 15)}
    assert len(got) == len(set(got)) and not any(4 in r or 17 in r for r in got)  # 17: the same sentences in another order


def test_report(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    rep = {(r.split, r.source): (r.n_examples, r.n_overlapping, r.n_pairs) for r in overlap_report(*cross_split_overlaps(df, id="id", text="text", split="split", source="source")).collect()}
    assert rep[("val", "b")] == (2, 2, 4) and rep[("test", None)] == (1, 1, 2) and rep[("dev", "b")] == (1, 0, 0)


def test_empty(spark):
    links, members = cross_split_overlaps(spark.createDataFrame([], SCHEMA), id="id", text="text", split="split")
    assert overlap_pairs(links, members).count() == 0 and overlap_report(links, members).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_brute_force(spark, sf):
    from chronoloom.llm.queries import p2_found

    data = [tuple(r) for r in spark.read.parquet(f"{sf}/training_data.parquet").select("example_id", "text", "split").collect()]
    assert {tuple(r) for r in p2_found(spark, sf).collect()} == brute(data)
