import random

import numpy as np

from chronoloom.llm.leak import karp_rabin, leaked_items, tiles

ITEM = [f"item{i}" for i in range(60)]


def noise(n, seed):
    r = random.Random(seed)
    return [f"n{r.randint(0, 10**9)}" for _ in range(n)]


def doc(*parts):
    return " ".join(w for p in parts for w in p)


def edit(words, *at):
    return [("changed" if i in at else w) for i, w in enumerate(words)]


def cases():
    big = noise(50_000, 9)
    return {
        1: (doc(noise(30, 1), ITEM, noise(30, 2)), 60),
        2: (doc(noise(9, 3), ITEM[10:32]), 22),
        3: (doc(ITEM[:19]), None),  # less than a third
        4: (doc(noise(9, 4), edit(ITEM[20:42], 3), noise(3, 5)), 22),  # one word changed near the end of the run
        5: (doc(ITEM[:22]).upper().replace(" ", ",\n** "), 22),
        6: (doc(ITEM[36:], ITEM[:12], ITEM[24:36]), 24),  # another order: the longest passage counts
        7: (doc(big, ITEM[5:35], big), 30),
        8: (doc(noise(50, 6)), None),
        9: ("", None), 10: (None, None), 11: ("  \n", None),
        12: (doc(ITEM[:12], noise(5, 7), ITEM[12:24], noise(5, 8)), None),  # two pieces of a fifth each
        13: (doc(ITEM[:10], ["extra"], ITEM[10:20], ITEM[21:31]), 31),  # a word added, a word dropped
        14: (doc(ITEM[:22]).replace("i", "і").replace(" ", " "), 22),
    }


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in cases().items()] + [(1, cases()[1][0], "x")], "d bigint, x string, i string")
    items = spark.createDataFrame([(100, doc(ITEM), 1), (100, doc(ITEM), 1), (101, "too short to leak", 1), (102, None, 1), (103, "", 1), (104, doc(noise(40, 77)), 1)], "i bigint, x string, d int")
    for per_block in (20_000, 1):
        got = leaked_items(docs, items, id="d", text="x", item_id="i", item_text="x", items_per_block=per_block).collect()
        assert {(r.d, r.i): r.words for r in got} == {(i, 100): n for i, (_, n) in cases().items() if n}
        assert len(got) == len({(r.d, r.i) for r in got})
    assert leaked_items(docs.limit(0), items, id="d", text="x", item_id="i", item_text="x").count() == 0
    assert leaked_items(docs, items.limit(0), id="d", text="x", item_id="i", item_text="x").count() == 0


def test_rolling_hash():
    h = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    doc_, part = np.concatenate([h, h[100:140], h]), h[100:140]
    a, b = karp_rabin(doc_, 5), karp_rabin(part, 5)
    for k, x in enumerate(b):
        assert {100 + k, 500 + k, 640 + k} - {500 + 36 + k} <= set(np.flatnonzero(a == x)) | {540 + 100 + k}
    assert len(karp_rabin(part, 50)) == 0


def test_tiles_do_not_overlap_and_take_the_longest_first():
    item = np.arange(40, dtype=np.uint64)
    d = np.concatenate([item[:10], [99], item[5:35], [98], item[:40]]).astype(np.uint64)
    hits = {int(x): k for k, x in enumerate(karp_rabin(item, 5))}
    start = [(p, hits[int(x)]) for p, x in enumerate(karp_rabin(d, 5)) if int(x) in hits]
    got = tiles(d, item, 5, start)
    assert got == [(42, 0, 40)]
    assert tiles(d, item, 5, []) == []


def test_against_brute_force(spark):
    """Every run of 14 equal words or more that is a third of the item is found."""
    from chronoloom.llm.queries import p8_found
    from chronoloom.llm.words import folded

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text").collect()
    got = {tuple(r) for r in p8_found(spark, sf).collect()}
    padded = {d.doc_id: " " + " ".join(folded(d.text)) + " " for d in docs}
    for it in items:
        w = folded(it.text)
        n = max(14, -(-len(w) // 3))
        runs = [" " + " ".join(w[i : i + n]) + " " for i in range(len(w) - n + 1)]
        for i, t in padded.items():
            if any(r in t for r in runs):
                assert (i, it.item_id) in got


def test_least_seeds_loses_no_run():
    """Runs of every size with the edits spread as badly as can be still have that many places."""
    from chronoloom.llm.leak import least_seeds

    for seed in (4, 5, 6):
        need = least_seeds(14, 13.0, seed)
        assert need > 1 or seed > 5
        for n in range(14, 200):
            edits = max(1, round(n / 13))
            pieces = [(n - edits) // (edits + 1) + (k < (n - edits) % (edits + 1)) for k in range(edits + 1)]
            assert sum(max(0, m - seed + 1) for m in pieces) >= need


def test_reordered_passages_by_coverage(spark):
    words = noise(60, 41)
    mixed = [w for at in (40, 10, 50, 0, 30, 20) for w in words[at : at + 10]]
    items = spark.createDataFrame([(1, doc(words))], "i bigint, x string")
    docs = spark.createDataFrame([(10, doc(mixed)), (11, doc(words[:12]))], "d bigint, x string")
    run = lambda **how: {(r.d, r.covered) for r in leaked_items(docs, items, id="d", text="x", item_id="i", item_text="x", **how).collect()}
    assert run() == set() and run(least_cover=0.5) == {(10, 60)}


def test_frames_of_another_item(spark):
    frame = "which of {} {} and {} must silence the orchard feed when relay {} is naive at the top of the hour"
    items = [(1, frame.format("ann", "bob", "cid", "5968") + " and so it went"), (2, frame.format("dan", "eve", "fay", "1391") + " or it did not")]
    docs = [(10, "before " + items[0][1] + " after"), (20, "before " + items[1][1].replace("feed", "gate") + " after")]
    df, it = spark.createDataFrame(docs, "d bigint, x string"), spark.createDataFrame(items, "i bigint, x string")
    got = leaked_items(df, it, id="d", text="x", item_id="i", item_text="x").collect()
    assert {(r.d, r.i) for r in got} == {(10, 1), (20, 2)}


def test_a_run_counts_whatever_other_items_share_its_place(spark):
    shared = [f"s{i}" for i in range(14)]
    a = noise(20, 21) + shared + noise(26, 22)  # 14 of 60 words are less than a third
    b = edit(shared, 7) + noise(26, 23)
    items = spark.createDataFrame([(1, doc(a)), (2, doc(b))], "i bigint, x string")
    docs = spark.createDataFrame([(10, doc(noise(9, 24), shared, noise(9, 25))), (11, doc(noise(9, 26), a[15:40], noise(9, 27)))], "d bigint, x string")
    for per_block in (20_000, 1):
        got = leaked_items(docs, items, id="d", text="x", item_id="i", item_text="x", items_per_block=per_block).collect()
        assert {(r.d, r.i) for r in got} == {(10, 2), (11, 1), (11, 2)}


def test_blocks_do_not_change_frames(spark):
    frame = "must silence the orchard feed when relay {} is naive at the top of the hour"
    items = spark.createDataFrame([(i, frame.format(n)) for i, n in enumerate((5968, 1391, 77))], "i bigint, x string")
    docs = spark.createDataFrame([(10, frame.format(5968)), (11, frame.format("now"))], "d bigint, x string")
    for per_block in (20_000, 1):
        got = leaked_items(docs, items, id="d", text="x", item_id="i", item_text="x", items_per_block=per_block).collect()
        assert {(r.d, r.i) for r in got} == {(10, 0), (11, 0), (11, 1), (11, 2)}


def test_numbers_of_an_edited_run(spark):
    words = noise(30, 31)
    item = words[:8] + ["7646"] + words[8:]
    items = spark.createDataFrame([(1, doc(item))], "i bigint, x string")
    part = lambda n, stop: doc(noise(5, 32), words[:8], [n], words[8:stop])
    docs = [(1, part("7616", 15)), (2, part("1234", 15)), (3, part("1234", 26)), (4, part("word", 15)), (5, part("764", 15))]
    got = leaked_items(spark.createDataFrame(docs, "d bigint, x string"), items, id="d", text="x", item_id="i", item_text="x").collect()
    assert {(r.d, r.words) for r in got} == {(1, 16), (3, 27), (4, 16), (5, 16)}
