"""Evaluation texts leaking into a corpus: greedy string tiling over shared-token seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chronoloom.common import spread
from chronoloom.llm.words import WordHashes, folded

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))  # the base is odd


def karp_rabin(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words: the polynomial in BASE modulo 2^64, by the running sum of Karp and Rabin."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(np.full(len(h), BASE, np.uint64)))])
    # a run that starts at i carries BASE^(i+1) too much
    return (total[n:] - total[:-n]) * np.cumprod(np.full(len(h) - n + 1, INVERSE, np.uint64))


def tiles(doc: np.ndarray, item: np.ndarray, seed: int, start: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc position, item position, length), longest first, no word in two tiles.

    ``start`` are places where a run of ``seed`` words is shared. The longest
    match through any of them is marked, then the next one over words still
    unmarked, until none of at least ``seed`` words is left.
    """
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    todo = start
    while todo:
        grown, seen = [], {}
        for d, i in sorted(todo):
            diag = d - i
            if seen.get(diag, -1) >= d:
                continue  # inside the match found on this diagonal
            if used_d[d : d + seed].any() or used_i[i : i + seed].any():
                continue
            n = min(len(doc) - d, len(item) - i)
            stop = np.flatnonzero((doc[d : d + n] != item[i : i + n]) | used_d[d : d + n] | used_i[i : i + n])
            n = int(stop[0]) if len(stop) else n
            if n >= seed:
                grown.append((n, d, i))
                seen[diag] = d + n - seed
        if not grown:
            break
        longest = max(grown)[0]
        for n, d, i in sorted(grown, key=lambda x: (-x[0], x[1], x[2])):
            if n < longest:
                break
            if not used_d[d : d + n].any() and not used_i[i : i + n].any():
                used_d[d : d + n] = used_i[i : i + n] = True
                out.append((d, i, n))
        todo = [(d + k, i + k) for n, d, i in grown for k in range(n - seed + 1) if not (used_d[d + k : d + k + seed].any() or used_i[i + k : i + k + seed].any())]
    return out


STEPS = sorted(((a, b) for a in range(4) for b in range(4) if a or b), key=lambda s: (max(s), sum(s)))


def numbers(words: list[str]) -> list[str]:
    """The words that are numbers, "" for the others."""
    return [w if w.isdigit() else "" for w in words]


def _slip(x: str, y: str) -> bool:
    """Whether one character is changed, added or dropped at most."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), len(y))
    return x[k + 1 :] == y[k + (len(x) == len(y)) :]


def _other_number(x: list[str], y: list[str]) -> bool:
    """Whether words with a number stand in the place of words with quite another one."""
    x, y = [w for w in x if w], [w for w in y if w]
    return bool(x and y) and not any(_slip(p, q) for p in x for q in y)


def _grow(doc: np.ndarray, item: np.ndarray, d: int, i: int, way: int, spare, doc_no: list[str], item_no: list[str]) -> list[tuple[int, int, int]]:
    """Follows a run past its end over single edits: [(item words covered, edits, document words covered)] after each further match.

    A number in the place of quite another one is two edits.
    """
    out, covered, edits, first = [], 0, 0, d
    while True:
        while 0 <= d < len(doc) and 0 <= i < len(item) and doc[d] == item[i]:
            d, i, covered = d + way, i + way, covered + 1
        out.append((covered, edits, abs(d - first)))
        best = None
        for a, b in STEPS:  # words skipped in the document, in the item
            if best and max(a, b) > best[0]:
                break
            n, x, y = 0, d + way * a, i + way * b
            while 0 <= x < len(doc) and 0 <= y < len(item) and n < 8 and doc[x] == item[y]:
                n, x, y = n + 1, x + way, y + way
            if n >= (1 if max(a, b) == 1 else 2) and (best is None or n > best[1]):
                best = (max(a, b), n, a, b)
        if best is None:
            return out
        x, y = (no[min(at, at + way * (n - 1)) : max(at, at + way * (n - 1)) + 1] if n else [] for no, at, n in ((doc_no, d, best[2]), (item_no, i, best[3])))
        edits += best[0] + _other_number(x, y)
        if edits > spare:
            return out
        d, i, covered = d + way * best[2], i + way * best[3], covered + best[3]


def longest_run(doc: np.ndarray, item: np.ndarray, found: list[tuple[int, int, int]], words_per_edit: float, doc_no: list[str], item_no: list[str]) -> tuple[int, int, int, int]:
    """(size, edits, start, stop) of the longest run through any tile, with at most about one edit in ``words_per_edit`` words.

    The size is in item words, of equal ones the one with fewer edits counts;
    start and stop are places in the document. ``doc_no`` and ``item_no`` are
    the ``numbers`` of both: items made to one pattern differ in them, so a
    number for quite another one (more than a slip of one digit) is two edits.
    """
    best = (0, 0, 0, 0)
    spare = len(item) // 8 + 1
    for d, i, n in found:
        right = _grow(doc, item, d + n, i + n, 1, spare, doc_no, item_no)
        left = _grow(doc, item, d - 1, i - 1, -1, spare, doc_no, item_no)
        for cl, el, dl in left:
            for cr, er, dr in right:
                size, edits = n + cl + cr, el + er
                if (size, -edits) > (best[0], -best[1]) and edits <= max(1, round(size / words_per_edit)):
                    best = (size, edits, d - dl, d + n + dr)
    return best


def least_seeds(least_words: int, words_per_edit: float, seed: int) -> int:
    """At how many places of a document a run that counts shares ``seed`` words with its item, at the least.

    A run of n words with e edits has n - e matching words in e + 1 pieces, and
    a piece of m words has m - seed + 1 such places.
    """
    sizes = range(least_words, max(least_words, round(40 * words_per_edit)) + 1)
    edits = lambda n: max(1, round(n / words_per_edit))
    return max(1, min(n - edits(n) - (edits(n) + 1) * (seed - 1) for n in sizes))


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id: str,
    text: str,
    item_id: str,
    item_text: str,
    least_words: int = 14,
    least_share: float = 1 / 3,
    words_per_edit: float = 13.0,
    seed: int = 5,
    items_per_block: int = 20_000,
    least_cover: float | None = None,
) -> DataFrame:
    """(``id``, ``item_id``, ``words``, ``covered``): documents that contain a passage of an item, its length in item words, and the item words in all tiles.

    A passage is a run of at least ``least_words`` consecutive words and
    ``least_share`` of the item, of which about one word in ``words_per_edit``
    may be changed, added or dropped; case, punctuation, accents, line breaks,
    markup and the way of encoding don't matter. One run is measured, not the
    coverage of all tiles: of passages in another order than in the item the
    longest counts. With ``least_cover`` a document also counts if its tiles
    together cover that share of the item, in whatever order. A number changed to quite
    another one counts twice, as items made to one pattern differ in such words;
    otherwise every run counts, whatever other items explain the same place,
    so the size of the blocks doesn't matter. Each pair appears once.

    Items are the stated query set: they go out in blocks of
    ``items_per_block``, one pass over the documents each, which bounds what is
    broadcast; documents are never shuffled for it. In each document the
    hashes of all runs of ``seed`` words are looked up among those of the
    items; only pairs that share as many as a run that counts must have
    (``least_seeds``) are tiled. Null, empty and wordless texts contain
    nothing and are contained in nothing; repeated rows count once; empty
    tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    own = spread(docs.select(F.col(id).alias("d"), F.col(text).alias("x")).filter("x IS NOT NULL"))
    its = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("x")).filter("x IS NOT NULL").distinct()
    n = its.count()
    blocks = max(1, -(-n // items_per_block))
    least = 1 if least_cover else least_seeds(least_words, words_per_edit, seed)
    its = its.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    kind = StructType([StructField("d", docs.schema[id].dataType), StructField("i", items.schema[item_id].dataType), StructField("words", IntegerType()), StructField("covered", IntegerType())])
    out = spark.createDataFrame([], kind)
    for block in range(blocks):
        rows = its.filter(F.col("block") == block).select("i", "x").collect()
        known = WordHashes()
        texts = [(r.i, folded(r.x)) for r in rows]
        texts = [(i, known.of(w), numbers(w)) for i, w in texts if len(w) >= least_words]
        if not texts:
            continue
        keys = np.concatenate([karp_rabin(h, seed) for _, h, _ in texts])
        of = np.concatenate([np.full(max(len(h) - seed + 1, 0), k, np.int32) for k, (_, h, _) in enumerate(texts)])
        at = np.concatenate([np.arange(max(len(h) - seed + 1, 0), dtype=np.int32) for _, h, _ in texts])
        order = np.argsort(keys, kind="stable")
        shared = spark.sparkContext.broadcast((keys[order], of[order], at[order], [i for i, _, _ in texts], [h for _, h, _ in texts], [m for *_, m in texts]))

        def run(batches, shared=shared):
            keys, of, at, ids, words, masks = shared.value
            known = WordHashes()
            for b in batches:
                got_d, got_i, got_n, got_c = [], [], [], []
                for k, t in enumerate(b.column("x").to_pylist()):
                    own_words = folded(t)
                    doc = known.of(own_words)
                    runs = karp_rabin(doc, seed)
                    lo = np.searchsorted(keys, runs, "left")
                    n = np.searchsorted(keys, runs, "right") - lo
                    if np.count_nonzero(n) < least:
                        continue
                    places = np.repeat(np.arange(len(runs)), n)
                    hit = np.arange(len(places)) + np.repeat(lo - np.cumsum(n) + n, n)
                    item_of, item_at = of[hit], at[hit]
                    # an item counts by the document's places, not by its own repeats
                    met, times = np.unique(np.unique(item_of.astype(np.int64) << 32 | places) >> 32, return_counts=True)
                    met = met[times >= least].tolist()
                    doc_no = numbers(own_words) if met else None
                    for item in met:
                        own_hits = item_of == item
                        start = list(zip(places[own_hits].tolist(), item_at[own_hits].tolist()))
                        found = tiles(doc, words[item], seed, start)
                        size = longest_run(doc, words[item], found, words_per_edit, doc_no, masks[item])[0]
                        covered = sum(n for *_, n in found)
                        if size >= least_words and size >= least_share * len(words[item]) - 0.5 or least_cover and covered >= least_cover * len(words[item]):
                            got_d.append(k)
                            got_i.append(ids[item])
                            got_n.append(size)
                            got_c.append(covered)
                d = b.column("d").take(pa.array(got_d, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [d, pa.array(got_i, pa.infer_type(ids)), pa.array(got_n, pa.int32()), pa.array(got_c, pa.int32())], names=["d", "i", "words", "covered"]
                )

        out = out.unionByName(own.mapInArrow(run, kind))
    out = out.groupBy("d", "i").agg(F.max("words").alias("words"), F.max("covered").alias("covered"))
    return out.select(F.col("d").alias(id), F.col("i").alias(item_id), "words", "covered")
