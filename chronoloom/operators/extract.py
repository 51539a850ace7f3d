"""Entities and relations in text by rules: sentences, mentions, dictionary links, relations, pronouns."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.common import bit_map, in_map, table

#: Names of software in running text: CamelCase words and hyphenated lower-case names, with or without a number.
MENTION = r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[a-z]{3,}-[a-z]{3,}(?:-[0-9]+)?"
#: Word endings and the type they show, first match wins.
TYPE_OF = (("Service", "(?:[Ss]ervice|[Pp]rovider|[Gg]ateway|[Bb]roker|[Pp]roxy)"), ("Infrastructure", "(?:[Cc]ache|[Vv]ault|[Ll]edger|[Rr]egistry|[Rr]elay)"))
# Words that show a relation of the default vocabulary.
RELATIONS = {
    "chose": ("chose", "picked"),
    "rejected": ("rejected", "turned down"),
    "replaced": ("replaced", "migrated from"),
    "depends_on": ("depends on", "relies on"),
    "fixed": ("fixed", "patched"),
    "introduced": ("introduced", "adopted"),
    "deprecated": ("deprecated", "retired"),
    "caused": ("caused", "broke"),
    "constrained_by": ("limited by", "must stay"),
}
ESCALATE = ("@", "#", "::", "->", "outage", "incident")


def sentences(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """(``id``, at, sentence): text cut after . ! ? before white space and at blank lines, numbered from 0; empty pieces are left out."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+|\n\s*\n")
    parts = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return df.select(id, F.posexplode(parts).alias("at", "sentence"))


def mentions(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """(``id``, mention, type, n): names of software that a text mentions and how often."""
    m = df.select(id, F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"\b(?:{MENTION})\b"), F.lit(0))).alias("mention"))
    kind = reduce(lambda c, x: c.when(F.col("mention").rlike(x[1] + "(?:-[0-9]+)?$"), x[0]), TYPE_OF, F.when(F.lit(False), "")).otherwise("Component")
    return m.groupBy(id, "mention").agg(F.count("*").alias("n")).select(id, "mention", kind.alias("type"), "n")


_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _sequences(texts: list[str], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the folded words of all texts, one after the other, and how many each text has."""
    words = [_WORD.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(n.sum())), n


def _key_names(batches):
    """(i, name) to (i, name, key, length): the key of the words of a name, and how many there are."""
    known = _Hashes()
    for b in batches:
        h, n = _sequences(b.column("n").to_pylist(), known)
        power = np.cumprod(np.full(max(n.max(initial=0), 1), _BASE, np.uint64))
        ends = np.cumsum(n)
        keys = np.array([(h[e - k : e] * power[:k]).sum(dtype=np.uint64) for e, k in zip(ends, n)], np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.view(np.int64)), pa.array(n)], names=["i", "n", "key", "len"])


def dictionary_links(docs: DataFrame, names: DataFrame, *, id: str, text: str, name_id: str, name: str) -> DataFrame:
    """(``id``, ``name_id``, span_start, span_end): texts that contain a name, word by word in its own case, with the bytes of its first mention.

    Names meet the texts' word sequences in an equi-join on 64-bit keys of the
    folded words; the exact spelling between word boundaries is checked on what
    meets. Sequences of every length that the names have (one row a length
    comes to the driver) are hashed for a whole batch of texts at once, and only
    those that a map of the names' keys (16 MB at most) lets through leave the
    workers. A name in a third of all texts stays one row on its side, its
    texts are spread by AQE; there is no product of texts and names. Blank and
    null names link nothing.
    """
    spark = docs.sparkSession
    rows = names.select(F.col(name_id).alias("i"), F.col(name).alias("n")).filter("n IS NOT NULL").distinct()
    kind, doc = rows.schema["i"].dataType.simpleString(), docs.schema[id].dataType.simpleString()
    keyed = table(rows.mapInArrow(_key_names, f"i {kind}, n string, key bigint, len bigint").filter("len > 0"), "names")
    lengths = sorted(r.len for r in keyed.select("len").distinct().collect())
    shared = spark.sparkContext.broadcast(bit_map(keyed.select("key").distinct(), "key"))

    def find(batches):
        known = _Hashes()
        for b in batches:
            h, n = _sequences(b.column("_t").to_pylist(), known)
            of, left = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n) - np.arange(len(h))
            at, keys, key, power = [], [], np.zeros(len(h), np.uint64), np.uint64(1)
            for k in range(1, (lengths[-1] if lengths else 0) + 1):
                # the key of the k words from each place on, by one multiplication more
                power = power * _BASE
                key = key + np.concatenate([h[k - 1 :], np.zeros(min(k - 1, len(h)), np.uint64)]) * power
                if k in lengths:
                    hit = np.flatnonzero(left >= k)
                    hit = hit[in_map(shared.value, key[hit])]
                    at.append(of[hit])
                    keys.append(key[hit])
            got = np.unique(np.stack([np.concatenate(at).astype(np.uint64), np.concatenate(keys)], 1), axis=0) if at else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("_d").take(pa.array(got[:, 0].astype(np.int64))), pa.array(got[:, 1].astype(np.uint64).view(np.int64))], names=["_d", "key"])

    d = docs.select(F.col(id).alias("_d"), F.col(text).alias("_t")).filter("_t IS NOT NULL").distinct()
    met = d.mapInArrow(find, f"_d {doc}, key bigint").join(keyed.select(F.col("i").alias("_i"), F.col("n").alias("_n"), "key"), "key").select("_d", "_i", "_n").distinct()
    sure = met.join(d, "_d")
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace("_n", r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}])"))
    sure = sure.withColumn("_p", F.regexp_instr("_t", quoted)).filter("_p > 0")
    start = F.octet_length(F.substring(F.col("_t"), F.lit(1), F.col("_p") - 1)).cast("bigint")
    return sure.select(F.col("_d").alias(id), F.col("_i").alias(name_id), start.alias("span_start"), (start + F.octet_length("_n")).alias("span_end"))


def relations(sents: DataFrame, *, id: str) -> DataFrame:
    """(``id``, at, head, relation, tail): the last name before and the first after a relation's word in one sentence."""
    per = []
    for rel, words in RELATIONS.items():
        key = "(?:" + "|".join(words) + ")"
        head = F.regexp_extract("sentence", rf"^.*\b({MENTION})\b.*?\b{key}\b", 1)
        tail = F.regexp_extract("sentence", rf"\b{key}\b.*?\b({MENTION})\b", 1)
        per.append(F.when(F.col("sentence").rlike(rf"\b{key}\b"), F.struct(head.alias("head"), F.lit(rel).alias("relation"), tail.alias("tail"))))
    got = sents.select(id, "at", F.explode(F.filter(F.array(*per), lambda x: x.isNotNull())).alias("r")).select(id, "at", "r.*")
    return got.filter("head <> '' AND tail <> '' AND head <> tail")


def scored_relations(sents: DataFrame, *, id: str, threshold: float = 0.55, relaxed: float = 0.15, base: float = 0.65) -> DataFrame:
    """(``id``, head, relation, tail, score): the best relation of each pair of names in a text.

    A relation scores ``base`` / (1 + d / 50), d the mean number of characters
    between its word and the two names. Of several relations of one unordered
    pair the best stays, ties by relation, head and tail. Texts in which
    something reaches ``threshold`` keep what does, others what reaches
    ``relaxed``.
    """
    per = []
    for rel, words in RELATIONS.items():
        p = rf"^.*\b({MENTION})\b(.*?)\b(?:{'|'.join(words)})\b(.*?)\b({MENTION})\b"
        part = lambda g, p=p: F.regexp_extract("sentence", p, g)
        gap = (F.length(part(2)) + F.length(part(3))) / 2
        per.append(F.when(F.col("sentence").rlike(p), F.struct(part(1).alias("head"), F.lit(rel).alias("relation"), part(4).alias("tail"), (base / (1 + gap / 50)).alias("score"))))
    got = sents.select(id, F.explode(F.filter(F.array(*per), lambda x: x.isNotNull())).alias("r")).select(id, "r.*").filter("head <> tail")
    pair = [F.least("head", "tail").alias("_a"), F.greatest("head", "tail").alias("_b")]
    row = F.struct("head", "relation", "tail", "score")
    best = got.groupBy(id, *pair).agg(F.min_by(row, F.struct(-F.col("score"), F.col("relation"), F.col("head"), F.col("tail"))).alias("r")).select(id, "r.*")
    top = best.groupBy(id).agg(F.max("score").alias("_top"))
    kept = best.join(top, id).filter((F.col("score") >= threshold) | ((F.col("_top") < threshold) & (F.col("score") >= relaxed)))
    return kept.drop("_top")


def pronouns(sents: DataFrame, *, id: str) -> DataFrame:
    """(``id``, at, pronoun, refers_to): a sentence that opens with a pronoun, and the last name in the sentences before it."""
    w = Window.partitionBy(id).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.regexp_extract("sentence", rf"^.*\b({MENTION})\b", 1)
    own = sents.withColumn("_m", F.when(last != "", last))
    own = own.withColumn("refers_to", F.last("_m", ignorenulls=True).over(w)).withColumn("pronoun", F.regexp_extract("sentence", r"^(It|This|They|He|She)\b", 1))
    return own.filter("pronoun <> '' AND refers_to IS NOT NULL").select(id, "at", "pronoun", "refers_to")


def escalation(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """(``id``, words, names, escalate): texts on which rules alone are too weak.

    Fewer than 1.5 names in 10 words, more than 25 words with under 5 names, or
    two signs of a dense technical text.
    """
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    names = F.size(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"\b(?:{MENTION})\b"), F.lit(0))))
    signs = reduce(lambda a, b: a + b, (F.contains(F.lower(F.col(text)), F.lit(s)).cast("int") for s in ESCALATE))
    got = df.filter(F.col(text).isNotNull()).select(id, words.alias("words"), names.alias("names"), signs.alias("signs"))
    weak = (F.col("names") * 10 < F.col("words") * 1.5) | ((F.col("words") > 25) & (F.col("names") < 5)) | (F.col("signs") >= 2)
    return got.filter("words > 0").select(id, "words", "names", weak.alias("escalate"))


def canonical_name(c: str) -> Column:
    """A technical name without scope, version and generic ending."""
    x = F.regexp_replace(F.trim(F.col(c)), r"^(?:[Tt]he|[Aa]n?) ", "")
    x = F.regexp_replace(x, r"^@[^/ ]+/", "")
    x = F.regexp_replace(x, r"[@ ]v?[0-9]+(?:\.[0-9]+)*$", "")
    return F.regexp_replace(x, r" (?:database|service|server|client|library|framework|engine|platform|system|tool|SDK|CLI)$", "")


def without_contained(spans: DataFrame, *, by: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Spans that no other span of the group contains; equal spans stay."""
    w = Window.partitionBy(by).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct(F.col(end), (-F.col(start)).alias("s"))).over(w)
    return spans.filter(f"{start} IS NOT NULL AND {end} IS NOT NULL").withColumn("_b", before).filter(
        F.col("_b").isNull() | (F.col("_b")[end] < F.col(end)) | ((F.col("_b")[end] == F.col(end)) & (F.col("_b.s") == -F.col(start)))
    ).drop("_b")


def json_answer(c: str) -> Column:
    """The JSON object inside a model's answer: fenced or bare; null where there is none that can be read."""
    fenced = F.regexp_extract(F.col(c), r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(F.col(c), r"(?s)(\{.*\})", 1)
    got = F.when(fenced != "", fenced).otherwise(bare)
    return F.when(F.try_parse_json(got).isNotNull(), got)
