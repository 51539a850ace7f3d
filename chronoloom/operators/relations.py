"""Typed relations in text: names with types and places, words that show a relation, schema, distance and direction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.extract import dictionary_links, mentions

# The types that head and tail of each relation have in the default vocabulary.
SCHEMA = {
    "chose": ("Person Service Component", "Component Database Language Infrastructure Pattern"),
    "rejected": ("Person Service Component", "Component Database Language Infrastructure"),
    "replaced": ("Component Database Infrastructure Service Pattern Language", "Component Database Infrastructure Pattern Language"),
    "depends_on": ("Service Component Infrastructure Language Pattern Decision", "Service Component Database Infrastructure Pattern Language"),
    "fixed": ("Person Component Service Language Infrastructure", "Component Service Database Pattern Metric Constraint"),
    "introduced": ("Person Service Infrastructure Component Language", "Component Pattern Infrastructure Database Language Metric"),
    "deprecated": ("Person Decision Service Component Infrastructure Pattern", "Component Pattern Infrastructure Database Language"),
    "caused": ("Component Decision Service Infrastructure Language Pattern Database", "Metric Constraint Pattern"),
    "constrained_by": ("Decision Component Service Infrastructure Database Pattern", "Constraint Pattern Infrastructure Metric"),
}
#: Stems that show a relation, looked for in the small letters of a sentence; a vocabulary of one's own can take their place.
STEMS = {
    "chose": ("chose", "picked", "opted for", "settled on", "went with"),
    "rejected": ("reject", "ruled out", "turned down", "decided against"),
    "replaced": ("replac", "swapped", "in favor of", "instead of", "migrated from"),
    "depends_on": ("depend", "relies on", " uses ", "backed by", "used by", "runs on", "reads from", "writes to"),
    "fixed": ("fixed", "patched", "resolv", "repaired"),
    "introduced": ("introduc", "added", "rolled out", "adopted", "forked"),
    "deprecated": ("deprecat", "retired", "removed", "mothballed", "sunset"),
    "caused": ("caused", "led to", "trigger", "broke"),
    "constrained_by": ("limited by", "must stay", "blocked by", "due to", "capped at"),
}
CONSUMERS, PROVIDERS = ("Service", "Component"), ("Database", "Infrastructure", "Language")
USED = ("used by", "consumed by", "scraped by")
CUT = r"([.!?]\s+|\n\s*\n)"


def typed_mentions(docs: DataFrame, names: DataFrame, *, id: str, text: str, name: str, type: str) -> DataFrame:
    """(``id``, mention, type, span_start, span_end, confidence): the names in a text, each at the bytes of its first mention.

    Names of the table have its type (of several the first by letter) and
    confidence 0.85, other names by their form the type of their ending and
    0.8. Of overlapping ones a name of the table stays before others, then the
    surer, the shorter, the earlier. Null texts, and blank and null names, give
    nothing; repeated rows count once.
    """
    known = names.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("mention")).agg(F.min(type).alias("type"))
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).dropna().distinct()
    table = dictionary_links(docs, known.select("mention", F.col("mention").alias("n")), id="id", text="text", name_id="mention", name="n").distinct()
    table = table.join(known, "mention").select("id", "mention", "type", "span_start", "span_end", F.lit(0.85).alias("confidence"))
    form = mentions(docs, id="id", text="text").join(table.select("id", "mention"), ["id", "mention"], "left_anti").join(docs, "id")
    at = F.octet_length(F.substring("text", F.lit(1), F.regexp_instr("text", F.concat(F.lit(r"\b"), F.col("mention"), F.lit(r"\b"))) - 1)).cast("bigint")
    form = form.select("id", "mention", "type", at.alias("span_start"), (at + F.octet_length("mention")).alias("span_end"), F.lit(0.8).alias("confidence"))
    row = F.struct((-F.col("confidence")).alias("o"), (F.col("span_end") - F.col("span_start")).alias("len"), "span_start", "span_end", "mention", "type", "confidence")
    rows = table.unionByName(form).groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("l"))
    best = F.expr("aggregate(l, slice(l, 1, 0), (t, x) -> IF(exists(t, y -> x.span_start < y.span_end AND y.span_start < x.span_end), t, array_append(t, x)))")
    return rows.select("id", F.explode(best).alias("x")).select(F.col("id").alias(id), *(f"x.{c}" for c in ("mention", "type", "span_start", "span_end", "confidence")))


def typed_relations(docs: DataFrame, named: DataFrame, *, id: str, text: str, stems: dict[str, tuple[str, ...]] = STEMS, threshold: float = 0.55, relaxed: float = 0.15) -> DataFrame:
    """(``id``, head, relation, tail, score): what the words of a sentence say of its names.

    ``named``: the rows of ``typed_mentions``. A name in a sentence with a stem
    of a relation is paired with the names of that sentence and of the ones
    before and after it. A pair scores 0.65 (0.45 across sentences) / (1 + d / 50)
    with d the mean distance of both from the stem in bytes, 0.55 of that if the
    schema knows the two types in neither direction, and less for names in
    small letters. The best pair of each sentence and relation stays;
    its direction follows from the sentence (``direction``). "constrained_by"
    gives way to "fixed", two persons only choose or reject. Texts in which
    something reaches ``threshold`` keep what does, others what reaches
    ``relaxed``. Everything joins by (id, sentence), no text with itself.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).dropna().distinct()
    pieces = docs.select("id", F.posexplode(F.split(F.regexp_replace("text", CUT, "$1\u0001"), "\u0001")).alias("at", "piece"))
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)))
    # the sentence of a name is the last one that begins before it
    n = named.select(F.col(id).alias("id"), "mention", "type", F.col("span_start").alias("pos")).filter(~F.col("mention").rlike(r"^(?:ADR[- ]|PR$|PR[ :]|Issue[ :])"))
    events = n.withColumns({"k": F.lit(1), "at": F.lit(None).cast("int")}).unionByName(pieces.select("id", F.lit(None).cast("string").alias("mention"), F.lit(None).cast("string").alias("type"), F.col("start").alias("pos"), F.lit(0).alias("k"), "at"))
    events = events.withColumn("at", F.last("at", ignorenulls=True).over(Window.partitionBy("id").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)))
    n = events.filter("k = 1").select("id", "at", "mention", "type", "pos")

    low = F.concat(F.lit(" "), F.lower("piece"), F.lit(" "))
    hit = lambda words: F.array_min(F.filter(F.array(*(F.instr(low, w) for w in words)), lambda x: x > 0))
    found = F.array(*(F.struct(F.lit(r).alias("relation"), hit(words).alias("p")) for r, words in stems.items()))
    told = pieces.select("id", "at", "start", low.alias("low"), F.filter(found, lambda x: x["p"].isNotNull()).alias("r"))
    told = told.select("id", "at", "start", "low", F.explode(F.filter("r", lambda x: (x["relation"] != "constrained_by") | ~F.exists("r", lambda y: y["relation"] == "fixed"))).alias("x"))
    told = told.select("id", "at", "low", "x.relation", (F.col("start") + F.octet_length(F.expr("substring(low, 1, x.p - 1)"))).alias("word"))
    head = n.select("id", "at", F.col("mention").alias("h"), F.col("type").alias("ht"), F.col("pos").alias("hp"))
    tail = n.select("id", F.explode(F.array(*(F.col("at") + d for d in (-1, 0, 1)))).alias("at"), F.col("at").alias("own"), F.col("mention").alias("t"), F.col("type").alias("tt"), F.col("pos").alias("tp"))
    pairs = told.join(head, ["id", "at"]).join(tail, ["id", "at"]).filter("h <> t AND (relation IN ('chose', 'rejected') OR NOT (ht <=> 'Person' AND tt <=> 'Person'))")

    of = lambda side, c: reduce(lambda w, r: w.when(F.col("relation") == r, F.col(c).isin(*SCHEMA[r][side].split())), SCHEMA, F.when(F.lit(False), F.lit(False)))
    valid = lambda a, b: F.coalesce(of(0, a) & of(1, b), F.lit(False))
    worth = lambda c: F.when(F.col(c).rlike("^[A-ZÀ-Þ]"), 1.0).when(F.col(c).rlike("^[0-9]"), 0.95).otherwise(0.75)
    gap = (F.abs(F.col("hp") - F.col("word")) + F.abs(F.col("tp") - F.col("word"))) / 2.0
    score = F.when(F.col("own") == F.col("at"), 0.65).otherwise(0.45) / (1 + gap / 50.0) * F.when(valid("ht", "tt") | valid("tt", "ht"), 1.0).otherwise(0.55) * ((worth("h") + worth("t")) / 2.0)
    pairs = pairs.withColumn("score", score)
    rest = [c for c in pairs.columns if c not in ("id", "at", "relation")]
    best = pairs.groupBy("id", "at", "relation").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), "hp", "tp", "h", "t")).alias("x")).select("id", "relation", "x.*")
    first = F.struct("hp", "h") <= F.struct(F.col("tp").alias("hp"), F.col("t").alias("h"))
    best = best.select("id", "relation", "low", "score", *(F.when(first, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("h", "t", "f"), ("ht", "tt", "ft"), ("t", "h", "s"), ("tt", "ht", "st"))))
    turned = direction(valid("ft", "st"), valid("st", "ft"))
    best = best.select("id", F.when(turned, F.col("s")).otherwise(F.col("f")).alias("head"), "relation", F.when(turned, F.col("f")).otherwise(F.col("s")).alias("tail"), "score")
    best = best.groupBy("id", "head", "relation", "tail").agg(F.max("score").alias("score"))
    top = best.groupBy("id").agg(F.max("score").alias("_top"))
    kept = best.join(top, "id").filter((F.col("score") >= threshold) | ((F.col("_top") < threshold) & (F.col("score") >= relaxed)))
    return kept.select(F.col("id").alias(id), "head", "relation", "tail", "score")


def direction(forward: Column, backward: Column) -> Column:
    """Whether the later name (s) is the head and the earlier one (f) the tail of a relation, by the sentence in small letters (low).

    replaced: the new one is the head (from f to s; replaced f with s; in favor
    of s). deprecated: f is deprecated. depends_on: f used by s, else a service
    or component depends on a database, infrastructure or language. Otherwise
    the direction that the schema allows, else the order in the text.
    """
    f, s, low = F.lower("f"), F.lower("s"), F.col("low")
    at = lambda x: F.instr(low, x)
    says = lambda *parts: F.contains(low, F.concat(*parts))
    favor, repl, with_ = F.expr("substring(low, instr(low, 'in favor of'))"), at("replac"), at(" with ")
    place = lambda c: F.expr(f"instr(low, lower({c}))")
    replaced = (
        F.when(says(F.lit("from "), f) & (says(F.lit("to "), s) | says(F.lit("to the "), s)), True)
        .when(says(F.lit("in favor of")), F.contains(favor, s))
        .otherwise((repl > 0) & (place("f") > repl) & (with_ > place("f")) & (place("s") > with_))
    )
    passive = reduce(lambda a, b: a | b, ((at(m) > 0) & (place("f") < at(m)) & (place("s") > at(m)) & (place("f") > 0) for m in USED))
    isin = lambda c, kinds: F.coalesce(F.col(c).isin(*kinds), F.lit(False))
    depends = F.when(passive, True).when(isin("ft", CONSUMERS) & isin("st", PROVIDERS), False).when(isin("st", CONSUMERS) & isin("ft", PROVIDERS), True)
    gone = F.when(says(f, F.lit(" is deprecated")) | says(f, F.lit(" are deprecated")), True)
    cue = F.when(F.col("relation") == "replaced", replaced).when(F.col("relation") == "depends_on", depends).when(F.col("relation") == "deprecated", gone)
    return F.coalesce(cue, backward & ~forward)


# Pronouns by what they can stand for.
PRONOUNS = {"person": "he him his she her hers", "thing": "it its this that these those", "any": "they them their theirs we our us"}


def pronoun_mentions(docs: DataFrame, named: DataFrame, *, id: str, text: str, confidence: float = 0.45) -> DataFrame:
    """(``id``, pronoun, span_start, mention, type, confidence): each pronoun with the nearest name before it that it can stand for.

    he and she stand for persons, it and this for anything else, they and we for
    both; words are runs of ASCII letters, places are bytes. ``named``: the rows
    of ``typed_mentions``. Names and pronouns of a text are put in order and
    read once, no pair is made.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).dropna().distinct()
    words = docs.select("id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))).alias("n", "w"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("pos", F.coalesce(F.sum(F.octet_length("w")).over(before), F.lit(0)))
    kind = reduce(lambda c, k: c.when(F.lower("w").isin(*PRONOUNS[k].split()), k), PRONOUNS, F.when(F.lit(False), ""))
    none = F.lit(None).cast("string")
    rows = words.select("id", "pos", F.lit(1).alias("k"), F.col("w").alias("pronoun"), kind.alias("kind"), none.alias("mention"), none.alias("type")).filter("kind IS NOT NULL")
    rows = rows.unionByName(named.select(F.col(id).alias("id"), F.col("span_start").alias("pos"), F.lit(0).alias("k"), none.alias("pronoun"), none.alias("kind"), "mention", "type"))
    w = Window.partitionBy("id").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    person = F.coalesce(F.lower("type") == "person", F.lit(False))
    row = F.struct("mention", "type")
    last = lambda cond: F.last(F.when(F.col("mention").isNotNull() & cond, row), ignorenulls=True).over(w)
    rows = rows.withColumns({"person": last(person), "thing": last(~person), "any": last(F.lit(True))})
    to = F.when(F.col("kind") == "person", F.col("person")).when(F.col("kind") == "thing", F.col("thing")).otherwise(F.col("any"))
    rows = rows.filter("pronoun IS NOT NULL").withColumn("to", to).filter("to IS NOT NULL")
    return rows.select(F.col("id").alias(id), "pronoun", F.col("pos").alias("span_start"), "to.mention", "to.type", F.lit(confidence).alias("confidence"))


def merged(first: DataFrame, more: DataFrame, *, id: str) -> DataFrame:
    """(``id``, head, relation, tail): the first relations, and of further ones those of pairs of names that have none, in either direction."""
    key = lambda df: df.select(id, "head", "relation", "tail", F.least("head", "tail").alias("_a"), F.greatest("head", "tail").alias("_b")).distinct()
    a, b = key(first), key(more)
    return a.unionByName(b.join(a.select(id, "_a", "_b").distinct(), [id, "_a", "_b"], "left_anti").select(*a.columns)).drop("_a", "_b")
