"""Variant spellings of names typed by people: suffix blocking and longest common subsequences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from chronoloom.common import bounded_side, spread, table
from chronoloom.llm.components import components
from chronoloom.llm.words import folded

# Titles before a person's name and legal forms of organisations, folded.
TITLES = set("dr prof professor mr mrs ms miss mx sir dame herr frau sr sra señor señora senor senora monsieur madame mme rev hon".split())
FORMS = set(
    "limited ltd plc incorporated inc corporation corp company co gmbh sa ag kg llc llp lp bv nv oy ab as spa srl sarl sas pty pte kk sl "
    "aktiengesellschaft".split()
)
FILLERS = {"the", "and", "of", "und", "et", "de", "for"}
# Common short forms of given names, short form first.
SHORT_FORMS = (
    "bill william|will william|billy william|bob robert|rob robert|bobby robert|kathy katherine|kate katherine|katie katherine|"
    "beth elizabeth|liz elizabeth|lisa elizabeth|betty elizabeth|zach zachary|zack zachary|dima dmitri|zhenya yevgenia|fritz friedrich|"
    "steph stephane|quin quentin|seun oluwaseun|gabi gabriele|lupe guadalupe|thea dorothea|dora dorothea|sam samantha|uli ulrike|"
    "hattie harriet|harry harriet|hannes johannes|hans johannes|pepe jose|rick richard|dick richard|rich richard|ted theodore|"
    "theo theodore|vicky victoria|vic victoria|nate nathaniel|nat nathaniel|paco francisco|pancho francisco|leo leonardo|"
    "bella isabella|isa isabella|alex alexander|sasha alexander|meg margaret|peggy margaret|maggie margaret|tom tomasz|tomek tomasz|"
    "gene genevieve|vieve genevieve|priya priyanka|vik vikram|xime ximena|mike michael|jim james|jack john|tony anthony|nick nicholas|dan daniel|dave david|"
    "chris christopher|joe joseph|andy andrew|ben benjamin|matt matthew|pat patricia|sue susan|peg margaret|jenny jennifer|"
    "becky rebecca|debbie deborah|ned edward|eddie edward|larry lawrence|charlie charles|chuck charles|"
    # further formal names of a short form, for where the first one fits nobody
    "sam samuel|alex alexandra|sasha alexandra|chris christine|chris christina|pat patrick|nick nicola|tony antonio|max maximilian|"
    "jo joanna|jo josephine|kate catherine|kathy kathleen|fran francesca|fran francisco|gene eugene|ben bennett|lou louis|lou louise|"
    "terry terence|terry theresa|jackie jacqueline|jess jessica|mel melanie|val valerie|val valentin|theo theodora|leo leopold|dan danielle"
)
#: Misspelt words and short forms go to the names by broadcast up to so many rows; the driver holds a copy for each join.
BROADCAST = 20_000
DOTTED = re.compile(r"\b(?:\w\.){2,}")


def name_parts(name: str | None) -> tuple[list[str], bool]:
    """The folded words of a name without titles and fillers, and whether a legal form was among them.

    P.L.C. is one word, S/W software, a single letter an initial.
    """
    if not name:
        return [], False
    name = DOTTED.sub(lambda m: m[0].replace(".", "") + " ", name)
    words = folded(re.sub(r"(?i)\bs/w\b", "software", name), tags=False)
    kept = [w for w in words if w not in FORMS and w not in FILLERS]
    if len(kept) > 1:
        kept = [w for w in kept if w not in TITLES] or kept
    return kept, any(w in FORMS for w in words)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two words or lists of words: one operation on a bit row per element of ``b``."""
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & at.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the common subsequence over both lengths."""
    return pd.Series([2 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype="float64")


_PARTS = StructType([StructField("words", ArrayType(StringType())), StructField("form", StringType())])


@F.pandas_udf(_PARTS)
def _parts(name: pd.Series) -> pd.DataFrame:
    got = [name_parts(x) for x in name]
    return pd.DataFrame({"words": [w for w, _ in got], "form": ["y" if f else "n" for _, f in got]})


def suffix_candidates(words: DataFrame, shortest: int = 4, common: int = 60) -> DataFrame:
    """Pairs (kind, t, u, t < u) of words of one kind that share a suffix, of the word or of its reverse.

    A suffix has ``shortest`` letters or more, half of a shorter word: so much
    is left at one end of a word with one letter wrong. A suffix that more
    than ``common`` words have isn't dropped at once: it is refined by the first
    letter and the length of the word, with one letter more or less allowed.
    Only what stays more common than that is discarded. Words with a suffix
    that was refined also meet by an exact way, whatever was discarded: by
    their spellings with one, from 9 letters on two, from 12 on three letters
    left out, of which two words of an LCS distance of so many letters share
    one. Words of under ten letters always meet by one letter left out.
    ``words``: kind, w and n.
    """
    ends = F.array(F.struct(F.lit("s").alias("end"), F.col("w").alias("x")), F.struct(F.lit("p").alias("end"), F.reverse("w").alias("x")))
    keys = words.select("kind", "w", F.explode(ends).alias("e")).select(
        "kind",
        "w",
        F.length("w").alias("len"),
        "e.end",
        F.explode(F.expr(f"transform(sequence(greatest(2, least({shortest}, length(w) div 2)), length(w)), k -> right(e.x, k))")).alias("suffix"),
    )
    size = keys.groupBy("kind", "end", "suffix").agg(F.count("*").alias("n"))
    keys = keys.join(size, ["kind", "end", "suffix"])
    plain = keys.filter(F.col("n") <= common).select("kind", "w", F.concat_ws("|", "end", "suffix").alias("key"))
    fine = keys.filter(F.col("n") > common).select(
        "kind", "w", F.explode(F.array("len", F.col("len") + 1)).alias("l"), F.concat_ws("|", "end", "suffix", F.substring("w", 1, 1)).alias("key")
    )
    fine = fine.withColumn("key", F.concat_ws("|", "key", "l"))
    fine = fine.join(fine.groupBy("kind", "key").agg(F.count("*").alias("m")), ["kind", "key"])
    rest = fine.select("kind", "w").unionByName(words.filter("length(w) < 10").select("kind", "w")).distinct()
    # the spellings with letters left out, as hashes; what shares a hash only is compared in vain
    less = lambda x: f"array_distinct(flatten(transform({x}, y -> transform(sequence(1, length(y)), i -> concat(left(y, i - 1), substring(y, i + 1))))))"
    rest = rest.withColumn("one", F.expr(less("array(w)")))
    rest = rest.withColumn("two", F.expr(f"IF(length(w) >= 9, {less('one')}, array())"))
    rest = rest.withColumn("three", F.expr(f"IF(length(w) >= 12, {less('two')}, array())"))
    rest = rest.select("kind", "w", F.explode(F.expr("concat(array(w), one, two, three)")).alias("x"))
    rest = rest.select("kind", "w", F.xxhash64(F.lit("d"), "x").alias("key"))
    hashed = lambda x: x.select("kind", "w", F.xxhash64("key").alias("key"))
    keyed = hashed(plain).unionByName(hashed(fine.filter(F.col("m") <= 4 * common))).unionByName(rest)
    return (
        keyed.select("kind", F.col("w").alias("t"), "key")
        .join(keyed.select("kind", F.col("w").alias("u"), "key"), ["kind", "key"])
        .filter("t < u AND abs(length(t) - length(u)) <= 3")
        .select("kind", "t", "u")
        .distinct()
    )


def canonical_words(words: DataFrame, established: int = 3, dominance: int = 8) -> DataFrame:
    """(kind, w, c) for words that are a misspelling of another of their kind: c is the established spelling.

    ``words``: kind, w and n, the number of different names with it. Two words
    are near if their LCS ratio is 0.85 or more and they differ in at most
    three letters, or differ by one letter typed wrong, left out, added or
    swapped. A word in ``established`` or more names is established, unless a
    near word is ``dominance`` times as frequent: two established words (Andre
    and Andrea) are different names however near. Any other word takes its
    nearest established word; words of six letters or more without one are
    grouped among themselves.
    """
    usable = words.filter(F.length("w") >= 3)
    pairs = suffix_candidates(usable)
    near = pairs.withColumn("r", lcs_ratio("t", "u")).withColumn("gap", F.round((F.length("t") + F.length("u")) * (1 - F.col("r"))))
    # two letters of LCS distance are one wrong letter; short words allow only that
    near = near.filter(
        "(r >= 0.85 AND gap <= 3) OR (gap <= 2 AND r >= 0.72 AND length(t) >= 4 AND length(u) >= 4) OR (gap <= 1 AND r >= 0.85)"
    )
    near = table(near, "near")
    near = near.unionByName(near.select("kind", F.col("u").alias("t"), F.col("t").alias("u"), "r", "gap"))
    n_of = lambda a: usable.select("kind", F.col("w").alias(a), F.col("n").alias(f"n_{a}"))
    near = table(near.join(n_of("t"), ["kind", "t"]).join(n_of("u"), ["kind", "u"]), "near")
    # how frequent the most frequent near word is decides whether a word is established
    most = near.groupBy("kind", "t").agg(F.max("n_u").alias("top"))
    sure = lambda n, top: (F.col(n) >= established) & (F.coalesce(top, F.lit(0)) < dominance * F.col(n))
    near = near.join(most, ["kind", "t"]).join(most.select("kind", F.col("t").alias("u"), F.col("top").alias("top_u")), ["kind", "u"])
    near = table(near.filter(~sure("n_t", F.col("top"))).withColumn("ok_u", sure("n_u", F.col("top_u"))), "misspelt")
    best = (
        near.filter("ok_u")
        .groupBy("kind", "t")
        .agg(F.max(F.struct("r", "n_u", "u")).alias("b"))
        .select("kind", F.col("t").alias("w"), F.col("b.u").alias("c"))
    )
    done = best.select("kind", F.col("w").alias("t"))
    loose = near.filter("NOT ok_u AND length(t) >= 6 AND length(u) >= 6 AND t < u").join(done, ["kind", "t"], "left_anti")
    loose = loose.join(done.withColumnRenamed("t", "u"), ["kind", "u"], "left_anti")
    # kinds don't mix: the kind is the first letter of the nodes
    alone = components(loose.select(F.concat("kind", "t").alias("t"), F.concat("kind", "u").alias("u")), a="t", b="u").filter("node <> component")
    alone = alone.select(F.substring("node", 1, 1).alias("kind"), F.expr("substring(node, 2)").alias("w"), F.expr("substring(component, 2)").alias("c"))
    return table(best.unionByName(alone), "canonical")


def learned_short_forms(known: DataFrame, least: int = 2) -> DataFrame:
    """(w, formal): given-name forms that resolved names use for another, e.g. Dima for Dmitri.

    ``known``: (key, a, b), canonical words of two names of one person. Names
    that share a word and differ in one word each support that pair; a pair
    needs ``least`` persons, and the form with fewer names in all is the short
    one. A short form keeps its best supported formal one.
    """
    diff = known.select(
        "key", F.array_except("a", "b").alias("x"), F.array_except("b", "a").alias("y"), F.size(F.array_intersect("a", "b")).alias("same")
    ).filter("same >= 1 AND size(x) = 1 AND size(y) = 1")
    pairs = diff.select("key", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y")).filter("x <> y AND length(x) > 2 AND length(y) > 2 AND left(x, 1) <> ''")
    seen = pairs.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.countDistinct("key").alias("k")).filter(F.col("k") >= least)
    return seen


def _with_tokens(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("p", _parts(name)).select("*", F.col("p.words").alias("words"), (F.col("p.form") == "y").alias("form")).drop("p")


def name_identities(
    entities: DataFrame,
    aliases: DataFrame,
    *,
    entity_id: str,
    entity_name: str,
    entity_type: str,
    alias_id: str,
    canonical_id: str,
    alias_name: str,
) -> DataFrame:
    """(record, identity): which records name the same person or organisation.

    Records are the entities of type Person or Organization (any letter case)
    and the aliases without canonical id. Names are split into folded words
    without titles and legal forms. Misspelt words are led back to the
    established spelling (suffix blocking, LCS ratio, see
    ``canonical_words``), short forms to the formal given name (a fixed list,
    and what resolved aliases of persons show; of several the one with which
    one person of the other words is known, else the best supported).

    A person is the set of these words in any order; an initial and one word
    belong to the only person with that word and a word of that initial, and to
    none if several fit. An organisation is its name word, the one
    that leads names most often, and its trade by the initials of the trade words, so that
    abbreviations and acronyms of the trade agree; trades whose words can't be
    abbreviations of each other are different. Middle initials don't count.

    Records with a null id, or a null or wordless name, and persons of one word
    without an initial have no identity and don't appear; repeated rows count once; ties in every choice are broken by
    spelling; empty tables give an empty result; other columns are ignored.
    Work is per distinct name and per distinct word, never per pair of records.
    """
    kind = F.lower(F.trim(F.col(entity_type)))
    e = entities.select(F.col(entity_id).alias("record"), F.col(entity_name).alias("name"), kind.alias("kind"))
    e = e.filter(F.col("kind").isin("person", "organization", "organisation")).withColumn("kind", F.substring("kind", 1, 1))
    e = e.dropna(subset=["record", "name"]).distinct()
    a = aliases.filter(F.col(canonical_id).isNull()).select(F.col(alias_id).alias("record"), F.col(alias_name).alias("name"), F.lit("?").alias("kind"))
    records = e.unionByName(a.dropna(subset=["record", "name"]).distinct())
    records = table(_with_tokens(spread(records), "name").filter(F.size("words") > 0).drop("name"), "names")
    # an untyped name is an organisation's if it has a legal form or a word that only typed organisations have
    typed = records.filter("kind <> '?'").select("kind", F.explode("words").alias("w")).groupBy("w").agg(F.max("kind").alias("hi"), F.min("kind").alias("lo"))
    org_only = typed.filter("lo = 'o' AND hi = 'o'").select("w")
    open_ = records.filter("kind = '?'")
    as_org = open_.select("record", F.explode("words").alias("w")).join(org_only, "w", "left_semi").select("record").distinct().withColumn("o", F.lit(True))
    open_ = open_.join(as_org, "record", "left").withColumn("kind", F.when(F.col("form") | F.col("o"), "o").otherwise("p")).drop("o")
    records = table(records.filter("kind <> '?'").unionByName(open_), "kinds")
    # resolved aliases of the same entities teach short forms and count as names, too
    known = aliases.filter(F.col(canonical_id).isNotNull() & F.col(alias_name).isNotNull()).select(F.col(canonical_id).alias("record"), F.col(alias_name).alias("other")).distinct()
    taught = _with_tokens(_with_tokens(e.join(known, "record"), "name").withColumnRenamed("words", "a").drop("form"), "other").drop("form")
    taught = table(taught.select("record", "kind", "a", F.col("words").alias("b")), "taught")

    spelt = records.select("kind", "words").unionByName(taught.select("kind", F.col("b").alias("words")))
    spelt = spelt.select("kind", F.array_sort(F.array_distinct("words")).alias("words")).distinct()
    words = table(spelt.select("kind", F.explode("words").alias("w")).groupBy("kind", "w").agg(F.count("*").alias("n")), "words")
    # words of persons and of organisations are told apart: Marian is no typo of Marine
    fixed = bounded_side(canonical_words(words), BROADCAST)

    def canonical(df: DataFrame, key: list[str], col: str) -> DataFrame:
        """Replaces the words of an array column of persons' names; a row has a handful of words, so they are regrouped by key."""
        out = df.select(*key, F.lit("p").alias("kind"), F.posexplode(col).alias("at", "w")).join(fixed, ["kind", "w"], "left")
        out = out.select(*key, "at", F.coalesce("c", "w").alias("w"))
        out = out.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("l"))
        return out.select(*key, F.col("l.w").alias(col))

    pairs = taught.filter("kind = 'p'").withColumn("key", F.concat_ws("|", "record", F.array_join("b", " ")))
    pairs = canonical(pairs.select("key", "a").distinct(), ["key"], "a").join(canonical(pairs.select("key", "b").distinct(), ["key"], "b"), "key")
    seen = learned_short_forms(pairs.withColumn("key", F.substring_index("key", "|", 1)))
    weight = words.filter("kind = 'p'").join(fixed, ["kind", "w"], "left").groupBy(F.coalesce("c", "w").alias("w")).agg(F.sum("n").alias("n"))
    weight = table(weight, "weight")
    ns = lambda x: weight.select(F.col("w").alias(x), F.col("n").alias(f"n_{x}"))
    seen = seen.join(ns("p"), "p").join(ns("q"), "q")
    first = F.struct(F.col("n_p"), F.col("p")) >= F.struct(F.col("n_q"), F.col("q"))
    seen = seen.select(F.when(first, F.col("q")).otherwise(F.col("p")).alias("w"), F.when(first, F.col("p")).otherwise(F.col("q")).alias("formal"), "k")
    listed = [(*x.split(), i) for i, x in enumerate(SHORT_FORMS.split("|"))]  # of several formal names the first is the usual one
    listed = entities.sparkSession.createDataFrame(listed, "w string, formal string, at int")
    listed = listed.withColumn("k", F.lit(1.0) / (F.row_number().over(Window.partitionBy("w").orderBy("at"))))
    seen = seen.withColumn("k", F.col("k").cast("double")).unionByName(listed.drop("at"))
    short = seen.groupBy("w").agg(F.max(F.struct("k", "formal")).alias("b"), F.collect_set("formal").alias("every"))
    short = short.select("w", F.col("b.formal").alias("formal"), F.array_sort(F.array_remove("every", F.col("b.formal"))).alias("others"))
    short = bounded_side(table(short.withColumn("kind", F.lit("p")), "short"), BROADCAST)

    # how often a word leads the names of organisations that have it
    lead = records.filter("kind = 'o'").select("words").distinct().select(F.lit("o").alias("kind"), F.posexplode("words").alias("at", "w")).join(fixed, ["kind", "w"], "left")
    lead = lead.groupBy("kind", F.coalesce("c", "w").alias("w")).agg(F.avg(F.when(F.col("at") == 0, 1.0).otherwise(0.0)).alias("lead"))

    per = records.select("record", "kind", F.posexplode("words").alias("at", "raw"))
    per = per.join(fixed.select("kind", F.col("w").alias("raw"), "c"), ["kind", "raw"], "left").withColumn("w", F.coalesce("c", "raw")).drop("c")
    per = per.join(lead, ["kind", "w"], "left").join(short, ["kind", "w"], "left")
    row = F.struct("at", "w", F.coalesce("lead", F.lit(0.5)).alias("lead"), F.coalesce("formal", "w").alias("g"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    per = table(per.groupBy("record", "kind").agg(F.array_sort(F.collect_list(row)).alias("l")), "canonical")

    persons = per.filter("kind = 'p'").select(
        "record",
        F.expr("array_sort(array_distinct(transform(filter(l, x -> length(x.w) > 1), x -> x.g)))").alias("long"),
        F.expr("transform(filter(l, x -> length(x.w) = 1), x -> x.w)").alias("initials"),
        # the same with another formal name of a short form
        F.expr(
            """flatten(transform(filter(l, x -> size(x.others) > 0), x -> transform(x.others, o ->
            array_sort(array_distinct(transform(filter(l, y -> length(y.w) > 1), y -> IF(y.at = x.at, o, y.g)))))))"""
        ).alias("also"),
    )
    whole = persons.filter("size(long) >= 2").select("record", "long", "also")
    # of several formal names the one counts with which somebody is known, if that is one person only
    known = whole.filter("size(also) = 0").select(F.col("long").alias("fit")).distinct()
    open_ = whole.filter("size(also) > 0")
    fits = open_.select("record", F.explode(F.array_append("also", F.col("long"))).alias("fit")).distinct().join(known, "fit")
    fits = fits.groupBy("record").agg(F.min("fit").alias("lo"), F.max("fit").alias("hi")).filter("lo = hi").select("record", "lo")
    open_ = open_.join(fits, "record", "left").select("record", F.coalesce("lo", "long").alias("long"))
    full = whole.filter("size(also) = 0").select("record", "long").unionByName(open_)
    full = full.withColumn("identity", F.concat(F.lit("p|"), F.array_join("long", "|")))
    idents = full.select("identity", "long").distinct()
    other = idents.select("identity", F.explode("long").alias("w"), "long").select("identity", "w", F.explode("long").alias("g")).filter("w <> g")
    only = other.groupBy("w", F.substring("g", 1, 1).alias("i")).agg(F.min("identity").alias("lo"), F.max("identity").alias("hi"))
    one = persons.filter("size(long) = 1").select("record", F.get("long", F.lit(0)).alias("w"), F.get("initials", F.lit(0)).alias("i"))
    one = one.join(only, ["w", "i"], "left")
    one = one.withColumn(
        "identity",
        # a word alone names nobody in particular; an initial that several fit neither
        F.expr("CASE WHEN i IS NULL THEN NULL WHEN lo = hi THEN lo WHEN lo IS NOT NULL THEN NULL ELSE concat('p|', w, '|', i) END"),
    )
    persons = full.select("record", "identity").unionByName(one.filter("identity IS NOT NULL").select("record", "identity"))

    orgs = per.filter("kind = 'o'").withColumn("stem", F.expr("array_max(transform(l, x -> named_struct('lead', x.lead, 'at', -x.at, 'w', x.w))).w"))
    orgs = orgs.withColumn("trade", F.expr("transform(filter(l, x -> x.w <> stem), x -> x.w)"))
    # one word of two or three letters is an acronym of the trade, anything else counts by initials
    acronym = F.expr("CASE WHEN size(trade) = 1 AND length(get(trade, 0)) BETWEEN 2 AND 3 THEN get(trade, 0) ELSE array_join(transform(trade, x -> left(x, 1)), '') END")
    orgs = orgs.select("record", "stem", "trade", acronym.alias("acr"))
    best = (
        orgs.filter("array_join(trade, '') <> acr")
        .groupBy("stem", "acr")
        .agg(F.max(F.struct(F.expr("length(array_join(trade, ''))").alias("len"), F.col("trade").alias("words"))).alias("b"))
        .select("stem", "acr", F.col("b.words").alias("full"))
    )
    orgs = orgs.join(best, ["stem", "acr"], "left")
    # a word fits the full one if its letters occur there in order
    fits = F.expr(
        "full IS NULL OR array_join(trade, '') = acr OR forall(zip_with(trade, full, (x, y) -> y RLIKE concat('^', regexp_replace(x, '(.)', '$1.*'))), z -> z)"
    )
    orgs = orgs.withColumn("identity", F.concat(F.lit("o|"), "stem", F.lit("|"), F.when(fits, F.col("acr")).otherwise(F.array_join("trade", "+"))))
    only = orgs.filter("size(trade) > 0").groupBy("stem").agg(F.min("identity").alias("lo"), F.max("identity").alias("hi"))
    orgs = orgs.join(only, "stem", "left").withColumn("identity", F.expr("IF(size(trade) = 0 AND lo = hi, lo, identity)"))
    return persons.unionByName(orgs.select("record", "identity"))


def identity_pairs(identities: DataFrame) -> DataFrame:
    """Pairs (record_a < record_b) of records with one identity."""
    own = table(identities, "identities")
    return (
        own.select(F.col("record").alias("record_a"), "identity")
        .join(own.select(F.col("record").alias("record_b"), "identity"), "identity")
        .filter("record_a < record_b")
        .select("record_a", "record_b")
        .distinct()
    )
