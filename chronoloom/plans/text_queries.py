"""Registered queries over text: dates, sentences, mentions, dictionary links, relations, scores of extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.common import load
from chronoloom.operators import dates, extract, learning
from chronoloom.operators.extract import ESCALATE, MENTION, RELATIONS, TYPE_OF
from chronoloom.plans.base import once, query

EPI = "(SELECT DISTINCT id, content, recorded_at FROM episodes WHERE content IS NOT NULL)"
UTC_DAY = "(recorded_at AT TIME ZONE 'UTC')::DATE"


def _eps(spark, sf_dir):
    return once(spark, sf_dir, "episodes", "id", "content", "recorded_at")


def _rel(word: str, shift: int) -> str:
    return f"SELECT id, 'relative' AS layer, '{word}' AS label, {UTC_DAY} + {shift} AS s, NULL AS e, NULL AS months, NULL AS days FROM {EPI} WHERE regexp_matches(content, '(?i)\\b{word}\\b')"


MONTH = "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: Written dates by their order: day month year, month day year, month year (where no day stands before).
DMY, MDY, MY = rf"(?i)\b([0-9]{{1,2}}) {MONTH} ([0-9]{{4}})\b", rf"(?i)\b{MONTH} ([0-9]{{1,2}}), ([0-9]{{4}})\b", rf"(?i)\b{MONTH} ([0-9]{{4}})\b"


def _written(pattern: str, year: int, month: int, day: int | None, content: str = "content") -> str:
    x = lambda g: f"regexp_extract(label, '{pattern}', {g})"
    number = f"(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left({x(month)}, 3))))"
    date = f"try_cast({x(year)} || '-' || lpad({number}::VARCHAR, 2, '0') || '-' || lpad({x(day) if day else chr(39) + '1' + chr(39)}, 2, '0') AS DATE)"
    return f"SELECT id, 'written', label, {date}, NULL, NULL, NULL FROM (SELECT id, unnest(regexp_extract_all({content}, '{pattern}')) AS label FROM {EPI})"


DATES_SQL = rf"""WITH i AS (SELECT id, 'iso' AS layer, unnest(regexp_extract_all(content, '\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b')) AS label FROM {EPI}),
f AS (SELECT id, unnest(regexp_extract_all(content, '(?i)\bQ[1-4] [0-9]{{4}}\b')) AS label FROM {EPI}),
g AS (SELECT id, recorded_at, unnest(regexp_extract_all(content, '(?i)\b[0-9]{{1,3}} (?:days?|weeks?) ago\b')) AS label FROM {EPI}),
d AS (SELECT id, unnest(regexp_extract_all(content, '(?i)\b(?:for|over) [0-9]{{1,3}} (?:months?|weeks?|days?)\b')) AS label FROM {EPI}),
u AS (SELECT id, layer, label, try_cast(label AS DATE) AS s, NULL::DATE AS e, NULL::INT AS months, NULL::INT AS days FROM i
UNION ALL SELECT id, 'fiscal', label, make_date(right(label, 4)::BIGINT, label[2]::BIGINT * 3 - 2, 1), last_day(make_date(right(label, 4)::BIGINT, label[2]::BIGINT * 3, 1)), NULL, NULL FROM f
UNION ALL SELECT id, 'relative', label, {UTC_DAY} - (regexp_extract(label, '[0-9]+')::INT * CASE WHEN label ILIKE '%week%' THEN 7 ELSE 1 END), NULL, NULL, NULL FROM g
UNION ALL SELECT id, 'duration', label, NULL, NULL, CASE WHEN label ILIKE '%month%' THEN regexp_extract(label, '[0-9]+')::INT END, CASE WHEN label NOT ILIKE '%month%' THEN regexp_extract(label, '[0-9]+')::INT * CASE WHEN label ILIKE '%week%' THEN 7 ELSE 1 END END FROM d
UNION ALL SELECT id, 'iso', label, try_cast(label || '-01' AS DATE), NULL, NULL, NULL FROM (SELECT id, unnest(regexp_extract_all(content, '\b[0-9]{{4}}-[0-9]{{2}}\b(?:-[0-9])?')) AS label FROM {EPI}) WHERE length(label) = 7
UNION ALL SELECT id, 'fiscal', label, make_date(2000 + right(label, 2)::BIGINT, 1, 1), make_date(2000 + right(label, 2)::BIGINT, 12, 31), NULL, NULL FROM (SELECT id, unnest(regexp_extract_all(content, '\bFY(?:[0-9]{{4}}|[0-9]{{2}})\b')) AS label FROM {EPI})
UNION ALL {_written(MDY, 3, 1, 2)} UNION ALL {_written(DMY, 3, 2, 1)} UNION ALL {_written(MY, 2, 1, None, f"regexp_replace(content, '{DMY}', ' ', 'g')")}
UNION ALL {' UNION ALL '.join(_rel(w, n) for w, n in (('today', 0), ('yesterday', -1), ('tomorrow', 1), ('last week', -7), ('last month', -30)))})
SELECT id, layer, label, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day, months, days, count(*) AS n FROM u WHERE layer = 'duration' OR s IS NOT NULL GROUP BY ALL"""


@query(DATES_SQL)
def dates_in_episodes(spark, sf_dir):
    """Dates, ranges and durations written in the episodes."""
    got = dates.dates_in(_eps(spark, sf_dir), id="id", text="content", reference="recorded_at")
    return got.groupBy("id", "layer", "label", F.col("start").cast("string").alias("start_day"), F.col("end").cast("string").alias("end_day"), "months", "days").agg(F.count("*").alias("n"))


SENT = rf"""(SELECT id, sentence, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS "at" FROM (SELECT id, unnest(p) AS raw, generate_subscripts(p, 1) AS i, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS sentence FROM (SELECT id, string_split(regexp_replace(regexp_replace(content, '\n\s*\n', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM {EPI})) WHERE sentence <> '')"""


@query(f'SELECT id, "at"::INT AS "at", sentence FROM {SENT}')
def episode_sentences(spark, sf_dir):
    return _sents(spark, sf_dir)


def _sents(spark, sf_dir):
    return extract.sentences(_eps(spark, sf_dir).filter("content IS NOT NULL"), id="id", text="content")


M = MENTION.replace("(?:", "(?:")
KIND = "CASE " + " ".join(f"WHEN regexp_matches(mention, '{p}(?:-[0-9]+)?$') THEN '{t}'" for t, p in TYPE_OF) + " ELSE 'Component' END"


@query(rf"SELECT id, mention, {KIND} AS type, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '\b(?:{M})\b')) AS mention FROM {EPI}) GROUP BY ALL")
def mentions(spark, sf_dir):
    """Names of software in the episodes, with the type their ending shows."""
    return extract.mentions(_eps(spark, sf_dir), id="id", text="content")


BETWEEN = r"[^\p{L}\p{N}]"


@query(rf"""WITH c AS MATERIALIZED (SELECT e.id AS episode_id, n.id AS entity_id, e.content, n.name FROM {EPI} e JOIN (SELECT DISTINCT id, name FROM entities
WHERE regexp_matches(name, '[\p{{L}}\p{{N}}]')) n ON contains(e.content, n.name)),
p AS (SELECT DISTINCT episode_id, entity_id, name,
 regexp_extract(content, '(?s)^(.*?{BETWEEN})' || regexp_escape(name) || '(?:$|{BETWEEN})', 1) AS before, regexp_matches(content, '(?s)^' || regexp_escape(name) || '(?:$|{BETWEEN})') AS first FROM c)
SELECT episode_id, entity_id, CASE WHEN first THEN 0 ELSE strlen(before) END::BIGINT AS span_start, CASE WHEN first THEN 0 ELSE strlen(before) END::BIGINT + strlen(name) AS span_end FROM p WHERE first OR before <> ''""")
def dictionary_links(spark, sf_dir):
    """Entities whose name stands in an episode, with the bytes of the first mention."""
    got = extract.dictionary_links(_eps(spark, sf_dir).filter("content IS NOT NULL"), load(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"), "name"), id="id", text="content", name_id="entity_id", name="name")
    return got.select(F.col("id").alias("episode_id"), "entity_id", "span_start", "span_end").distinct()


UA = ' UNION ALL '


def _rel_sql() -> str:
    parts = []
    for rel, words in RELATIONS.items():
        key = "(?:" + "|".join(words) + ")"
        parts.append(rf"""SELECT id, "at", '{rel}' AS relation, regexp_extract(sentence, '^.*\b({M})\b.*?\b{key}\b', 1) AS head, regexp_extract(sentence, '\b{key}\b.*?\b({M})\b', 1) AS tail FROM s WHERE regexp_matches(sentence, '\b{key}\b')""")
    return f'WITH s AS {SENT}, r AS ({UA.join(parts)}) SELECT id, "at"::INT AS "at", head, relation, tail FROM r WHERE length(head) > 0 AND length(tail) > 0 AND head <> tail'


@query(_rel_sql())
def rule_relations(spark, sf_dir):
    """Relations that the words of a sentence show."""
    return extract.relations(_sents(spark, sf_dir), id="id")


def _scored_sql() -> str:
    parts = []
    for rel, words in RELATIONS.items():
        p = rf"^.*\b({M})\b(.*?)\b(?:{'|'.join(words)})\b(.*?)\b({M})\b"
        x = lambda g, p=p: f"regexp_extract(sentence, '{p}', {g})"
        parts.append(f"SELECT id, '{rel}' AS relation, {x(1)} AS head, {x(4)} AS tail, 0.65 / (1 + (length({x(2)}) + length({x(3)})) / 2.0 / 50) AS score FROM s WHERE regexp_matches(sentence, '{p}')")
    return f"""WITH s AS {SENT}, r AS ({UA.join(parts)}), b AS (
SELECT *, row_number() OVER (PARTITION BY id, least(head, tail), greatest(head, tail) ORDER BY score DESC, relation, head, tail) AS n FROM r WHERE head <> tail),
k AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM b WHERE n = 1)
SELECT id, head, relation, tail, round(score, 6) AS score FROM k WHERE score >= 0.55 OR (top < 0.55 AND score >= 0.15)"""


@query(_scored_sql())
def scored_relations(spark, sf_dir):
    """The surest relation of each pair of names, with a lower bar where a text has nothing better."""
    return extract.scored_relations(_sents(spark, sf_dir), id="id").withColumn("score", F.round("score", 6))


@query(rf"""WITH m AS (SELECT id, "at", sentence, nullif(regexp_extract(sentence, '^.*\b({M})\b', 1), '') AS m, regexp_extract(sentence, '^(It|This|They|He|She)\b', 1) AS pronoun FROM {SENT}),
w AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refers_to FROM m)
SELECT id, "at"::INT AS "at", pronoun, refers_to FROM w WHERE pronoun <> '' AND refers_to IS NOT NULL""")
def pronoun_references(spark, sf_dir):
    return extract.pronouns(_sents(spark, sf_dir), id="id")


SIGNS = " + ".join(f"contains(lower(content), '{s}')::INT" for s in ESCALATE)


@query(rf"""WITH g AS (SELECT id, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS words, len(list_distinct(regexp_extract_all(content, '\b(?:{M})\b'))) AS names, {SIGNS} AS signs FROM {EPI})
SELECT id, words::INT AS words, names::INT AS names, (names * 10 < words * 1.5) OR (words > 25 AND names < 5) OR signs >= 2 AS escalate FROM g WHERE words > 0""")
def escalation(spark, sf_dir):
    """Episodes on which rules alone are too weak."""
    return extract.escalation(_eps(spark, sf_dir), id="id", text="content")


@query(r"""SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(name), '^(?:[Tt]he|[Aa]n?) ', ''), '^@[^/ ]+/', ''), '[@ ]v?[0-9]+(?:\.[0-9]+)*$', ''), ' (?:database|service|server|client|library|framework|engine|platform|system|tool|SDK|CLI)$', '') AS canonical FROM entities""")
def canonical_names(spark, sf_dir):
    return load(spark, sf_dir, "entities").select("id", extract.canonical_name("name").alias("canonical")).distinct()


@query("""WITH s AS (SELECT DISTINCT * FROM episode_entities WHERE span_start IS NOT NULL AND span_end IS NOT NULL)
SELECT a.episode_id, a.entity_id, a.span_start, a.span_end FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.episode_id = a.episode_id AND b.span_start <= a.span_start AND b.span_end >= a.span_end AND (b.span_start < a.span_start OR b.span_end > a.span_end))""")
def outer_spans(spark, sf_dir):
    """Mentions that no longer mention contains."""
    return extract.without_contained(load(spark, sf_dir, "episode_entities").distinct(), by="episode_id")


@query(rf"""WITH f AS (SELECT DISTINCT id, mention FROM (SELECT id, unnest(regexp_extract_all(content, '\b(?:{M})\b')) AS mention FROM {EPI})),
x AS (SELECT DISTINCT l.episode_id AS id, n.name AS mention FROM episode_entities l JOIN entities n ON n.id = l.entity_id WHERE n.name IS NOT NULL),
a AS (SELECT id, count(*) AS nf FROM f GROUP BY id), b AS (SELECT id, count(*) AS ne FROM x GROUP BY id), c AS (SELECT id, count(*) AS nb FROM f JOIN x USING (id, mention) GROUP BY id)
SELECT e.id, round(CASE WHEN coalesce(nf, 0) + coalesce(ne, 0) = 0 THEN 1.0 ELSE 2.0 * coalesce(nb, 0) / (coalesce(nf, 0) + coalesce(ne, 0)) END, 6) AS f1
FROM (SELECT DISTINCT id FROM episodes) e LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)""")
def extraction_f1(spark, sf_dir):
    """F1 of the mentions found by rules against the linked entities, per episode."""
    found, expected, got = _found_and_expected(spark, sf_dir)
    return got.select("id", F.round(learning.f1(found, expected), 6).alias("f1"))


def _found_and_expected(spark, sf_dir):
    found = extract.mentions(_eps(spark, sf_dir), id="id", text="content").groupBy("id").agg(F.array_sort(F.collect_set("mention")).alias("found"))
    names = load(spark, sf_dir, "entities").filter("name IS NOT NULL").select(F.col("id").alias("entity_id"), "name").distinct()
    links = load(spark, sf_dir, "episode_entities").select(F.col("episode_id").alias("id"), "entity_id").distinct()
    want = links.join(names, "entity_id").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("expected"))
    got = load(spark, sf_dir, "episodes").select("id").distinct().join(found, "id", "left").join(want, "id", "left")
    none = F.array().cast("array<string>")
    return F.coalesce("found", none), F.coalesce("expected", none), got


FOUND_SQL = rf"""WITH f AS (SELECT id, list_sort(list_distinct(list(mention))) AS found FROM (SELECT id, unnest(regexp_extract_all(content, '\b(?:{M})\b')) AS mention FROM {EPI}) GROUP BY id),
x AS (SELECT l.episode_id AS id, list_sort(list_distinct(list(n.name))) AS expected FROM episode_entities l JOIN entities n ON n.id = l.entity_id WHERE n.name IS NOT NULL GROUP BY 1),
b AS (SELECT e.id, coalesce(found, []) AS found, coalesce(expected, []) AS expected FROM (SELECT DISTINCT id FROM episodes) e LEFT JOIN f USING (id) LEFT JOIN x USING (id)),"""
SCORES_SQL = """SELECT id, round(CASE WHEN len(found) + len(expected) = 0 THEN 1.0 WHEN len(found) = 0 THEN 0.0 ELSE hits::DOUBLE / len(found) END, 6) AS precision,
round(CASE WHEN len(found) + len(expected) = 0 THEN 1.0 WHEN len(expected) = 0 THEN 0.0 ELSE hits::DOUBLE / len(expected) END, 6) AS recall,
round(CASE WHEN len(found) + len(expected) = 0 THEN 1.0 ELSE 2.0 * hits / (len(found) + len(expected)) END, 6) AS f1 FROM s"""


def _rounded(got, x):
    return got.select("id", x.alias("x")).select("id", *(F.round(f"x.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


@query(FOUND_SQL + " s AS (SELECT *, len(list_intersect(found, expected)) AS hits FROM b) " + SCORES_SQL)
def extraction_scores(spark, sf_dir):
    """Precision, recall and F1 of the mentions against the linked entities, by equal names."""
    found, expected, got = _found_and_expected(spark, sf_dir)
    return _rounded(got, learning.scores(found, expected))


LEFT = "list_reduce(list_prepend(list_transform(expected, lambda e: lower(e)), list_transform(found, lambda f: [lower(f)])), lambda acc, f: CASE WHEN len(list_filter(acc, lambda e: contains(e, f[1]) OR contains(f[1], e))) = 0 THEN acc ELSE list_filter(acc, lambda e, i: i <> list_position(list_transform(acc, lambda y: contains(y, f[1]) OR contains(f[1], y)), true)) END)"


@query(FOUND_SQL + f" s AS (SELECT *, len(expected) - len({LEFT}) AS hits FROM b) " + SCORES_SQL)
def extraction_fuzzy_scores(spark, sf_dir):
    """The same where one name may contain the other; each expected name counts once."""
    found, expected, got = _found_and_expected(spark, sf_dir)
    return _rounded(got, learning.fuzzy_scores(found, expected))
