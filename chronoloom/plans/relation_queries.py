"""Registered queries of typed names and relations in the episodes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.common import load
from chronoloom.operators import extract, relations
from chronoloom.operators.relations import CONSUMERS, PRONOUNS, PROVIDERS, SCHEMA, STEMS, USED
from chronoloom.plans.base import SQL, once, query
from chronoloom.plans.text_queries import BETWEEN, EPI, KIND, M, _sents


def _named(spark, sf_dir):
    eps = once(spark, sf_dir, "episodes", "id", "content")
    return eps, relations.typed_mentions(eps, load(spark, sf_dir, "entities"), id="id", text="content", name="name", type="entity_type")


TEXTS = f"(SELECT DISTINCT id, content FROM {EPI})"
NAMED_SQL = rf"""k AS (SELECT name AS mention, min(entity_type) AS type FROM entities WHERE name IS NOT NULL GROUP BY name),
c AS MATERIALIZED (SELECT e.id, e.content, k.mention, k.type FROM {TEXTS} e JOIN k ON contains(e.content, k.mention) WHERE regexp_matches(k.mention, '[\p{{L}}\p{{N}}]')),
p AS (SELECT id, mention, type, regexp_extract(content, '(?s)^(.*?{BETWEEN})' || regexp_escape(mention) || '(?:$|{BETWEEN})', 1) AS before, regexp_matches(content, '(?s)^' || regexp_escape(mention) || '(?:$|{BETWEEN})') AS first FROM c),
d AS (SELECT id, mention, type, CASE WHEN first THEN 0 ELSE strlen(before) END::BIGINT AS s, 0.85::DOUBLE AS confidence FROM p WHERE first OR before <> ''),
g AS (SELECT DISTINCT id, content, unnest(regexp_extract_all(content, '\b(?:{M})\b')) AS mention FROM {TEXTS}),
w AS (SELECT id, mention, {KIND} AS type, strlen(regexp_extract(content, '(?s)^(.*?)\b' || mention || '\b', 1))::BIGINT AS s, 0.8::DOUBLE AS confidence FROM g WHERE (id, mention) NOT IN (SELECT id, mention FROM d)),
u AS (SELECT *, s + strlen(mention) AS e FROM (SELECT * FROM d UNION ALL SELECT * FROM w)),
l AS (SELECT id, list([{{'s': s, 'e': e, 'mention': mention, 'type': type, 'confidence': confidence}}] ORDER BY confidence DESC, e - s, s, mention) AS l FROM u GROUP BY id),
named AS (SELECT id, unnest(list_reduce(l, lambda t, x: CASE WHEN len(list_filter(t, lambda y: x[1].s < y.e AND y.s < x[1].e)) > 0 THEN t ELSE list_concat(t, x) END), recursive := true) FROM l)"""


@query(f"WITH {NAMED_SQL} SELECT id, mention, type, s AS span_start, e AS span_end, confidence FROM named")
def typed_mentions(spark, sf_dir):
    """Names in the episodes with their types and places, overlaps resolved."""
    return _named(spark, sf_dir)[1]


def _in(side: int, c: str) -> str:
    return "CASE relation " + " ".join(f"WHEN '{r}' THEN {c} IN ({', '.join(repr(x) for x in SCHEMA[r][side].split())})" for r in SCHEMA) + " END"


def _valid(a: str, b: str) -> str:
    return f"coalesce({_in(0, a)} AND {_in(1, b)}, false)"


def _worth(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[A-ZÀ-Þ]') THEN 1.0::DOUBLE WHEN regexp_matches({c}, '^[0-9]') THEN 0.95 ELSE 0.75 END"


def _words(words) -> str:
    return "list_min(list_filter([" + ", ".join(f"instr(low, '{w}')" for w in words) + "], lambda x: x > 0))"


_IS = lambda c, kinds: f"coalesce({c} IN ({', '.join(map(repr, kinds))}), false)"
_PASSIVE = " OR ".join(f"(instr(low, '{m}') > 0 AND instr(low, lower(f)) < instr(low, '{m}') AND instr(low, lower(s)) > instr(low, '{m}') AND instr(low, lower(f)) > 0)" for m in USED)
TURNED = f"""coalesce(CASE relation WHEN 'replaced' THEN CASE WHEN contains(low, 'from ' || lower(f)) AND (contains(low, 'to ' || lower(s)) OR contains(low, 'to the ' || lower(s))) THEN true
 WHEN contains(low, 'in favor of') THEN contains(low[instr(low, 'in favor of'):], lower(s))
 ELSE instr(low, 'replac') > 0 AND instr(low, lower(f)) > instr(low, 'replac') AND instr(low, ' with ') > instr(low, lower(f)) AND instr(low, lower(s)) > instr(low, ' with ') END
WHEN 'depends_on' THEN CASE WHEN {_PASSIVE} THEN true WHEN {_IS('ft', CONSUMERS)} AND {_IS('st', PROVIDERS)} THEN false WHEN {_IS('st', CONSUMERS)} AND {_IS('ft', PROVIDERS)} THEN true END
WHEN 'deprecated' THEN CASE WHEN contains(low, lower(f) || ' is deprecated') OR contains(low, lower(f) || ' are deprecated') THEN true END END, {_valid('st', 'ft')} AND NOT {_valid('ft', 'st')})"""
RELATIONS_SQL = rf"""WITH {NAMED_SQL},
z AS (SELECT id, unnest(q) AS piece, generate_subscripts(q, 1) - 1 AS "at" FROM (SELECT id, string_split(regexp_replace(content, '([.!?]\s+|\n\s*\n)', '\1' || chr(1), 'g'), chr(1)) AS q FROM {TEXTS})),
pieces AS (SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, ' ' || lower(piece) || ' ' AS low FROM z),
n AS (SELECT id, mention, type, s AS pos, (SELECT max("at") FROM pieces z WHERE z.id = named.id AND z.start <= named.s) AS "at" FROM named WHERE NOT regexp_matches(mention, '^(?:ADR[- ]|PR$|PR[ :]|Issue[ :])')),
r AS (SELECT id, "at", start, low, unnest([{', '.join(f"{{'relation': '{r}', 'p': {_words(w)}}}" for r, w in STEMS.items())}], recursive := true) FROM pieces),
told AS (SELECT id, "at", low, relation, start + strlen(low[:p - 1]) AS word FROM r WHERE p IS NOT NULL AND (relation <> 'constrained_by' OR NOT EXISTS (SELECT 1 FROM r o WHERE o.id = r.id AND o."at" = r."at" AND o.relation = 'fixed' AND o.p IS NOT NULL))),
pairs AS (SELECT k.id, k."at", k.low, k.relation, h.mention AS h, h.type AS ht, h.pos AS hp, t.mention AS t, t.type AS tt, t.pos AS tp, k.word, t."at" AS own FROM told k JOIN n h ON h.id = k.id AND h."at" = k."at" JOIN n t ON t.id = k.id AND t."at" BETWEEN k."at" - 1 AND k."at" + 1
 WHERE h.mention <> t.mention AND (relation IN ('chose', 'rejected') OR NOT (coalesce(h.type = 'Person', false) AND coalesce(t.type = 'Person', false)))),
scored AS (SELECT *, CASE WHEN own = "at" THEN 0.65::DOUBLE ELSE 0.45 END / (1 + (abs(hp - word) + abs(tp - word)) / 2.0::DOUBLE / 50.0::DOUBLE) * CASE WHEN {_valid('ht', 'tt')} OR {_valid('tt', 'ht')} THEN 1.0::DOUBLE ELSE 0.55 END * (({_worth('h')} + {_worth('t')}) / 2.0::DOUBLE) AS score FROM pairs),
best AS (SELECT *, (hp, h) <= (tp, t) AS inorder FROM (SELECT *, row_number() OVER (PARTITION BY id, "at", relation ORDER BY score DESC, hp, tp, h, t) AS rn FROM scored) WHERE rn = 1),
fs AS (SELECT id, relation, low, score, CASE WHEN inorder THEN h ELSE t END AS f, CASE WHEN inorder THEN ht ELSE tt END AS ft, CASE WHEN inorder THEN t ELSE h END AS s, CASE WHEN inorder THEN tt ELSE ht END AS st FROM best),
o AS (SELECT id, CASE WHEN {TURNED} THEN s ELSE f END AS head, relation, CASE WHEN {TURNED} THEN f ELSE s END AS tail, max(score) AS score FROM fs GROUP BY ALL),
x AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM o)
SELECT id, head, relation, tail, round(score, 6) AS score FROM x WHERE score >= 0.55 OR (top < 0.55 AND score >= 0.15)"""


@query(RELATIONS_SQL)
def typed_relations(spark, sf_dir):
    """Relations between typed names by stems, distance, schema and direction."""
    eps, named = _named(spark, sf_dir)
    return relations.typed_relations(eps, named, id="id", text="content").withColumn("score", F.round("score", 6))


_KINDS = " ".join(f"WHEN lower(w) IN ({', '.join(repr(x) for x in words.split())}) THEN '{k}'" for k, words in PRONOUNS.items())


@query(rf"""WITH {NAMED_SQL},
z AS (SELECT id, unnest(q) AS w, generate_subscripts(q, 1) AS n FROM (SELECT id, regexp_extract_all(content, '[A-Za-z]+|[^A-Za-z]+') AS q FROM {TEXTS})),
y AS (SELECT id, w, CASE {_KINDS} END AS kind, coalesce(sum(strlen(w)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM z),
v AS (SELECT id, pos, 1 AS k, w AS pronoun, kind, NULL AS mention, NULL AS type FROM y WHERE kind IS NOT NULL UNION ALL SELECT id, s, 0, NULL, NULL, mention, type FROM named),
x AS (SELECT *, last_value(CASE WHEN mention IS NOT NULL AND coalesce(lower(type) = 'person', false) THEN {{'m': mention, 't': type}} END IGNORE NULLS) OVER o AS person,
 last_value(CASE WHEN mention IS NOT NULL AND NOT coalesce(lower(type) = 'person', false) THEN {{'m': mention, 't': type}} END IGNORE NULLS) OVER o AS thing,
 last_value(CASE WHEN mention IS NOT NULL THEN {{'m': mention, 't': type}} END IGNORE NULLS) OVER o AS anything FROM v WINDOW o AS (PARTITION BY id ORDER BY pos, k ROWS UNBOUNDED PRECEDING)),
r AS (SELECT id, pronoun, pos, CASE kind WHEN 'person' THEN person WHEN 'thing' THEN thing ELSE anything END AS to_ FROM x WHERE pronoun IS NOT NULL)
SELECT id, pronoun, pos AS span_start, to_.m AS mention, to_.t AS type, 0.45::DOUBLE AS confidence FROM r WHERE to_.m IS NOT NULL""")
def pronoun_mentions(spark, sf_dir):
    """Every pronoun of the episodes with the nearest earlier name that it can stand for."""
    eps, named = _named(spark, sf_dir)
    return relations.pronoun_mentions(eps, named, id="id", text="content")


@query(f"""WITH a AS (SELECT DISTINCT id, head, relation, tail FROM ({SQL['rule_relations']})), b AS (SELECT DISTINCT id, head, relation, tail FROM ({RELATIONS_SQL}))
SELECT * FROM a UNION ALL SELECT * FROM b WHERE (id, least(head, tail), greatest(head, tail)) NOT IN (SELECT id, least(head, tail), greatest(head, tail) FROM a)""")
def merged_relations(spark, sf_dir):
    """Relations inside a sentence, and typed ones for the pairs of names that those leave out."""
    eps, named = _named(spark, sf_dir)
    return relations.merged(extract.relations(_sents(spark, sf_dir), id="id"), relations.typed_relations(eps, named, id="id", text="content"), id="id")
