"""Column expressions of the graph: visibility, memory classes, decay, tokens, vectors. All run inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days to live by memory class; a pattern never expires.
TTL_DAYS = {"fact": 90, "experience": 180, "preference": 30, "decision": 90}
GRACE_SECONDS = 604_800
#: Latin letters with marks and their bare forms, from Unicode's decompositions.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1)
BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def flag(metadata, key: str) -> Column:
    """Whether a JSON flag is 1 or true; false for null, absent or unreadable JSON."""
    return F.coalesce(F.lower(F.get_json_object(col(metadata), f"$.{key}")).isin("1", "true"), F.lit(False))


def soft_live(metadata="metadata") -> Column:
    return ~flag(metadata, "marked_for_deletion")


def archived(metadata="metadata") -> Column:
    return flag(metadata, "archived")


def valid_at(t: Column, valid_from="valid_from", valid_until="valid_until") -> Column:
    """Half-open validity; a null bound is open."""
    return (col(valid_from).isNull() | (col(valid_from) <= t)) & (col(valid_until).isNull() | (col(valid_until) > t))


def memory_class(c="memory_type") -> Column:
    """Lower-cased class; unknown, empty and null count as fact."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin("fact", "pattern", "experience", "preference", "decision"), low).otherwise(F.lit("fact"))


def default_ttl_seconds(c: Column) -> Column:
    """Seconds to live of a memory class, null for a pattern."""
    return F.create_map(*(F.lit(x) for k, d in TTL_DAYS.items() for x in (k, d * 86_400)))[c].cast("bigint")


def ttl(c="ttl_seconds") -> Column:
    """A negative time to live counts as none."""
    return F.when(col(c) >= 0, col(c))


def seconds(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def decay(base, memory: Column, created, ttl_s: Column, now: Column, usage=None, recalled=None) -> Column:
    """The strength that is left of ``base`` at ``now``.

    Patterns and rows without a time to live keep it; a time to live of 0
    leaves nothing. Age counts from the last recall if that lies between
    creation and now, else from creation, in whole seconds, at least 0. Use
    stretches the time to live by 1 + 0.15 ln(1 + usage), at most 1.75. Facts,
    decisions and preferences halve every half time to live; past it a quarter
    is left that fades with e^-3 per time to live. Experiences fade in a
    straight line to 0.
    """
    base = F.lit(base) if isinstance(base, (int, float)) else base
    usage = F.coalesce(col(usage), F.lit(0)) if usage is not None else F.lit(0)
    origin = col(created)
    if recalled is not None:
        origin = F.when((col(recalled) > col(created)) & (col(recalled) <= now), col(recalled)).otherwise(origin)
    age = F.greatest(F.floor((seconds(now) - seconds(origin)) / 1_000_000), F.lit(0)).cast("double")
    life = ttl_s.cast("double") * F.least(1 + 0.15 * F.log1p(usage.cast("double")), F.lit(1.75))
    past = age > life
    fact = F.when(past, base * 0.25 * F.exp(-3 * (age - life) / life)).otherwise(base * F.exp(-F.lit(2.0) * F.log(F.lit(2.0)) / life * age))
    exper = F.when(past, F.lit(0.0)).otherwise(base * F.greatest(F.lit(0.0), 1 - age / life))
    return (
        F.when((memory == "pattern") | ttl_s.isNull(), base)
        .when(ttl_s == 0, F.lit(0.0))
        .when(memory == "experience", exper)
        .otherwise(fact)
        .cast("double")
    )


def candidate_score(decayed: Column, memory: Column, confidence, text_score: Column, usage) -> Column:
    """Decayed strength, confidence, text relevance and use in one score; a pattern counts 0.5 at least, no strength gives 0."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = (
        decayed
        * (0.5 + 0.5 * clamp(F.coalesce(col(confidence), F.lit(1.0))))
        * clamp(text_score)
        * (1 + 0.1 * F.log1p(F.coalesce(col(usage), F.lit(0)).cast("double")))
    )
    score = F.when((decayed == 0) | F.isnan(score), F.lit(0.0)).otherwise(score)
    return F.when((memory == "pattern") & (score > 0), F.greatest(score, F.lit(0.5))).otherwise(score)


def tokens_of(text) -> Column:
    """A text's cost in tokens: a quarter of its UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(col(text)) / 4).cast("bigint")


def bare(text) -> Column:
    """Lower case without marks on Latin letters."""
    return F.lower(F.translate(col(text), MARKED, BARE))


def terms(*texts) -> Column:
    """The words of one or several texts: runs of letters and digits, lower case, without marks. Null texts have none."""
    joined = F.concat_ws(" ", *(col(t) for t in texts))
    return F.filter(F.split(bare(joined), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 for unequal lengths, empty arrays and zero vectors."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    ok = (F.size(col(a)) == F.size(col(b))) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def cut_at_word(text, most: int = 80) -> Column:
    """At most ``most`` characters, cut back to a word's end; whole characters, never bytes."""
    c = col(text)
    head = F.substring(c, 1, most)
    back = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(back)
