"""Personal information inside free text: voting labelers, reliabilities by expectation-maximisation, a span classifier."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.common import spread, table
from chronoloom.llm.names import FORMS, SHORT_FORMS, _parts
from chronoloom.llm.words import folded

KINDS = ("email", "phone", "id_number", "address", "name")
NAME, WORD = KINDS.index("name"), -1
BUCKETS = 32
#: Bits of the map of known words that workers hold, 2 MB at any size of the gazetteer.
MAP_BITS = 1 << 24

# --- candidates: wide patterns, wrong ones are for the labelers to vote down ---
AT = r"(?:\s?[(\[{]\s?at\s?[)\]}]\s?|\s?@\s?|\sat\s)"
DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+%'-]*?{AT}[A-Za-z0-9][\w-]*(?:{DOT}[A-Za-z0-9][\w-]*)+", re.I)
NUMBER = re.compile(r"(?<![\w@#/.:+-])(?:\+\s?|\()?\d(?:[ ./() -]{0,2}\d){5,16}(?![\w@])")
NANP = r"(?:(?:\+|00)?1[ .-]?)?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-]?)[2-9]\d\d[ .-]?\d{4}"
NATIONAL = re.compile(
    rf"{NANP}"
    r"|(?:\+|00 ?)44[ .-]?(?:\(0\)[ ]?)?\d(?:[ .-]?\d){8,9}|0(?:\d{2}[ ]\d{4}[ ]\d{4}|\d{3}[ ]\d{3}[ ]\d{4}|\d{4}[ ]?\d{6}|\d{4}[ ]\d{3}[ ]\d{3})"
    r"|(?:(?:\+|00 ?)33[ .]?(?:\(0\)[ ]?)?|0)[1-9](?:[ .-]?\d\d){4}"
    r"|(?:\+|00 ?)49[ .-]?(?:\(0\)[ ]?)?[1-9]\d{1,4}(?:[ ./-]?\d{2,8}){1,3}|0[1-9]\d{1,4}[ /-]\d{3,8}(?:[ -]\d{1,5})?"
    r"|(?:\+|00 ?)34[ .-]?[6-9]\d\d(?:[ .-]?\d{2,3}){2,3}"
    r"|\+[1-9]\d{0,2}(?:[ .-]?\d{1,4}){3,5}"
)
IDS = {
    "us": re.compile(r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|\d{2}-\d{7}"),
    "gb": re.compile(r"[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d]"),
    "es": re.compile(r"(?:\d{8}|\d{2}\.\d{3}\.\d{3})[ -]?[A-Za-z]|[XYZxyz][ -]?\d{7}[ -]?[A-Za-z]"),
    "fr": re.compile(r"[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?"),
    "de": re.compile(r"\d{11}|\d{2} \d{3} \d{3} \d{3}|\d{2} ?\d{6} ?[A-Za-z] ?\d{3}"),
}
ID = re.compile(r"(?<![\w.@#/-])(?:" + "|".join(p.pattern for p in (IDS["gb"], IDS["es"], IDS["fr"], IDS["de"], IDS["us"])) + r")(?![\w@]|[./-]\w)")
SUITE = r"(?:,?\s(?:(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Room|Rm)\.?\s\w{1,5}\b|\d{1,2}(?:st|nd|rd|th)\s[Ff]loor)|,?\s#\s?\w{1,5}\b)?"
EN_TYPES = r"(?:Street|St\.|St\b|Road|Rd|Lane|Ln|Mews|Terrace|Crescent|Close|Drive|Dr(?!\.)|Avenue|Ave|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Square|Sq|Row|Gardens|Grove|Hill|Parkway|Pkwy|Highway|Hwy|Walk|Quay)(?![\w-])"
ADDRESS = {
    "en": rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Floor|Room)\s\w{{1,5}},\s)?\d{{1,5}}[a-zA-Z]?\s(?:(?:\d{{1,3}}(?:st|nd|rd|th)|[A-Z][\w'’]*(?:-[A-Z]\w+)*)\s){{1,4}}?(?:{EN_TYPES})(?!\s(?:[A-Z]\w+\s)?{EN_TYPES}){SUITE}",
    "de": r"(?:(?:Alte[rs]?|Neue[rs]?|Am|An\sder|Im|Zum|Zur|Große|Kleine|Obere|Untere|Hintere|Lange)\s)?[A-ZÄÖÜ][\wäöüß]*(?:-[A-ZÄÖÜ]?[\wäöüß]+)*(?:(?<=\w)(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|hof|steig|chaussee)|-(?:Straße|Str\.|Weg|Allee|Gasse|Platz|Ring|Damm|Ufer))\s\d{1,4}(?:\s?[a-h](?!\w))?(?:,\s(?:\d\.\s?(?:OG|Stock|Etage)|Whg\.?\s\w+|EG))?",
    "es": r"(?:Calle|C/|C\.|Avda\.?|Av\.|Avenida|Paseo|P\.º|Plaza|Pza\.|Camino|Ronda|Carrer|Travesía|Glorieta)\s(?:(?:de|del|la|las|los|el|y)\s){0,3}[A-ZÁÉÍÓÚÑ][\wáéíóúñü]*(?:\s(?:(?:de|del|la|las|los)\s){0,2}[A-ZÁÉÍÓÚÑ][\wáéíóúñü]*){0,3},?\s(?:n\.?º\s?|núm\.\s?)?\d{1,4}(?:\s?[A-Z](?!\w))?(?:,\s(?:bajo|ático|entlo\.?|\d{1,2}\.?\s?[ºª]\s?(?:[A-Z](?!\w)|izq\.?|dcha\.?|izda\.?|centro)?)(?:\s[A-Z](?!\w))?)?",
    "fr": r"(?:Appt?\.?\s\w{1,4},\s)?\d{1,4}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|impasse|chemin|allée|quai|cours|route|square|passage|villa)\s(?:(?:de\sla|de\sl['’]|des|du|de|d['’]|la|le|les)\s?)?[A-ZÀ-Þ][\wà-ÿ'’]*(?:-(?:(?:de|du|des|la|le|les|sur)-)?[A-ZÀ-Þ][\wà-ÿ'’]*){0,4}(?:(?:\s[A-ZÀ-Þ][\wà-ÿ'’-]*){1,2}(?=,\s\d{5}|\x22))?(?:,\s(?:bât\.?\s\w+|appt?\.?\s\w+|\d{1,2}(?:e|er|ème)\sétage))?",
}
ADDRESSES = {k: re.compile(r"(?<![\w/#-])" + p.replace(r"[\s-]", "[ \u00a0-]").replace(r"\s", "[ \u00a0]")) for k, p in ADDRESS.items()}
LOOSE_ADDRESS = re.compile(rf"(?<![\w/#-])(?:{EN_TYPES}\s\d{{1,4}}|\d{{1,4}}\s[A-Z]\w+\s[A-Z]\w+)(?!\w)")
TOKEN = r"[^\W\d_]+(?:['’][^\W\d_]{2,})?(?:-[^\W\d_]+)*"
TOKENS = re.compile(rf"(?<![\w@.+/-]){TOKEN}(?![\w@]|[.+_-]\w)")
#: A word with the shape of a name: a capital and small letters, or three capitals and more; McCall, O'Brien, Jean-Luc.
SMALL, LARGE = r"[^\W\d_A-ZÀ-ÖØ-Þ]", r"[^\W\d_a-zß-öø-ÿ]"
NAMELIKE = re.compile(rf"(?:(?:Mc|Mac|De|Di|Du|La|Le|Van|Fitz|[ODL]['’])?{LARGE}{SMALL}+|{LARGE}{{3,}})(?:[-'’](?:{LARGE}{SMALL}*|{LARGE}{{2,}}))*")
CAPS = re.compile(r"[A-ZÀ-Þ][a-zà-ÿßşğıćčńłœŞ'’]*(?:-[A-ZÀ-Þ][a-zà-ÿ]+)*|[A-ZÀ-ÞŞ'’-]+")
PERSON = re.compile(rf"(?<![\w@.+/-])({TOKEN})(\.?)(,?)[ \u00a0]{{1,2}}(?:([^\W\d_])\.[ \u00a0]{{1,2}})?({TOKEN})(\.?)(?:[ \u00a0]([^\W\d_])\.)?(?![\w@]|[.+_-]\w)")

# --- words of context, fixed values ---
PHONE_WORDS = re.compile(r"(?i)\b(?:phone|tele?(?:fon|phone|fono|léfono)?|teléfono|mobile?|móvil|call|sms|on-call|joignable|rückruf|llam\w+|appel\w*|ring|dial|fax|number|numéro|número|nummer|handy|cell|lead|contact|reach\w*|whatsapp|unter)\b")
ID_WORDS = re.compile(r"(?i)\b(?:ssn|social security|tax id|itin|tin|insurance|ni number|nino|ni num\w*|dni|nie|nif|documento|steuer-?id\w*|idnr|steuernummer|sécurité sociale|nir|insee|sozialversicherung\w*|rentenversicherung\w*|seguridad social|national id|id card|passport|ausweis\w*)\b")
OTHER_WORDS = re.compile(r"(?i)(?:\b(?:ean|build|serial|part(?: no)?|invoice|ratio|ticket|order|sha|meter|range|sku|isbn|batch|version|issue|pr|rows?|offset|commit|sn|port|pid|trace|tracking|lot|iban|account|counter|revision|upgrade)\b|#)[\s.:=#]*(?:no\.?|number)?[\s.:=#]*[A-Z-]*$")
ADDRESS_WORDS = re.compile(r"(?i)(?:address|adresse|dirección|addr\W|street\W|deliver\w*|liefer\w*|ship\w*|visit\w*|(?:lives|located|office|meet\w*) (?:at|to)|wohnt|domicil\w*|sede|vive en|habite|envío a|livr\w+)")
BEFORE_NAME = re.compile(r"(?i)(?:\b(?:dr|prof|mr|mrs|ms|miss|sir|herr|frau|señora?|sra?|mme|rev)\b\.?|\bcc|\b[a-z-]+-by:|\b(?:from|to|owner|author|user|reporter|assignee|contact|name|attn|kontakt|auteur|autor)\W{1,4}|--|\b(?:by|with|per|via|to|of|thanks|hi|hello|dear|laut|von|mit|bei|avec|selon|con|según|por|para)|d['’]après)\s*$")
AFTER_NAME = re.compile(r"^(?:['’]s\b|:|\s<|\)|\s(?:and|und|y|et|ist|hat|war|is|was|has|will|est|dit)\b|,|\"|;|\s[–—]|$|\n|\s[a-z-]+(?:ed|ó)\b|\sabout\b)")
ORG_WORDS = set("insurance group foods international water technologies research institute timber products software development power light robotics laboratories freight systems data services analytics media holdings health partners marine engineering team teams bank university association foundation ministry department".split())
STREETISH = re.compile(r"(?i)\b(?:street|road|lane|mews|terrace|crescent|close|drive|avenue|calle|paseo|rue|impasse|straße)\b")
TOPLEVEL = set("com org net edu gov io dev co uk us de es fr eu info biz ai app example test invalid local me tv ch at it nl".split())


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _check(form: str, s: str) -> int:
    """Whether the check digit or letter is right: 1, -1, or 0 where there is none."""
    d = _digits(s)
    if form == "es":
        body = re.sub(r"[^0-9A-Z]", "", s.upper())
        body = {"X": "0", "Y": "1", "Z": "2"}.get(body[0], body[0]) + body[1:]
        return 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(body[:-1]) % 23] == body[-1] else -1
    if form == "fr" and len(d) == 15:
        return 1 if 97 - int(d[:13]) % 97 == int(d[13:]) else -1
    if form == "de" and len(d) == 11:
        p = 10
        for c in d[:10]:
            p = ((int(c) + p) % 10 or 10) * 2 % 11
        return 1 if (11 - p) % 10 == int(d[10]) else -1
    return 0


def _last(pattern: re.Pattern, text: str) -> int:
    """Where the last match ends, 0 if there is none."""
    return max((m.end() for m in pattern.finditer(text)), default=0)


def _email(text):
    for m in EMAIL.finditer(text):
        s, word = m[0], " at " in m[0].lower()
        host = re.split(AT, s, maxsplit=1, flags=re.I)[-1]
        labels = [x for x in re.split(DOT, host, flags=re.I) if x]
        alpha = labels[-1].isalpha() and len(labels[-1]) > 1
        before = text[max(0, m.start() - 24) : m.start()]
        local = s[: len(s) - len(host)]
        yield m.start(), m.end(), [
            1 if "@" in s and alpha else (-1 if not alpha else 0),
            1 if re.search(r"[(\[{]at|\sdot\s|\(dot\)|\[\.\]", s, re.I) else (-1 if word else 0),
            1 if labels[-1].lower() in TOPLEVEL else -1,
            1 if re.search(r"(?i)(?:<|mailto:|to|an|a|contact|for|user\W+|reply-to:|lead|\n)\s*$", before) else 0,
            -1 if word and " dot " not in s.lower() and not re.search(r"[._+\d-]", local.strip()) else (1 if re.search(r"[._+\d-]|@", local) else 0),
        ]


def _phone(text):
    for m in NUMBER.finditer(text):
        s = m[0]
        if s.startswith("(") and ")" not in s:
            continue
        d, before = _digits(s), text[max(0, m.start() - 32) : m.start()]
        near = re.split(r"[.;!?\n]\s", before)[-1]
        # of two captions the nearer one holds
        called = _last(PHONE_WORDS, near)
        caption = max(_last(ID_WORDS, near), _last(ID_WORDS, before[-18:]) and 1) > called or OTHER_WORDS.search(before) is not None
        called = called > 0 and not caption
        lead = s.startswith(("+", "00", "0", "(")) or re.fullmatch(NANP, s) is not None
        yield m.start(), m.end(), [
            # digits alone have the form of many numbers
            -1 if not NATIONAL.fullmatch(s) else 1 if not s.isdigit() or called else (-1 if caption else 0),
            -1 if caption else (1 if called else 0),
            1 if lead and 9 <= len(d) <= 14 else -1,
            -1 if re.fullmatch(r"\d{3}([ -])\d{2}\1\d{4}|\d{4}-\d{2}-\d{2}.*|\d{1,3}(?:\.\d{1,3}){3}.*|\d{2} \d{3} \d{3} \d{3}|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d", s) else (1 if re.search(r"[ ().+/-]", s) else 0),
            1 if re.match(r"(?:,? ext|\W*$|[\"',.;)\s])", text[m.end() : m.end() + 6]) else -1,
        ]


def _id_number(text):
    for m in ID.finditer(text):
        s = m[0]
        form = next((k for k in ("gb", "es", "fr", "de", "us") if IDS[k].fullmatch(s)), "us")
        before = text[max(0, m.start() - 34) : m.start()]
        near = re.split(r"[.;!?\n]\s", before)[-1]
        cap = ID_WORDS.search(near[-30:]) or ID_WORDS.search(before[-26:])
        shaped = form in ("gb", "es") or re.search(r"[ .-]", s)
        yield m.start(), m.end(), [
            1 if cap else -1,
            -1 if OTHER_WORDS.search(before) else (-1 if PHONE_WORDS.search(near[-14:]) and not cap else 0),
            _check(form, s),
            1 if shaped else 0,
            1 if form in ("gb", "es", "fr") else (-1 if NATIONAL.fullmatch(s) and not cap else 0),
        ]


# Words of street names by language; forms are looked for only where one of them occurs.
STREETS = {
    "en": frozenset("Street St Road Rd Lane Ln Mews Terrace Crescent Close Drive Dr Avenue Ave Boulevard Blvd Court Ct Way Place Pl Square Sq Row Gardens Grove Hill Parkway Pkwy Highway Hwy Walk Quay".split()),
    "es": frozenset("Calle C Avda Av Avenida Paseo P Plaza Pza Camino Ronda Carrer Travesía Glorieta".split()),
    "fr": frozenset("rue avenue av boulevard bd place impasse chemin allée quai cours route square passage villa".split()),
}
STREET_ENDS = ("straße", "strasse", "str", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "hof", "steig", "chaussee")


def _address(text, languages):
    seen = []
    for form, p in [*((k, ADDRESSES[k]) for k in ADDRESSES if k in languages), ("loose", LOOSE_ADDRESS)]:
        for m in p.finditer(text):
            if form == "loose" and any(a < m.end() and m.start() < b for a, b in seen):
                continue
            seen.append(m.span())
            before, after = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 12]
            yield m.start(), m.end(), [
                -1 if form == "loose" else 1,
                1 if ADDRESS_WORDS.search(before) else 0,
                1 if re.match(r"(?:,\s(?:\d{4,5}\s)?[A-Z]|,? same|[\".;\n]|\s(?:on|in|ist|rejected)\b|$)", after) else 0,
                -1 if re.search(r"(?:[#/v]|\bPR|\bsee|[Ll]ane)\s*$", before) else 0,
                1 if re.search(r"\d", m[0]) and re.search(r"[A-ZÀ-Þ]", m[0]) and form != "loose" else -1,
            ]


#: What the first pass knows of a pair of words, as bits: Family, Given; first or second word an initial; shape votes yes;
#: both begin alike; counts only if the other word is a family name; has the shape of a name; and what tables know of it.
COMMA, INITIAL_A, INITIAL_B, SHAPE, ALIKE, NEEDS_A, NEEDS_B, SHAPED = (1 << i for i in range(8))
GIVEN_A, GIVEN_B, FAMILY_A, FAMILY_B = (1 << i for i in range(4))
#: Marks of a single word: tables may know it, shape of a name, one letter.
KNOWN, LIKE, ONE = 1, 2, 4


def _name(text, words, info):
    """Pairs of words that may be a name: by a word that tables may know, or by shape. (start, stop, bits, votes of the words around, both words)."""
    # a word that tables may know beside any other, two with the shape of a name or one and an initial, with a middle initial or none
    marks = [x[1] for x in info]
    first = [i for i, (x, y) in enumerate(zip(marks, marks[1:])) if x and y or x & KNOWN or y & KNOWN or y & ONE]
    if not first:
        return
    starts = [m.start() for m in TOKENS.finditer(text)]
    for i in first:
        if not (m := PERSON.match(text, starts[i])):
            continue
        a, dot_a, comma, _, b, dot_b, mid2 = m.groups()
        if dot_a and len(a) > 1 or (dot_b and mid2):
            continue
        (fa, mark_a, _), (fb, mark_b, _) = words[a], words[b]
        (known_a, like_a, ia), (known_b, like_b, ib) = ((x & KNOWN > 0, x & LIKE > 0, x & ONE > 0) for x in (mark_a, mark_b))
        if not fa or not fb or ia and ib:
            continue
        if ia or ib:
            shaped = bool(ia and a.isupper() and dot_a and like_b or ib and b.isupper() and dot_b and like_a)
        else:
            shaped = like_a and like_b and a.isupper() == b.isupper()
        if not (shaped or known_a or known_b) or ia and a.islower() and not dot_a or ib and b.islower() and (a[0].isupper() or not dot_b):
            continue
        end = m.end(6) if ib and dot_b else m.end(7) + 1 if mid2 and not ib else m.end(5)
        before, after = text[max(0, m.start() - 22) : m.start()], text[end : end + 40]
        nxt = folded(after[:30], False)[:1] if after[:1] in (" ", "-") else []
        org = any(w in ORG_WORDS or w in FORMS for w in (*fa, *fb, *nxt))
        bits = (COMMA, bool(comma)), (INITIAL_A, ia), (INITIAL_B, ib), (SHAPE, CAPS.fullmatch(a) and CAPS.fullmatch(b)), (ALIKE, a[0].isupper() == b[0].isupper())
        bits = *bits, (NEEDS_A, ib and not b.isupper()), (NEEDS_B, ia and (not a.isupper() or b[0].islower())), (SHAPED, shaped)
        around = [1 if BEFORE_NAME.search(before) else 0, -1 if org or STREETISH.search(m[0]) else (1 if AFTER_NAME.match(after) else 0)]
        yield m.start(), end, sum(x for x, yes in bits if yes), around, fa, fb


def name_votes(flags: Column, common: Column) -> Column:
    """Votes on a name, null if it is none: both words known, their order, the words before, the shape, the words after, and how rare its words are in small letters.

    Columns: ``form`` (bits of ``_name``), ``votes`` (of the words around);
    ``flags`` tells which words are given and family names.
    """
    on = lambda c, b: c.bitwiseAND(F.lit(b)) > 0
    comma, ia, ib, shape, alike, needs_a, needs_b, shaped = (on(F.col("form"), b) for b in (COMMA, INITIAL_A, INITIAL_B, SHAPE, ALIKE, NEEDS_A, NEEDS_B, SHAPED))
    ga, gb, ma, mb = (on(flags, b) for b in (GIVEN_A, GIVEN_B, FAMILY_A, FAMILY_B))
    known = ((ga | ia) & mb) | ((gb | ib) & ma)
    some = (ga & ~comma) | (shaped & ((mb & ~comma & ~ia) | (ma & comma & ~ib)))
    ordered = ((ga | ia) & mb & ~comma) | ((gb | ib) & ma)
    vote = lambda yes, none: F.when(yes, "y").when(none, "-").otherwise("n")
    none = (needs_a & ~ma) | (needs_b & ~mb) | ~(shaped | ga | gb | ((ia | ib) & (ma | mb)))
    return F.when(
        ~none,
        F.concat(
            vote(known, some), vote(ordered, (ga | ia) & ~comma), F.substring("votes", 1, 1), vote(shape, known & alike), F.substring("votes", 2, 1),
            vote(common < 0.2, common <= 0.5),
        ),
    )


class Words(dict):
    """What is known of each word that workers meet: (folded words, marks, language of a street word)."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def likely(self, word: str) -> bool:
        at = xxhash.xxh64_intdigest(word.encode(), 42) % MAP_BITS
        return bool(self.bits) and self.bits[at >> 3] >> (at & 7) & 1 == 1

    def __missing__(self, word: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        f, low = folded(word, False), word.lower()
        street = next((k for k, names in STREETS.items() if word in names), "de" if low.endswith(STREET_ENDS) else None)
        mark = KNOWN * any(self.likely(w) for w in f) | LIKE * (NAMELIKE.fullmatch(word) is not None) | ONE * (len(word) == 1)
        self[word] = out = (f, mark, street)
        return out


LONG_NUMBER = re.compile(r"\d(?:[ ./() -]{0,2}\d){5}")
AT_WORD = re.compile(r"(?i)@|\bat\b")


def candidates(text: str, words: Words, counts: Counter):
    """(kind, start, stop, votes, context bucket, form, word, word) of every candidate span; adds the text's words to ``counts``.

    Votes are letters: y, n or - for none. Those on a name are only the ones on the words around it.
    """
    own = TOKENS.findall(text)
    counts.update(own)
    info = [words[t] for t in own]
    found = []
    if AT_WORD.search(text):
        found += [(0, s, e, v, 0, None, None) for s, e, v in _email(text)]
    if LONG_NUMBER.search(text):
        found += [(1, s, e, v, 0, None, None) for s, e, v in _phone(text)] + [(2, s, e, v, 0, None, None) for s, e, v in _id_number(text)]
    found += [(3, s, e, v, 0, None, None) for s, e, v in _address(text, {x[2] for x in info})]
    found += [(NAME, s, e, v, form, fa, fb) for s, e, form, v, fa, fb in _name(text, words, info)]
    for k, s, e, votes, form, fa, fb in found:
        last = folded(text[max(0, s - 20) : s], False)
        yield k, s, e, "".join("n-y"[v + 1] for v in votes), xxhash.xxh32_intdigest(last[-1] if last else "") % BUCKETS, form, fa, fb


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Dawid and Skene's expectation-maximisation for one kind: the prior and P(vote | class) of each labeler.

    ``counts``: how often each pattern of votes occurs. Starts from the
    majority, with the first labeler (the form, or the gazetteer) counted twice; one imagined vote of each value for every class keeps labelers
    that never met a class at even odds.
    """
    pats = np.array([["n-y".index(c) for c in p] for p in counts])
    n = np.array(list(counts.values()), float)
    p = 1 / (1 + np.exp(-1.5 * ((pats - 1).sum(axis=1) + pats[:, 0] - 1)))
    for _ in range(rounds):
        w = np.stack([(1 - p) * n, p * n])
        prior = np.clip((w[1].sum() + 1) / (n.sum() + 2), 0.02, 0.98)
        emit = np.array([[[w[c][pats[:, j] == v].sum() + 1 for v in range(3)] for j in range(pats.shape[1])] for c in range(2)])
        emit /= emit.sum(axis=2, keepdims=True)
        logit = np.log(prior / (1 - prior)) + np.log(emit[1] / emit[0])[np.arange(pats.shape[1]), pats].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return float(prior), emit


def posterior(votes: str, prior: float, emit: np.ndarray) -> float:
    v = ["n-y".index(c) for c in votes]
    z = np.log(prior / (1 - prior)) + sum(np.log(emit[1][j][x] / emit[0][j][x]) for j, x in enumerate(v))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(votes: str, ctx: int) -> np.ndarray:
    x = np.zeros(3 * len(votes) + BUCKETS + 1)
    for j, c in enumerate(votes):
        x[3 * j + "n-y".index(c)] = 1
    x[3 * len(votes) + ctx] = 0.3
    x[-1] = 1
    return x


def fit_classifier(rows: list[tuple[str, int, float, int]], steps: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression of the posteriors on votes and the bucket of the word before the span.

    ``rows``: votes, bucket, posterior and how many spans have them. A row
    counts by the root of its number, so that the most common forms don't drown
    the rest.
    """
    x = np.stack([features(v, c) for v, c, _, _ in rows])
    y = np.array([p for _, _, p, _ in rows])
    n = np.sqrt(np.array([k for *_, k in rows], float))
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= 2.0 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + decay * w)
    return w


def gazetteer(people: DataFrame, *, name: str, kind: str) -> DataFrame:
    """(w, given, family): the words of the names of all people that the graph knows, and which kind of name each is.

    A word is a given name if it mostly stands first, or last in "Family,
    Given"; else it is a family name. Common short forms are given names, too.
    """
    rows = people.filter(F.lower(F.trim(kind)) == "person").select(F.col(name).alias("name")).dropna().distinct().withColumn("p", _parts("name"))
    rows = rows.select("name", F.expr("filter(p.words, x -> length(x) > 1)").alias("w")).filter("size(w) >= 2")
    end = lambda w, g: F.struct(F.expr(w).alias("w"), g.cast("double").alias("g"))
    comma = F.col("name").contains(",")
    ends = rows.select(F.explode(F.array(end("w[0]", ~comma), end("w[size(w) - 1]", comma))).alias("x"))
    ends = ends.groupBy("x.w").agg((F.avg("x.g") >= 0.5).alias("given"))
    listed = people.sparkSession.createDataFrame([(x,) for x in sorted({x for pair in SHORT_FORMS.split("|") for x in pair.split()})], "w string").withColumn("given", F.lit(True))
    return ends.unionByName(listed).groupBy("w").agg(F.max("given").alias("given")).select("w", "given", (~F.col("given")).alias("family"))


def word_map(names: DataFrame) -> bytes:
    """One bit for each known word, in a map of fixed size. A set bit may be another word's, so what it lets through is joined with the words themselves."""
    at = F.pmod(F.xxhash64("w"), F.lit(MAP_BITS))
    rows = names.select((at / 32_768).cast("bigint").alias("b"), (at % 32_768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = bytearray(MAP_BITS // 8)
    for r in rows:
        out[r.b * 4096 : (r.b + 1) * 4096] = r.m
    return bytes(out) if rows else b""


def _model(counts: list, kinds: list[int]) -> list[tuple[int, str, int, float]]:
    """(kind, votes, ctx, p) of all that was counted: reliabilities first, then the span classifier of each kind."""
    out = []
    for k in kinds:
        own = sorted((r.votes, r.ctx, r.n) for r in counts if r.kind == k)
        if not own:
            continue
        patterns: dict[str, int] = {}
        for v, _, n in own:
            patterns[v] = patterns.get(v, 0) + n
        prior, emit = reliabilities(patterns)
        w = fit_classifier([(v, c, posterior(v, prior, emit), n) for v, c, n in own])
        out += [(k, v, c, float(1 / (1 + np.exp(-features(v, c) @ w)))) for v, c, _ in own]
    return out


SPAN = "s int, e int, kind int, votes string, ctx int, form int, found string, a string, b string"


def personal_spans(df: DataFrame, *, id: str, text: str, names: DataFrame, least: float = 0.5) -> DataFrame:
    """(``id``, text_hash, kind, start, stop, found_text): the personal data of each text, places in code points.

    1. Wide patterns propose spans, for names any two words that a table may
       know or that have the shape of a name (also with an initial). Five or
       six labelers a kind (form, tables, check digits, words before and after,
       how often the corpus has the words in small letters) vote on each or
       abstain.
    2. The vote patterns of the whole corpus are counted, at most 3^6 a kind,
       and expectation-maximisation estimates how reliable every labeler is.
    3. A logistic span classifier is trained on the resulting posteriors of all
       spans, counted by votes and bucket of the word before, and applied to
       each span.
    4. Words of the names found join the table of known ones, and names are
       judged once more; a name that either round accepts is one.

    ``names``: (w, given, family) of any size, ``gazetteer`` makes it. It is one
    labeler and joined by word; workers hold a map of fixed size only, which
    says whose pairs of small letters are worth a look. Only candidates are
    shuffled, never texts. Of overlapping spans e-mail and address stay before
    numbers and names, then the longer, then the surer; that is decided in each
    run of overlapping spans. Repeated rows of one id and text count once. Null,
    empty and blank texts have no spans; texts are scanned whole; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    names = table(names.select("w", "given", "family"), "gazetteer")
    shared = spark.sparkContext.broadcast(word_map(names))
    rows = spread(df.select(F.col(id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\S")))
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches):
        words, counts = Words(shared.value), Counter()
        names = ["id", "h", *(x.split()[0] for x in SPAN.split(", "))]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

        def counted():
            """Words as rows of kind WORD: how often in small letters (s) and otherwise (e)."""
            by: dict[str, list[int]] = {}
            for t, n in counts.items():
                for w in words[t][0]:
                    by.setdefault(w, [0, 0])[not t.islower()] += n
            counts.clear()
            n = len(by)
            cols = [[0] * n, [x for x, _ in by.values()], [y for _, y in by.values()], [WORD] * n, [None] * n, [0] * n, [0] * n, [*by], [None] * n, [None] * n]
            return [pa.nulls(n, id_type), *(pa.array(c, t) for c, t in zip(cols, kinds))]

        id_type = None
        for b in batches:
            id_type = b.column("id").type
            at, cols = [], [[] for _ in kinds]
            for i, (h, t) in enumerate(zip(b.column("h").to_pylist(), b.column("text").to_pylist())):
                for k, s, e, votes, ctx, form, fa, fb in candidates(t, words, counts):
                    at.append(i)
                    for c, x in zip(cols, (h, s, e, k, votes, ctx, form, t[s:e], fa and " ".join(fa), fb and " ".join(fb))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)
            if len(counts) > 100_000:
                yield pa.RecordBatch.from_arrays(counted(), names=names)
        if counts:
            yield pa.RecordBatch.from_arrays(counted(), names=names)

    found = table(rows.mapInArrow(find, f"id {kind}, h bigint, {SPAN}"), "spans")
    cands = found.filter(F.col("kind") != WORD).distinct()
    common = found.filter(F.col("kind") == WORD).groupBy(F.col("found").alias("w")).agg((F.sum("s") / (F.sum("s") + F.sum("e"))).alias("low"))
    cands = table(cands, "candidates")
    named = cands.filter(F.col("kind") == NAME)

    # the words of each distinct pair with what tables and corpus know of them
    side = lambda c, given, family: F.transform(F.split(c, " "), lambda x, i: F.struct(x.alias("w"), F.when(i == 0, given).otherwise(0).alias("given_bit"), F.lit(family).alias("family_bit")))
    pairs = named.select("a", "b").distinct()
    pairs = pairs.select("a", "b", F.explode(F.concat(side("a", GIVEN_A, FAMILY_A), side("b", GIVEN_B, FAMILY_B))).alias("x")).select("a", "b", "x.*")
    pairs = table(pairs.join(common, "w", "left").join(names, "w", "left"), "pairs")

    def flags(given: str, family: str) -> Column:
        bit = lambda yes, b: F.when(F.expr(yes), F.col(b)).otherwise(F.lit(0))
        return F.bit_or(bit(given, "given_bit").bitwiseOR(bit(family, "family_bit"))).cast("int")

    rare = F.coalesce(F.max(F.when(F.length("w") > 1, F.col("low"))), F.lit(0.0)).alias("low")
    per = pairs.groupBy("a", "b").agg(flags("given", "family").alias("flags"), rare)
    key = ["id", "h", "s", "e", "kind"]
    other = cands.filter(F.col("kind") != NAME).select(*key, "found", "votes", "ctx")
    first = named.join(per, ["a", "b"]).withColumn("votes", name_votes(F.col("flags"), F.col("low"))).dropna(subset=["votes"])
    # at most 5 kinds x 3^6 patterns x BUCKETS rows, whatever the corpus
    count = lambda x: x.groupBy("kind", "votes", "ctx").agg(F.count("*").alias("n")).collect()
    as_table = lambda m: F.broadcast(spark.createDataFrame(m, "kind int, votes string, ctx int, p double"))
    model = as_table(_model(count(other.unionByName(first.select(*other.columns))), [*range(len(KINDS))]))

    # words of the names that were found: given or family name by their place
    swap = "(form & {c}) > 0 OR ((flags & {gb}) > 0 AND (flags & {ga}) = 0) OR ((flags & {ma}) > 0 AND (flags & {mb}) = 0)".format(c=COMMA, ga=GIVEN_A, gb=GIVEN_B, ma=FAMILY_A, mb=FAMILY_B)
    seen = first.join(model, ["kind", "votes", "ctx"]).select("a", "b", F.expr(swap).alias("swap"), (F.col("p") >= least).alias("ok"))
    seen = seen.groupBy("a", "b", "swap").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    place = lambda c, first: F.transform(F.split(c, " "), lambda x: F.struct(x.alias("w"), first.alias("g")))
    seen = seen.select("n", "k", F.explode(F.concat(place("a", ~F.col("swap")), place("b", F.col("swap")))).alias("x")).filter("length(x.w) > 1")
    learned = seen.groupBy("x.w").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.when(F.col("x.g"), F.col("k")).otherwise(0)).alias("g"))
    learned = learned.filter("k > 0 AND 2 * k >= n").select("w", (2 * F.col("g") > F.col("k")).alias("as_given"))
    # a word of a table keeps its kind, a common word stays one
    more = pairs.join(learned, "w", "left").withColumn("as_given", F.when(F.col("given").isNull() & (F.coalesce("low", F.lit(0.0)) <= 0.5), F.col("as_given")))
    more = more.groupBy("a", "b").agg(flags("given", "family").alias("flags"), flags("given OR as_given", "family OR NOT as_given").alias("flags2"), rare)
    both = named.join(more, ["a", "b"]).withColumns({"v1": name_votes(F.col("flags"), F.col("low")), "v2": name_votes(F.col("flags2"), F.col("low"))})
    both = table(both.filter("v2 IS NOT NULL").select(*key, "found", "v1", "v2", "ctx"), "names")
    again = as_table(_model(count(both.withColumnRenamed("v2", "votes")), [NAME]))
    judged = both.join(model.select("kind", "ctx", F.col("votes").alias("v1"), F.col("p").alias("p1")), ["kind", "ctx", "v1"], "left")
    judged = judged.join(again.select("kind", "ctx", F.col("votes").alias("v2"), F.col("p").alias("p2")), ["kind", "ctx", "v2"])
    judged = judged.select(*key, "found", F.greatest("p1", "p2").alias("p"))
    good = other.join(model, ["kind", "votes", "ctx"]).select(*key, "found", "p").unionByName(judged).filter(F.col("p") >= least)

    # runs of overlapping spans, then the best of each run and what it leaves room for
    w = Window.partitionBy("id", "h").orderBy("s", "e", "kind")
    good = good.withColumn("new", F.coalesce(F.col("s") >= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    good = good.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    rank = "CASE kind WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END"
    rows = good.groupBy("id", "h", "run").agg(F.array_sort(F.collect_list(F.struct(F.expr(rank).alias("r"), F.expr("s - e").alias("l"), (-F.col("p")).alias("p"), F.when(F.col("kind") == 1, 9).otherwise(F.col("kind")).alias("r2"), "s", "e", "kind", "found"))).alias("l"))
    taken = F.expr("aggregate(l, slice(l, 1, 1), (t, x) -> IF(exists(t, y -> x.s < y.e AND y.s < x.e), t, array_append(t, x)))")
    out = rows.select("id", "h", F.explode(taken).alias("x"))
    label = F.get(F.array(*map(F.lit, KINDS)), F.col("x.kind"))
    return out.select(F.col("id").alias(id), F.col("h").alias("text_hash"), label.alias("kind"), F.col("x.s").alias("start"), F.col("x.e").alias("stop"), F.col("x.found").alias("found_text"))


def found_texts(spans: DataFrame, *, id: str) -> DataFrame:
    """(``id``, kind, found_text), once for each distinct text of a kind in a row."""
    return spans.select(id, "kind", "found_text").distinct()


def redacted(df: DataFrame, spans: DataFrame, *, id: str, text: str) -> DataFrame:
    """(``id``, ``text``) of each distinct row: personal data replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME], all else as it was."""
    own = df.select(F.col(id).alias("i"), F.col(text).alias("x")).distinct().withColumn("h", F.xxhash64("x"))
    per = spans.groupBy(F.col(id).alias("j"), F.col("text_hash").alias("g")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("l"))
    kept = F.transform("l", lambda s, k: F.concat(F.substring("x", F.when(k == 0, 0).otherwise(F.get("l", k - 1)["stop"]) + 1, s["start"] - F.when(k == 0, 0).otherwise(F.get("l", k - 1)["stop"])), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.expr("substring(x, l[size(l) - 1].stop + 1)")
    done = F.when(F.col("l").isNull(), F.col("x")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return own.join(per, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g")), "left").select(F.col("i").alias(id), done.alias(text))
