"""Scalar functions on text, as columns: parsing of requests, times, prices and names.

All run inside the JVM. Failing parses are null unless a default is named.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, keywords in the order of their precedence, boundaries.
TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"
TIME_RANGE = r"(?i)(\d{1,2}:\d{2})\s*(?:-|to)\s*(\d{1,2}:\d{2})"
CLOCKS = r"^([01]?\d|2[0-3]):[0-5]\d\D+([01]?\d|2[0-3]):[0-5]\d$"  # what is a time of day in it
BUDGET = r"(?i)budget of [楼$]?\s*([0-9]+(?:\.[0-9]+)?)"
MEAL_RANGE = r"(?i)meal costs?\s*(?:ranging from)?\s*[楼$]?\s*([0-9]+)\s*(?:to|-)\s*[楼$]?\s*([0-9]+)"
MEAL_OVER = r"(?i)meal costs?\s*(?:over|above)\s*[楼$]?\s*([0-9]+)"
DURATION_RANGE = r"([0-9]+(?:\.[0-9]+)?)\s*(?:to|-)\s*([0-9]+(?:\.[0-9]+)?)\s*(minutes?|hours?|days?)"
DURATION = r"([0-9]+(?:\.[0-9]+)?)\s*(minutes?|hours?|days?)"
HOTEL_CATEGORIES = [("economy", "Economy"), ("midscale", "Midscale"), ("luxury", "Luxury"), ("high-end", "Luxury"), ("budget", "Economy")]
INTENSITIES = [("relaxed", "low"), ("low", "low"), ("moderate", "moderate"), ("balanced", "moderate"), ("intense", "high"), ("high", "high"), ("packed", "high")]
BOUNDARIES = ["along with", "the itinerary", "itinerary should"]
CHECKIN = ["check-in", "check in", "check out"]
TRANSPORT = ["flight", "train", "travel", "airport", "station", "return"]
DINING = ["lunch", "dinner", "breakfast", "dining", "restaurant", "meal"]
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\))"
ZERO_WIDTH = r"[​-‏⁠﻿]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
INTERESTED, SPLIT, SHORTEST_TAG = "interested in", ",| and |/", 3
RATED_OF = ["/5", "/10"]
OPEN_END = 2147483647.0
DAY_MINUTES = 1440


class _Unicode:
    """NFKC by rule, from the tables that Python has.

    `one`: characters that fold to a single one; `more`: the decompositions of all others, but for
    Hangul syllables; `order`: marks by their combining class; `pairs`: what composes;
    `second`: characters without a class that compose with what stands before them.
    """

    def __init__(self):
        self.one, self.more, self.order, self.pairs = {}, {}, {}, {}
        for c in map(chr, (x for x in range(0x80, sys.maxunicode + 1) if not 0xD800 <= x < 0xE000)):
            folded, apart = unicodedata.normalize("NFKC", c), unicodedata.normalize("NFKD", c)
            if len(folded) == 1 and folded != c:
                self.one[c] = folded
            elif apart != c and not "\uac00" <= c <= "\ud7a3":
                self.more[c] = apart
            if unicodedata.combining(c):
                self.order[c] = unicodedata.combining(c)
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
                self.pairs["".join(chr(int(x, 16)) for x in parts)] = c
        jamo = {chr(x) for x in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
        self.second = {p[-1] for p in self.pairs if p[-1] not in self.order} | jamo
        self.open = {c for c in self.more if unicodedata.normalize("NFKC", c) != c}


def _class(chars) -> str:
    """Characters as a regular expression's class, in ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in out)


def _quoted(said: str) -> str:
    return "'" + said.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _looked_up(pairs: dict[str, str], key: str, otherwise: str) -> str:
    """What a table has for a key: of texts of some pairs each, the one whose place follows from order. A constant list of texts costs a plan little."""
    names = sorted(pairs)
    texts = ["\u0001" + "".join(f"{k}\u0002{pairs[k]}\u0001" for k in names[a : a + 64]) for a in range(0, len(names), 64)]
    at = f"size(filter(split({_quoted(chr(3).join(names[::64]))}, '\u0003'), b -> b <= k)) - 1"
    table = f"get(split({_quoted(chr(3).join(texts))}, '\u0003'), {at})"
    there = "instr(t, concat('\u0001', k, '\u0002'))"
    return f"transform(array({key}), k -> transform(array({table}), t -> if({there} > 0, substring_index(substring(t, {there} + length(k) + 2), '\u0001', 1), {otherwise}))[0])[0]"


def _calm(u: _Unicode, most: int = 10) -> str:
    """Ranges of characters that NFKC leaves alone whatever stands around them, marks apart: Latin ones, and the `most` longest of two bytes.

    A class is tried range by range for each character, so these are few; what they miss is only looked at more closely.
    """
    codes = [x for x in range(0x10000) if not 0xD800 <= x < 0xE000 and chr(x) not in u.second and not unicodedata.combining(chr(x)) and unicodedata.is_normalized("NFKC", chr(x))]
    ends = [k for k, (a, b) in enumerate(zip(codes, [*codes[1:], -1], strict=True)) if b != a + 1]
    ranges = [(codes[a + 1], codes[b]) for a, b in zip([-1, *ends[:-1]], ends, strict=True)]
    kept = {r for r in ranges if r[0] < 0x180 and r[1] - r[0] > 8} | set(sorted(ranges, key=lambda r: r[0] - r[1])[:most])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in sorted(kept))


def _folding() -> str:
    """NFKC of `x` in SQL.

    Texts of calm characters pass as they are; of others, stretches without a calm character are
    cut out, each with the character before it, and only they are folded. Characters that fold to
    one are replaced first. Of the rest only stretches with a character that decomposes, is a mark
    or joins what stands before it are looked at, each with the character before it: decomposed,
    marks sorted by class, and composed from left to right.
    """
    u = _Unicode()
    marks, joining = _class(u.order), _class({*u.order, *u.second})
    busy = _class({*u.order, *u.second, *u.open})
    all_ = lambda t, pattern: f"regexp_extract_all({t}, {_quoted('(?s)' + pattern)}, 0)"
    let_ = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    each = lambda parts, name, body: f"array_join(transform({parts}, {name} -> {body}), '')"
    rank = f"if(c rlike {_quoted(f'[{marks}]')}, ascii(translate(c, {_quoted(''.join(u.order))}, {_quoted(''.join(map(chr, u.order.values())))})), 0)"
    apart = each(all_("w", "."), "c", f"if(c rlike {_quoted('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')}, {_looked_up(u.more, 'c', 'c')}, c)")
    # marks behind one character, by class and then as they stand
    sorted_ = each(f"array_sort(transform({all_('v', '.')}, (c, i) -> struct({rank} as r, i as i, c as c)))", "m", "m.c")
    in_order = each(all_("g", f"[^{marks}][{marks}]*|[{marks}]+"), "v", f"if(v rlike {_quoted(f'(?s)^(.|[^{marks}].)$')}, v, {sorted_})")
    # leading and vowel letters of Hangul, or a syllable without tail and a tail
    lead, vowel, tail = "(ascii(s.a) - 4352)", "(ascii(c) - 4449)", "(ascii(c) - 4519)"
    made = lambda code: f"decode(unhex(hex({code})), 'UTF-16BE')"
    hangul = f"case when {lead} between 0 and 18 and {vowel} between 0 and 20 then {made(f'44032 + ({lead} * 21 + {vowel}) * 28')} when ascii(s.a) between 44032 and 55203 and (ascii(s.a) - 44032) % 28 = 0 and {tail} between 1 and 27 then {made(f'ascii(s.a) + {tail}')} end"
    pair = f"if(c between '\u1161' and '\u11c2', {hangul}, {_looked_up(u.pairs, 'concat(s.a, c)', 'null')})"
    state = "named_struct('out', {}, 'a', {}, 'rest', {}, 'r', {})".format
    step = f"if(p is not null and s.a <> '' and (s.rest = '' or (r > 0 and s.r < r)), {state('s.out', 'p', 's.rest', 's.r')}, if(r = 0, {state('concat(s.out, s.a, s.rest)', 'c', chr(39) * 2, '0')}, {state('s.out', 's.a', 'concat(s.rest, c)', 'r')}))"
    fold = f"aggregate({all_('q', '.')}, {state(chr(39) * 2, chr(39) * 2, chr(39) * 2, '0')}, (s, c) -> {let_(pair, 'p', let_(rank, 'r', step))}, s -> concat(s.out, s.a, s.rest))"
    composed = each(all_("d", f"[^{joining}][{joining}]*|[{joining}]+"), "g", f"if(length(g) = 1, g, {let_(in_order, 'q', fold)})")
    stretch = let_(apart, "d", composed)
    busy_, quiet = f"[{busy}]", f"[^{busy}]"
    parts = each(all_("y", f"{quiet}+(?!{busy_})|{quiet}?{busy_}+"), "w", f"if(w rlike {_quoted(busy_)}, {stretch}, w)")
    single = f"translate(h, {_quoted(''.join(u.one))}, {_quoted(''.join(u.one.values()))})"
    whole = let_(single, "y", f"if(y rlike {_quoted(busy_)}, {parts}, y)")
    calm = _calm(u)
    loud_, calm_ = f"[^{calm}]", f"[{calm}]"
    cuts = each(all_("x", f"{calm_}+(?!{loud_})|{calm_}?{loud_}+"), "h", f"if(h rlike {_quoted(loud_)}, {whole}, h)")
    far = _quoted("[^" + chr(92) + "x00-" + chr(92) + "x7F]+")  # one range for most characters; calm ranges are tried for the others
    return f"if(x rlike {far}, if(array_join(regexp_extract_all(x, {far}, 0), '') rlike {_quoted(loud_)}, {cuts}, x), x)"


_FOLD = _folding()
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({_FOLD}, '')), '’', {_quoted(chr(39))}), {_quoted('(?U)' + chr(92) + 's+')}, ' '), '^ | $', '')"

#: What is plain once it is in lower case is looked at once: printable ASCII without spaces at its ends or beside each other.
_FOLDED = rf"if(not (lower(x) rlike {_quoted('[^ -@' + chr(92) + '[-~]|^ | $|  ')}), lower(x), {_PLAIN})"


def _of(text: Column, sql: str) -> Column:
    """A SQL expression over `x`, the text."""
    return F.element_at(F.call_function("transform", F.array(text), F.expr(f"x -> {sql}")), 1)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_compatibility(text: Column) -> Column:
    """NFKC inside the JVM."""
    return _of(text, _FOLD)


def normalize(text: Column) -> Column:
    """NFKC, lower case, straight apostrophes, single spaces, trimmed; null becomes empty."""
    return _of(text, _FOLDED)


def normalize_all(texts: Column) -> Column:
    """`normalize` of each of an array; one look at all of them together tells whether lower case is enough."""
    plain = F.lower(F.array_join(texts, "\x02", "\x01")).rlike("[^ -@\\[-~\x02]|(^|\x02) | (\x02|$)|  ")
    return F.when(~plain, F.transform(texts, F.lower)).otherwise(F.transform(texts, normalize))


def slugify(text: Column) -> Column:
    return slug_of(normalize(text))


def slug_of(plain: Column) -> Column:
    """The slug of a text that `normalize` made."""
    t = F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-")
    return F.coalesce(F.nullif(F.trim(t, F.lit("-")), F.lit("")), F.lit("na"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(0))


def sanitize(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    for pattern in (ANSI, ZERO_WIDTH, CONTROL):
        t = F.regexp_replace(t, pattern, "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def safe_float(text: Column, default: float = 0.0) -> Column:
    t = F.trim(text)
    for mark in RATED_OF:
        t = F.replace(t, F.lit(mark), F.lit(""))
    return F.coalesce(t.try_cast("double"), F.lit(default))


def safe_int(text: Column, default: int = 0) -> Column:
    whole = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text)).try_cast("long")
    return F.coalesce(whole, F.lit(default).cast("long"))


def _group(text: Column, pattern: str, k: int) -> Column:
    """Group k of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def parse_budget(text: Column) -> Column:
    return _group(F.coalesce(text, F.lit("")), BUDGET, 1).cast("double")


def parse_meal_range(text: Column) -> Column:
    """A struct (lo, hi); an open end is OPEN_END."""
    t = F.coalesce(text, F.lit(""))
    a, b = _group(t, MEAL_RANGE, 1).cast("double"), _group(t, MEAL_RANGE, 2).cast("double")
    over = _group(t, MEAL_OVER, 1).cast("double")
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    return F.when(a.isNotNull(), span(F.least(a, b), F.greatest(a, b))).when(over.isNotNull(), span(over, F.lit(OPEN_END)))


def _first_of(text: Column, pairs: list[tuple[str, str]]) -> Column:

    def first(t: Column) -> Column:
        out = None
        for key, value in pairs:
            out = F.when(t.contains(key), F.lit(value)) if out is None else out.when(t.contains(key), F.lit(value))
        return out

    return let(normalize(text), first)


def hotel_category(text: Column) -> Column:
    return _first_of(text, HOTEL_CATEGORIES)


def intensity(text: Column) -> Column:
    return _first_of(text, INTENSITIES)


def interest_tags(text: Column) -> Column:
    """What follows "interested in", up to the first listed boundary there is, split and cleaned."""

    def ended(rest: Column) -> Column:
        cut = None
        for b in BOUNDARIES:
            cut = F.when(rest.contains(b), F.substring_index(rest, b, 1)) if cut is None else cut.when(rest.contains(b), F.substring_index(rest, b, 1))
        return cut.otherwise(rest)

    rest = let(normalize(text), lambda t: F.when(t.contains(INTERESTED), F.substring_index(F.regexp_replace(t, f"^.*?{INTERESTED}", "\u0001"), "\u0001", -1)))
    parts = F.transform(F.split(let(rest, ended), SPLIT), lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", ""))
    return F.coalesce(F.filter(F.array_distinct(parts), lambda x: F.length(x) >= SHORTEST_TAG), F.array().cast("array<string>"))


def time_to_minutes(text: Column) -> Column:
    h, m = F.split(text, ":").getItem(0).try_cast("int"), F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)


def parse_time_range(text: Column) -> Column:
    """A struct (start, end) of minutes; an end before its start is on the next day. One match, cut at what is no digit."""
    minutes = lambda p, k: F.get(p, F.lit(k)).cast("int") * 60 + F.get(p, F.lit(k + 1)).cast("int")
    both = lambda p: F.struct(minutes(p, 0).alias("a"), minutes(p, 2).alias("b"))
    span = lambda x: F.struct(x["a"].alias("start"), F.when(x["b"] < x["a"], x["b"] + DAY_MINUTES).otherwise(x["b"]).alias("end"))
    return let(F.regexp_extract(text, TIME_RANGE, 0), lambda t: F.when(t.rlike(CLOCKS), let(F.split(t, "[^0-9]+"), lambda p: let(both(p), span))))


def format_minutes(minutes: Column) -> Column:
    m = F.greatest(minutes, F.lit(0))
    return F.format_string("%02d:%02d", (F.floor(m / 60) % 24).cast("int"), (m % 60).cast("int"))


def format_range(start: Column, end: Column) -> Column:
    return F.concat(format_minutes(start), F.lit("-"), format_minutes(end))


def opening_hours(text: Column) -> Column:
    always = F.struct(F.lit(0).alias("start"), F.lit(DAY_MINUTES).alias("end"))
    return F.when(let(normalize(text), lambda t: t.contains("24/7") | t.contains("24 hours")), always).otherwise(parse_time_range(text))


def duration_minutes(text: Column) -> Column:
    """Minutes of a duration; of a range its lower end; a day has eight hours; halves round to even."""

    def minutes(t: Column) -> Column:
        ranged = t.rlike(DURATION_RANGE)
        value = F.coalesce(F.when(ranged, F.regexp_extract(t, DURATION_RANGE, 1)), _group(t, DURATION, 1)).cast("double")
        unit = F.coalesce(F.when(ranged, F.regexp_extract(t, DURATION_RANGE, 3)), _group(t, DURATION, 2))
        factor = F.when(unit.startswith("hour"), 60.0).when(unit.startswith("day"), 480.0).otherwise(1.0)
        return F.bround(value * factor).cast("int")

    return let(normalize(text), minutes)


def classify_action(title: Column) -> Column:
    some = lambda t, words: t.rlike("|".join(words))
    return let(F.lower(title), lambda t: F.when(some(t, CHECKIN), "checkin").when(some(t, TRANSPORT), "transport").when(some(t, DINING), "dining").otherwise("sightseeing"))


def time_to_slot(minute: Column) -> Column:
    return F.when(minute < 0, "unknown").when(minute < 660, "morning").when(minute < 840, "noon").when(minute < 1080, "afternoon").otherwise("evening")


def price_bucket(price: Column) -> Column:
    return F.when(price <= 50, "low").when(price <= 150, "medium").when(price <= 300, "high").otherwise("premium")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; an empty side gives 0."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / all_).otherwise(F.lit(0.0))


def blind_first(pid: Column, text: Column) -> Column:
    """Whether the generated plan is shown first: the parity of the first byte of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(pid.cast("string"), F.lit(":"), text), 256), 1, 2), 16, 10).cast("int") % 2 == 0


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
