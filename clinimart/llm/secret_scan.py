"""Secret scan: patterns of known shapes, and sliding-window entropy for the rest.

Patterns (fixed values) give the kinds assign, access and hex: leftmost matches
that do not overlap, per kind; a match that is too short is dropped afterwards, so
it still uses up its text. The method adds the kinds mixed and digits: candidate
strings are runs of the characters of a class; in each, a window of ``window``
characters moves on by one, its character counts are updated for the character that
enters and the one that leaves, and with them the sum of c log2 c. A window counts
where the entropy, log2 window - sum / window, is at least the class's limit; windows
that overlap make one span. Logarithms are whole thousandths, so every engine finds
the same windows. Candidates that an allow-list pattern matches, and those inside a
span of a pattern, give no span of the method; spans of patterns are never
suppressed.

All of it is built-in functions. Where a pattern occurs is found by cutting the text
at its matches: pieces and matches in turn add up to the offsets, in code points,
end exclusive.

Nulls: a null text is empty and gives zero counts, empty spans and the digest of an
empty string. Repeated rows each give a row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, group to measure, least length of it.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
PATTERNS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
HEX_RUN = "[0-9a-f]{24,}"  # the same matches of hex that are long enough
# Candidate classes: kind, pattern of a run, what a candidate must also have, limit in
# thousandths of a bit; and the characters of each class.
CLASSES = (
    ("mixed", "[A-Za-z0-9+/_-]{20,}", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3600),
    ("digits", "[0-9A-F]{24,}", "^(?=.*[0-9])(?=.*[A-F])", 2800),
)
CHARACTERS = {
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
    "digits": "0123456789ABCDEF",
}
# Not secrets: placeholders, words in one case joined by marks, one character repeated.
# Repeated groups are possessive: without that a very long candidate overflows the stack.
ALLOWED = ("(?i)example|placeholder|changeme|dummy|x{6,}", "^[a-z]++(?:[-_/][a-z]++)++$", "^(.)\\1+$")
WINDOW = 20
KINDS = [p[0] for p in PATTERNS] + [c[0] for c in CLASSES]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, text of the group) for each match."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(
        F.slice(F.transform(pieces, F.char_length), 1, F.size(whole)).alias("gap"),
        F.transform(whole, F.char_length).alias("size"),
        part.alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:string>>").alias("out"))

    def add(state: Column, row: Column) -> Column:
        first = state["at"] + row["gap"]
        last = first + row["size"]
        found = F.struct(first.alias("start"), last.alias("end"), row["part"].alias("part"))
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    return F.aggregate(rows, start, add, lambda state: state["out"])


def pattern_spans(text: Column, kind: str) -> Column:
    _, pattern, group, least = next(p for p in PATTERNS if p[0] == kind)
    pattern = HEX_RUN if kind == "hex" else pattern
    found = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["part"]) >= least)
    return _when(text, pattern, found)


def _when(text: Column, pattern: str, found: Column) -> Column:
    """``found`` only where the pattern occurs at all."""
    empty = F.array().cast("array<struct<start:int,end:int,part:string>>")
    return F.when(text.rlike(pattern), found).otherwise(empty)


def steps_of(window: int) -> list[int]:
    """c log2 c in thousandths; a character may be counted window + 1 times before the
    one that leaves is taken off."""
    return [0, *(round(1000 * c * math.log2(c)) for c in range(1, window + 2))]


def hot_windows(part: Column, alphabet: str, limit: int, window: int) -> Column:
    """Array of (start, end) within the string, where windows reach the limit. The
    state holds the count of each character of the class in the window, in an array by
    the character's place in the alphabet, the sum of c log2 c, the span that is open,
    and the spans closed before."""
    codes = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(alphabet), c))
    places = F.sequence(F.lit(1), F.char_length(part))
    # entering and leaving character of each step, in one array that is made once
    left = F.concat(F.array_repeat(F.lit(1), window), codes)
    steps = F.slice(
        F.arrays_zip(codes.alias("new"), left.alias("old"), places.alias("at")), F.lit(1), F.char_length(part)
    )
    table = F.array(*[F.lit(n) for n in steps_of(window)])
    most = round(1000 * window * math.log2(window)) - limit * window

    def cost(count: Column) -> Column:
        return F.element_at(table, count + 1)

    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).alias("sum"),
        F.lit(-1).alias("open"),
        F.lit(-1).alias("until"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def closed(state: Column) -> Column:
        span = F.struct(state["open"].alias("start"), state["until"].alias("end"))
        return F.when(state["open"] < 0, state["out"]).otherwise(F.concat(state["out"], F.array(span)))

    def move(state: Column, step: Column) -> Column:
        new, old, at = step["new"], step["old"], step["at"].cast("int")
        full = at > window
        here = F.element_at(state["counts"], new)
        gone = F.element_at(state["counts"], old) + F.when(old == new, 1).otherwise(0)
        entered = state["sum"] + cost(here + 1) - cost(here)
        total = F.when(full, entered + cost(gone - 1) - cost(gone)).otherwise(entered)
        leaving = F.when(full, old).otherwise(0)
        counts = F.transform(
            state["counts"],
            lambda c, i: c + F.when(i == new - 1, 1).otherwise(0) - F.when(i == leaving - 1, 1).otherwise(0),
        )
        hot = (at >= window) & (total <= most)
        apart = hot & (state["until"] < at - window)  # a new span; the open one is done
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(apart, at - window).otherwise(state["open"]).alias("open"),
            F.when(hot, at).otherwise(state["until"]).alias("until"),
            F.when(apart, closed(state)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(steps, start, move, closed)


def entropy_spans(text: Column, kind: str, known: Column, window: int = WINDOW) -> Column:
    _, pattern, must, limit = next(c for c in CLASSES if c[0] == kind)

    def wanted(m: Column) -> Column:
        allowed = m["part"].rlike(ALLOWED[0])
        for more in ALLOWED[1:]:
            allowed = allowed | m["part"].rlike(more)
        inside = F.exists(known, lambda k: (k["start"] <= m["start"]) & (m["end"] <= k["end"]))
        return m["part"].rlike(must) & ~allowed & ~inside

    def shifted(m: Column) -> Column:
        return F.transform(
            hot_windows(m["part"], CHARACTERS[kind], limit, window),
            lambda s: F.struct(
                (m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end"), F.lit("").alias("part")
            ),
        )

    found = F.flatten(F.transform(F.filter(matches(text, pattern), wanted), shifted))
    return _when(text, pattern, found)


def _named(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def _listed(*spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    ordered = F.array_sort(F.concat(*spans))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """The documents' ``doc_id`` with their spans of each kind: arrays of (start, end,
    part)."""
    text = F.col("_text")
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = found.select("doc_id", "_text", *[pattern_spans(text, p[0]).alias(p[0]) for p in PATTERNS])
    known = F.concat(*[F.col(p[0]) for p in PATTERNS])
    added = [entropy_spans(text, c[0], known).alias(c[0]) for c in CLASSES]
    return found.select("doc_id", *[p[0] for p in PATTERNS], *added)


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    named = {kind: _named(F.col(kind), kind) for kind in KINDS}
    base = _listed(*[named[p[0]] for p in PATTERNS])
    return found.select(
        "doc_id",
        *[F.size(p[0]).cast("long").alias(f"n_{p[0]}") for p in PATTERNS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _listed(*named.values()).alias("spans"),
    )
