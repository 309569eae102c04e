"""Secrets: fixed patterns, and stretches of high entropy, with DataFrame functions only.

Besides the patterns (assignments, access keys, long hex strings), every run of 20 or more key-like characters outside their matches
is a candidate. A window of 20 characters slides over it; the counts of the character that enters and of the one that leaves bring
the sum that Shannon's entropy needs up to date, and counts of characters outside hex, outside letters and digits, and of digits
give the window's class. Windows with letters and digits at or above the threshold of their class are hot; those that touch or
overlap join to one span, cold stretches between stay out. Candidates on the allow-list (words, numbers,
UUIDs, paths, placeholders) aren't reported. The work is linear in the text's length.

Spans are code points, end exclusive, of whole matches. Null and empty texts have none; null doc_ids and repeated rows are
scanned row by row; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What candidates are looked for between: an assignment whose value is too short to count is shorter than a window.
BETWEEN = f"{ASSIGN}|{ACCESS}|{HEX}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character from which a window counts, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[A-Za-z_=-]+$",  # words and rules
    r"^[0-9_=+-]+$",  # numbers
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUIDs
    r"^/?([A-Za-z0-9_-]{0,14}/)+[A-Za-z0-9_-]{0,14}$",  # paths of short names
    r"(?i)example|placeholder|xxxx|1234567|abcdef",
)


def running(a: Column) -> Column:
    """Sums of ``a`` (a bound array of integers) up to and with each place, by doubling."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(2)).cast("double"))).cast("int"))
    step = lambda k: F.shiftleft(F.lit(1), k) if isinstance(k, int) else F.pow(F.lit(2.0), k).cast("int")
    return F.aggregate(rounds, a, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= step(k), F.get(acc, i - step(k))), F.lit(0))))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, part) of the leftmost matches of ``pattern``; part: its group ``group``."""
    empty = F.array().cast("array<struct<start:int,end:int,part:string>>")

    def placed(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda g: F.length(g))
        steps = F.zip_with(gaps, m, lambda g, x: g + F.length(x))
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        ends = let(steps, running)
        return F.zip_with(F.arrays_zip(m.alias("m"), parts.alias("p")), ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["p"].alias("part")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def _bits(c: Column) -> Column:
    """c * log2(c) of a count, 0 of 0."""
    return F.element_at(F.array(*[F.lit(0.0 if not k else k * math.log2(k)) for k in range(WINDOW + 2)]), c + 1)


def hot_spans(part: Column) -> Column:
    """(from, to) of the stretches of ``part`` (ASCII) whose windows reach the threshold of their class."""
    char = lambda i: F.substr(part, i + 1, F.lit(1))
    within = lambda c, i, n: F.regexp_count(F.substr(part, i + 1, n), F.concat(F.lit("\\Q"), c, F.lit("\\E")))
    is_in = lambda c, pattern: c.rlike(pattern).cast("int")
    spans = F.array().cast("array<struct<from:int,to:int>>")
    start = F.struct(F.lit(0.0).alias("s"), *[F.lit(0).alias(k) for k in ("wide", "marks", "digits")], spans.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        new, old, leaves = char(i), char(i - WINDOW), i >= WINDOW
        before = F.greatest(i - WINDOW, F.lit(0))
        k_new, k_old = within(new, before, i - before), F.when(leaves, within(old, before, i - before + 1)).otherwise(F.lit(1))
        s = acc["s"] + _bits(k_new + 1) - _bits(k_new) + F.when(leaves, _bits(k_old - 1) - _bits(k_old)).otherwise(F.lit(0.0))
        moved = lambda k, pattern: acc[k] + is_in(new, pattern) - F.when(leaves, is_in(old, pattern)).otherwise(F.lit(0))
        wide, marks, digits = moved("wide", "[^0-9A-Fa-f]"), moved("marks", "[^0-9A-Za-z]"), moved("digits", "[0-9]")
        threshold = F.when(wide == 0, F.lit(THRESHOLDS["hex"])).when(marks == 0, F.lit(THRESHOLDS["alnum"])).otherwise(F.lit(THRESHOLDS["base64"]))
        hot = (i >= WINDOW - 1) & (digits > 0) & (digits + marks < WINDOW) & (F.lit(math.log2(WINDOW)) - s / WINDOW >= threshold)
        own = F.struct((i - WINDOW + 1).alias("from"), (i + 1).alias("to"))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = F.coalesce(last["to"] >= own["from"], F.lit(False))
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["from"].alias("from"), own["to"].alias("to"))))
        out = F.when(~hot, acc["out"]).when(joins, longer).otherwise(F.concat(acc["out"], F.array(own)))
        return F.struct(s.alias("s"), wide.alias("wide"), marks.alias("marks"), digits.alias("digits"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.length(part) - 1), start, step, lambda acc: acc["out"])


def candidates(text: Column) -> Column:
    """(start, end, part) of the candidates of ``text``, which lie between the patterns' matches."""

    def between(gaps: Column, matches: Column) -> Column:
        lengths = F.transform(gaps, lambda g, k: F.length(g) + F.coalesce(F.length(F.get(matches, k - 1)), F.lit(0)))
        shift = lambda e, g: lambda m: F.struct((m["start"] + e - F.length(g)).alias("start"), (m["end"] + e - F.length(g)).alias("end"), m["part"].alias("part"))
        return F.flatten(F.zip_with(gaps, let(lengths, running), lambda g, e: F.transform(found(g, CANDIDATE), shift(e, g))))

    return let(F.split(text, BETWEEN, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(BETWEEN), F.lit(0)), lambda m: between(gaps, m)))


def spans(text: Column) -> Column:
    """(start, k, end) of all spans, sorted; k: place in ``KINDS``."""
    one = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"))
    base = F.concat(
        F.transform(F.filter(found(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= 6), one(0)),
        F.transform(found(text, ACCESS), one(1)),
        F.transform(found(text, HEX), one(2)),
    )
    allowed = lambda p: F.coalesce(*[F.when(p.rlike(a), F.lit(True)) for a in ALLOWED], F.lit(False))
    shift = lambda m: F.transform(hot_spans(m["part"]), lambda h: F.struct((m["start"] + h["from"]).alias("start"), F.lit(3).alias("k"), (m["start"] + h["to"]).alias("end")))
    hot = F.flatten(F.transform(F.filter(candidates(text), lambda m: ~allowed(m["part"])), shift))
    return F.sort_array(F.concat(base, F.when(text.rlike(CANDIDATE), hot).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>"))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs``."""
    rows = columns(docs, doc_id="long", text="string").select("doc_id", spans(F.coalesce("text", F.lit(""))).alias("s"))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(text(F.filter("s", lambda x: x["k"] < 3)).cast("binary"), 256).alias("base_sha256"), text(F.col("s")).alias("spans"),
    )
