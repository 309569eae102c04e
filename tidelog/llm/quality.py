"""Quality rules as a short-circuit cascade, with DataFrame functions only.

The measures of a text are counted in one pass over it. The rules that reject by them are tried one after the other and
a text leaves at the first that rejects it; their order follows from a bounded sample (``sample_rows`` rows of at most ``longest``
characters, chosen by a hash of doc_id), on which each rule's time and the share that it rejects of what the rules before it leave are
measured: most rejections per second first. The order changes the time only, never the verdict.

Null text has no words and fails the base rules, as do empty ones; null doc_ids and repeated rows are judged row
by row; very long texts are counted whole (n log n at most); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WS, columns, let, save

SYMBOLS = "[#*$%&|<>]"
#: Rules of the method, by name: true rejects. Columns: text and the measures.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 4 > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 16),
    "repeated_lines": lambda: F.col("n_dup_lines") * 10 > F.regexp_count("text", F.lit(f"[^\\n{WS}][^\\n]*")) * 3,
    "shouting": lambda: F.regexp_count("text", F.lit(r"\p{Lu}")) * 2 > F.regexp_count("text", F.lit(r"\p{L}")),
    "letters": lambda: F.regexp_count("text", F.lit(r"\p{L}")) * 2 < F.col("word_chars"),
}


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def _neighbours(s: Column, field: str) -> Column:
    """Of ``s``, sorted by ``field``, the entries that share it with the one before or after."""
    return F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)[field] == e[field], F.lit(False)) | F.coalesce(F.get(s, k + 1)[field] == e[field], F.lit(False)))


def repeat_words(w: Column, width: int = 5) -> Column:
    """Words of ``w`` (a bound array) that lie in windows of ``width`` words found twice or more.

    Windows are told apart by hash; those whose hash occurs again are compared by their words.
    """
    zero = F.lit(0).cast("long")
    windows = F.transform(F.slice(w, F.lit(1), F.size(w) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(by_hash, lambda s: _neighbours(s, "h"))
        by_words = F.sort_array(F.transform(same, lambda e: F.struct(F.array_join(F.slice(w, e["i"] + 1, width), " ").alias("t"), e["i"].alias("i"))))
        at = F.sort_array(F.transform(let(by_words, lambda s: _neighbours(s, "t")), lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("end"), zero.alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(a["end"], i)).cast("long").alias("n")), lambda a: a["n"])

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))
    return F.when(F.size(w) <= width, zero).otherwise(found)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), the measures and base_failed."""
    rows = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    by_words = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    rows = rows.select("doc_id", "text", by_words.alias("__w"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), dup_lines(F.col("text")).alias("n_dup_lines"))
    rows = rows.select("doc_id", "text", "__w.n_words", "__w.word_chars", "n_symbols", "n_dup_lines", "__w.n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, sample_rows: int = 1000, longest: int = 50_000, times: int = 3) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule, in the order to try them.

    Costs are the least of ``times`` runs over the sample, which is read over and over so that a rule outweighs a job's own time. Shares are
    conditional: the rule with most rejections a second comes first, the others are estimated on what it leaves, and so on.
    """
    rows = columns(docs, doc_id="long", text="string").filter(f"pmod(xxhash64(doc_id), 16) = 0 and length(text) <= {longest}")
    picked = rows.limit(sample_rows).collect()  # reads only as many partitions as it takes
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, text string").coalesce(1)
    tests = F.struct(*[rule().alias(name) for name, rule in rules.items()])
    sample = save(measured(sample).filter("not base_failed").withColumn("__hit", tests), "quality-sample")
    patterns = sample.groupBy("__hit").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each pattern of verdicts

    def timed(test: Column) -> float:
        again = sample.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(5)))).agg(F.sum((test & (F.col("__k") > 0)).cast("int")))
        spent = []
        for _ in range(times):
            began = time.perf_counter()
            again.collect()
            spent.append(time.perf_counter() - began)
        return min(spent)

    idle = timed(F.length("text") < 0)
    cost = {name: max(1e-4, timed(rule()) - idle) for name, rule in rules.items()}
    order, left = [], [(r["__hit"], r["n"]) for r in patterns]
    while len(order) < len(rules):
        n = max(1, sum(k for _, k in left))
        share = {name: sum(k for hit, k in left if hit[name]) / n for name in rules if name not in {o[0] for o in order}}
        name = min(share, key=lambda x: (-share[x] / cost[x], cost[x], x))
        order.append((name, cost[name], share[name]))
        left = [(hit, k) for hit, k in left if not hit[name]]
    return order


def judge(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs``."""
    order = order or [name for name, _, _ in cascade_order(docs, rules)]
    rejected = F.when(F.col("base_failed"), F.lit(True))
    for name in order:
        rejected = rejected.when(rules[name](), F.lit(True))
    rows = measured(docs).withColumn("kept", ~rejected.otherwise(F.lit(False)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
