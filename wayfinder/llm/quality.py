"""Quality rules: decision lists learned from labelled statistics.

Sequential covering: while rows labelled bad are left, a rule is grown as a conjunction of
thresholds with the best information gain on two thirds of the sample, pruned on the other
third, and kept if it is precise enough. The list becomes one ordered Spark expression.

Nulls: a null text has no words, so it fails the base rule; a null doc_id or label takes no part
in learning. Of documents that share an id the one with the least features is learned from; rows
that repeat are judged alike, each by itself, and texts of any length are read whole. Empty tables
give no rules and no rows. A column named like the added one is replaced, others are never read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._shared import let, words

#: What rules may test; each is a number from 0, computed by `with_statistics`.
FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the word array `w`, the first included.

    Hashes of the windows show whether any can repeat; only then are the windows themselves sorted.
    """
    at = F.sequence(F.lit(0), F.size(w) - 3)

    def exact(marks):
        # places whose hash is found twice; where these are many, all places
        twice = let(F.sort_array(marks), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False)))))
        some = let(twice, lambda d: F.when(F.size(d) <= 64, F.filter(at, lambda i: F.array_contains(d, F.get(marks, i)))).otherwise(at))
        rows = F.sort_array(F.transform(some, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))

        def covered(s):
            same = lambda x, j: F.coalesce(x["t"] == F.get(s, j)["t"], F.lit(False))
            twice = F.filter(F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda x: x.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

        return let(rows, covered)

    marks = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    found = let(marks, lambda m: F.when(F.size(F.array_distinct(m)) < F.size(m), exact(m)).otherwise(F.lit(0)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(found)


def statistics(text: Column) -> Column:
    """A struct of the base counts and the counts behind the learned features, from one whole text."""
    t = F.coalesce(text, F.lit(""))

    def of(w):
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            without(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.split(t, "\n")).cast("long").alias("n_lines"),
            without(r"\p{Lu}").cast("long").alias("n_upper"),
            without(r"[!?]").cast("long").alias("n_marks"),
        )

    return let(words(text), of)


def with_statistics(docs: DataFrame, text: str = "text", at: str = "_wf_stats") -> DataFrame:
    return docs.withColumn(at, statistics(F.col(text)))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def feature(s: Column, name: str) -> Column:
    share = lambda a, b: s[a].cast("double") / F.greatest(s[b], F.lit(1)).cast("double")
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
    }[name]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, s: Column) -> Column:
        x = feature(s, self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above


Rule = tuple[Condition, ...]


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 3, cuts: int = 24, precision: float = 0.9, support: int = 4) -> list[Rule]:
    """Rules that reject, in order, from rows of features with `bad` (bool) and `key` (str).

    Rows are sets of bits, so that counting a conjunction is one AND; the time is bounded by
    rules x conditions x cuts, whatever the order of the rows.
    """
    rows = sorted(rows, key=lambda r: r["key"])
    if not rows:
        return []
    mask = lambda test: int("".join("1" if test(r) else "0" for r in reversed(rows)), 2)
    bad, grow = mask(lambda r: r["bad"]), mask(lambda r: zlib.crc32(r["key"].encode()) % 3 != 2)
    conditions = []
    for name in FEATURES:
        values = sorted(r[name] for r in rows)
        seen = sorted({values[min(len(values) - 1, len(values) * k // cuts)] for k in range(cuts)} | {values[len(values) * k // 1000] for k in (5, 10, 20, 980, 990, 995)})
        # halfway to the next value there is, so that a threshold never lies on a value
        after = {v: next((x for x in values[_right(values, v) :]), None) for v in seen}
        for v in seen:
            if after[v] is not None:
                for above in (True, False):
                    c = Condition(name, above, (v + after[v]) / 2)
                    conditions.append((c, mask(c.holds)))
    rules: list[Rule] = []
    left = (1 << len(rows)) - 1
    count = int.bit_count
    while count(left & bad) and len(rules) < max_rules:
        at, picked = left & grow, []
        while len(picked) < max_conditions and count(at & ~bad):
            p, n = count(at & bad), count(at & ~bad)
            if not p:
                break

            def gain(c):
                q, m = count(at & c[1] & bad), count(at & c[1] & ~bad)
                return (q * (math.log2(q / (q + m)) - math.log2(p / (p + n))) if q else -1.0, q)  # noqa: B023

            best = max(conditions, key=gain, default=None)
            if best is None or gain(best)[0] <= 1e-9:
                break
            picked.append(best)
            at &= best[1]
        if not picked:
            break

        def worth(cs):
            m = left & ~grow  # noqa: B023
            for c in cs:
                m &= c[1]
            p, n = count(m & bad), count(m & ~bad)
            return (p + 1) / (p + n + 2)

        while len(picked) > 1 and worth(picked[:-1]) >= worth(picked):
            picked.pop()
        covered = left
        for c in picked:
            covered &= c[1]
        p, n = count(covered & bad), count(covered & ~bad)
        if p < support or p < precision * (p + n):
            break
        rules.append(tuple(c for c, _ in picked))
        left &= ~covered
    return rules


def _right(values: list, v) -> int:
    import bisect

    return bisect.bisect_right(values, v)


def verdict(rules: list[Rule], s: Column) -> Column:
    """True for rows to keep: the rules as one ordered conditional expression, true where none holds."""
    out = None
    for rule in rules:
        test = rule[0].column(s)
        for c in rule[1:]:
            test = test & c.column(s)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, **options) -> list[Rule]:
    """Learn from at most `max_labelled` labelled documents, those whose id has the lowest MD5.

    The bound holds at every size of the input: it caps what is broadcast (16 bytes a row) and
    what the driver receives (8 numbers a row). Documents that fail the base rule are left out,
    since the learned list never judges them. Learning is the same for any order of rows.
    """
    key = F.md5(F.col("_wf_id").cast("string"))
    marked = labels.select(F.col("doc_id").alias("_wf_id"), F.col("quality").alias("_wf_quality")).where("_wf_id is not null and _wf_quality is not null")
    marked = marked.groupBy("_wf_id").agg(F.min("_wf_quality").alias("_wf_quality")).orderBy(key, "_wf_id").limit(max_labelled)
    some = docs.select(F.col("doc_id").alias("_wf_id"), F.col("text").alias("_wf_text")).join(F.broadcast(marked), "_wf_id")
    some = Scratch(docs.sparkSession, "quality").cut(some, "labelled")  # else the counts are made for all documents, below the join
    s = F.col("_wf_stats")
    judged = with_statistics(some, "_wf_text").where(~base_failed(s)).select(F.col("_wf_id").cast("string").alias("key"), (F.col("_wf_quality") == 0).alias("bad"), F.struct(*(feature(s, f).alias(f) for f in FEATURES)).alias("x"))
    found = judged.groupBy("key", "bad").agg(F.min("x").alias("x")).select("key", "bad", "x.*").collect()  # an id that repeats counts once
    return learn([r.asDict() for r in found], **options)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", at: str = "_wf_stats") -> DataFrame:
    """`docs` with the struct column `at`: all counts, base_failed and kept."""
    s = F.col(at)
    with_all = with_statistics(docs, text, at)
    return with_all.withColumn(at, let(s, lambda x: F.struct(x.alias("counts"), base_failed(x).alias("base_failed"), (~base_failed(x) & verdict(rules, x)).alias("kept"))))
