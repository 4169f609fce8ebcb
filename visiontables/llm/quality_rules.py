"""Quality rules of message logs: decision lists learnt from labelled statistics.

Everything runs as DataFrame expressions and aggregates; a learnt list is an
ordered chain of ``when`` conditions that a reader can check.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiontables.llm.tables import written

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
SAMPLE = 16_384
GRADES = 32
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.9


def _statistics() -> dict[str, Column]:
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / some("n_words"),
        "symbols_per_word": F.col("n_symbols") / some("n_words"),
        "repeated_words": F.col("n_repeat_words") / some("n_words"),
        "distinct_words": F.col("n_distinct") / some("n_words"),
        "repeated_lines": F.col("n_dup_lines") / some("n_lines"),
        "words_per_line": F.col("n_words") / some("n_lines"),
        "digits": F.col("n_digits") / some("n_chars"),
        "capitals": F.col("n_capitals") / some("n_chars"),
    }


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), use), 0)


def _in_words(words: Column) -> Column:
    """Of an array of word hashes: all, distinct ones, and those in repeated windows."""
    size = lambda a: F.size(a).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def covered(placed: Column) -> Column:
        next_to = lambda x, i: F.coalesce(F.get(placed, i)["h"] == x["h"], F.lit(False))
        again = F.filter(placed, lambda x, i: next_to(x, i - 1) | next_to(x, i + 1))
        start = F.struct(F.lit(-WINDOW).alias("last"), zero.alias("words"))
        more = lambda a, x: F.struct(x.alias("last"), (a["words"] + F.least(F.lit(WINDOW), x - a["last"])).alias("words"))
        return F.aggregate(F.array_sort(F.transform(again, lambda x: x["at"])), start, more, lambda a: a["words"])

    def repeated(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _bound(placed, covered)).otherwise(zero)

    first = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.struct(size(words).alias("n_words"), size(F.array_distinct(words)).alias("n_distinct"), _bound(windows, repeated).alias("n_repeat_words"))


def count_words(messages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The counts of every whole text that rules are made of, beside the ``keys`` columns.

    Words stand between the six ASCII white space characters. ``n_words``,
    ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``),
    ``n_lines`` and ``n_dup_lines`` (lines with a word, and those equal to an
    earlier one), ``n_repeat_words`` (words in windows of five words that stand
    in the text twice or more, all of them counted), ``n_distinct`` words,
    ``n_digits``, ``n_capitals``, ``n_chars``. A null text is empty. Windows
    are compared by 64-bit hashes; a text's windows are sorted, so very long
    texts take n log n steps. No row leaves its task.
    """
    held = [f"_key{i}" for i in range(len(keys))]
    d = messages.select(*[messages[k].alias(h) for k, h in zip(keys, held)], F.coalesce(messages[text], F.lit("")).alias("_text"))
    counts = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("bigint")
    words = F.transform(F.array_remove(F.split("_text", _SPACE), ""), lambda x: F.xxhash64(x))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = lambda a: F.struct(F.size(a).cast("bigint").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"))
    d = d.select(
        *held, _bound(words, _in_words).alias("_w"), _bound(lines, of_lines).alias("_l"),
        F.length(F.regexp_replace("_text", _SPACE, "")).cast("bigint").alias("word_chars"), counts(_SYMBOL).alias("n_symbols"),
        counts("[0-9]").alias("n_digits"), counts("[A-Z]").alias("n_capitals"), F.length("_text").cast("bigint").alias("n_chars"))
    return d.select(
        *[F.col(h).alias(k) for h, k in zip(held, keys)], "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        "_l.n_lines", "_w.n_distinct", "n_digits", "n_capitals", "n_chars")


def fails_base(least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = _statistics()[self.statistic]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A text that meets all conditions is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def first_rule(rules: Sequence[Rule]) -> Column:
    """The first rule that rejects a row of counts, as text; null where none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.column(), F.lit(str(r))).otherwise(out)
    return out


def learn_rules(
    messages: DataFrame, labels: DataFrame, keys: Sequence[str] = ("message_id",), text: str = "text", quality: str = "quality",
    sample: int = SAMPLE, grades: int = GRADES, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS, least_precision: float = LEAST_PRECISION,
) -> list[Rule]:
    """A decision list by sequential covering of labelled messages.

    ``labels`` has ``keys`` and ``quality`` (0/1); null keys or labels are left
    out, of several labels the larger counts. At most ``sample`` labelled keys,
    those of the smallest hashes, are learnt from; texts that the base rules
    reject are not.

    Two thirds of the rows grow rules, one third prunes them. A rule starts
    empty and takes the condition (statistic, threshold) that gains most until
    it covers no good text, none gains, or it has ``most_conditions``; its last
    conditions go while that does not lessen (bad - good) / (bad + good) of the
    pruning rows it covers. It joins the list if at least ``least_precision``
    of these are bad (one more good one assumed), and the rows it covers leave
    before the next. Thresholds are quantiles, ``grades`` of each statistic.

    Statistics are counted by Spark; the driver sees quantiles and counts per
    statistic and grade. Without labels, or labels of one kind, there is no rule.
    """
    names = [f"_id{i}" for i in range(len(keys))]
    ids = labels.select(*[labels[k].alias(n) for k, n in zip(keys, names)], labels[quality].cast("int").alias("_label")).dropna()
    ids = ids.groupBy(*names).agg(F.max("_label").alias("_label")).orderBy(F.xxhash64(*names), *names).limit(sample)
    m = messages.select(*[messages[k].alias(n) for k, n in zip(keys, names)], messages[text].alias("_text"))
    m = m.join(F.broadcast(ids), names).select("_text", "_label", F.pmod(F.xxhash64(*names), F.lit(3)).alias("_part"))
    counted = written(count_words(m, ["_label", "_part"], "_text"), "counts").where(~fails_base())
    statistics = list(_statistics())
    rows = written(counted.select((F.col("_label") == 0).alias("bad"), (F.col("_part") < 2).alias("grow"), *[c.alias(n) for n, c in _statistics().items()]), "statistics")
    cuts = rows.agg(*[F.percentile_approx(s, [k / grades for k in range(1, grades)], 10_000).alias(s) for s in statistics]).first()
    edges = {s: sorted(set(cuts[s] or [])) for s in statistics}
    grade = lambda s: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[s]]), lambda e: e <= F.col(s))) if edges[s] else F.lit(0)
    graded = written(rows.select("bad", "grow", *[grade(s).alias(s) for s in statistics]), "grades")
    meets = lambda c: F.col(c[0]) >= c[2] if c[1] else F.col(c[0]) < c[2]

    def every(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & meets(c)
        return out

    left, rules = F.lit(True), []
    while len(rules) < most_rules:
        grown = _grown(graded.where(F.col("grow") & left), statistics, edges, every, most_conditions)
        if not grown:
            break
        held = [F.col("bad") & every(grown[: k + 1]) for k in range(len(grown))], [~F.col("bad") & every(grown[: k + 1]) for k in range(len(grown))]
        got = graded.where(~F.col("grow") & left).agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(held[0] + held[1])]).first()
        bad, good = list(got)[: len(grown)], list(got)[len(grown) :]
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in zip(bad, good)]
        k = worth.index(max(worth))
        if bad[k] < least_precision * (bad[k] + good[k] + 1):
            break
        kept = grown[: k + 1]
        rules.append(Rule(tuple(Condition(s, up, float(edges[s][g - 1])) for s, up, g in kept)))
        left = left & ~every(kept)
    return rules


def _grown(rows: DataFrame, statistics: list[str], edges: dict[str, list[float]], every, most: int) -> list[tuple[str, bool, int]]:
    """Conditions (statistic, at least?, grade), each the one that gains most among what the earlier ones leave."""
    out: list[tuple[str, bool, int]] = []
    while len(out) < most:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(s).alias("g")) for i, s in enumerate(statistics)]))
        table = rows.where(every(out)).select("bad", each.alias("x")).groupBy("x.s", "x.g").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("w")).collect()
        bad, good = (sum(r[c] for r in table if r["s"] == 0) for c in ("b", "w"))
        if not bad or (out and not good):
            break
        best, gain = None, 1e-9
        for i, s in enumerate(statistics):
            for g in range(1, len(edges[s]) + 1):
                for up in (True, False):
                    b, w = (sum(r[c] for r in table if r["s"] == i and (r["g"] >= g) == up) for c in ("b", "w"))
                    if b and (now := b * (math.log2(b / (b + w)) - math.log2(bad / (bad + good)))) > gain:
                        best, gain = (s, up, g), now
        if best is None:
            break
        out.append(best)
    return out


def rate_messages(messages: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("message_id",), text: str = "text") -> DataFrame:
    """Every message's counts and verdict.

    Returns ``keys`` and the counts of ``count_words``, ``base_failed`` (fewer
    than 10 words, or more than 20 of 100 in repeated windows), ``rule`` (the
    first learnt rule that rejects it, as text) and ``kept`` (neither). One row
    per input row, null and repeated keys included; other columns are ignored.
    """
    counted = count_words(messages, keys, text)
    rated = counted.withColumns({"base_failed": fails_base(), "rule": first_rule(rules)})
    return rated.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
