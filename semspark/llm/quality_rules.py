"""Quality rules: text statistics and a learned decision list, with native Spark functions only.

The statistics are column expressions. The list is learned by sequential covering from labelled statistics: a rule
is a conjunction of threshold conditions, grown by information gain on two thirds of the labelled rows, pruned on the
other third, and kept if it is precise enough there. All counts come from grouped aggregations by feature and bin.
The learned list is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Labelled documents that the list is learned from (those with the least hashes of their ids); bins of a feature.
SAMPLE, BINS = 20_000, 24
#: A rule must be this precise on the rows kept for pruning, and catch this many of the rows that it grows on.
LEAST_PRECISION, LEAST_CAUGHT, MOST_CONDITIONS, MOST_RULES = 0.97, 5, 3, 12
FEATURES = ("word_len", "symbol_rate", "shout_rate", "upper_rate", "dup_line_rate", "repeat_rate", "variety", "n_words")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_upper, n_shouts and n_distinct_words (long).

    Words are runs of characters other than the space and the controls 9 to 13. A line repeats if it holds a word and
    equals an earlier line. Repeated words are those in windows of eight words that occur twice or more in the text,
    told by 64-bit hashes. A null text has no words. Columns of the same names are replaced.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_distinct_words")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in own]
    text, words, lines, hashes, pairs, fours, windows, ordered, places = fresh([*docs.columns, *own], "qr_text", "qr_words", "qr_lines", "qr_hashes", "qr_pairs", "qr_fours", "qr_windows", "qr_ordered", "qr_places")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text))
    bare = F.col(text)
    for sign in SYMBOLS:
        bare = F.replace(bare, F.lit(sign), F.lit(""))
    count = lambda sign: F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(sign), F.lit("")))
    df = df.select(
        *[F.col(f"`{c}`") for c in keep],
        words_of(F.col(text)).alias(words),
        F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD)).alias(lines),
        (F.octet_length(text) - F.octet_length(bare)).cast("long").alias("n_symbols"),
        count("!").cast("long").alias("n_shouts"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    df = df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_upper",
        "n_shouts",
        F.transform(words, lambda w: F.xxhash64(w)).alias(hashes),
    )
    # Hashes of two words, of four, and of the eight of a window, each from two of the step before.
    joined = lambda array, step: f"(a, i) -> xxhash64(a, get(`{array}`, i + {step}))"
    df = df.withColumn(pairs, F.expr(f"transform(`{hashes}`, {joined(hashes, 1)})")).withColumn(fours, F.expr(f"transform(`{pairs}`, {joined(pairs, 2)})"))
    spans = F.expr(f"transform(slice(`{fours}`, 1, size(`{fours}`) - {WINDOW - 1}), {joined(fours, 4)})")
    df = df.withColumn(windows, F.when(F.size(hashes) > WINDOW, spans).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window sort theirs: a window repeats if it equals a neighbour in that order.
    placed = F.expr(f"array_sort(transform(`{windows}`, (w, i) -> named_struct('w', w, 'i', i)))")
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed))
    equal = f"transform(zip_with(`{ordered}`, slice(`{ordered}`, 2, size(`{ordered}`)), (a, b) -> array(if(a.w = b.w, a.i, null), if(a.w = b.w, b.i, null))), x -> x)"
    df = df.withColumn(places, F.expr(f"array_sort(array_distinct(filter(flatten({equal}), x -> x is not null)))"))
    covered = f"aggregate(zip_with(`{places}`, slice(`{places}`, 2, size(`{places}`)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x)"
    df = df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))).withColumn("n_distinct_words", F.size(F.array_distinct(hashes)).cast("long"))
    # A filter on a statistic would be pushed below these projections, with a copy of the expressions for each mention.
    # The statistics go through an explode of one element, which filters stay above.
    (one,) = fresh([*docs.columns, *own], "qr_one")
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(F.struct(*own))).alias(one))
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(one)[c].alias(c) for c in own])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Numbers of a text that conditions look at, from its statistics; a text without words has 0 for all."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "word_len": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "shout_rate": per("n_shouts", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_words"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "variety": per("n_distinct_words", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A text that meets all conditions is rejected."""

    conditions: tuple[Condition, ...]
    caught: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the text, 0 if none does: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def _binned(stats: DataFrame, label: str) -> tuple[DataFrame, dict[str, list[float]]]:
    """Rows (bad, part, one bin for each feature) and the cuts between the bins, which are quantiles."""
    values = features()
    steps = F.lit([k / BINS for k in range(1, BINS)])
    frame = stats.select(F.col(label).alias("bad"), F.col("part"), *[c.alias(n) for n, c in values.items()])
    frame = written(frame, "labelled")
    # Quantiles of either class, so that a rare class has cuts of its own.
    found = frame.groupBy("bad").agg(*[F.percentile_approx(n, steps).alias(n) for n in values]).collect()
    cuts = {n: sorted({x for row in found for x in row[n] or []}) for n in values}
    bins = [F.expr(f"size(filter(array({','.join(f'{x!r}D' for x in cuts[n])}), x -> `{n}` > x))").alias(n) for n in values]
    return written(frame.select("bad", "part", *bins), "bins"), cuts


def _counts(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
    """For each feature and bin the rows that are (good, bad): one grouped aggregation."""
    names = [n for n in rows.columns if n not in ("bad", "part")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names])).alias("x")
    out: dict[str, dict[int, list[int]]] = {n: {} for n in names}
    for r in rows.select("bad", pairs).groupBy("x.feature", "x.bin").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).collect():
        out[r.feature][r.bin] = [r.good, r.bad]
    return out


def _gain(good: int, bad: int, all_good: int, all_bad: int) -> float:
    if not bad:
        return -1.0
    return bad * (math.log2(bad / (good + bad)) - math.log2(all_bad / (all_good + all_bad)))


def learn_rules(stats: DataFrame, bad: Column) -> list[Rule]:
    """An ordered list of rules that reject rows like those where ``bad`` holds.

    ``stats`` has the statistics of labelled texts and a long ``key`` that deals them to growing and pruning. Without
    rows of both classes there are no rules.
    """
    labelled = stats.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(3))).withColumn("is_bad", F.coalesce(bad.cast("int"), F.lit(0)))
    rows, cuts = _binned(labelled, "is_bad")
    grow, prune = rows.where("part > 0"), rows.where("part = 0")
    rules: list[Rule] = []
    holds = lambda tests: F.expr(" and ".join(f"`{f}` {'>' if above else '<='} {b}" for f, above, b in tests) or "true")
    done = F.lit(False)
    while len(rules) < MOST_RULES:
        tests: list[tuple[str, bool, int]] = []
        caught = 0
        while len(tests) < MOST_CONDITIONS:
            counts = _counts(grow.where(~done & holds(tests)))
            first = next(iter(counts.values()))
            all_good, all_bad = (sum(x[k] for x in first.values()) for k in (0, 1))
            if not all_bad or not all_good:
                break
            best = None
            for name, bins in counts.items():
                good_below = bad_below = 0
                for b in sorted(bins)[:-1]:
                    good_below, bad_below = good_below + bins[b][0], bad_below + bins[b][1]
                    for above, g, x in ((False, good_below, bad_below), (True, all_good - good_below, all_bad - bad_below)):
                        if x >= LEAST_CAUGHT and (score := _gain(g, x, all_good, all_bad)) > (best[0] if best else 1e-9):
                            best = (score, (name, above, b), x)
            if best is None:
                break
            tests, caught = [*tests, best[1]], best[2]
        if not tests:
            break
        # Prune from the end: the shortest prefix that is as precise as any on the rows kept for it.
        sums = [F.sum(F.when(holds(tests[: k + 1]), F.col("bad") if bad_ else 1 - F.col("bad")).otherwise(0)) for k in range(len(tests)) for bad_ in (0, 1)]
        found = [x or 0 for x in prune.where(~done).agg(*sums).first()]
        quality = [(found[2 * k + 1] + 1) / (found[2 * k] + found[2 * k + 1] + 1) if found[2 * k + 1] else 0.0 for k in range(len(tests))]
        k = quality.index(max(quality))
        if quality[k] < LEAST_PRECISION:
            break
        tests = tests[: k + 1]
        middle = lambda f, b: (cuts[f][b] + cuts[f][min(b + 1, len(cuts[f]) - 1)]) / 2  # noqa: E731  between the bins' bounds
        rules.append(Rule(tuple(Condition(f, above, middle(f, b) if above else cuts[f][b]) for f, above, b in tests), caught, quality[k]))
        done = done | holds(tests)
    return rules


def learn_from_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the documents that ``labels`` (doc_id, quality) calls bad (quality 0), among those that pass the base
    checks. ``sample`` bounds the labelled documents that are looked at."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "key")), "key")
    return learn_rules(written(text_statistics(rows), "statistics").where(~base_failed()), F.col("quality") == 0)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (the first that rejects, 0 if none) and kept, for each row.

    A null or blank text fails the base checks. Rows that repeat are judged alike; an empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    out = text_statistics(own).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass (columns unchanged)."""
    (copy,) = fresh(docs.columns, "qr_copy")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(copy), F.col("`text`").alias("text"))
    judged = text_statistics(packed).where(~base_failed() & (verdict(rules) == 0))
    return judged.select(*[F.col(copy)[c].alias(c) for c in names])
