"""Quality rules: statistics as native expressions and learned decision lists.

``text_stats`` counts over each whole text with DataFrame functions alone. ``learn_rules`` grows
conjunctions of thresholds by sequential covering on labelled statistics: a rule takes the condition
of the highest FOIL gain until it is pure, is pruned on held-back rows, and the bad rows that it
covers leave before the next one is grown. ``verdict`` turns the list into one ordered conditional
expression.

Null or blank texts have no words. Null labels, and rows without one, are not learned from. With no
labelled bad rows the list is empty and rejects nothing. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import SPLIT, materialize

SYMBOLS = "#*$%&|<>"
#: Labelled rows that are learned from at most, those of the lowest hash first.
MAX_LABELLED = 20_000
#: A rule must be right for this share of the rows it covers, in growing and in pruning.
MIN_PRECISION = 0.98
#: Rules of a list, conditions of a rule, and thresholds tried for a statistic, at most.
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 8, 3, 64
#: Fewest bad rows that a rule must cover.
MIN_COVER = 5


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagged: bool = False) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_bangs (long) of each row.

    With ``tagged`` the rows also have ``tag``, the hash of their text. Materialize the result before it is
    filtered or joined: the optimizer may otherwise repeat the statistics' expressions in the filter.
    Repeated windows are told by hashes whose neighbours are compared, so where windows of one hash but
    other words lie between two equal ones, a repeat is missed (of 43 bits at 10^6 words).
    """
    text, words = F.col("_t"), F.col("_w")
    src = df.select(df[id_col].alias("_id"), F.xxhash64(df[text_col]).alias("_tag"), F.coalesce(df[text_col], F.lit("")).alias("_t"))
    src = src.withColumn("_w", F.filter(F.split(text, SPLIT), lambda w: w != ""))
    # Three-word windows as hashes whose low bits give way to the position: one sort of longs brings equal
    # windows together, and neighbours are equal only if their words are.
    src = src.withColumn("_bits", F.ceil(F.log2(F.greatest(F.size(words), F.lit(2)))).cast("int") + 1)
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    src = src.withColumn("_h", F.slice(hashed, 1, F.greatest(F.size(words) - 2, F.lit(0))))
    shift = lambda name, x: F.call_function(name, x, F.col("_bits"))
    src = src.withColumn("_s", F.sort_array(F.transform(F.col("_h"), lambda h, i: shift("shiftleft", shift("shiftright", h)) + i)))
    s = F.col("_s")
    at = lambda x: (x - shift("shiftleft", shift("shiftright", x))).cast("int")
    # first the candidates by hash, which are few in most texts
    near = F.filter(s, lambda x, i: (shift("shiftright", x) == shift("shiftright", F.get(s, i - 1))) | (shift("shiftright", x) == shift("shiftright", F.get(s, i + 1))))
    src = src.withColumn("_n", F.coalesce(near, F.array().cast("array<bigint>"))).withColumn("_p", F.transform(F.col("_n"), at))
    p = F.col("_p")

    def same(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.get(words, a + k) == F.get(words, b + k) for k in range(3)])

    found = F.filter(p, lambda x, i: F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)))
    src = src.withColumn("_f", F.sort_array(found))
    f = F.col("_f")
    covered = F.aggregate(F.transform(f, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(f, i - 1), x - 3))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    src = src.withColumn("_l", lines)
    return src.select(
        F.col("_id").alias(id_col),
        *[F.col("_tag").alias("tag")] * tagged,
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.length(text).cast("long").alias("n_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("!")))).cast("long").alias("n_bangs"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What rules compare: a name and a share of two statistics, the same in Spark and on the driver.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "duplicate_lines_per_word": ("n_dup_lines", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


def feature(name: str) -> Column:
    top, under = FEATURES[name]
    return F.col(top).cast("double") / F.greatest(F.col(under), F.lit(1)) if under else F.col(top).cast("double")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        return feature(self.name) > F.lit(self.threshold) if self.above else feature(self.name) <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(x) for c in rule])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (b := bad[inside].sum()) and b < inside.sum():
        best, gain_of_best = None, 1e-9
        before = np.log2(b / inside.sum())
        for name, values in x.items():
            for t in np.unique(np.quantile(values[inside], np.linspace(0, 1, THRESHOLDS))):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    hit = inside & c.holds(x)
                    if (k := (hit & bad).sum()) >= MIN_COVER and (gain := k * (np.log2(k / hit.sum()) - before)) > gain_of_best:
                        best, gain_of_best = c, gain
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
        if bad[inside].mean() >= 0.999:
            break
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """A decision list from feature arrays and labels; every third row is held back for pruning."""
    held = np.arange(len(bad)) % 3 == 0
    grow = {k: v[~held] for k, v in x.items()}
    prune = {k: v[held] for k, v in x.items()}
    left, rules = bad[~held].copy(), []
    here = np.ones(len(left), bool)
    worth = lambda r: (lambda hit: (bad[held][hit].mean() if hit.any() else 0.0))(_covers(r, prune))
    while len(rules) < MAX_RULES and left[here].sum() >= MIN_COVER:
        rule = _grow({k: v[here] for k, v in grow.items()}, left[here])
        while len(rule) > 1 and worth(rule[:-1]) >= max(worth(rule), MIN_PRECISION):
            rule = rule[:-1]
        if not rule:
            break
        hit = _covers(rule, grow)
        if worth(rule) < MIN_PRECISION or bad[~held][hit].mean() < MIN_PRECISION or (hit & here & left).sum() < MIN_COVER:
            break
        rules.append(rule)
        here &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for what the list keeps: the first rule that holds rejects."""
    kept = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [c.column() for c in rule])
        kept = F.when(test, False) if kept is None else kept.when(test, False)
    return F.lit(True) if kept is None else kept.otherwise(True)


def labelled_sample(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and bad flags of at most ``max_rows`` labelled rows that pass the base rules."""
    marks = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), "quality")
    joined = materialize(stats.where(~base_failed()).join(marks, F.col(id_col) == F.col("_id")).select(*[feature(n).alias(n) for n in FEATURES], "quality", F.xxhash64("_id").alias("_o")))
    # a hash bound leaves little more than the sample, so tasks do not each send as many rows to the driver
    share = min(1.0, 1.5 * max_rows / max(joined.count(), 1))
    rows = joined.where(F.pmod("_o", F.lit(1 << 20)) <= int(share * (1 << 20))).withColumn("_o", F.pmod("_o", F.lit(1 << 20))).orderBy("_o", *FEATURES, "quality").limit(max_rows).collect()
    return {n: np.array([r[n] for r in rows], float) for n in FEATURES}, np.array([r["quality"] == 0 for r in rows], bool)


def apply_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagged: bool = False) -> DataFrame:
    """id, the statistics, base_failed and kept for each row of ``df``; rules are learned from ``labels``."""
    stats = materialize(text_stats(df, id_col, text_col, tagged))
    rules = learn_rules(*labelled_sample(stats, labels, id_col))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
