"""Quality rules learned as a decision list: DataFrame expressions from the statistics to the verdict.

Sequential covering: a rule is a conjunction of thresholds on text statistics, grown one condition at a time on the
labelled rows of a growing part by its gain in information, pruned on the rows of a pruning part, and kept if it
holds there; the rows it covers are set aside and the next rule is grown. A rule that does not hold takes its growing rows
aside as well, so that one mixed kind of rows does not end the search. It ends when no rule gains more bits than it takes to
write down. What is left has the default verdict. Every step reads one histogram of (statistic, bin, label) counts, so
labelled rows are aggregated in Spark, however many.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glebe.llm.common import stage, whole_row

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Candidate thresholds per statistic.
BINS = 24
MAX_CONDITIONS = 3
#: A rule is kept if at least this share of the labelled rows it covers, pruning part included, is of low quality.
PRECISION = 0.95
MIN_COVERED = 5

_SPACE = r"[\x20\x09-\x0D]+"
_WORDY = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
#: Statistics that rules may test.
TESTED = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line",
          "distinct_share")


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_most: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value <= self.threshold if self.at_most else value > self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'<=' if self.at_most else '>'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are of low quality."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(Column.__and__, (c.column() for c in self.conditions), F.lit(True))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def text_statistics(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each row as the struct ``doc``, and the statistics of its whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word, equal to an
    earlier line), ``n_repeat_words`` (words in windows of ``window`` words found twice or more in the text), and the
    shares in TESTED. A null text has no words; a repeated row is a row. Windows are compared by 64-bit hash within one text.
    """
    text = F.coalesce(F.col(f"doc.{text_col}"), F.lit(""))
    doc = docs.select(whole_row(docs).alias("doc"))
    cut = doc.select("doc", F.array_remove(F.split(text, _SPACE), "").alias("words"),
                     F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORDY)).alias("lines"))
    n = F.size("words")
    windows = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)),
                                              lambda i: F.xxhash64(F.slice("words", i, window))))
    hashed = cut.withColumn("windows", windows)
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    # Most texts repeat no window and go no further.
    hashed = hashed.withColumn("sorted", F.when(twice, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.transform("sorted", lambda s, k: F.when(
        (s.h == F.get("sorted", k - 1).h) | F.coalesce(s.h == F.get("sorted", k + 1).h, F.lit(False)), s.i))
    hashed = hashed.withColumn("at", F.sort_array(F.filter(at, lambda i: i.isNotNull())))
    covered = F.transform("at", lambda i, k: F.least(F.lit(window), F.coalesce(F.get("at", k + 1) - i, F.lit(window))))
    lines, words = F.size("lines"), F.greatest(n, F.lit(1))
    counted = hashed.select(
        "doc", n.cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("bigint").alias("n_symbols"),
        (lines - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        (n / F.greatest(lines, F.lit(1))).alias("words_per_line"), lines.alias("n_lines"),
        (F.size(F.array_distinct("words")) / words).alias("distinct_share"))
    words = F.greatest("n_words", F.lit(1))
    return counted.withColumns({
        "mean_word_chars": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words}).drop("n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """An ordered decision list from rows of the TESTED statistics, ``low`` (1: low quality) and ``part`` (0: grow,
    1: prune). Nothing is learned without both kinds of rows. Only histograms come to the driver.
    """
    rules: list[Rule] = []
    left, growing = labelled, labelled.filter("part = 0")
    # Cut points are worked out anew from the rows that no rule covers yet.
    while thresholds := _thresholds(growing):
        rule, gain = _grow(growing, thresholds)
        candidates = 2 * sum(map(len, thresholds.values()))
        if rule is None or gain < len(rule.conditions) * log2(candidates):
            break
        kept = _prune(left, rule)
        if kept is not None:
            rules.append(kept)
            left = left.filter(~kept.column())
        growing = growing.filter(~(kept or rule).column())
    return rules


def _thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Per statistic, the middles between neighbouring quantiles of either kind of rows.

    Where the kinds lie apart, a rule so cuts in the middle of the gap, not at the last row of good quality seen.
    """
    steps = [i / BINS for i in range(BINS + 1)]
    quantiles = labelled.groupBy("low").agg(*(F.percentile_approx(s, steps).alias(s) for s in TESTED)).collect()
    if len(quantiles) < 2:
        return {}
    seen = {s: sorted({float(value) for row in quantiles for value in row[s]}) for s in TESTED}
    return {s: [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] for s, values in seen.items()}


def _grow(rows: DataFrame, thresholds: dict[str, list[float]]) -> tuple[Rule | None, float]:
    """Conditions added by the greatest information gain while rows of good quality are still covered, and the bits
    that all of them gain for the rows of low quality they cover."""
    conditions: list[Condition] = []
    prior, reached, total = 0.0, 0.0, 0.0
    bins = [F.struct(F.lit(s).alias("statistic"), F.size(F.filter(
        F.array(*(F.lit(t) for t in cuts)), _below(s))).alias("bin")) for s, cuts in thresholds.items() if cuts]
    while bins and len(conditions) < MAX_CONDITIONS:
        covered = rows.filter(Rule(tuple(conditions)).column())
        counts: dict[str, dict[int, list[int]]] = {}
        for r in covered.select("low", F.explode(F.array(*bins)).alias("b")).groupBy("b", "low").count().collect():
            counts.setdefault(r.b.statistic, {}).setdefault(r.b.bin, [0, 0])[r.low] += r["count"]
        if not counts:
            break
        good, low = map(sum, zip(*next(iter(counts.values())).values(), strict=True))
        if not low or not good:
            break
        reached = log2(low / (low + good))
        prior = prior if conditions else reached
        best, found, share = 0.0, None, 0.0
        for statistic, cuts in thresholds.items():
            below = [0, 0]
            for place, cut in enumerate(cuts):
                for kind in (0, 1):
                    below[kind] += counts.get(statistic, {}).get(place, (0, 0))[kind]
                for at_most, (g, p) in ((True, below), (False, (good - below[0], low - below[1]))):
                    gain = p * (log2(p / (p + g)) - reached) if p else 0.0
                    if gain > best + 1e-9:
                        best, found, share = gain, Condition(statistic, at_most, cut), p * (log2(p / (p + g)) - prior)
        if found is None:
            break
        conditions.append(found)
        total = share
    return (Rule(tuple(conditions)) if conditions else None), total


def _below(statistic: str):
    return lambda cut: F.col(statistic) > cut


def _prune(rows: DataFrame, rule: Rule) -> Rule | None:
    """The rule cut back to the first conditions that do best on the pruning part, if it is precise enough."""
    shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    sums = []
    for k, r in enumerate(shorter):
        for part, name in ((F.col("part") == 1, "prune"), (F.lit(True), "all")):
            for low in (0, 1):
                sums.append(F.count_if(r.column() & part & (F.col("low") == low)).alias(f"{name}{k}{low}"))
    counts = rows.agg(*sums).first().asDict()

    def worth(k: int) -> float:
        good, low = counts[f"prune{k}0"], counts[f"prune{k}1"]
        return (low - good) / (low + good) if low + good else -1.0

    k = max(range(len(shorter)), key=lambda k: (worth(k), -k))
    good, low = counts[f"all{k}0"], counts[f"all{k}1"]
    return shorter[k] if low >= MIN_COVERED and low >= PRECISION * (low + good) else None


def verdict(rules: list[Rule]) -> Column:
    """Whether a row is kept, as one conditional expression that tries the rules in order."""
    kept = F.when(base_failed(), False)
    for rule in rules:
        kept = kept.when(rule.column(), False)
    return kept.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    """Each row as ``doc`` (its columns in ``carry``, all by default) with its statistics and ``kept``; the rules.

    ``labels`` has (doc_id, quality): 0 is low; null ids or labels tell nothing, and an id with several labels counts
    as low if most of them are. Rules are learned on rows that pass the base rules. Rows with an empty or null text
    fail the base rules.
    """
    carried = F.struct(*(F.col(f"doc.`{c}`") for c in (carry or docs.columns)))
    found = text_statistics(docs, text_col).withColumn("doc", carried)
    statistics = stage(found, "statistics")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg((F.col("quality") == 0).cast("int")) > 0.5).cast("int").alias("low"))
    labelled = statistics.filter(~base_failed()).select(F.col(f"doc.`{id_col}`").alias("doc_id"), *TESTED)
    labelled = labelled.join(marks, "doc_id").select(
        *TESTED, "low", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 1).otherwise(0).alias("part"))
    rules = learn_rules(stage(labelled, "labelled"))
    return statistics.withColumn("kept", verdict(rules)), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns of the input."""
    judged, _ = judge(docs, labels, id_col, text_col)
    return judged.filter("kept").select("doc.*")
