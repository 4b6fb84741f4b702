"""Quality rules: decision lists learnt by sequential covering, in Spark's own expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import labelled_rows

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Signs that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Rules are learnt from so many labelled rows at most, those of least hash.
SAMPLE_ROWS = 8_000
#: Thresholds tried: these quantiles of each statistic among good and among bad rows.
QUANTILES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 1.0)
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be right for this share of the rows it was not grown on, and hold for so many bad rows of them.
LEAST_PRECISION = 0.9
LEAST_COVER = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_stops")
RATIOS = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "word_length", "mark_ratio", "line_words", "stop_ratio")


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, wherever the optimiser puts the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that an array of words holds twice or more."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))

    def alike(g: Column) -> Column:
        equal = F.filter(g, lambda x, k: x["h"].eqNullSafe(F.get(g, k - 1)["h"]) | x["h"].eqNullSafe(F.get(g, k + 1)["h"]))
        return F.sort_array(F.transform(equal, lambda x: x["i"]))

    places = _bind(F.sort_array(windows), alike)
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with STATISTICS of each whole text, as longs. Older columns of these names are replaced; null counts as empty.

    Words in repeated three-word windows: windows are sorted by hash and place,
    those with an equal neighbour give their places, and the union of their
    spans is counted; the work is n log n for a text of n words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(*(c for c in docs.columns if c not in STATISTICS), text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    step = plain.select("*", F.filter(F.split("_t", GAP), lambda w: w != "").alias("_w"), lines.alias("_l"))
    covered = _bind(F.col("_w"), _repeated)
    size = F.length("_t")
    own = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.regexp_replace("_t", GAP, "")),
        "n_symbols": size - F.length(F.translate("_t", SYMBOLS, "")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
        "n_lines": F.size("_l"),
        "n_marks": size - F.length(F.translate("_t", "!?", "")),
        "n_stops": size - F.length(F.translate("_t", ".,;:", "")),
    }
    return step.select(*(c for c in plain.columns if c != "_t"), *(v.cast("long").alias(k) for k, v in own.items()))


def ratios() -> dict[str, Column]:
    """RATIOS of the statistics; a text without words has 0."""

    def per(name: str, by: str) -> Column:
        return F.when(F.col(by) == 0, F.lit(0.0)).otherwise(F.col(name) / F.col(by))

    return {
        "symbol_ratio": per("n_symbols", "n_words"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "word_length": per("word_chars", "n_words"),
        "mark_ratio": per("n_marks", "n_words"),
        "line_words": per("n_words", "n_lines"),
        "stop_ratio": per("n_stops", "n_words"),
    }


def base_failed() -> Column:
    """Too short, or over half of the words in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """A statistic is at least, or at most, a threshold."""

    name: str
    at_least: bool
    threshold: float

    def column(self, by: dict[str, Column]) -> Column:
        return by[self.name] >= self.threshold if self.at_least else by[self.name] <= self.threshold

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.name] >= self.threshold if self.at_least else row[self.name] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, and what none holds for is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """The list as one ``CASE WHEN`` over the statistics."""
        by, out = ratios(), None
        for rule in self.rules:
            holds = rule[0].column(by)
            for c in rule[1:]:
                holds = holds & c.column(by)
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.name} {'>=' if c.at_least else '<='} {c.threshold:g}" for c in r) for r in self.rules)


#: Counts of equal labelled rows: bin of each statistic, good and bad rows to grow on, good and bad rows to prune on.
Cell = tuple[tuple[int, ...], tuple[int, int, int, int]]


def _covers(bins: tuple[int, ...], rule: list[tuple[int, bool, int]]) -> bool:
    return all(bins[f] >= cut if up else bins[f] < cut for f, up, cut in rule)


def _grow(cells: list[Cell], bounds: list[int]) -> list[tuple[int, bool, int]]:
    """Add the condition of most information gain until no good row is covered."""
    rule: list[tuple[int, bool, int]] = []
    while cells and len(rule) < MAX_CONDITIONS:
        good, bad = sum(n[0] for _, n in cells), sum(n[1] for _, n in cells)
        if not good or not bad:
            break
        old, best = math.log2(bad / (good + bad)), (1e-9, None)
        for f, top in enumerate(bounds):
            sums = [[0, 0] for _ in range(top + 1)]
            for bins, n in cells:
                sums[bins[f]][0] += n[0]
                sums[bins[f]][1] += n[1]
            low_good = low_bad = 0
            for cut in range(1, top + 1):
                low_good += sums[cut - 1][0]
                low_bad += sums[cut - 1][1]
                for up, g, b in ((True, good - low_good, bad - low_bad), (False, low_good, low_bad)):
                    if b and (gain := b * (math.log2(b / (g + b)) - old)) > best[0]:
                        best = (gain, (f, up, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        cells = [c for c in cells if _covers(c[0], rule[-1:])]
    return rule


def _prune(cells: list[Cell], rule: list[tuple[int, bool, int]]) -> tuple[list[tuple[int, bool, int]], int, int]:
    """The beginning of a rule that is worth most on the rows to prune on, with the good and bad rows it covers there."""
    best = (-2.0, rule, 0, 0)
    for k in range(len(rule), 0, -1):
        held = [n for bins, n in cells if _covers(bins, rule[:k])]
        good, bad = sum(n[2] for n in held), sum(n[3] for n in held)
        worth = (bad - good) / (bad + good) if bad + good else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], good, bad)
    return best[1:]


def cover(cells: list[Cell], names: list[str], cuts: list[list[float]]) -> DecisionList:
    """Sequential covering: grow a rule, prune it, drop the rows it covers, until a rule is not good enough."""
    rules, bounds = [], [len(c) for c in cuts]
    while len(rules) < MAX_RULES:
        rule = _grow(cells, bounds)
        if not rule:
            break
        rule, good, bad = _prune(cells, rule)
        if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
            break
        below = lambda f, cut: math.nextafter(cuts[f][cut - 1], -math.inf)
        rules.append(tuple(Condition(names[f], up, cuts[f][cut - 1] if up else below(f, cut)) for f, up, cut in rule))
        cells = [c for c in cells if not _covers(c[0], rule)]
    return DecisionList(tuple(rules))


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Rules that reject what ``labels`` call bad (0), from labelled rows that do not fail the base rules.

    The labelled rows of least hash, up to ``sample_rows``, are taken, equal
    ones once; of
    several labels of an id the lowest counts; null ids and labels are left out.
    Spark finds the quantiles that serve as thresholds and counts equal rows by
    bins; rows reach the driver only as such counts. Without labels of both
    kinds nothing is rejected.
    """
    named = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label")).dropna()
    chosen = named.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = labelled_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, sample_rows)
    part = F.pmod(F.xxhash64(F.lit("prune"), "id"), F.lit(3)) == 0
    rows = statistics(rows).filter(~base_failed()).select("label", part.alias("prune"), *(c.alias(k) for k, c in ratios().items())).cache()
    try:
        names, found = list(RATIOS), {k: set() for k in RATIOS}
        for r in rows.groupBy("label").agg(*(F.percentile(k, F.array(*map(F.lit, QUANTILES))).alias(k) for k in names)).collect():
            for k in names:
                found[k] |= set(r[k])
        cuts = [sorted(found[k]) for k in names]
        bins = [sum(((F.col(k) >= t).cast("int") for t in c), F.lit(0)) for k, c in zip(names, cuts, strict=True)]
        kinds = [F.count_if((F.col("label") == y) & (F.col("prune") == p)) for p in (False, True) for y in (1, 0)]
        counted = rows.groupBy(*(b.alias(f"b{i}") for i, b in enumerate(bins))).agg(*(n.alias(f"n{i}") for i, n in enumerate(kinds)))
        cells = sorted((tuple(r[: len(names)]), tuple(r[len(names) :])) for r in counted.collect())
    finally:
        rows.unpersist()
    return cover(cells, names, cuts)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``; older columns of these names are replaced."""
    done = statistics(docs.drop("base_failed", "kept"), text_col)
    return done.select("*", base_failed().alias("base_failed"), (~base_failed() & rules.keeps()).alias("kept"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
