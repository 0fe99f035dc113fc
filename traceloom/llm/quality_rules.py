"""Quality rules with risk-controlled thresholds.

Each text is measured by a few rules' statistics. One half of the labelled rows
proposes policies, from mild to severe, each with a cutoff for every rule; on the
other half a policy is certified if the exact upper binomial bound (Clopper and
Pearson, 1934) of the share of good texts that it rejects is at most `risk`. The
error of the bounds is divided by the number of strata, and within a stratum
policies are tried from the mildest on and the first that fails ends the search,
so that no further correction is due (fixed-sequence testing; Angelopoulos et
al., "Learn then test", 2021).

The sequence runs up to the risk itself. Of the certified policies, all of which
hold, that is taken which rejects the most bad holdouts beyond the good ones.

All labelled rows are used, as counts in bins: what reaches the driver is bounded
by strata x rules x bins. A stratum is one of the `strata` column's values with
at least `least` good labelled rows, as many as there are; all others are pooled,
and their bound holds for the pool. The bounds speak of texts that pass the base
rules; those say nothing of labels. Cutoffs are joined as a table, a row for each
stratum, so that plans do not grow with strata.

Defined results: a null text has no words and fails the base rules; a null
stratum is pooled; rows that repeat are judged each; without labels only the base
rules reject; an empty table gives no row; very long texts are measured whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import cut, map_arrow

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
BINS = 200

#: Rule name -> statistic, as SQL over the measured columns; higher is worse.
RULES = {
    "symbols": "try_divide(n_symbols, n_words)",
    "marks": "try_divide(n_marks, n_words)",
    "capitals": "try_divide(n_upper, word_chars)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "lines": "try_divide(n_dup_lines, n_lines)",
    "long_words": "try_divide(word_chars, n_words) / 40",
    "unended_lines": "try_divide(n_unended, n_lines)",
    "few_kinds": "1 - try_divide(n_kinds, sqrt(n_words) * 4)",
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_lines", "n_unended", "n_kinds")


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words in windows of the width that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(upto, i)
            upto = i + width
    return covered


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    spaces = sum(text.count(c) for c in SPACES)
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    duplicates = lines = unended = 0
    for line in text.split("\n"):
        if HAS_WORD.search(line):
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
            if line.rstrip()[-1:] not in (".", "!", "?", ":", '"', "”", "…"):
                unended += 1
    return (
        len(words), len(text) - spaces, symbols, duplicates, repeated_words(words),
        text.count("!") + text.count("?"), sum(map(str.isupper, text)) if text.lower() != text else 0, lines, unended, len(set(words)),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(id, *keep, the text if keep_text, the measures) of every row, from its whole text."""
    source = docs.select(F.col(id_col).alias("id"), *(F.col(c) for c in keep), F.col(text_col).cast("string").alias("text"))
    schema = (source if keep_text else source.drop("text")).select("*", *(F.lit(0).cast("bigint").alias(c) for c in MEASURES)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure_text(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(MEASURES)
            own = batch.columns if keep_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return map_arrow(source, run, schema)


def upper_bound(failures: int, n: int, error: float) -> float:
    """Exact upper confidence bound of a binomial share: the p with P(X <= failures) = error."""
    if n == 0 or failures >= n:
        return 1.0
    lo, hi = failures / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(failures + 1)]
    for _ in range(60):
        p = (lo + hi) / 2
        tail = math.fsum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs)) if 0 < p < 1 else float(p <= 0)
        lo, hi = (p, hi) if tail > error else (lo, p)
    return hi


def propose(good: list[int], bad: list[int], share: float) -> int | None:
    """A rule's cutoff from counts in bins: at most that share of good texts at or above it.

    It lies half-way from the last good text to the first bad one beyond; there is
    none if fewer bad texts lie beyond than three or one in fifty of all.
    """
    most, left, b = share * sum(good), 0, len(good)
    while b > 1 and left + good[b - 1] <= most:
        b -= 1
        left += good[b]
    first = next((k for k in range(b, len(bad)) if bad[k]), None)
    if first is None or sum(bad[b:]) < max(3, sum(bad) / 50):
        return None
    return (b + first + 1) // 2


@dataclass(frozen=True)
class Cutoffs:
    """Certified cutoffs: (stratum, rule) -> least bin rejected; the stratum "" is the pooled one.

    bounds: (stratum) -> the upper bound of its share of good texts rejected.
    """

    strata: tuple[str, ...]
    bins: dict[tuple[str, str], int]
    bounds: dict[str, float]


def _bin(rule: str) -> Column:
    value = F.coalesce(F.expr(RULES[rule]).cast("double"), F.lit(0.0))
    return F.least(F.greatest(F.floor(value * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _with_cuts(rows: DataFrame, strata: str, name: str, own: Collection[str], cuts: dict[str, list[list[int]]], empty: list[list[int]]) -> DataFrame:
    """rows with the column `name`: their stratum's cutoffs, those of the pooled one where it has none of its own."""
    names = list(RULES)
    if any(len(level) != len(names) for levels in cuts.values() for level in levels):
        raise ValueError("a cutoff for each rule is needed")
    table = rows.sparkSession.createDataFrame([(s, cuts.get(s, empty)) for s in sorted(own)], f"`{name}_of` string, `{name}` array<array<int>>")
    stratum = F.coalesce(F.col(strata).cast("string"), F.lit(""))
    pooled = F.array(*(F.array(*(F.lit(c) for c in level)) for level in cuts.get("", empty)))
    # One row of some hundred numbers for each stratum: broadcast while they are few enough to be small.
    table = F.broadcast(table) if len(own) <= MOST_BROADCAST else table
    found = rows.join(table, stratum == F.col(f"{name}_of"), "left") if own else rows.withColumn(name, F.lit(None).cast("array<array<int>>"))
    return found.withColumn(name, F.coalesce(name, pooled)).drop(f"{name}_of")


#: The cutoff of a rule that rejects nothing.
NEVER = BINS
#: Strata whose cutoffs are broadcast: under 2 MB for eight policies of eight rules.
MOST_BROADCAST = 4096


def calibrate(
    measured: DataFrame, labels: DataFrame, strata: str = "lang", risk: float = 0.05, error: float = 0.05,
    shares: tuple[float, ...] = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05), least: int = 150,
) -> Cutoffs:
    """Cutoffs from all labelled rows of measured (columns id, strata, measures).

    One half of them, by a hash of the id, proposes ever more severe policies, each
    a cutoff for every rule, by `shares` of good texts that a rule may reject; the
    other half certifies them. A stratum of its own needs `least` good rows.
    """
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    truth = truth.select(F.col("doc_id").alias("id"), (F.col("q") >= 0.5).alias("good"))
    held = measured.where(~_base_failed()).join(truth, "id")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    held = held.select(F.coalesce(F.col(strata).cast("string"), F.lit("")).alias("stratum"), half.alias("proposes"), "good", *(_bin(r).alias(r) for r in RULES))
    counts = held.where("good").groupBy("stratum").agg(F.count("*").alias("n"))
    own = {r["stratum"] for r in counts.where((F.col("n") >= least) & (F.col("stratum") != "")).collect()}
    names = held.sparkSession.createDataFrame([(s,) for s in sorted(own)], "own string")
    names = F.broadcast(names) if len(own) <= MOST_BROADCAST else names
    pooled = held.join(names, F.col("stratum") == F.col("own"), "left").withColumn("stratum", F.coalesce("own", F.lit(""))).drop("own")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES)))
    bins = pooled.where("proposes").select("stratum", "good", pairs.alias("x")).groupBy("stratum", "x.rule", "x.bin")
    table: dict[tuple[str, str], tuple[list[int], list[int]]] = {}
    for r in bins.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect():
        good, bad = table.setdefault((r["stratum"], r["rule"]), ([0] * BINS, [0] * BINS))
        good[r["bin"]] += r["good"]
        bad[r["bin"]] += r["bad"]
    levels = [{k: c for k, (g, b) in sorted(table.items()) if (c := propose(g, b, share)) is not None} for share in shares]
    names = sorted({s for s, _ in table})
    cuts = {s: [[level.get((s, rule), NEVER) for rule in RULES] for level in levels] for s in names}
    # The mildest policy by number that rejects a row.
    cut_rows = _with_cuts(pooled, "stratum", "_cuts", [s for s in names if s], cuts, [[NEVER] * len(RULES) for _ in levels])
    broken = lambda level: F.exists(F.zip_with(level, F.array(*RULES), lambda c, b: b >= c), lambda x: x)
    first = F.array_position(F.transform("_cuts", broken), True)
    rejected = F.when(first > 0, first - 1).otherwise(len(levels)).cast("int")
    tested = cut_rows.where("not proposes").select("stratum", "good", rejected.alias("level")).groupBy("stratum", "good", "level").count().collect()
    seen: dict[str, Counter] = {}
    for r in tested:
        seen.setdefault(r["stratum"], Counter())[r["good"], r["level"]] += r["count"]
    chosen: dict[tuple[str, str], int] = {}
    bounds: dict[str, float] = {}
    for s in names:
        n = sum(c for (good, _), c in seen.get(s, Counter()).items() if good)
        gained, lost, won = 0, 0, 0
        for k, level in enumerate(levels):
            lost, won = lost + seen[s][True, k] if n else 0, won + seen[s][False, k] if n else 0
            bound = upper_bound(lost, n, error / len(names))
            if n == 0 or bound > risk:
                break
            if won - lost > gained:
                gained, bounds[s] = won - lost, bound
                chosen = {key: c for key, c in chosen.items() if key[0] != s} | {key: c for key, c in level.items() if key[0] == s}
    return Cutoffs(tuple(sorted(own)), chosen, bounds)


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: Cutoffs, strata: str = "lang") -> DataFrame:
    """measured with base_failed, rule (one that rejects, else null) and kept."""
    cuts = {s: [[cutoffs.bins.get((s, rule), NEVER) for rule in RULES]] for s in ("", *cutoffs.strata)}
    rows = _with_cuts(measured, strata, "_cuts", cutoffs.strata, cuts, [[NEVER] * len(RULES)])
    rule = F.coalesce(*(F.when(_bin(name) >= F.get(F.get("_cuts", F.lit(0)), F.lit(k)), F.lit(name)) for k, name in sorted(enumerate(RULES), key=lambda x: x[1])))
    out = rows.withColumn("base_failed", _base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rule))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("_cuts")


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", strata: str = "lang") -> DataFrame:
    """Measure, calibrate and judge every row of docs; the measures are kept in the shared folder."""
    measured = cut(spark, measure(docs, id_col, keep=(strata,)), "measures")
    return judge(measured, calibrate(measured, labels, strata), strata)
