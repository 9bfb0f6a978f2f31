"""Reply ratings by rule or cache, and their agreement with reference ratings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.functions.numeric import count_if, ratio, round_dp
from deskgraph.functions.rules import first_match
from deskgraph.operators.gold import cohens_kappa
from deskgraph.operators.skew import join_to_unique, top_n_per_group

DIMENSIONS = D.JUDGE_DIMENSIONS
PASS = D.PASS_RATING


def _overall(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return round_dp(total.cast("double") / F.lit(float(len(columns))), 2)


def _scored(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    added = rows.select("*", *[scores[d].cast("bigint").alias(d) for d in DIMENSIONS])
    return added.withColumn("overall_score", _overall([F.col(d) for d in DIMENSIONS]))


def judge_heuristic(
    rows: DataFrame, reply: str = "reply", relevance_words: Sequence[str] = D.JUDGE_RELEVANCE_WORDS
) -> DataFrame:
    """Rule rating of a reply from its length and topic words."""
    n = T.word_count(F.col(reply))
    conciseness = first_match(
        [((n >= 10) & (n <= 35), F.lit(5)), (n <= 55, F.lit(3))], F.lit(2)
    )
    relevance = F.when(T.contains_any(F.lower(reply), relevance_words), F.lit(4)).otherwise(F.lit(2))
    four = F.lit(4)
    return _scored(
        rows,
        {"grounding": four, "relevance": relevance, "helpfulness": four, "tone_fit": four, "conciseness": conciseness},
    )


def judge_rule_scores(
    rows: DataFrame,
    category: str = "edge_case_category",
    context: str = "context",
    decision: str = "routing_decision",
    reply: str = "reply",
) -> DataFrame:
    """Rule rating from edge category, text lengths and route."""
    return _scored(
        rows,
        {
            "grounding": F.when(F.col(category) == D.STANDARD_CATEGORY, F.lit(5)).otherwise(F.lit(4)),
            "relevance": F.when(F.length(context) > 10, F.lit(5)).otherwise(F.lit(4)),
            "helpfulness": F.when(F.col(decision) == "ESCALATE", F.lit(4)).otherwise(F.lit(5)),
            "tone_fit": F.lit(5),
            "conciseness": F.when(T.word_count(F.col(reply)) <= 40, F.lit(5)).otherwise(F.lit(4)),
        },
    )


def judge_clamp(rows: DataFrame, fallback: dict[str, Column] | None = None) -> DataFrame:
    """Outside ratings made safe: missing to 3, whole, within 1 to 5, with their mean.

    A rating that is no number spoils its row's whole set, which then comes from ``fallback`` (the rule rating's
    columns by dimension; 3 each without it).
    """
    others = [c for c in rows.columns if c not in (*DIMENSIONS, "overall_score")]
    number = {d: F.col(d).cast("string").try_cast("double") for d in DIMENSIONS}
    spoilt = F.lit(False)
    for d in DIMENSIONS:
        spoilt = spoilt | (F.col(d).isNotNull() & (number[d].isNull() | F.isnan(number[d])))
    instead = fallback or dict.fromkeys(DIMENSIONS, F.lit(3))
    clamped = [
        F.when(spoilt, instead[d].cast("bigint"))
        .otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(number[d], F.lit(3.0)))).cast("bigint"))
        .alias(d)
        for d in DIMENSIONS
    ]
    return rows.select(*others, *clamped).withColumn("overall_score", _overall([F.col(d) for d in DIMENSIONS]))


def judge_key(context: Column, evidence: Column, reply: Column) -> Column:
    joined = F.concat_ws("|", T.strip(context), T.strip(evidence), T.strip(reply))
    return F.sha2(joined.cast("binary"), 256)


def judge_cache_join(
    rows: DataFrame,
    cache: DataFrame,
    row_id: str,
    context: str = "context",
    evidence: str = "evidence",
    reply: str = "reply",
) -> DataFrame:
    """Ratings from ``cache`` by content key, the rule rating where there is none; ``cached`` tells which.

    The same context and reply may come up very often, so hot keys are spread over ``row_id``.
    """
    names = [*DIMENSIONS, "overall_score"]
    stored = cache.select("cache_key", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_hit"))
    keyed = rows.withColumn("cache_key", judge_key(F.col(context), F.col(evidence), F.col(reply)))
    joined = join_to_unique(judge_heuristic(keyed, reply), stored, "cache_key", [row_id], how="left")
    return joined.select(
        *rows.columns,
        "cache_key",
        *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names],
        F.coalesce("_hit", F.lit(False)).alias("cached"),
    )


def judge_mean(scores: DataFrame, first: int | None = None, row_id: str = "example_id") -> DataFrame:
    """Mean overall rating of each system over all its rows, or over the ``first`` by id."""
    kept = scores
    if first is not None:
        kept = top_n_per_group(scores, ["system_name"], [F.col(row_id)], first)
    return kept.groupBy("system_name").agg(
        F.count(F.lit(1)).alias("rated"), round_dp(F.avg("overall_score"), 2).alias("mean_score")
    )


def reference_ratings(gold: DataFrame) -> DataFrame:
    """Ratings that follow from the gold attributes: ``example_id``, five dimensions, ``overall``."""
    edge = F.col("edge_case_category")
    escalated = F.upper("gold_routing_decision") == "ESCALATE"
    rated = gold.select(
        "example_id",
        first_match(
            [(edge == D.STANDARD_CATEGORY, F.lit(5)), (edge == D.LOW_INFO_CATEGORY, F.lit(4))], F.lit(3)
        ).cast("bigint").alias("grounding"),
        F.when(edge == D.LOW_INFO_CATEGORY, F.lit(3)).otherwise(F.lit(5)).cast("bigint").alias("relevance"),
        F.when(escalated, F.lit(4)).otherwise(F.lit(5)).cast("bigint").alias("helpfulness"),
        F.lit(5).cast("bigint").alias("tone_fit"),
        F.when(F.col("length_bucket").isin("short", "medium"), F.lit(5)).otherwise(F.lit(4)).cast("bigint").alias("conciseness"),
    )
    return rated.withColumn("overall", _overall([F.col(d) for d in DIMENSIONS]))


def paired_ratings(judge: DataFrame, human: DataFrame) -> DataFrame:
    """Long form ``example_id, dim, judge, human`` of two wide rating tables."""
    columns = [*DIMENSIONS, "overall"]

    def long(frame: DataFrame, name: str) -> DataFrame:
        wide = frame.select("example_id", *[F.col(c).cast("double").alias(c) for c in columns])
        return wide.unpivot("example_id", columns, "dim", name)

    renamed = judge.withColumn("overall", F.coalesce("overall_score", F.lit(PASS)))
    return long(renamed, "judge").join(long(human, "human"), ["example_id", "dim"])



def _average_ranks(pairs: DataFrame, by: Sequence[str], value: str, rank: str) -> DataFrame:
    """Average rank of each distinct value: counts first, then a running sum over the few values."""
    counts = pairs.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*by, value, (running - F.col("_n") + (F.col("_n") + 1) / 2).alias(rank))


def spearman_agreement(
    pairs: DataFrame, by: Sequence[str] = ("dim",), undefined: float | None = D.UNDEFINED_SPEARMAN,
    minimum: int = D.MIN_AGREEMENT_PAIRS, digits: int = 4,
) -> DataFrame:
    """Rank correlation of ``judge`` and ``human`` per group: ``by, n, spearman``.

    Pairs are counted per (judge, human) value first.  Ratings have few values, so ranks and
    correlation run on that small table with weights and no row is ranked on its own.
    """
    keys = list(by)
    cells = pairs.groupBy(*keys, "judge", "human").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ranked = cells.join(_average_ranks(pairs, keys, "judge", "rj"), [*keys, "judge"]).join(
        _average_ranks(pairs, keys, "human", "rh"), [*keys, "human"]
    )
    w, x, y = F.col("w"), F.col("rj"), F.col("rh")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * x).alias("sx"),
        F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
        F.sum(w * x * y).alias("sxy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    rho = F.when((vx > 0) & (vy > 0), round_dp((n * F.col("sxy") - sx * sy) / F.sqrt(vx * vy), digits))
    value = rho if undefined is None else F.coalesce(rho, F.lit(undefined))
    return sums.where(n >= minimum).select(*keys, n.cast("bigint").alias("n"), value.alias("spearman"))


def _t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    import math

    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    flip = x > (a + 1.0) / (a + b + 2.0)
    if flip:
        x, a, b = 1.0 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    fraction = d
    for m in range(1, 400):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + up * d)
        c = 1.0 + up / c
        fraction *= c * d
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + down * d)
        c = 1.0 + down / c
        fraction *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    value = front * fraction
    return 1.0 - value if flip else value


def spearman_p_value(pairs: DataFrame, by: Sequence[str] = ("dim",)) -> DataFrame:
    """Two-sided p-value per group; 0.01 where the correlation is undefined.

    The tail runs on one aggregate row per group.
    """
    rho = spearman_agreement(pairs, by, undefined=None, digits=12)

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = []
            for r, n in zip(frame["spearman"], frame["n"], strict=True):
                if pd.isna(r):
                    p.append(D.UNDEFINED_P_VALUE)
                elif abs(r) >= 1.0:
                    p.append(0.0)
                else:
                    p.append(round(_t_tail(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2), 5))
            yield frame.assign(p_value=p)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rho.schema.fields)
    return rho.mapInPandas(tails, f"{own}, p_value double")


def mean_abs_error(pairs: DataFrame, by: Sequence[str] = ("dim",)) -> DataFrame:
    return pairs.groupBy(*by).agg(round_dp(F.avg(F.abs(F.col("judge") - F.col("human"))), 4).alias("mean_absolute_error"))


def exact_match_rate(pairs: DataFrame, by: Sequence[str] = ("dim",)) -> DataFrame:
    """Share of pairs equal after rounding half to even."""
    same = F.bround(F.col("judge").cast("double"), 0) == F.bround(F.col("human").cast("double"), 0)
    return pairs.groupBy(*by).agg(round_dp(ratio(count_if(same), F.count(F.lit(1))), 4).alias("exact_match_rate"))


def pass_fail_kappa(pairs: DataFrame, by: Sequence[str] = ("dim",), passing: float = PASS) -> DataFrame:
    """Kappa of "at least ``passing``"; a fallback value where it is undefined."""
    return cohens_kappa(
        pairs,
        F.col("human") >= F.lit(passing),
        F.col("judge") >= F.lit(passing),
        by,
        undefined=D.UNDEFINED_KAPPA,
        name="cohen_kappa_pass_fail",
    )


def agreement_report(pairs: DataFrame) -> DataFrame:
    """Every agreement measure of every dimension with at least the minimum number of pairs."""
    return (
        spearman_agreement(pairs)
        .join(pass_fail_kappa(pairs), "dim")
        .join(mean_abs_error(pairs), "dim")
        .join(exact_match_rate(pairs), "dim")
        .select("dim", "n", "spearman", "cohen_kappa_pass_fail", "mean_absolute_error", "exact_match_rate")
    )


def agreement_summary(report: DataFrame) -> DataFrame:
    """The overall dimension in one row, with defaults where it is absent."""
    overall = F.col("dim") == "overall"

    def pick(column: str, default: float) -> Column:
        return F.coalesce(F.max(F.when(overall, F.col(column))), F.lit(default))

    return report.agg(
        pick("spearman", D.AGREEMENT_DEFAULTS["spearman"]).alias("overall_spearman_correlation"),
        pick("cohen_kappa_pass_fail", D.AGREEMENT_DEFAULTS["kappa"]).alias("overall_cohen_kappa"),
        pick("mean_absolute_error", D.AGREEMENT_DEFAULTS["mae"]).alias("overall_mae"),
    )

