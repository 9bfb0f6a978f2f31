"""Build, annotate and audit a gold set from the evaluation pool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions.numeric import count_if, percent, round_dp
from deskgraph.functions.rules import first_match, lookup
from deskgraph.functions.text import contains_any
from deskgraph.operators.sampling import quota_sample, seeded_key, seeded_sample, seeded_top
from deskgraph.operators.skew import top_n_per_group


def stratified_sample_edges(
    pool: DataFrame,
    quotas: Mapping[str, int] = D.EDGE_QUOTAS,
    seed: int = D.SPLIT_SEED,
    category: str = "edge_category",
    row_id: str = "customer_tweet_id",
) -> DataFrame:
    """Seeded sample of every edge category, up to its quota."""
    return quota_sample(pool, category, dict(quotas), seed, row_id)


def stratified_fill_quota(
    pool: DataFrame,
    chosen: DataFrame,
    per_intent: int = D.INTENT_QUOTA,
    seed: int = D.SPLIT_SEED,
    intent: str = "mapped_intent",
    row_id: str = "customer_tweet_id",
) -> DataFrame:
    """For every intent the unchosen rows that lift it to ``per_intent``.

    ``chosen`` is a sample of bounded size, so its ids and counts are small.
    """
    have = chosen.groupBy(intent).agg(F.count(F.lit(1)).alias("_have"))
    free = pool.join(F.broadcast(chosen.select(row_id)), row_id, "left_anti")
    ranked = top_n_per_group(free, [intent], [seeded_key(seed, row_id), F.col(row_id)], per_intent, rank="_rank")
    needed = F.greatest(F.lit(0), F.lit(per_intent) - F.coalesce("_have", F.lit(0)))
    return ranked.join(have, intent, "left").where(F.col("_rank") <= needed).select(*pool.columns)


def sample_fill_remainder(
    pool: DataFrame,
    chosen: DataFrame,
    target: int = D.GOLD_SIZE,
    seed: int = D.SPLIT_SEED,
    row_id: str = "customer_tweet_id",
) -> DataFrame:
    """Bring ``chosen`` to ``target`` rows: fill from the rest in seeded order, or cut in that order."""
    free = pool.join(F.broadcast(chosen.select(row_id)), row_id, "left_anti").select(*pool.columns)
    both = chosen.select(*pool.columns, F.lit(0).alias("_late")).unionByName(
        seeded_sample(free, target, seed, row_id).withColumn("_late", F.lit(1))
    )
    return both.orderBy("_late", seeded_key(seed, row_id), row_id).limit(target).drop("_late")


def gold_example_id(rows: DataFrame, row_id: str = "customer_tweet_id", seed: int = D.SPLIT_SEED) -> DataFrame:
    """Add ``example_id``: ``gold_001`` and on, in seeded order.

    The one global window here runs over a finished gold set, whose size is its target.
    """
    number = F.row_number().over(Window.orderBy(seeded_key(seed, row_id), row_id))
    text = number.cast("string")
    return rows.withColumn(
        "example_id", F.concat(F.lit("gold_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))
    )


def gold_annotation(
    rows: DataFrame,
    guidance: Mapping[str, str] = D.GOLD_GUIDANCE,
    reasons: Mapping[str, str] = D.GOLD_REASONS,
    support_intent: str = D.INTENTS[7],
    driver_intent: str = D.INTENTS[3],
    other: str = D.OTHER_INTENT,
) -> DataFrame:
    """The eleven gold columns from category, intent and policy."""
    intent, edge = F.col("mapped_intent"), F.col("edge_category")
    safety, support, driver = edge == D.SAFETY_CATEGORY, intent == support_intent, intent == driver_intent
    reason = first_match(
        [
            (safety, F.lit(D.GOLD_REASON_SAFETY)),
            (support, F.lit(D.GOLD_REASON_SUPPORT)),
            (driver, F.lit(D.GOLD_REASON_DRIVER)),
        ],
        lookup(intent, reasons, reasons[other]),
    )
    return rows.select(
        "example_id",
        "customer_tweet_id",
        F.col("customer_text_clean").alias("customer_text"),
        F.when(F.col("is_first_turn"), F.lit("first_turn")).otherwise(F.lit("follow_up")).alias("turn_position"),
        "length_bucket",
        edge.alias("edge_case_category"),
        intent.alias("gold_intent"),
        F.when(safety | support | driver, F.lit("ESCALATE")).otherwise(F.lit("AUTO_HANDLE")).alias("gold_routing_decision"),
        reason.alias("gold_escalate_reason"),
        lookup(intent, guidance, guidance[other]).alias("gold_reply_reference"),
        F.col("brand_reply_clean").alias("brand_historical_reply"),
    )


def build_golden_set(
    pool: DataFrame,
    target: int = D.GOLD_SIZE,
    seed: int = D.SPLIT_SEED,
    edge_quotas: Mapping[str, int] = D.EDGE_QUOTAS,
    per_intent: int = D.INTENT_QUOTA,
) -> DataFrame:
    """Edge cases first, then every intent to its quota, then the rest; numbered and annotated."""
    return gold_annotation(gold_example_id(select_gold(pool, target, seed, edge_quotas, per_intent), seed=seed))


def select_gold(
    pool: DataFrame,
    target: int = D.GOLD_SIZE,
    seed: int = D.SPLIT_SEED,
    edge_quotas: Mapping[str, int] = D.EDGE_QUOTAS,
    per_intent: int = D.INTENT_QUOTA,
    row_id: str = "customer_tweet_id",
) -> DataFrame:
    """The ``target`` pool rows that make the gold set: every edge category to its quota, every intent to its own, then the rest.

    The pool is ranked once, in seeded order, within each edge category, within each intent and as a whole, and only ranks
    that a step could need leave the tasks.  What each step takes then follows from ranks and counts among these few
    rows, whose number the quotas bound.  The pool is read again only for the rows that were chosen.
    """
    many = sum(edge_quotas.values())
    # edge rows may stand before the rows an intent or the remainder needs
    most = max([*edge_quotas.values(), per_intent + many, 2 * target, 1])
    group = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).cast("string").alias("group"))
    whole = F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("group"))
    keyed = pool.select(row_id, "edge_category", "mapped_intent", seeded_key(seed, row_id).alias("_key"))
    ranked = top_n_per_group(
        keyed.select("*", F.inline(F.array(group("edge", "edge_category"), group("intent", "mapped_intent"), whole))),
        ["kind", "group"], [F.col("_key"), F.col(row_id)], most, rank="_rank",
    )
    few = ranked.groupBy(row_id, "_key", "edge_category", "mapped_intent").agg(F.min(F.when(F.col("kind") == "edge", F.col("_rank"))).alias("_edge"))
    quota = lookup(F.col("edge_category"), dict(edge_quotas), 0) if edge_quotas else F.lit(0)
    order = ["_key", row_id]
    placed = few.withColumn("_is_edge", F.coalesce(F.col("_edge") <= quota, F.lit(False)))
    have = F.sum(F.col("_is_edge").cast("int")).over(Window.partitionBy("mapped_intent"))
    turn = F.row_number().over(Window.partitionBy("mapped_intent", "_is_edge").orderBy(*order))
    filled = placed.withColumn("_late", F.when(F.col("_is_edge") | (turn <= F.lit(per_intent) - have), 0).otherwise(1))
    final = filled.orderBy("_late", *order).limit(target).select(row_id, "edge_category", "mapped_intent")
    return pool.drop("edge_category", "mapped_intent").join(F.broadcast(final), row_id)


GOLD_DISTRIBUTIONS = {
    "intent": "gold_intent",
    "routing": "gold_routing_decision",
    "edge_case": "edge_case_category",
    "length": "length_bucket",
    "turn": "turn_position",
}


def gold_distribution(gold: DataFrame, columns: Mapping[str, str] = GOLD_DISTRIBUTIONS) -> DataFrame:
    """Frequency of every value of every listed column, and the total: one pass over unpivoted values."""
    pairs = F.array(
        F.struct(F.lit("total").alias("distribution"), F.lit("all").alias("value")),
        *[F.struct(F.lit(n).alias("distribution"), F.col(c).cast("string").alias("value")) for n, c in columns.items()],
    )
    return gold.select(F.inline(pairs)).groupBy("distribution", "value").agg(F.count(F.lit(1)).alias("n"))


def second_pass_relabel(
    gold: DataFrame,
    sample_size: int = D.AUDIT_SIZE,
    seed: int = D.AUDIT_SEED,
    fare_intent: str = D.INTENTS[0],
    cancel_intent: str = D.INTENTS[1],
    lost_intent: str = D.INTENTS[2],
    driver_intent: str = D.INTENTS[3],
    pickup_intent: str = D.INTENTS[4],
    rude_words: Sequence[str] = D.RUDE_WORDS,
    cancel_words: tuple[str, Sequence[str]] = ("cancellation", ("fee", "charge")),
    lost_words: tuple[str, str] = ("left", "phone"),
) -> DataFrame:
    """A seeded audit sample with first- and second-pass labels under the boundary rules."""
    body, intent = F.lower("customer_text"), F.col("gold_intent")
    cancel = body.contains(cancel_words[0]) & contains_any(body, cancel_words[1]) & (intent == fare_intent)
    lost = body.contains(lost_words[0]) & body.contains(lost_words[1]) & (intent == driver_intent)
    rude = contains_any(body, rude_words) & (intent == pickup_intent)
    relabelled = first_match(
        [(cancel, F.lit(cancel_intent)), (lost, F.lit(lost_intent)), (rude, F.lit(driver_intent))], intent
    )
    route = F.when(~cancel & ~lost & rude, F.lit("ESCALATE")).otherwise(F.col("gold_routing_decision"))
    return seeded_top(gold, sample_size, seed, "example_id").select(
        "example_id",
        F.col("customer_text").alias("text"),
        intent.alias("pass1_intent"),
        relabelled.alias("pass2_intent"),
        F.col("gold_routing_decision").alias("pass1_routing"),
        route.alias("pass2_routing"),
    )


def disagreement_cases(audit: DataFrame) -> DataFrame:
    return audit.where((F.col("pass1_intent") != F.col("pass2_intent")) | (F.col("pass1_routing") != F.col("pass2_routing")))


def raw_agreement(audit: DataFrame) -> DataFrame:
    """Percentage of equal labels."""
    n = F.count(F.lit(1))
    return audit.agg(
        percent(count_if(F.col("pass1_intent") == F.col("pass2_intent")), n, 1).alias("intent_agreement_pct"),
        percent(count_if(F.col("pass1_routing") == F.col("pass2_routing")), n, 1).alias("routing_agreement_pct"),
    )


def cohens_kappa(
    rows: DataFrame,
    a: str | Column,
    b: str | Column,
    group: Sequence[str] = (),
    undefined: float | None = None,
    name: str = "kappa",
    digits: int = 4,
) -> DataFrame:
    """Cohen's kappa of two label columns, per ``group``.

    Everything comes from the confusion counts, which have one row per pair of labels.
    A single shared label leaves kappa undefined: null, or ``undefined`` if given.
    """
    first = F.col(a) if isinstance(a, str) else a
    second = F.col(b) if isinstance(b, str) else b
    keys = list(group)
    cells = rows.groupBy(*keys, first.cast("string").alias("_a"), second.cast("string").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sides = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_a").alias("_label"), F.col("_n").alias("_na"), F.lit(0).cast("bigint").alias("_nb"), F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(F.lit(0)).alias("_same")),
                F.struct(F.col("_b").alias("_label"), F.lit(0).cast("bigint").alias("_na"), F.col("_n").alias("_nb"), F.lit(0).cast("bigint").alias("_same")),
            )
        ),
    )
    labels = sides.groupBy(*keys, "_label").agg(
        F.sum("_na").cast("double").alias("_na"), F.sum("_nb").cast("double").alias("_nb"), F.sum("_same").cast("double").alias("_same")
    )
    totals = labels.groupBy(*keys).agg(
        F.sum("_na").alias("_n"), F.sum("_same").alias("_agree"), F.sum(F.col("_na") * F.col("_nb")).alias("_cross")
    )
    observed = F.col("_agree") / F.col("_n")
    expected = F.col("_cross") / (F.col("_n") * F.col("_n"))
    value = F.when(expected != 1.0, round_dp((observed - expected) / (F.lit(1.0) - expected), digits))
    return totals.select(*keys, (value if undefined is None else F.coalesce(value, F.lit(undefined))).alias(name))


def gold_audit_report(gold: DataFrame, audit: DataFrame) -> DataFrame:
    """Sizes, agreement, kappas and the number of disagreements in one row of scalars."""
    total = gold.agg(F.count(F.lit(1))).scalar()
    agreement = raw_agreement(audit)
    return audit.agg(F.count(F.lit(1)).alias("audit_sample_size")).select(
        "audit_sample_size",
        total.alias("golden_set_total_size"),
        percent(F.col("audit_sample_size"), total, 1).alias("audit_fraction_pct"),
        agreement.select("intent_agreement_pct").scalar().alias("intent_raw_agreement_pct"),
        cohens_kappa(audit, "pass1_intent", "pass2_intent").scalar().alias("intent_cohens_kappa"),
        agreement.select("routing_agreement_pct").scalar().alias("routing_raw_agreement_pct"),
        cohens_kappa(audit, "pass1_routing", "pass2_routing").scalar().alias("routing_cohens_kappa"),
        disagreement_cases(audit).agg(F.count(F.lit(1))).scalar().alias("disagreement_count"),
    )
