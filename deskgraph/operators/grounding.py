"""Check amounts and phone numbers of a reply against its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions.text import java_regex
from deskgraph.functions.rules import first_match

VERDICT_TYPE = "struct<grounding_pass:boolean,grounding_score:double,unsupported_claims:array<string>,justification:string>"


def _found(text: Column, pattern: str, ignore_case: bool) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_regex(pattern, ignore_case)), F.lit(0))


def _first_missing(reply: Column, evidence: Column, pattern: str, ignore_case: bool) -> Column:
    """First claim of the reply that the evidence lacks.

    Each pattern runs once over a text: a lambda's argument holds what it found, where a column would be worked out at every
    mention.  The evidence is searched only if the reply claims anything.
    """
    form = F.lower if ignore_case else (lambda c: c)

    def among(claims: Column) -> Column:
        known = F.transform(_found(evidence, pattern, ignore_case), form) if ignore_case else _found(evidence, pattern, ignore_case)
        missing = F.transform(F.array(known), lambda k: F.try_element_at(F.filter(claims, lambda c: ~F.array_contains(k, form(c))), F.lit(1)))
        return F.when(F.size(claims) > 0, F.element_at(missing, 1))

    return F.element_at(F.transform(F.array(_found(reply, pattern, ignore_case)), among), 1)


def currency_claims(reply: Column, evidence: Column) -> Column:
    """First amount in the reply that the evidence lacks, whatever its case; null if none."""
    return _first_missing(reply, evidence, D.CURRENCY_PATTERN, True)


def phone_claims(reply: Column, evidence: Column) -> Column:
    """First phone number in the reply that the evidence lacks; null if none."""
    return _first_missing(reply, evidence, D.PHONE_PATTERN, False)


def parse_verdict(answer: Column) -> Column:
    """An outside auditor's JSON text as struct; null if there is none or it is malformed.

    Malformed is what is no JSON object, or has a score that is null or no number.  A missing score is none.
    """
    given = F.try_parse_json(answer)
    raw, score = F.try_variant_get(given, "$.grounding_score", "variant"), F.try_variant_get(given, "$.grounding_score", "double")
    usable = F.schema_of_variant(given).startswith("OBJECT") & (raw.isNull() | score.isNotNull())
    verdict = F.struct(
        F.try_variant_get(given, "$.grounding_pass", "boolean").alias("grounding_pass"),
        score.alias("grounding_score"),
        F.try_variant_get(given, "$.unsupported_claims", "array<string>").alias("unsupported_claims"),
        F.try_variant_get(given, "$.justification", "string").alias("justification"),
    )
    return F.when(usable, verdict)


def grounding_verdict(
    rows: DataFrame,
    reply: str = "generated_reply",
    evidence: str = "evidence_text",
    verdict: Column | None = None,
    threshold: float = D.MIN_GROUNDING_SCORE,
) -> DataFrame:
    """Add ``grounding_pass, grounding_score, unsupported_claims, justification``.

    An unsupported amount fails first, then an unsupported phone number, then the outside
    ``verdict`` struct decides.  A null verdict means the auditor was not available: pass.
    """
    given = F.lit(None).cast(VERDICT_TYPE) if verdict is None else verdict
    checked = (
        rows.withColumn("_amount", currency_claims(F.col(reply), F.col(evidence)))
        .withColumn("_phone", phone_claims(F.col(reply), F.col(evidence)))
        .withColumn("_given", given)
    )
    amount, phone, outside = F.col("_amount"), F.col("_phone"), F.col("_given")
    score = F.coalesce(outside["grounding_score"], F.lit(1.0))
    passed = F.coalesce(outside["grounding_pass"], F.lit(True)) & (score >= F.lit(threshold))
    none = F.array().cast("array<string>")

    def pick(on_amount: Column, on_phone: Column, on_verdict: Column, on_nothing: Column) -> Column:
        return first_match(
            [(amount.isNotNull(), on_amount), (phone.isNotNull(), on_phone), (outside.isNotNull(), on_verdict)],
            on_nothing,
        )

    return checked.select(
        *rows.columns,
        pick(F.lit(False), F.lit(False), passed, F.lit(True)).alias("grounding_pass"),
        pick(F.lit(D.CURRENCY_SCORE), F.lit(D.PHONE_SCORE), score, F.lit(D.UNAVAILABLE_SCORE)).alias("grounding_score"),
        pick(
            F.array(F.format_string(D.CURRENCY_CLAIM, amount)),
            F.array(F.format_string(D.PHONE_CLAIM, phone)),
            F.coalesce(outside["unsupported_claims"], none),
            none,
        ).alias("unsupported_claims"),
        pick(
            F.lit(D.CURRENCY_JUSTIFICATION),
            F.lit(D.PHONE_JUSTIFICATION),
            F.coalesce(outside["justification"], F.lit(D.AUDITED_JUSTIFICATION)),
            F.lit(D.UNAVAILABLE_JUSTIFICATION),
        ).alias("justification"),
    )
