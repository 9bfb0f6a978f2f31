from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import rules
from deskgraph.functions import text as T
from deskgraph.functions.numeric import fixed, round_dp
from deskgraph.operators import threads


@pytest.mark.parametrize(
    "raw, clean",
    [
        (
            "@115873 @jane_doe my trip was charged twice! Please help @Uber_Support",
            "@customer @customer my trip was charged twice! Please help @uber_support",
        ),
        ("receipt https://trip.uber.com/r/1 and HTTP://t.co/help", "receipt [URL] and [URL]"),
        ("Driver was aggressive 😡 and speeding 🔥 please help 🙏", "Driver was aggressive 😡 and speeding 🔥 please help 🙏"),
        ("   Where   is    my\n\n\nrefund???   ", "Where is my refund???"),
        ("   \n\t  ", ""),
        ("a　b c", "a b c"),
        ("@helper @HELP @uber_x @Uber", "@customer @uber_support @customer @uber_support"),
        ("see www.example.com/a?b=@me now", "see [URL] now"),
        ("@@uber mail me@home.org", "@@uber_support mail me@customer.org"),
        (None, ""),
    ],
)
def test_message_normalisation(value, raw, clean):
    assert value(T.normalize_message(F.col("t")), t=raw) == clean


def test_corpus_normalisation_keeps_brand_case(value):
    text = "@AcmeCare @support @joe HTTPS://x.y https://x.y"
    assert value(T.normalize_corpus_text(F.col("t"), "AcmeCare"), t=text) == "@AcmeCare @AcmeCare @customer HTTPS://x.y [URL]"


def test_corpus_normalisation_by_brand_column(value):
    text = "@A$B @acme @support"
    clean = T.normalize_corpus_text(F.col("t"), F.col("b"))
    assert value(clean, t=text, b="acme") == "@customer$B @acme @acme"
    assert value(clean, t="@support", b=r"A$1\b") == r"@A$1\b"


def test_normalisation_is_idempotent(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(T.normalize_message(F.col("html")).alias("once"))
    assert rows.where(T.normalize_message(F.col("once")) != F.col("once")).count() == 0


def test_message_features(spark):
    rows = spark.createDataFrame([("   Where   is    my\n\n\nrefund???   ",), ("  \n ",), ("é a",)], "text string")
    got = threads.message_features(rows).select("char_length", "word_count", "is_ascii").collect()
    assert [tuple(r) for r in got] == [(21, 4, True), (0, 0, False), (3, 2, False)]


@pytest.mark.parametrize(
    "text, label",
    [
        ("I was charged a $5 cancellation fee", "Cancellation_Fee_Dispute"),
        ("I left my purse in the car", "Lost_Item_Inquiry"),
        ("want a REFUND now", "Fare_Dispute_Or_Refund"),
        ("so rude", "Driver_Behavior_Or_Safety"),
        ("no reply for days", "Support_Status_Or_Escalation_Request"),
        ("lost my phone\nin the car", "Other_Or_Unclear"),
        ("bonjour", "Other_Or_Unclear"),
        (None, "Other_Or_Unclear"),
    ],
)
def test_keyword_intents(value, text, label):
    assert value(rules.keyword_first_match(F.col("t")), t=text) == label


@pytest.mark.parametrize(
    "text, category",
    [
        ("I will sue you for this accident ok", "safety_legal_escalate"),
        ("there is an issue with my trip today", "standard"),
        ("Great job, what a horrible long delay again", "sarcasm_implicit_dissatisfaction"),
        ("@acme @acme hello !!", "low_info_vague"),
        ("one two three four", "low_info_vague"),
        ("one two three four five", "standard"),
    ],
)
def test_edge_categories(value, text, category):
    assert value(rules.edge_category(F.col("t")), t=text) == category


def test_safety_words_are_substrings_unless_asked(value):
    edge = F.lit("standard")
    assert value(rules.safety_trigger(F.col("t"), edge), t="one more issue") is True
    assert value(rules.safety_trigger(F.col("t"), edge, whole_word=True), t="one more issue") is False
    assert value(rules.safety_trigger(F.col("t"), F.lit(D.SAFETY_CATEGORY)), t="hi") is True


def test_keyword_escalation(spark):
    rows = spark.createDataFrame([("Police and LEGAL police",), ("police!",), (None,)], "t string")
    got = [tuple(r)[1:] for r in rules.keyword_escalation(rows, "t").collect()]
    assert got[0] == ("escalate", "Simple ML keyword trigger matched: legal, police")
    assert got[1][0] == got[2][0] == "auto_handle"


def test_rounding_follows_the_binary_value(spark):
    rows = spark.createDataFrame([(0.285,), (0.125,), (12.25,), (-0.00001,)], "x double")
    got = rows.select(round_dp(F.col("x"), 2).alias("r"), fixed(F.col("x"), 2).alias("f")).collect()
    assert [r["r"] for r in got] == [0.28, 0.12, 12.25, 0.0]
    assert [r["f"] for r in got][:3] == ["0.28", "0.12", "12.25"]
