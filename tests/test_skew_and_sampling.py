from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from deskgraph.operators import corpus, profile, sampling, skew
from deskgraph.plans import tables


def hot_rows(spark, n=3000):
    """A third of the rows share one key, some have none."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 500).cast("long").alias("k"),
    )


def test_spread_join_equals_plain_join(spark):
    rows = hot_rows(spark)
    unique = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain = sorted(map(tuple, rows.join(unique, "k", how).select("id", "k", "v").collect()))
        salted = skew.join_to_unique(rows, unique, "k", ["id"], how, hot_rows=0)
        assert sorted(map(tuple, salted.select("id", "k", "v").collect())) == plain


def test_hot_keys_are_found_and_bounded(spark):
    rows = hot_rows(spark)
    expected = spark.sql("SELECT xxhash64(7L) AS h").first()["h"]
    assert [r["_h"] for r in skew.hot_keys(rows, "k", share=0.1, hot_rows=0).collect()] == [expected]
    assert skew.hot_keys(rows, "k").count() == 0
    assert skew.hot_keys(rows.where("id < 0"), "k", hot_rows=0).count() == 0


def test_spread_rows_of_a_hot_key_leave_one_partition(spark):
    rows = hot_rows(spark).where("k = 7")
    unique = spark.range(0, 400).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_to_unique(rows, unique, "k", ["id"], hot_rows=0)
        used = joined.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used > 1


def test_top_n_in_slices_is_exact(spark):
    rows = hot_rows(spark).where("k is not null")
    expected = {}
    for r in rows.collect():
        expected.setdefault(r["k"], []).append(r["id"])
    expected = {(k, i) for k, ids in expected.items() for i in sorted(ids)[:5]}
    got = skew.top_n_per_group(rows, ["k"], [F.col("id")], 5, spread_by=["id"], salts=4)
    assert {(r["k"], r["id"]) for r in got.collect()} == expected


def test_dedup_with_a_hot_text_keeps_the_earliest(spark):
    rows = spark.range(2000).select(
        (2000 - F.col("id")).alias("customer_tweet_id"),
        F.col("id").alias("brand_tweet_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise((F.col("id") % 50).cast("string")).alias("customer_text_clean"),
    )
    got = {r["customer_text_clean"]: r["customer_tweet_id"] for r in corpus.dedup_keep_earliest(rows).collect()}
    expected = {}
    for r in rows.collect():
        expected[r["customer_text_clean"]] = min(expected.get(r["customer_text_clean"], 1 << 60), r["customer_tweet_id"])
    assert got == expected
    report = corpus.dedup_report(rows).first()
    assert (report["before"], report["after"]) == (2000, len(expected))
    assert profile.duplicate_text_rate(rows, "customer_text_clean").first()["distinct_texts"] == len(expected)


def md5(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_samples_follow_the_seeded_order(spark):
    rows = spark.range(500).withColumnRenamed("id", "i")
    first = sorted(range(500), key=lambda i: md5(3, i))
    assert {r["i"] for r in sampling.seeded_sample(rows, 20, 3, "i").collect()} == set(first[:20])
    for n in (0, 1, 137, 500, 900):
        assert {r["i"] for r in sampling.take_seeded(rows, n, 3, "i").collect()} == set(first[:n])


def test_split_is_exact_disjoint_and_stable(spark):
    for n in (0, 1, 4, 1003):
        rows = spark.range(n).withColumnRenamed("id", "i")
        split = sampling.holdout_split(rows, "i")
        pools = {}
        for r in split.collect():
            pools.setdefault(r["split"], set()).add(r["i"])
        kept = pools.get("retrieval_pool", set())
        assert len(kept) == int(0.8 * n)
        assert kept == set(sorted(range(n), key=lambda i: md5(42, i))[: int(0.8 * n)])
        assert {r["i"] for r in sampling.holdout_split(rows.repartition(7), "i").where("split = 'retrieval_pool'").collect()} == kept


def test_text_leakage_is_removed_even_for_a_hot_text(spark):
    rows = spark.range(300).select(
        F.col("id").alias("customer_tweet_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("customer_text_clean"),
        F.when(F.col("id") < 200, F.lit("retrieval_pool")).otherwise(F.lit("held_out_eval_pool")).alias("split"),
    )
    got = {r["customer_tweet_id"] for r in corpus.split_leakage_text(rows).collect()}
    assert got == {i for i in range(300) if i < 200 or i % 3}


def test_quota_sample(spark):
    rows = spark.range(90).select("id", F.when(F.col("id") < 60, F.lit("a")).when(F.col("id") < 85, F.lit("b")).otherwise(F.lit("c")).alias("g"))
    got = sampling.quota_sample(rows, "g", {"a": 10, "c": 10}, 1, "id").groupBy("g").count().collect()
    assert {(r["g"], r["count"]) for r in got} == {("a", 10), ("c", 5)}


def test_every_one_of_many_hot_keys_is_split(spark):
    rows = spark.range(60_000).select("id", (F.col("id") % 240).alias("k"))  # 240 keys of 250 rows, 0.42 % each
    assert skew.hot_keys(rows, "k", hot_rows=100).count() == 240
    unique = spark.range(240).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        joined = skew.join_to_unique(rows, unique, "k", ["id"], hot_rows=100)
        placed = joined.select("k", F.spark_partition_id().alias("p")).groupBy("k").agg(F.countDistinct("p").alias("n"), F.count("*").alias("rows"))
        got = placed.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 240 and all(r["rows"] == 250 for r in got)
    assert sum(r["n"] > 1 for r in got) > 230  # three salts each; a few may share a partition by chance


def test_rows_that_cannot_match_stay_out_of_a_join(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"), F.lit("wide").alias("text"))
    wanted = spark.range(0, 40_000, 7).select(F.col("id").cast("int").alias("w"))  # another type, and ids that no row has
    few = skew.may_match(rows, "k", wanted)
    assert few.columns == rows.columns
    got, want = {r["k"] for r in few.collect()}, {r["k"] for r in rows.where("k % 7 = 0").collect()}
    assert want <= got and len(got) < 1.05 * len(want)
    crowded = {r["k"] for r in skew.may_match(rows, "k", wanted, bits=64).collect()}  # every bit is set
    assert crowded >= {r["k"] for r in rows.where("k IS NOT NULL").collect()}
    assert skew.may_match(rows, "k", wanted.where("w < 0")).count() == 0


def test_cases_shuffle_no_document_that_no_vector_picks(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    vectors = spark.range(60).select((F.col("id") % 30).alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))  # every id twice
    docs.union(docs.where("doc_id = 4")).write.parquet(f"{tmp_path}/documents.parquet")  # one document twice
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r)[:3] for r in tables.cases(spark, str(tmp_path)).collect())
    pairs = [(i, f"text {i}", f"@customer text {i + 1}") for i in range(30)]
    assert got == sorted(p for p in pairs for _ in range(2) for _ in range(2 if p[0] in (3, 4) else 1))
    narrowed = skew.may_match(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", vectors.select("vec_id"))
    assert narrowed.count() < 60
