"""Beneficiaries that entity names contain."""

import random

import pytest
from pyspark.sql import functions as F

from txnwatch.operators import refine
from txnwatch.operators.refine import key_grams, name_grams, verified_names


def brute(keys, names):
    return {(k.lower(), kind) for k in keys if k for name, kind, active in names if active and name and k.lower() in name.lower()}


@pytest.mark.parametrize("block", [256, 2])
def test_same_as_comparing_all(spark, monkeypatch, block):
    monkeypatch.setattr(refine, "NAMES_PER_BLOCK", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 14)))
    names = [(rng.choice([word(), word() + word() + word(), "AB" * 20 + word(), "", None]), rng.choice("UFC"), rng.random() < 0.9) for _ in range(300)]
    keys = [None, "", "a" * 70, "ab" * 19] + [word().upper() for _ in range(300)]
    keys += [n[rng.randrange(len(n)) :][: rng.randint(1, 40)] for n, _, _ in names if n]
    entities = spark.createDataFrame(names, "entity_name string, entity_type string, is_active boolean")
    got = [(r._key, r.entity_type) for r in verified_names(spark.createDataFrame([(k,) for k in keys], "beneficiary_name string"), entities).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(keys, names)


def test_rows_follow_names_and_grams(spark):
    """A name of n characters gives at most n rows per gram size, whatever the lengths of the beneficiaries."""
    names = spark.range(50).select(F.lit("U").alias("entity_type"), F.concat(F.lit("the entity with number "), "id").alias("_name"))
    assert name_grams(names).count() <= names.select(F.sum(F.length("_name"))).first()[0] * len(refine.GRAM_SIZES)
    keys = spark.createDataFrame([("x" * n,) for n in range(1, 200)], "_key string")
    most = key_grams(keys).groupBy("_key").count().agg(F.max("count")).first()[0]
    assert most <= 7
    # Short keys take one or two grams.
    assert key_grams(spark.createDataFrame([("abcdefghij",)], "_key string")).count() == 2


def test_frequent_names(spark):
    """Names that all share their grams: keys that all contain are found in one block, others by all blocks."""
    names = spark.range(3000).select(F.concat(F.lit("Entity number "), "id", F.lit(" of the trust")).alias("entity_name"), F.lit("U").alias("entity_type"), F.lit(True).alias("is_active"))
    keys = ["entity number", "number 29", "number 2999 of", "y number 1", "trustee", "the trust entity", "e", "zz"]
    got = {r._key for r in verified_names(spark.createDataFrame([(k,) for k in keys], "beneficiary_name string"), names).collect()}
    assert got == {"entity number", "number 29", "number 2999 of", "y number 1", "e"}
