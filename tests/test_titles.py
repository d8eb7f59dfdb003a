"""Titles told alike inside a fold, against pairs found by frames; results of one-pass folds against those with pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions import titles
from kgloom.operators import assembly, resolution

SF = "/root/testdata/sf0.001"
TITLES = [
    "Red Shop", "red  shop", "Ｒed Shop", "Red Shops", "Red Shop 2", "Red Shop 3", "red-shop", "shop", "Blue Shop", "!!", "", None, "쇼핑몰 앱", "쇼핑몰 앱 2", "a b c d", "a b c d e", "b c", "cold plate", "old plate", "redshop", "Straße 7", "STRASSE 7", "straße 8",
]


def _rows(seed: int, n: int = 60):
    dice = random.Random(seed)
    return [(g, f"i{dice.random():.6f}", dice.choice(TITLES), i) for i in range(n) for g in (1, 2)]


def test_met_is_similar_title_pairs(spark):
    rows = _rows(1)
    items = spark.createDataFrame(rows, "graph_id bigint, id string, title string, n int")
    pairs = [r for r in resolution.similar_title_pairs(items, ["graph_id"], "id", "title").collect()]
    for graph in (1, 2):
        heads, near = titles.met((r[1], r[2]) for r in rows if r[0] == graph)
        assert {(r.a, r.b) for r in pairs if r.graph_id == graph and r.equal} == {(h, i) for i, h in heads.items() if h != i}
        assert {(r.a, r.b) for r in pairs if r.graph_id == graph and not r.equal} == {(a, b) for a, others in near.items() for b in others if a < b}


def test_one_pass_is_what_pairs_give(spark):
    items = spark.createDataFrame(_rows(2), "graph_id bigint, id string, title string, n int")
    pairs = resolution.similar_title_pairs(items, ["graph_id"], "id", "title")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    new, old = items.where("n % 2 = 0"), items.where("n % 2 = 1")
    is_new = F.col("n") % 2 == 0
    want = resolution.sequential_resolve(new.select("graph_id", F.col("n").alias("ord"), F.col("id").alias("ref")), old.select("graph_id", F.col("id").alias("entity_id")), pairs)
    got = resolution.resolve_titles(items.select("graph_id", F.when(is_new, F.col("n")).otherwise(-1).alias("ord"), "id", is_new.alias("is_new"), "title"))
    assert rows(got) == rows(want) and {"new", "matched", "ambiguous"} == {r.outcome for r in got.collect()}
    chunked = items.withColumn("chunk", F.col("n") % 7)
    assert rows(resolution.title_components(chunked.select("graph_id", "id", "chunk", "title"))) == rows(resolution.constrained_components(chunked, pairs))
    named = items.select("graph_id", F.col("id").alias("entity_id"), "title", F.col("n").alias("ordinal"))
    want = assembly.absorb_activities(named.where("ordinal % 2 = 0"), named.where("ordinal % 2 = 1"), pairs).select("graph_id", "entity_id", "absorbed_by")
    assert rows(assembly.absorb_by_title(named.withColumn("is_work", F.col("ordinal") % 2 == 1))) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_folds_of_titles_are_one_pass(spark):
    """From the stored frame to the result without a shuffle and without stored pairs."""
    import __spark_entry__ as e

    for name in ("sequential_resolution", "entity_components", "activity_absorption"):
        plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Scan parquet") == 1 and "Join" not in plan, name
