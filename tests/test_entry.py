"""The driver contract, with and without the training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_registered_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_import_without_the_optional_part(tmp_path):
    for p in ("__spark_entry__.py",):
        (tmp_path / p).write_text((ROOT / p).read_text())
    (tmp_path / "kgloom").mkdir()
    for p in (ROOT / "kgloom").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "kgloom" / p.name)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'active_facts' in q and not any(x.startswith('op') and x[2].isdigit() for x in q)"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONSAFEPATH": "1"})
    assert run.returncode == 0, run.stderr


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_oracles_agree_on_a_few(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("active_facts", "stale_fact_keys", "issues_by_code", "snapshot_state", "section_paths"):
        df = e.queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
        want = sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()))
        assert got == want, name
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_queries_without_sql_run_over_all_graphs(spark):
    import __spark_entry__ as e
    from kgloom.plans.adapter import Frames

    sf = "/root/testdata/sf0.01"
    q = e.queries()
    orders = spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").collect()
    customers = {r.o_custkey for r in orders}
    assert {r.graph_id for r in q["timeline_dedupe"](spark, sf).select("graph_id").collect()} == customers and max(customers) >= 200

    works: dict = {}  # brute force: the first earlier work of a kind with a common URL takes a work in
    for r in orders:
        kept = works.setdefault(r.o_custkey, [])
        have = next((w for w in kept if w[1] == r.o_orderstatus and w[2] == r.o_orderkey % 7), None)
        if have is None:
            kept.append((r.o_orderkey, r.o_orderstatus, r.o_orderkey % 7))
    got = {(r.graph_id, r.ordinal, r.kind, r.urls) for r in q["work_dedupe"](spark, sf).collect()}
    assert got == {(g, n, kind, f"u{url}") for g, kept in works.items() for n, kind, url in kept}

    named = Frames(spark, SF).facts.where("predicate = 'name' AND entity_id LIKE 'S:%'").collect()
    even = {r.graph_id for r in named if r.updated % 2 == 0}
    assert {r.graph_id for r in q["entity_components"](spark, SF).select("graph_id").collect()} == {r.graph_id for r in named}
    for name in ("sequential_resolution", "activity_absorption"):
        assert {r.graph_id for r in q[name](spark, SF).select("graph_id").collect()} == even
    assert max(even) >= 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_frames_meet_without_a_shuffle(spark):
    import __spark_entry__ as e

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("active_facts", "active_scoped", "date_ranks", "latest_fact", "proof_join"):
            plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_loops_stay_in_buckets(spark):
    """What reachable() and canonical_trees() write is read back in buckets of graph_id, so its groups and joins need no shuffle."""
    from kgloom.operators import graph
    from kgloom.plans.adapter import Frames

    k = Frames(spark, SF)
    seen = graph.reachable(k.entities, k.relations, store=k.by_graph)
    met = seen.distinct().join(k.facts, ["graph_id", "entity_id"])
    assert "hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in seen.collect()} == {tuple(r) for r in graph.reachable(k.entities, k.relations).collect()}


def test_careers_stay_in_buckets(spark):
    """Facts and relations of all careers are grouped and joined by graph without a shuffle, though they are unions."""
    from kgloom.plans.adapter import Frames
    from kgloom.plans.queries_deep import _career

    entities, facts, relations, _ = _career(Frames(spark, SF))
    named = facts.groupBy("graph_id", "entity_id").count().join(relations.withColumnRenamed("object_id", "entity_id"), ["graph_id", "entity_id"]).join(entities, ["graph_id", "entity_id"])
    assert "hashpartitioning" not in named._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_titles_and_pools_stay_in_buckets(spark):
    """Title pairs are stored and met in buckets of graph_id, and stored keys are read from there."""
    import __spark_entry__ as e

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("activity_absorption", "resolution_pool"):
            plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
