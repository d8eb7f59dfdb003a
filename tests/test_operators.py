"""Folds, documents, sources and streams on micro fixtures."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kgloom.operators import assembly, content, documents, graph, graph_store, incremental, resolution
from kgloom.plans.staging import stage
from kgloom.sources import blocks, repositories


def test_section_paths_push_and_pop(spark):
    rows = [(1, i, level, t) for i, (level, t) in enumerate([(None, "a"), (1, "A"), (None, "b"), (2, "B"), (None, "c"), (2, "C"), (None, "d"), (1, "D"), (3, "E")])]
    df = documents.section_path(spark.createDataFrame(rows, "d int, o int, level int, t string"), ["d"], "o", "level", "t")
    assert [r.section_path for r in df.orderBy("o").collect()] == ["", "A", "A", "A > B", "A > B", "A > C", "A > C", "D", "D > E"]


def test_chunks_split_and_overlap(spark):
    df = spark.createDataFrame([("s", i, i // 8 if i < 40 else 99) for i in range(120)], "source string, o int, section int")
    out = documents.chunks(df, "source", "o", "section", 30)
    sizes = {r.chunk: r.n for r in out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[0] == 24 and max(sizes.values()) <= 30 and sum(sizes.values()) == 120
    rows = documents.overlap(out, "source", "o", 5).groupBy("chunk").agg(F.min("o").alias("o")).orderBy("chunk").collect()
    assert [r.o for r in rows][:2] == [0, 19]


def test_margins_modes_and_lines(spark):
    lines = spark.createDataFrame([("d", p, k) for p in range(4) for k in ("head", f"body{p}")], "doc_id string, page int, key string")
    assert [r.key for r in documents.repeated_margins(lines).collect()] == ["head"]
    sizes = spark.createDataFrame([(1, 10.0, 5), (1, 12.0, 9), (1, 10.0, 6)], "g int, size double, n int")
    assert documents.weighted_mode(sizes, ["g"], "size", F.col("n")).first().size == 10.0
    row = lambda n, t, x, top, head=False, links=(): (1, n, t, 10.0, x, top, top + 10.0, head, list(links))
    wrap = spark.createDataFrame(
        [row(0, "one", 0.0, 0.0, links=["u"]), row(1, "two", 4.0, 12.0, links=["v", "u"]), row(2, "still one", 4.0, 24.0), row(3, "left", 3.0, 36.0), row(4, "- far in", 9.0, 48.0), row(5, "low", 20.0, 67.0), row(6, "H", 30.0, 79.0, True), row(7, "under", 40.0, 91.0)],
        "page int, ord int, text string, size double, x0 double, top double, bottom double, is_heading boolean, links array<string>",
    )
    got = documents.merge_wrapped(wrap, ["page"], "ord").orderBy("ord").collect()
    assert [r.text for r in got] == ["one two still one", "left", "- far in", "low", "H", "under"] and got[0].links == ["u", "v"] and got[0].bottom == 34.0
    words = spark.createDataFrame([(1, 1, "u", 2.0, 4.0, 11.0, 13.0)], "doc_id int, page int, link string, x0 double, x1 double, top double, bottom double")
    spans = spark.createDataFrame([(1, 1, 0, 0.0, 9.0, 0.0, 5.0), (1, 1, 1, 0.0, 9.0, 10.0, 14.0), (1, 1, 2, 5.0, 9.0, 11.0, 13.0)], "doc_id int, page int, ord int, x0 double, x1 double, top double, bottom double")
    assert documents.nearest_line(words, spans).first().ord == 1
    assert [r.o for r in spark.createDataFrame([("",), ("ordinary text with words in it",), ("?!?!?!?!?!?!?!?!?!?!?!?!a",)], "t string").select(documents.quality_gate(F.col("t")).alias("o")).collect()] == ["no_text", None, "unreadable"]


def test_sequential_resolution_truth_table(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "x")], "graph_id bigint, ord int, ref string")
    s = spark.createDataFrame([(1, "S1"), (1, "S2"), (1, "S3")], "graph_id bigint, entity_id string")
    same = spark.createDataFrame([(1, "a", "S1"), (1, "b", "S1"), (1, "b", "S2"), (1, "S1", "S2"), (1, "c", "S2"), (1, "c", "S3")], "graph_id bigint, a string, b string").withColumn("equal", F.lit(False))
    got = {(r.graph_id, r.ref): (r.outcome, r.entity_id) for r in resolution.sequential_resolve(c, s, same).collect()}
    assert got == {(1, "a"): ("matched", "S1"), (1, "b"): ("matched", "S1"), (1, "c"): ("ambiguous", None), (1, "d"): ("new", "d"), (2, "x"): ("new", "x")}


def test_equal_titles_are_alike(spark):
    rows = [(1, "a", "Red Shop"), (1, "b", "red  shop"), (1, "c", "RED SHOP"), (1, "d", "Red Shop 2"), (1, "e", "Blue"), (2, "f", "red shop"), (1, "g", "!!")]
    items = spark.createDataFrame(rows, "graph_id bigint, id string, title string")
    pairs = resolution.similar_title_pairs(items, ["graph_id"], "id", "title")
    got = {(r.graph_id, r.a, r.b, r.equal) for r in pairs.collect()}
    assert {(1, "a", "c", True)} <= got and not any(x[0] == 2 for x in got) and (1, "a", "d", False) in got and not any("e" in x or "g" in x for x in got)
    out = resolution.sequential_resolve(items.where("id IN ('b', 'c', 'd')").select("graph_id", F.col("id").alias("ord"), F.col("id").alias("ref")).withColumn("ord", F.ascii("ord")), items.where("id = 'a'").select("graph_id", F.col("id").alias("entity_id")), pairs)
    assert {r.ref: r.entity_id for r in out.collect()} == {"b": "a", "c": "a", "d": "a"}
    acts, works = (items.where(f"id IN ({ids})").select("graph_id", F.col("id").alias("entity_id"), F.ascii("id").alias("ordinal")) for ids in ("'c', 'e'", "'b', 'd', 'f'"))
    assert {r.entity_id: r.absorbed_by for r in assembly.absorb_activities(acts, works, pairs).collect()} == {"c": "b", "e": None}


def test_link_groups_are_greedy(spark):
    members = spark.createDataFrame([(1, "n1", True, "s1"), (1, "n2", True, "s2"), (1, "n3", True, "s1"), (1, "E1", False, None), (1, "E2", False, None)], "graph_id bigint, id string, is_new boolean, source_id string")
    groups = spark.createDataFrame([(1, 0, 0.5, ["n1", "n2"]), (1, 1, 0.9, ["n1", "E1", "E2"]), (1, 2, 0.9, ["n1", "n3"]), (1, 3, 0.9, ["n1", "E1", "n1"]), (1, 4, 0.9, ["n1", "n2"]), (1, 5, 0.95, ["n2", "n3"])], "graph_id bigint, group_ord int, confidence double, ids array<string>")
    got = {r.id: r.target for r in resolution.accept_links(groups, members, 0.8).collect()}
    assert got == {"n1": "E1", "n2": "n2", "n3": "n2"}


def test_constrained_components(spark):
    items = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 0), (1, "d", 2)], "graph_id bigint, id string, chunk int")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d")], "graph_id bigint, a string, b string")
    assert {r.id: r.component for r in resolution.constrained_components(items, pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_reachability_follows_direction_and_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, "P", "Person"), (1, "W", "Work"), (1, "S", "Skill"), (1, "O", "Organization"), (1, "E", "Education"), (1, "X", "Work")], "graph_id bigint, entity_id string, class_type string")
    r = spark.createDataFrame([(1, "P", "W"), (1, "W", "S"), (1, "S", "W"), (1, "W", "O"), (1, "X", "O"), (1, "O", "P")], "graph_id bigint, subject_id string, object_id string")
    assert {x.entity_id for x in graph.reachable(e, r).collect()} == {"P", "W", "S", "O"}
    assert {x.entity_id for x in graph.reachable(e, r, ("Education",)).collect()} == {"P"}
    small = {x.entity_id for x in graph.reachable(e, r.where("subject_id <> 'W'")).collect()}
    assert small <= {"P", "W", "S", "O"}


def test_block_walk_is_depth_first(spark):
    rows = [("p", "root", "page", ["a", "b", "sub"]), ("p", "a", "toggle", ["c"]), ("p", "b", "text", []), ("p", "c", "text", ["a"]), ("p", "sub", "page", ["d"]), ("p", "d", "text", [])]
    b = spark.createDataFrame(rows, "page string, id string, kind string, children array<string>")
    out = graph.walk(b, spark.createDataFrame([("p", "root")], "page string, id string"))
    assert [r.id for r in out.orderBy("path").collect()] == ["root", "a", "c", "b", "sub"]


def test_decisions_truth_table(spark):
    key = "graph_id bigint, entity_id string, predicate string, value string"
    existing = spark.createDataFrame([(1, "a", "t", "old", "active", True), (1, "b", "t", "old", "active", False), (1, "c", "t", "v", "candidate", False), (1, "d", "t", "old", "active", True), (1, "d", "t", "v", "candidate", False)], key + ", status string, blocks boolean")
    offered = spark.createDataFrame([(1, x, "t", "v", False) for x in "abcde"] + [(1, "f", "t", "v", True), (1, "a", "m", "v", False)], key + ", forced boolean")
    stale = spark.createDataFrame([(1, "d", "t")], "graph_id bigint, entity_id string, predicate string")
    got = {(r.entity_id, r.predicate): r.decision for r in graph_store.decide(offered, existing, stale, ["m"], ["graph_id", "entity_id", "predicate"], "value").collect()}
    assert got == {("a", "t"): "candidate", ("b", "t"): "active", ("c", "t"): "promote", ("d", "t"): "reuse", ("e", "t"): "active", ("f", "t"): "candidate", ("a", "m"): "active"}


def test_timeline_and_work_folds(spark):
    items = [(1, 0, "x", "O", "r", "2020.01", None), (1, 1, "y", "O", "r", "2020.05", "2021.01"), (1, 2, "z", None, "r", "2020.01", None), (1, 3, "x", None, None, None, "2019.01")]
    out = assembly.timeline_dedupe(spark.createDataFrame(items, "graph_id bigint, ordinal int, entity_id string, org string, role string, start string, end string")).orderBy("ordinal").collect()
    assert [(r.entity_id, r.start, r.end) for r in out] == [("y", "2020.01", "2021.01"), ("z", "2020.01", None), ("x", None, "2019.01")]
    works = spark.createDataFrame([(1, 0, "a", "k", ["u"]), (1, 1, "b", "k", ["v", "u"]), (1, 2, "c", "j", ["u"])], "graph_id bigint, ordinal int, entity_id string, kind string, urls array<string>")
    assert [(r.entity_id, r.urls) for r in assembly.work_dedupe(works).orderBy("ordinal").collect()] == [("a", ["u", "v"]), ("c", ["u"])]


def test_platforms_roll_up_under_their_own_category(spark):
    names = {"a": "AWS Lambda", "b": "AWS S3", "c": "Azure Functions", "d": "PostgreSQL"}
    entities = spark.createDataFrame([(1, i, "Skill") for i in names], "graph_id bigint, entity_id string, class_type string")
    facts = [(1, i, "name", n) for i, n in names.items()] + [(1, i, "kind", "tool") for i in names] + [(1, "a", "category", "backend"), (1, "b", "category", "storage_cdn"), (1, "c", "category", "backend"), (1, "d", "category", "database")]
    got = content.skills_block(entities, spark.createDataFrame(facts, "graph_id bigint, entity_id string, predicate string, value_str string")).collect()
    assert {(r.category, r.name, r.position) for r in got} == {("cloud_deployment", "AWS", 1), ("backend", "Azure Functions", 1), ("database", "PostgreSQL", 1)}


def test_deep_trees_are_an_error(spark):
    chain = spark.createDataFrame([("p", str(i), "text", [str(i + 1)]) for i in range(6)] + [("p", "6", "text", [])], "page string, id string, kind string, children array<string>")
    roots = spark.createDataFrame([("p", "0")], "page string, id string")
    assert graph.walk(chain, roots, max_depth=8).count() == 7
    with pytest.raises(RuntimeError):
        graph.walk(chain, roots, max_depth=4)


def test_content_helpers(spark):
    df = spark.createDataFrame([("aws lambda",), ("Amazon S3",), ("AWS",), ("Python",)], "n string").select(content.platform(F.col("n")).alias("p")).collect()
    assert [r.p and (r.p.platform, r.p.service) for r in df] == [("AWS", "lambda"), ("AWS", "s3"), ("AWS", ""), None]
    g = spark.createDataFrame([(1, "projects", "A b", 0, ["x", "y"]), (1, "projects", "a-B", 1, ["y", "z", "w"])], "graph_id bigint, section string, title string, ordinal int, bullets array<string>")
    r = content.merge_bullets(g).first()
    assert (r.title, r.bullets) == ("A b", ["x", "y", "z"])
    m = spark.createDataFrame([(1, "e", 0, "2020", None), (1, "e", 1, "2020", "2021"), (1, "e", 2, None, "2019")], "graph_id bigint, entity_id string, ordinal int, start string, end string")
    assert sorted((r.start or "", r.end or "") for r in content.merge_periods(m).collect()) == [("", "2019"), ("2020", "2021")]


def test_incremental_idempotence(spark):
    a = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "g bigint, k string, v string")
    assert {r.change for r in incremental.diff(a, a, ["g", "k"], "v").collect()} == {"same"}
    assert incremental.insert_missing(a, a, ["g", "k"]).count() == 2


def test_stream_equals_batch_in_any_order(spark):
    from kgloom.streaming.snapshots import replay

    r = random.Random(1)
    rows = [(r.randint(1, 4), r.choice("ab"), i, 1_700_000_000 + i * 7, r.choice([None, "h1", "h2"])) for i in range(60)]
    r.shuffle(rows)
    df = stage(spark.createDataFrame(rows, "graph_id bigint, source_key string, event_id bigint, s bigint, content_hash string").withColumn("fetched", F.timestamp_seconds("s")).drop("s"), "fetches")
    key = lambda x: (x.graph_id, x.source_key, x.event_id, x.content_hash, x.fetch_status)
    assert sorted(map(key, replay(df).collect()), key=str) == sorted(map(key, incremental.snapshot_state(df).collect()), key=str)


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "n", "topics": ["t"]}, {"id": -1, "name": "n"}, {"id": 2, "name": " "}, {"id": 3, "name": "n", "private": True}, {"id": 4, "name": "n", "topics": [" "]}]))
    p = blocks.payloads(spark, str(tmp_path))
    got = p.orderBy("ord").select(blocks.typed_fields(F.col("payload")).alias("f")).collect()
    assert [r.f.issue for r in got] == [None, "bad_id", "bad_name", "private", "bad_topics"]
    blobs = spark.createDataFrame([("aGk=",), ("!!",), ("/w==",), ("AAE=",)], "b string").select(repositories.decode_blob(F.col("b")).alias("d")).collect()
    assert [(r.d.text, r.d.issue) for r in blobs] == [("hi", None), (None, "not_base64"), (None, "not_utf8"), (None, "control_bytes")]
    html = spark.createDataFrame([('<img src="a/badge.png"><img alt="" src="b.png">',), ("<p>",)], "h string").select(repositories.first_image(F.col("h")).alias("o")).collect()
    assert [r.o for r in html] == ["b.png", None]


def test_docx_reader(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(1001):
            z.writestr(str(i), "")
    for name, data in (("a.docx", buf.getvalue()), ("b.docx", b"no zip"), ("c.docx", big.getvalue())):
        (tmp_path / name).write_bytes(data)
    got = blocks.docx_lines(blocks.attachments(spark, str(tmp_path))).orderBy("path", "ord").collect()
    assert [(r.path[-6], r.kind, r.text, r.issue) for r in got] == [("a", "heading", "Title", None), ("a", "paragraph", "one two", None), ("a", "row", "a | ", None), ("b", None, None, "unreadable"), ("c", None, None, "too_large")]


@pytest.mark.parametrize("name", ["rich", "line"])
def test_block_text(spark, name):
    df = spark.createDataFrame([([("a", None), ("b", "u")], "header")], "f array<struct<text:string,url:string>>, k string")
    text = blocks.rich_text(F.col("f"))
    assert df.select((text if name == "rich" else blocks.line_of(F.col("k"), text)).alias("o")).first().o == ("ab (u)" if name == "rich" else "# ab (u)")


def test_folds_take_many_keys_in_a_batch(spark):
    """One Python call a batch: no group of pandas a key."""
    from kgloom.operators import assembly
    from kgloom.operators.folds import fold_by

    df = spark.range(3000).selectExpr("id % 1000 AS g", "id AS n")
    out = fold_by(df, "g", ["n"], lambda rows: [(rows[0]["g"], [r["n"] for r in rows])], "g bigint, ns array<bigint>")
    assert {r.g: r.ns for r in out.collect()} == {g: [g, g + 1000, g + 2000] for g in range(1000)}
    items = spark.createDataFrame([(1, 1, "a", None, None, None, None)], "graph_id bigint, ordinal int, entity_id string, org string, role string, start string, end string")
    assert "FlatMapGroupsInPandas" not in assembly.timeline_dedupe(items)._jdf.queryExecution().toString()


def test_documents_are_folded_a_batch_a_call(spark):
    from kgloom.operators import documents

    lines = spark.createDataFrame([(1, n, 0 if n < 20 else 1) for n in range(70)], "doc bigint, line bigint, section int")
    out = documents.chunks(lines, "doc", "line", "section", 30)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert [r.chunk for r in out.orderBy("line").collect()] == [0] * 20 + [1] * 30 + [2] * 20
