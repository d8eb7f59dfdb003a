"""Generated items, entity identity, layout and page databases on micro fixtures."""

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text
from kgloom.operators import documents, identity, items, seeds
from kgloom.sources import databases

ENTITY = "graph_id bigint, id string, class_type string, ord int, stored boolean, forced_id string, facts array<struct<predicate:string,value:string>>, keys array<struct<key_type:string,key_value:string>>, orgs array<string>"


def resolve(spark, rows, **options):
    full = [(1, i, c, n, stored, forced, [tuple(f) for f in facts], [tuple(k) for k in keys], orgs) for n, (i, c, stored, forced, facts, keys, orgs) in enumerate(rows)]
    return {r.ref: (r.outcome, r.entity_id) for r in identity.resolve_entities(spark.createDataFrame(full, ENTITY), **options).collect()}


def test_works_meet_by_url_or_title(spark):
    url = lambda u: [("work_url", u)]
    got = resolve(spark, [
        ("S1", "Work", True, None, [("title", "Red Shop"), ("kind", "project")], url("https://a.example"), []),
        ("a", "Work", False, None, [("title", "red shop"), ("kind", "Project ")], [], []),
        ("b", "Work", False, None, [("title", "Something else")], url("https://a.example"), []),
        ("c", "Work", False, None, [("title", "Red Shop")], url("https://b.example"), []),
        ("d", "Work", False, None, [("title", "Red Shop"), ("kind", "publication")], [], []),
        ("e", "Work", False, None, [("title", "something  ELSE")], [], []),
    ])
    # b's title is known of S1 from then on, so e meets it; d meets c, whose kind is unknown
    assert got == {"a": ("matched", "S1"), "b": ("matched", "S1"), "c": ("new", "c"), "d": ("new", "c"), "e": ("matched", "S1")}


def test_affiliations_decide_by_stage(spark):
    rows = [
        ("x1", "Experience", False, None, [("role", "Engineer")], [], ["o1"]), ("x2", "Experience", False, None, [("role", "engineer")], [], ["o2"]), ("x3", "Experience", False, None, [("role", "Engineer")], [], []),
        ("x4", "Experience", False, None, [("role", "Engineer")], [], ["o1", "o3"]), ("a1", "Activity", False, None, [("name", "Hack night")], [], ["gone"]), ("a2", "Activity", False, "A9", [("name", "Hack night")], [], ["gone"]),
        ("o1", "Organization", False, None, [("name", "Acme Lab")], [], []), ("o2", "Organization", False, None, [("name", "acme lab")], [], []), ("o3", "Organization", False, None, [("name", "Other")], [], []),
        ("X0", "Experience", True, None, [("role", "Engineer"), ("start", "2020-01")], [], ["O0"]), ("O0", "Organization", True, None, [("name", "Acme Lab")], [], []),
        ("x5", "Experience", False, None, [("role", "Engineer"), ("start", "2021")], [], ["o1"]),
    ]
    got = resolve(spark, rows)
    assert got["o1"] == got["o2"] == ("matched", "O0") and got["o3"] == ("new", "o3")
    assert got["x1"] == got["x2"] == ("matched", "X0") and got["x3"] == ("new", "x3") and got["x4"] == ("ambiguous", None) and got["x5"] == ("new", "x5")
    assert got["a1"] == ("ambiguous", None) and got["a2"] == ("new", "A9")


def test_several_matches_are_ambiguous_unless_they_are_one(spark):
    stored = [("C1", "Credential", True, None, [("title", "Best paper"), ("date", "2020")], [], []), ("C2", "Credential", True, None, [("title", "best paper"), ("date", "2020-05")], [], [])]
    new = ("n", "Credential", False, None, [("title", "Best Paper"), ("date", "2020-05-01")], [], [])
    assert resolve(spark, [*stored, new])["n"] == ("matched", "C1")
    apart = [(*s[:4], [*s[4], ("issuerName", name)], *s[5:]) for s, name in zip(stored, ("X", "Y"), strict=True)]
    assert resolve(spark, [*apart, new])["n"] == ("ambiguous", None)
    assert resolve(spark, [stored[0], ("n", "Credential", False, None, [("title", "Best paper")], [], [])])["n"] == ("new", "n")


@pytest.mark.parametrize(("names", "tool", "keys"), [
    (["C++"], True, {"cplusplus"}), (["C#"], True, {"csharp"}), (["Vue 3.2"], True, {"vue32", "vue"}), (["ROS 2"], True, {"ros2"}), (["S3"], True, {"s3"}), (["Python3"], True, {"python3", "python"}),
    (["Vue 3"], False, {"vue3"}), (["Retrieval-Augmented Generation (RAG)"], False, {"retrievalaugmentedgenerationrag", "retrievalaugmentedgeneration", "rag"}), (["RAG (Retrieval Augmented Generation)"], False, {"ragretrievalaugmentedgeneration", "rag", "retrievalaugmentedgeneration"}), (["Go (lang)"], False, {"golang"}),
])
def test_skill_aliases(spark, names, tool, keys):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select(identity.skill_aliases(F.col("name"), F.lit(tool), frozenset({"ros2", "s3", "python"})).alias("keys")).collect()
    assert {k for r in got for k in r["keys"]} == keys


def test_skills_meet_by_alias(spark):
    rows = [
        ("S1", "Skill", True, None, [("name", "Retrieval-Augmented Generation (RAG)")], [], []), ("s2", "Skill", False, None, [("name", "rag"), ("kind", "method")], [], []), ("s3", "Skill", False, None, [("name", "Vue 3"), ("kind", "tool")], [], []),
        ("s4", "Skill", False, None, [("name", "VUE"), ("kind", "Tool")], [], []), ("s5", "Skill", False, None, [("name", "vue"), ("kind", "method")], [], []), ("s6", "Skill", False, None, [("name", "+"), ("kind", None)], [], []), ("s7", "Skill", False, None, [], [], []),
    ]
    got = resolve(spark, rows)
    assert got == {"s2": ("matched", "S1"), "s3": ("new", "s3"), "s4": ("new", "s3"), "s5": ("new", "s5"), "s6": ("new", "s6"), "s7": ("new", "s7")}


def test_organisation_names(spark):
    rows = [("이화여대", "이화여자대학교", True), ("Acme Lab", "Acme Laboratory Team A", True), ("Acme Lab", "Other Lab", False), ("ACME", "Acme Research", True), ("abc", "abcd", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", identity.organizations_compatible(F.col("a"), F.col("b")).alias("got")).collect())


def test_item_starts(spark):
    line = "n int, heading_level int, table string, is_list boolean, blank_before boolean, keep_with_next boolean, gap_before double, want boolean"
    rows = [(0, 1, None, False, False, False, None, True), (1, 2, None, False, False, False, 99.0, False), (2, None, None, False, True, False, 99.0, False), (3, None, None, False, True, False, None, True), (4, None, None, True, True, False, None, False),
            (5, None, "t", False, False, False, None, True), (6, None, "t", False, False, False, None, False), (7, None, None, False, False, True, None, True), (8, None, None, False, True, False, 99.0, False), (9, None, None, False, False, False, 11.9, False), (10, None, None, False, False, False, 12.0, True), (11, 3, None, False, False, False, None, True)]
    got = documents.item_starts(spark.createDataFrame([(1, *r) for r in rows], "doc int, " + line), ["doc"], "n").collect()
    assert [r.starts for r in sorted(got, key=lambda r: r.n)] == [r[-1] for r in rows]


def test_payloads_and_lists(spark):
    df = spark.createDataFrame([(["a"], "x", None), (["a", "b\"c"], "", "2024")], "v array<string>, s string, d string")
    out = df.select(items.scalar_or_list(F.col("v")).alias("l"), items.payload({"v": F.col("v"), "s": F.col("s"), "start": F.col("d")}, ("start",)).alias("p"), items.url_list(F.array(F.lit(" http://a.b "), F.col("s"))).alias("u")).collect()
    assert [r.l for r in out] == ['"a"', '["a","b\\"c"]'] and [r.p for r in out] == ['{"v":["a"],"s":"x","start":null}', '{"v":["a","b\\"c"],"start":"2024"}'] and [r.u for r in out] == [None, None]
    index = databases.block_index(spark.createDataFrame([("p", "A-1", 1, "text"), ("p", "a1", 2, "page"), ("q", "", 1, "page")], "page string, id string, ord int, kind string"))
    roots = spark.createDataFrame([("p", "a1"), ("q", "a1")], "page string, id string")
    assert {r.page: r.issue for r in databases.root_issue(index, roots).collect()} == {"p": None, "q": "invalid_response"}


def test_representative_and_first_distinct(spark):
    works = spark.createDataFrame([(1, 0, "t", "", "long title"), (1, 1, "t", "r", "x"), (1, 2, "t", "r", "y"), (2, 0, "", "", "a")], "g int, ordinal int, description string, role string, title string")
    assert {r.g: r.ordinal for r in items.representative(works, ["g"]).collect()} == {1: 1, 2: 0}
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (1, "c", 3)], "g int, v string, o int")
    assert [(r.v, r.position) for r in items.first_distinct(rows, ["g"], "v", "o", 2).orderBy("position").collect()] == [("b", 1), ("a", 2)]


def test_one_source_is_applied_as_a_whole(spark):
    fact = "source_id int, ref string, ord int, class_type string, predicate string, value_str string, confidence double, claim string"
    rows = [(1, "w", 0, "Work", "title", "Shop", 0.9, "c0"), (1, "w", 1, "Work", "kind", "Project", 0.8, "c1"), (1, "w", 2, "Work", "title", "Unseen", 0.9, "c2"), (1, "s", 3, "Skill", "kind", "tool", 0.9, "c3"),
            (1, "o", 4, "Organization", "name", "A", 0.5, "c4"), (1, "o", 5, "Organization", "name", "B", 0.5, "c5"), (1, "w", 6, "Work", "salary", "9", 0.5, "c6")]
    relation = "source_id int, ord int, subject_ref string, predicate string, object_ref string, confidence double, claim string"
    edges = [(1, 0, "w", "usesSkill", "s", 0.9, "r0"), (1, 1, "w", "atOrganization", "o", 0.9, "r1"), (1, 2, "w", "atOrganization", "o", 0.95, "r1"), (1, 3, "o", "atOrganization", "w", 0.9, "r2")]
    claims = [(1, f"c{i}", "bad" if i == 2 else "ok") for i in range(7)] + [(1, f"r{i}", "ok") for i in range(3)]
    out = seeds.apply_sources(
        spark.createDataFrame(rows, fact), spark.createDataFrame(edges, relation), spark.createDataFrame(claims, "source_id int, claim string, locator string"),
        spark.createDataFrame([(1, "ok", "text"), (1, "bad", "absent")], "source_id int, locator string, snippet string"), spark.createDataFrame([(1, "some text")], "source_id int, content string"))
    assert {(r.ref, r.predicate, r.value) for r in out["facts"].collect()} == {("w", "title", "Shop"), ("w", "kind", "project")}
    # the skill has no name, so the edge to it goes as well
    assert {(r.subject_ref, r.predicate, r.object_ref, r.confidence) for r in out["relations"].collect()} == {("w", "atOrganization", "o", 0.95)}
    assert sorted(r.code for r in out["issues"].collect()) == ["CONFLICTING_VALUES", "INVALID_PROPERTY", "INVALID_RELATION_DIRECTION", "MISSING_IDENTITY", "UNSUPPORTED_EVIDENCE"]


def test_stored_titles_meet_only_where_a_candidate_asks(spark):
    """Titles of classes without a candidate in the graph make no pairs."""
    row = lambda g, i, c, stored, p, v: (g, i, c, 0, stored, None, [(p, v)], [], [])
    rows = [row(1, "O1", "Organization", True, "name", "Acme Lab"), row(1, "O2", "Organization", True, "name", "acme lab"), row(1, "W1", "Work", True, "title", "Red Shop"), row(1, "w", "Work", False, "title", "red shop"), row(2, "W2", "Work", True, "title", "Red Shop")]
    entities = spark.createDataFrame(rows, ENTITY)
    pairs = identity._alike_titles(identity.comparable(entities), entities).collect()
    assert {(r.graph_id, r.class_type) for r in pairs} == {(1, "Work")}
    assert {(r.a, r.b) for r in pairs} == {(x, y) for x in ("Red Shop", "red shop") for y in ("Red Shop", "red shop")}


def test_held_values_are_comparable(spark):
    """What a row says of itself is what frames of all rows say of it."""
    facts = [("name", "Vue 3.2"), ("kind", " Tool"), ("start", "2020-05-01"), ("end", "2021"), ("title", "Red Shop"), ("role", "Lead  Dev"), ("date", None), ("name", None), ("name", "Retrieval Augmented Generation (RAG)")]
    rows = [(1, f"{c}{n}", c, 0, True, None, facts[n:], [], []) for c in (*identity.RULES, "Person") for n in range(len(facts))] + [(1, "none", "Skill", 0, True, None, None, None, None)]
    entities = spark.createDataFrame(rows, ENTITY)
    want = {r.id: {tuple(h) for h in r.held} for r in identity.comparable(entities).collect()}
    got = {r.id: {tuple(h) for h in r.held or ()} for r in entities.select("id", identity.held_values(F.col("class_type"), F.col("facts")).alias("held")).collect()}
    assert {i: h for i, h in got.items() if h} == want


def test_resolution_is_one_pass(spark):
    """Pairs of titles are neither stored nor joined, and entities meet by what they share, not all with all."""
    rows = [(1, f"O{i}", "Organization", i, i % 2 == 0, None, [("name", f"Supplier {i}")], [], []) for i in range(4000)]
    rows += [(1, "n", "Organization", 5000, False, None, [("name", "supplier  7")], [], [])]
    out = identity.resolve_entities(spark.createDataFrame(rows, ENTITY))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.ref: (r.outcome, r.entity_id) for r in out.collect()}
    assert len(got) == 2001 and got["n"] == ("new", "O7") and got["O7"] == ("new", "O7")
