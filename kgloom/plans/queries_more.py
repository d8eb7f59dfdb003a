"""More registered queries: supporting operators of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import dates, text, urls
from kgloom.operators import assembly, content, graph, graph_store
from kgloom.plans import ontology
from kgloom.plans.queries import named_skills, query
from kgloom.sources import blocks


@query("SELECT d.graph_id, d.document_id, s.fetch_status FROM source_documents d LEFT JOIN (SELECT * FROM source_snapshots WHERE fetch_status = 'success') s USING (graph_id, source_key)")
def doc_snapshot_left(k):
    return k.source_documents.join(k.source_snapshots.where("fetch_status = 'success'"), ["graph_id", "source_key"], "left").select("graph_id", "document_id", "fetch_status")


@query("SELECT d.doc_id, (SELECT min(p.url) FROM pages p WHERE p.page_id % 200 = d.doc_id % 200 AND lower(replace(p.page_id::VARCHAR, '-', '')) = (d.doc_id % 200)::VARCHAR) AS title FROM docs d")
def page_titles(k):
    keyed = k.pages.select(urls.page_id(F.col("page_id").cast("string")).alias("key"), "url").groupBy("key").agg(F.min("url").alias("title"))
    return k.docs.select("doc_id", (F.col("doc_id") % 200).cast("string").alias("key")).join(keyed, "key", "left").select("doc_id", "title")


@query("SELECT graph_id, entity_id, evidence_id FROM entity_evidence UNION SELECT f.graph_id, f.entity_id, l.evidence_id FROM facts f JOIN fact_evidence l ON f.graph_id = l.graph_id AND f.fact_id = l.fact_id")
def evidence_by_entity(k):
    own = k.entity_evidence.select("graph_id", "entity_id", "evidence_id")
    return own.union(k.fact_evidence.join(k.facts.select("graph_id", "fact_id", "entity_id"), ["graph_id", "fact_id"]).select("graph_id", "entity_id", "evidence_id")).distinct()


@query("SELECT e.graph_id, e.entity_id FROM entities e WHERE class_type IN ('Work', 'Activity') AND EXISTS (SELECT 1 FROM relations r JOIN entities p ON p.graph_id = r.graph_id AND p.entity_id = r.subject_id AND p.class_type = 'Person' WHERE r.graph_id = e.graph_id AND r.object_id = e.entity_id AND r.predicate = 'participatedIn' AND e.status = 'active')")
def owned_entities(k):
    people = k.entities.where("class_type = 'Person'").select("graph_id", F.col("entity_id").alias("subject_id"))
    held = k.relations.where("predicate = 'participatedIn'").join(people, ["graph_id", "subject_id"], "left_semi").select("graph_id", F.col("object_id").alias("entity_id"))
    return k.entities.where("class_type IN ('Work', 'Activity') AND status = 'active'").join(held, ["graph_id", "entity_id"], "left_semi").select("graph_id", "entity_id")


@query("SELECT event_id, event_id % 3 = 0 AND NOT event_id % 5 = 0 AS is_generic FROM events")
def generic_participation(k):
    said = F.concat(F.lit("Participated in the "), F.col("event_id"), F.lit(" project"), F.when(F.col("event_id") % 5 == 0, " and built it").otherwise(""))
    return k.events.select("event_id", assembly.generic_participation(F.when(F.col("event_id") % 3 != 0, "lead"), said).alias("is_generic"))


@query("SELECT graph_id, subject_id AS entity_id, min(object_id) AS folded_into FROM relations r WHERE predicate = 'atOrganization' AND EXISTS (SELECT 1 FROM entities e WHERE e.graph_id = r.graph_id AND e.entity_id = r.object_id AND e.class_type = 'Organization') GROUP BY ALL")
def folded_children(k):
    parents = k.entities.where("class_type = 'Organization'").select("graph_id", F.col("entity_id").alias("object_id"))
    kept = k.relations.where("predicate = 'atOrganization'").join(parents, ["graph_id", "object_id"], "left_semi")
    return graph_store.latest(kept, ["graph_id", "subject_id"], ["object_id"]).select("graph_id", F.col("subject_id").alias("entity_id"), F.col("object_id").alias("folded_into"))


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY fact_id) AS n FROM facts WHERE predicate = 'title'), b AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY fact_id) AS n FROM facts WHERE predicate = 'start') SELECT a.graph_id, a.n::INT AS n, a.value_str AS title, b.value_str AS start FROM a JOIN b USING (graph_id, n)")
def ordinal_zip(k):
    n = F.row_number().over(Window.partitionBy("graph_id").orderBy("fact_id"))
    a = k.facts.where("predicate = 'title'").select("graph_id", n.alias("n"), F.col("value_str").alias("title"))
    return a.join(k.facts.where("predicate = 'start'").select("graph_id", n.alias("n"), F.col("value_str").alias("start")), ["graph_id", "n"])


@query("SELECT graph_id, predicate, string_agg(DISTINCT value_str, ',' ORDER BY value_str) AS held FROM facts WHERE predicate IN ('kind', 'role', 'category') GROUP BY ALL")
def value_sets(k):
    per = k.facts.where("predicate IN ('kind', 'role', 'category')").groupBy("graph_id", "predicate").agg(F.sort_array(F.collect_set("value_str")).alias("h"))
    return per.select("graph_id", "predicate", F.array_join("h", ",").alias("held"))


@query("SELECT e.graph_id, e.entity_id, EXISTS (SELECT 1 FROM entity_evidence l WHERE l.graph_id = e.graph_id AND l.entity_id = e.entity_id) AS by_entity, EXISTS (SELECT 1 FROM fact_evidence l JOIN facts f ON f.graph_id = l.graph_id AND f.fact_id = l.fact_id WHERE f.graph_id = e.graph_id AND f.entity_id = e.entity_id) AS by_fact FROM entities e WHERE class_type = 'Work'")
def link_flags(k):
    works = k.entities.where("class_type = 'Work'").select("graph_id", "entity_id")
    a = k.entity_evidence.select("graph_id", "entity_id").distinct().withColumn("a", F.lit(True))
    b = k.fact_evidence.join(k.facts, ["graph_id", "fact_id"]).select("graph_id", "entity_id").distinct().withColumn("b", F.lit(True))
    return works.join(a, ["graph_id", "entity_id"], "left").join(b, ["graph_id", "entity_id"], "left").select("graph_id", "entity_id", F.col("a").isNotNull().alias("by_entity"), F.col("b").isNotNull().alias("by_fact"))


@query("SELECT o_custkey AS case_id, avg(CASE WHEN o_orderkey % 4 <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score, coalesce(string_agg(CASE WHEN o_orderkey % 4 = 0 THEN 'f' || o_orderkey END, ',' ORDER BY 'f' || o_orderkey), '') AS mismatches FROM orders GROUP BY ALL")
def expected_field_score(k):
    rows = k.orders.select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("f"), "o_orderkey").alias("field"), F.col("o_orderkey").alias("value"))
    return assembly.score(rows.withColumn("value", F.when(F.col("value") % 4 != 0, F.col("value")).otherwise(-1)), rows)


@query("SELECT e.graph_id, e.entity_id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.graph_id = e.graph_id AND f.entity_id = e.entity_id AND predicate = 'kind')")
def key_difference(k):
    return k.entities.join(k.facts.where("predicate = 'kind'"), ["graph_id", "entity_id"], "left_anti").select("graph_id", "entity_id")


_T = "list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))"


@query(f"SELECT p_partkey, len(list_intersect({_T}, ['almond', 'red', 'blue', 'small'])) AS n_both, len(list_distinct({_T} || ['almond', 'red', 'blue', 'small'])) AS n_any, len(list_filter({_T}, lambda x: NOT list_contains(['almond', 'red', 'blue', 'small'], x))) AS n_only FROM part")
def token_algebra(k):
    t, other = text.token_set(F.lower("p_name")), F.array(*[F.lit(x) for x in ("almond", "red", "blue", "small")])
    return k.part.select("p_partkey", F.size(F.array_intersect(t, other)).cast("long").alias("n_both"), F.size(F.array_union(t, other)).cast("long").alias("n_any"), F.size(F.array_except(t, other)).cast("long").alias("n_only"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) - 1 AS dropped FROM events GROUP BY ALL")
def first_wins(k):
    w = Window.partitionBy("user_id", "event_type")
    ranked = k.events.withColumn("rn", F.row_number().over(w.orderBy("event_id"))).withColumn("dropped", F.count(F.lit(1)).over(w) - 1)
    return ranked.where("rn = 1").select("user_id", "event_type", "event_id", "dropped")


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM part")
def text_keys(k):
    return k.part.select("p_partkey", text.text_key(text.nfkc_fold(F.col("p_name"))).alias("key"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, p_type) THEN p_name WHEN contains(p_type, p_name) THEN p_type ELSE p_name || ' · ' || p_type END AS merged FROM part")
def description_merge(k):
    return k.part.select("p_partkey", text.merge_descriptions(F.col("p_name"), F.col("p_type")).alias("merged"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(p_type) THEN p_brand ELSE p_brand || ', ' || p_type END AS roles FROM part")
def role_merge(k):
    return k.part.select("p_partkey", text.merge_roles(F.concat_ws(";", "p_brand", "p_type", F.upper("p_brand"))).alias("roles"))


@query("SELECT graph_id, entity_id, CASE WHEN updated % 2 = 0 THEN value_str WHEN updated % 3 = 0 THEN NULL ELSE value_str END AS kept FROM facts WHERE predicate = 'kind' AND entity_id LIKE 'W:%'")
def evidenced_values(k):
    f = k.facts.where("predicate = 'kind' AND entity_id LIKE 'W:%'")
    asked = F.when(F.col("updated") % 2 == 0, F.col("value_str")).otherwise("unknown")
    held = F.when(F.col("updated") % 3 == 0, F.array("value_str", F.lit("another"))).otherwise(F.array("value_str"))
    return f.select("graph_id", "entity_id", text.required_value(asked, held).alias("kept"))


@query("SELECT o_custkey AS graph_id, NOT (bool_or(kind = 'publication') AND count(DISTINCT kind) > 1) AS compatible, count(DISTINCT lower(o_orderpriority)) <= 1 AS one_priority FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'publication' ELSE 'project' END AS kind FROM orders) GROUP BY ALL")
def at_most_one(k):
    kind = F.when(F.col("o_orderkey") % 7 == 0, "publication").otherwise("project")
    none = F.array().cast("array<struct<start:string,end:string>>")
    per = k.orders.groupBy(F.col("o_custkey").alias("graph_id")).agg(F.collect_list(kind).alias("kinds"), F.collect_list("o_orderpriority").alias("p"))
    return per.select("graph_id", assembly.works_compatible(F.col("kinds"), none).alias("compatible"), assembly.at_most_one(F.col("p")).alias("one_priority"))


@query("SELECT a.o_custkey AS graph_id, a.o_orderkey AS a, b.o_orderkey AS b, CAST(a.o_orderdate AS DATE) <= CAST(b.o_orderdate AS DATE) + 100 AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + 100 AS overlap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def period_pairs(k):
    day = F.col("o_orderdate").cast("date")
    p = k.orders.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("id"), F.struct(day.cast("string").alias("start"), F.date_add(day, 100).cast("string").alias("end")).alias("p"))
    a, b = p.select("graph_id", F.col("id").alias("a"), F.col("p").alias("pa")), p.select("graph_id", F.col("id").alias("b"), F.col("p").alias("pb"))
    return a.join(b, "graph_id").where("a < b").select("graph_id", "a", "b", dates.periods_overlap(F.array("pa", "pb")).alias("overlap"))


@query("SELECT page_id, 'b' || (page_id % 10 + 20) AS id FROM pages WHERE page_id % 3 = 0")
def missing_children(k):
    missing = F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("b"), F.col("page_id") % 10 + 20))).otherwise(F.array().cast("array<string>"))
    root = k.pages.select(F.col("page_id").alias("page"), F.lit("root").alias("id"), F.concat(F.array(F.lit("b1"), F.lit("b2")), missing).alias("children"))
    leaf = k.pages.select(F.col("page_id").alias("page"), F.explode(F.array(F.lit("b1"), F.lit("b2"))).alias("id"), F.array().cast("array<string>").alias("children"))
    return graph.missing_children(root.union(leaf)).withColumnRenamed("page", "page_id")


@query("SELECT DISTINCT l.graph_id, l.entity_id, e.document_id FROM entity_evidence l JOIN evidence e USING (graph_id, evidence_id)")
def work_documents(k):
    return k.entity_evidence.join(k.evidence, ["graph_id", "evidence_id"]).select("graph_id", "entity_id", "document_id").distinct()


@query("SELECT DISTINCT l.graph_id, l.entity_id, e.document_id FROM entity_evidence l JOIN evidence e USING (graph_id, evidence_id) JOIN source_documents d ON d.graph_id = e.graph_id AND d.document_id = e.document_id WHERE d.source_type <> 'notion' OR e.locator = 'line:0'")
def dedicated_pages(k):
    e = k.evidence.join(k.source_documents.select("graph_id", "document_id", "source_type"), ["graph_id", "document_id"]).where("source_type <> 'notion' OR locator = 'line:0'")
    return k.entity_evidence.join(e, ["graph_id", "evidence_id"]).select("graph_id", "entity_id", "document_id").distinct()


@query("SELECT graph_id, 'INVALID_PERSON_COUNT' AS code, 1::BIGINT AS n FROM (SELECT g.graph_id, count(e.entity_id) FILTER (e.class_type = 'Person' AND e.graph_id % 5 <> 0) AS p FROM graphs g LEFT JOIN entities e USING (graph_id) GROUP BY ALL) WHERE p <> 1 UNION ALL SELECT graph_id, 'INVALID_PROPERTY_VALUE', count(*) FROM facts WHERE (predicate = 'kind' AND value_str = 'thesis') OR (predicate = 'category' AND value_str = 'unlisted') GROUP BY ALL")
def seed_issues(k):
    people = k.entities.where("class_type = 'Person' AND graph_id % 5 <> 0").groupBy("graph_id").agg(F.count(F.lit(1)).alias("p"))
    a = k.graphs.join(people, "graph_id", "left").where("coalesce(p, 0) <> 1").select("graph_id", F.lit("INVALID_PERSON_COUNT").alias("code"), F.lit(1).cast("long").alias("n"))
    listed = ontology.values(k.spark).where("class_type IN ('Work', 'Skill')").select("predicate", F.col("allowed").alias("value_str")).union(k.spark.createDataFrame([("category", c) for c in ontology.CATEGORIES], "predicate string, value_str string"))
    b = k.facts.where("predicate IN ('kind', 'category')").join(F.broadcast(listed), ["predicate", "value_str"], "left_anti").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return a.union(b.select("graph_id", F.lit("INVALID_PROPERTY_VALUE"), "n"))


@query("""WITH s AS (SELECT graph_id, l_orderkey AS item, l_partkey * 1000 + l_suppkey AS ordinal, CASE WHEN l_partkey % 11 = 0 THEN 'W:none' ELSE concat('W:', l_orderkey - l_partkey % 3) END AS entity_id FROM owned),
 c AS (SELECT graph_id, entity_id, CASE WHEN max(value_str) FILTER (predicate = 'kind') = 'publication' THEN 'publications' ELSE 'projects' END AS section FROM facts WHERE entity_id LIKE 'W:%' GROUP BY ALL),
 j AS (SELECT s.*, section, row_number() OVER (PARTITION BY s.graph_id, s.entity_id ORDER BY item, ordinal) > 1 AS dup FROM s LEFT JOIN c USING (graph_id, entity_id)),
 l AS (SELECT *, first_value(CASE WHEN section IS NOT NULL AND NOT dup THEN section END IGNORE NULLS) OVER (PARTITION BY graph_id, item ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lead FROM j)
 SELECT graph_id, item, ordinal, entity_id, CASE WHEN section IS NULL THEN 'CV_UNKNOWN_ENTITY' WHEN dup THEN 'CV_DUPLICATE_ENTITY' WHEN section <> lead THEN 'CV_SECTION_MISMATCH' END AS warning FROM l""")
def selection_warnings(k):
    s = k.owned.select("graph_id", F.col("l_orderkey").alias("item"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"), F.when(F.col("l_partkey") % 11 == 0, "W:none").otherwise(F.concat(F.lit("W:"), F.col("l_orderkey") - F.col("l_partkey") % 3)).alias("entity_id"))
    kinds = content.pivot_facts(k.facts.where("entity_id LIKE 'W:%'"), ["kind"])
    c = kinds.select("graph_id", "entity_id", F.when(F.col("kind") == "publication", "publications").otherwise("projects").alias("section"))
    return content.selection_warnings(s, c).select("graph_id", "item", "ordinal", "entity_id", "warning")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'CREDENTIAL_TITLE_MISSING' WHEN o_orderkey % 7 = 0 THEN 'CREDENTIAL_DATE_MISSING' ELSE 'CREDENTIAL_KIND_UNSUPPORTED' END AS code FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0")
def award_certification_issues(k):
    o = F.col("o_orderkey")
    items = k.orders.select(o, F.when(o % 5 != 0, F.concat(F.lit("T"), o)).alias("title"), F.when(o % 7 != 0, "2024").alias("date"), F.when(o % 9 == 0, "thing").otherwise("award").alias("kind"))
    return content.credential_issues(items).select("o_orderkey", "code")


@query("SELECT graph_id, version + 1 AS version FROM graphs WHERE graph_id % 3 <> 0")
def version_check(k):
    expected = k.graphs.select("graph_id", F.when(F.col("graph_id") % 3 == 0, 7).otherwise(0).alias("version"))
    return k.graphs.join(expected, ["graph_id", "version"], "left_semi").select("graph_id", (F.col("version") + 1).alias("version"))


@query("SELECT g.graph_id, n.value_str AS name, r.value_str AS role, (SELECT count(*) FROM relations x WHERE x.graph_id = g.graph_id AND x.provenance = 'profile' AND x.subject_id = concat('P:', g.graph_id)) AS n_items FROM graphs g JOIN facts n ON n.graph_id = g.graph_id AND n.entity_id LIKE 'P:%' AND n.predicate = 'name' JOIN facts r ON r.graph_id = g.graph_id AND r.entity_id LIKE 'P:%' AND r.predicate = 'role'")
def profile_blocks(k):
    about = content.pivot_facts(k.facts.where("entity_id LIKE 'P:%' AND provenance = 'profile'"), ["name", "role"])
    items = k.relations.where("provenance = 'profile' AND subject_id LIKE 'P:%'").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_items"))
    return about.join(items, "graph_id", "left").select("graph_id", "name", "role", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN s WHEN o_orderkey % 3 = 0 THEN s || ' – 현재' ELSE s || ' – 2031.01' END AS shown FROM (SELECT o_orderkey, substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) || '.' || substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 6, 2) AS s FROM orders)")
def cv_entries(k):
    start = dates.iso_to_output(F.col("o_orderdate").cast("date").cast("string"))
    end = F.when(F.col("o_orderkey") % 4 == 0, start).when(F.col("o_orderkey") % 3 == 0, dates.PRESENT).otherwise("2031.01")
    return k.orders.select("o_orderkey", dates.format_range(start, end).alias("shown"))


@query("SELECT source_id, chunk, 'e' || n AS ref, 'e' || (n + CASE WHEN chunk = 1 THEN 3 ELSE 0 END) AS new_ref FROM (SELECT o_orderkey AS source_id, unnest([0, 0, 0, 1, 1]) AS chunk, unnest([1, 2, 3, 1, 2]) AS n FROM orders WHERE o_orderkey % 10 <> 2)")
def chunk_merge(k):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    rows = F.array(F.struct(F.lit(0).alias("chunk"), arr("e1", "e2", "e3").alias("refs")), F.struct(F.lit(1).alias("chunk"), F.when(F.col("o_orderkey") % 10 != 2, arr("e1", "e2")).alias("refs")))
    r = k.orders.select(F.col("o_orderkey").alias("source_id"), F.explode(rows).alias("x")).select("source_id", "x.*")
    return assembly.merge_chunk_results(r)


@query()
def timeline_dedupe(k):
    items = k.orders.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("X:"), F.col("o_orderkey") % 6).alias("entity_id"), F.when(F.col("o_orderkey") % 5 != 0, "Org").alias("org"), F.col("o_orderpriority").alias("role"), F.date_format("o_orderdate", "yyyy.MM").alias("start"), F.lit(None).cast("string").alias("end"))
    return assembly.timeline_dedupe(items)


@query()
def work_dedupe(k):
    items = k.orders.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("W:"), "o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("kind"), F.array(F.concat(F.lit("u"), F.col("o_orderkey") % 7)).alias("urls"))
    return assembly.work_dedupe(items).select("graph_id", "ordinal", "entity_id", "kind", F.array_join("urls", ",").alias("urls"))


@query()
def activity_absorption(k):
    return assembly.absorb_by_title(named_skills(k).select("graph_id", F.col("id").alias("entity_id"), "title", F.col("n").alias("ordinal"), (F.col("n") % 2 == 1).alias("is_work")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END END AS row FROM orders")
def table_rows(k):
    blank = F.col("o_orderkey") % 3 == 0
    cells = F.create_map(F.lit("a"), F.when(~blank, F.col("o_orderpriority")).otherwise(" "), F.lit("b"), F.when(~blank & (F.col("o_orderkey") % 2 != 0), F.col("o_orderstatus")).otherwise(""))
    return k.orders.select("o_orderkey", blocks.row_text(cells, F.array(F.lit("a"), F.lit("b"))).alias("row"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'bad_id' WHEN c_custkey % 5 = 0 THEN 'private' END AS issue FROM customer")
def typed_fields(k):
    payload = F.to_json(F.struct(F.when(F.col("c_custkey") % 4 == 0, -1).otherwise(F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("private")))
    return k.customer.select("c_custkey", blocks.typed_fields(payload)["issue"].alias("issue"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'folder' WHEN 2 THEN 'submodule' END AS kind FROM events")
def tree_kinds(k):
    mode = F.element_at(F.array(*[F.lit(x) for x in ("blob", "tree", "commit", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return k.events.select("event_id", blocks.tree_kind(mode).alias("kind"))


@query("SELECT repo, n FROM (SELECT graph_id AS repo, count(DISTINCT l_orderkey) AS n FROM owned GROUP BY graph_id) ORDER BY n DESC, repo LIMIT 5")
def file_supplement(k):
    return k.owned.groupBy(F.col("graph_id").alias("repo")).agg(F.countDistinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "repo").limit(5)


@query("SELECT graph_id, entity_id, 'url' AS predicate, 'https://github.com/o/' || graph_id AS value_str FROM (SELECT graph_id, min(entity_id) AS entity_id, count(*) AS n FROM entities WHERE class_type = 'Work' GROUP BY ALL) WHERE n = 1")
def url_fact_candidates(k):
    one = k.entities.where("class_type = 'Work'").groupBy("graph_id").agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    url = F.concat(F.lit("https://github.com/o/"), "graph_id")
    return one.where(urls.is_repository(url)).select("graph_id", "entity_id", F.lit("url").alias("predicate"), url.alias("value_str"))
