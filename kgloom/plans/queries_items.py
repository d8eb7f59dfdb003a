"""Registered queries of generated items, entity identity and small supporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import text
from kgloom.operators import documents, identity, items, validation
from kgloom.plans import ontology
from kgloom.plans.queries import query

# Facts and items of one entity an order, as a table that both engines make alike
_YEAR, _END = "CAST(1995 + o_orderkey % 33 AS STRING)", "CAST(2000 + o_orderkey % 30 AS STRING)"
_WIDE = f"""SELECT o_custkey AS graph_id, o_orderkey AS ordinal, concat('X:', o_orderkey) AS entity_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'Education' WHEN 1 THEN 'Experience' ELSE 'Activity' END AS block,
  concat({_YEAR}, '-03') AS f_start, CASE WHEN o_orderkey % 4 <> 0 THEN concat({_END}, '-06') END AS f_end, CASE WHEN o_orderkey % 8 = 0 THEN 'true' END AS f_current,
  CASE o_orderkey % 7 WHEN 0 THEN 'fulltime' ELSE 'club' END AS f_kind, CASE WHEN o_orderkey % 5 <> 0 THEN 'lead, build' END AS f_role, CASE WHEN o_orderkey % 11 <> 0 THEN concat('N', o_orderkey % 9) END AS f_name,
  CASE WHEN o_orderkey % 6 <> 0 THEN concat('Org ', o_custkey % 10) END AS f_org,
  CASE o_orderkey % 10 WHEN 0 THEN 'Nobody' WHEN 1 THEN NULL WHEN 2 THEN concat('N', o_orderkey % 9) ELSE concat('Org ', o_custkey % 10) END AS organization,
  CASE o_orderkey % 9 WHEN 0 THEN 'build' WHEN 1 THEN 'cook' WHEN 2 THEN NULL ELSE 'lead, build' END AS role, CASE o_orderkey % 13 WHEN 0 THEN 'intern' WHEN 1 THEN NULL ELSE 'club' END AS kind,
  CASE o_orderkey % 17 WHEN 0 THEN '1901.01' WHEN 1 THEN NULL ELSE concat({_YEAR}, '.03') END AS start_date,
  CASE o_orderkey % 8 WHEN 0 THEN 'Present' WHEN 1 THEN NULL WHEN 2 THEN '1902.02' WHEN 4 THEN 'Present' ELSE concat({_END}, '.06') END AS end_date FROM orders"""


def _wide(k):
    return k.sql(_WIDE)


def _held(w):
    facts = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(f"f_{c}").alias("value_str")) for p, c in (("start", "start"), ("end", "end"), ("isCurrent", "current"), ("kind", "kind"), ("role", "role"), ("name", "name"))])
    own = w.select("graph_id", "entity_id", F.explode(facts).alias("x")).select("graph_id", "entity_id", "x.*").where("value_str IS NOT NULL")
    org = F.concat(F.lit("O:"), "entity_id")
    named = w.where("f_org IS NOT NULL").select("graph_id", org.alias("entity_id"), F.lit("name").alias("predicate"), F.col("f_org").alias("value_str"))
    relations = w.where("f_org IS NOT NULL").select("graph_id", F.col("entity_id").alias("subject_id"), F.lit("atOrganization").alias("predicate"), org.alias("object_id"))
    return items.held_values(own.union(named), relations)


_ITEM = ("graph_id", "ordinal", "block", "entity_id", "organization", "role", "kind", "start_date", "end_date")
_ACCEPTED = "CASE WHEN block = 'Activity' THEN coalesce(f_org, f_name) ELSE f_org END"
_DOTTED = "concat(substr({0}, 1, 4), '.', substr({0}, 6, 2))"
_RANK = "try_cast(substr({0}, 1, 4) AS INT) * 100 + try_cast(substr({0}, 6, 2) AS INT)"
_CODES = {
    "ORGANIZATION_NOT_FOUND": f"{_ACCEPTED} IS NULL AND NOT (block = 'Experience' AND organization IS NULL)",
    "ORGANIZATION_MISMATCH": f"{_ACCEPTED} IS NOT NULL AND organization IS DISTINCT FROM {_ACCEPTED} AND NOT (block = 'Experience' AND organization IS NULL)",
    "START_DATE_UNSUPPORTED": f"start_date <> {_DOTTED.format('f_start')}",
    "PRESENT_WITHOUT_CURRENT": "end_date = 'Present' AND f_current IS NULL",
    "END_DATE_UNSUPPORTED": f"end_date <> 'Present' AND end_date IS DISTINCT FROM {_DOTTED.format('f_end')}",
    "DATE_RANGE_INVALID": f"start_date IS NOT NULL AND end_date <> 'Present' AND {_RANK.format('start_date')} > {_RANK.format('end_date')}",
    "KIND_UNSUPPORTED": "block <> 'Education' AND kind IS NOT NULL AND kind <> f_kind",
    "ROLE_UNSUPPORTED": "block = 'Activity' AND role IS NOT NULL AND (f_role IS NULL OR role = 'cook')",
}
_PATHS = ("organization", "organization", "startDate", "endDate", "endDate", "", "kind", "role")


@query(f"WITH w AS ({_WIDE}) " + " UNION ALL ".join(f"SELECT graph_id, ordinal, '{p}' AS path, upper(block) || '_{c}' AS code FROM w WHERE {bad}" for p, (c, bad) in zip(_PATHS, _CODES.items(), strict=True)))
def timeline_issues(k):
    w = _wide(k)
    return items.timeline_issues(w.select(*_ITEM), _held(w))


@query(f"""WITH w AS ({_WIDE}) SELECT graph_id, ordinal, block, entity_id, {_ACCEPTED} AS organization, CASE WHEN role = f_role THEN role END AS role, CASE WHEN kind = f_kind THEN kind END AS kind,
 {_DOTTED.format('f_start')} AS start_date, CASE WHEN end_date = 'Present' THEN CASE WHEN f_current = 'true' THEN end_date END WHEN f_end IS NOT NULL THEN {_DOTTED.format('f_end')} END AS end_date FROM w WHERE {_ACCEPTED} IS NOT NULL OR block = 'Experience'""")
def normalised_items(k):
    w = _wide(k)
    return items.normalise_timeline(w.select(*_ITEM), _held(w))


_WORKS = """SELECT o_custkey AS graph_id, o_orderkey AS ordinal, concat('W:', o_orderkey) AS entity_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Other' ELSE concat('Order ', o_orderkey) END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'publication' ELSE 'project' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'lead' END AS role FROM orders"""
_WORK_HELD = "SELECT graph_id, entity_id, max(value_str) FILTER (predicate = 'title') AS ft, max(value_str) FILTER (predicate = 'kind') AS fk FROM facts GROUP BY ALL"


def _works(k):
    first = k.relations.where("predicate = 'usesSkill'").join(k.facts.where("predicate = 'name'").select("graph_id", F.col("entity_id").alias("object_id"), "value_str"), ["graph_id", "object_id"])
    first = first.groupBy("graph_id", F.col("subject_id").alias("entity_id")).agg(F.min("value_str").alias("skill"))
    w = k.sql(_WORKS).join(first, ["graph_id", "entity_id"], "left")
    o = F.col("ordinal")
    skills = F.when(F.col("skill").isNull(), F.array().cast("array<string>")).when(o % 6 == 0, F.array("skill", F.lit("juggling"))).otherwise(F.array("skill"))
    links = F.when(o % 8 == 0, F.array(F.lit("https://elsewhere.example"))).otherwise(F.array().cast("array<string>"))
    return w.withColumns({"skills": skills, "links": links}).drop("skill"), items.held_values(k.facts, k.relations)


@query(f"""WITH w AS ({_WORKS}), h AS ({_WORK_HELD}), s AS (SELECT DISTINCT r.graph_id, r.subject_id AS entity_id FROM relations r JOIN facts f ON f.graph_id = r.graph_id AND f.entity_id = r.object_id AND f.predicate = 'name' WHERE r.predicate = 'usesSkill'), j AS (SELECT w.*, ft, fk, s.entity_id IS NOT NULL AS skilled FROM w JOIN h USING (graph_id, entity_id) LEFT JOIN s USING (graph_id, entity_id))
 SELECT graph_id, ordinal, 'title' AS path, 'WORK_TITLE_UNSUPPORTED' AS code FROM j WHERE title <> ft UNION ALL SELECT graph_id, ordinal, 'kind', 'WORK_KIND_UNSUPPORTED' FROM j WHERE kind <> fk UNION ALL SELECT graph_id, ordinal, 'role', 'WORK_ROLE_UNSUPPORTED' FROM j WHERE role IS NOT NULL
 UNION ALL SELECT graph_id, ordinal, 'skills', 'WORK_SKILL_UNSUPPORTED' FROM j WHERE skilled AND ordinal % 6 = 0 UNION ALL SELECT graph_id, ordinal, 'links', 'WORK_LINK_UNSUPPORTED' FROM j WHERE ordinal % 8 = 0""")
def work_item_issues(k):
    return items.work_issues(*_works(k))


@query(f"""WITH w AS ({_WORKS}), h AS ({_WORK_HELD}), s AS (SELECT r.graph_id, r.subject_id AS entity_id, min(f.value_str) AS skill FROM relations r JOIN facts f ON f.graph_id = r.graph_id AND f.entity_id = r.object_id AND f.predicate = 'name' WHERE r.predicate = 'usesSkill' GROUP BY ALL)
 SELECT graph_id, ordinal, ft AS title, fk AS kind, role IS NULL OR true AS checked, coalesce(skill, '') AS skills, '' AS links FROM w JOIN h USING (graph_id, entity_id) LEFT JOIN s USING (graph_id, entity_id) WHERE fk IN ('project', 'publication', 'opensource')""")
def normalised_works(k):
    out = items.normalise_works(*_works(k))
    return out.select("graph_id", "ordinal", "title", "kind", F.col("role").isNull().alias("checked"), F.array_join("skills", ",").alias("skills"), F.array_join("links", ",").alias("links"))


@query("""SELECT o_custkey AS graph_id, o_orderkey AS position, CASE WHEN o_orderkey % 9 = 0 THEN 'About' ELSE 'Works' END AS type FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0
 UNION ALL SELECT o_custkey, min(o_orderkey), 'About' FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, -1, 'About' FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 9 = 0) = 0""")
def normalised_output(k):
    o = F.col("o_orderkey")
    blocks = k.orders.select(F.col("o_custkey").alias("graph_id"), o.alias("position"), F.when(o % 9 == 0, "About").otherwise("Works").alias("type"), (o % 4).alias("n_items"), F.lit("").alias("description"))
    return items.normalise_blocks(blocks).select("graph_id", "position", "type")


@query("SELECT o_custkey, o_orderkey AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 3 <> 0) DESC, (o_orderkey % 4 <> 0) DESC, length(o_orderpriority) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def representative_works(k):
    o = F.col("o_orderkey")
    w = k.orders.select("o_custkey", o.alias("ordinal"), F.when(o % 3 != 0, "text").alias("description"), F.when(o % 4 != 0, "lead").otherwise("").alias("role"), F.col("o_orderpriority").alias("title"))
    return items.representative(w, ["o_custkey"]).select("o_custkey", "ordinal")


@query("SELECT graph_id, entity_id, value_str, position FROM (SELECT graph_id, subject_id AS entity_id, value_str, row_number() OVER (PARTITION BY graph_id, subject_id ORDER BY min(relation_id), value_str)::INT AS position FROM (SELECT r.*, f.value_str FROM relations r JOIN facts f ON f.graph_id = r.graph_id AND f.entity_id = r.object_id AND f.predicate = 'name' WHERE r.predicate = 'usesSkill') GROUP BY graph_id, subject_id, value_str) WHERE position <= 5")
def first_skills(k):
    names = k.facts.where("predicate = 'name'").select("graph_id", F.col("entity_id").alias("object_id"), "value_str")
    used = k.relations.where("predicate = 'usesSkill'").join(names, ["graph_id", "object_id"]).withColumnRenamed("subject_id", "entity_id")
    return items.first_distinct(used, ["graph_id", "entity_id"], "value_str", "relation_id", 5).select("graph_id", "entity_id", "value_str", "position")


@query("""SELECT graph_id, entity_id, '{' || CASE WHEN n = 1 THEN '"names":"' || v || '"' ELSE '"names":["' || replace(v, '|', '","') || '"]' END || ',"startDate":null}' AS body FROM (SELECT graph_id, entity_id, count(DISTINCT value_str) AS n, string_agg(DISTINCT value_str, '|' ORDER BY value_str) AS v FROM facts WHERE predicate IN ('kind', 'title', 'category') GROUP BY ALL)""")
def link_payloads(k):
    values = k.facts.where("predicate IN ('kind', 'title', 'category')").groupBy("graph_id", "entity_id").agg(F.sort_array(F.collect_set("value_str")).alias("v"))
    start = F.lit(None).cast("string")
    whole = items.payload({"names": F.col("v"), "note": F.lit(""), "startDate": start}, required=("startDate",))
    one = items.payload({"names": F.get("v", F.lit(0)), "note": F.lit(""), "startDate": start}, required=("startDate",))
    return values.select("graph_id", "entity_id", F.when(F.size("v") == 1, one).otherwise(whole).alias("body"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'https://a.example/' || o_orderkey || ' http://b.example' END AS links FROM orders")
def url_lists(k):
    o = F.col("o_orderkey")
    first = F.when(o % 3 == 0, "ftp://a.example").otherwise(F.concat(F.lit(" https://a.example/"), o))
    second = F.when(o % 5 == 0, "https://").otherwise("http://b.example ")
    return k.orders.select("o_orderkey", F.array_join(items.url_list(F.array(first, second)), " ").alias("links"))


@query("SELECT graph_id, bool_and(asked AND held) AS equal FROM (SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, a.entity_id IS NOT NULL AS asked, b.entity_id IS NOT NULL AS held FROM (SELECT graph_id, entity_id FROM entities WHERE entity_id NOT LIKE '%77') a FULL JOIN (SELECT graph_id, entity_id FROM entities WHERE status = 'active') b ON a.graph_id = b.graph_id AND a.entity_id = b.entity_id) GROUP BY graph_id")
def membership_equality(k):
    return validation.same_members(k.entities.where("entity_id NOT LIKE '%77'"), k.entities.where("status = 'active'"), ["graph_id"], "entity_id")


@query("""SELECT d.graph_id, d.document_id, CASE WHEN s.source_key IS NULL OR s.fetch_status <> 'success' OR s.content_hash IS NULL THEN 'NOT_STORED' WHEN s.content_hash <> now_hash THEN 'HASH_MISMATCH'
 WHEN d.processed_hash = s.content_hash AND d.processed_ontology = '2.1' THEN 'ALREADY_PROCESSED' END AS issue FROM source_documents d JOIN docs USING (doc_id) LEFT JOIN source_snapshots s ON s.graph_id = d.graph_id AND s.source_key = d.source_key""")
def apply_precondition(k):
    text_of = k.docs.select("doc_id", "text")
    return validation.apply_precondition(k.source_documents.join(text_of, "doc_id"), k.source_snapshots, ontology.VERSION).select("graph_id", "document_id", "issue")


@query("SELECT source_id, ref FROM candidate_facts WHERE class_type = 'Work' AND predicate = 'kind' AND l_kind IN ('award', 'certification')".replace("candidate_facts", "(SELECT *, lower(CASE WHEN ord % 4 = 0 THEN ' Award' ELSE value_str END) AS l_kind FROM candidate_facts)").replace("l_kind IN", "trim(l_kind) IN") + " GROUP BY ALL")
def credential_works(k):
    raw = F.when(F.col("ord") % 4 == 0, " Award").otherwise(F.col("value_str"))
    return validation.credential_works(k.candidate_facts.withColumn("value_str", raw)).select("source_id", "ref")


# Identity
@query("""SELECT e.graph_id, e.entity_id AS id, e.class_type, coalesce(f.n, 0) AS n_facts, coalesce(ks.n, 0) AS n_keys, coalesce(o.n, 0) AS n_orgs FROM entities e LEFT JOIN (SELECT graph_id, entity_id, count(DISTINCT (predicate, value_str)) AS n FROM facts WHERE status = 'active' GROUP BY ALL) f USING (graph_id, entity_id)
 LEFT JOIN (SELECT graph_id, entity_id, count(DISTINCT (key_type, key_value)) AS n FROM entity_keys WHERE is_strong GROUP BY ALL) ks USING (graph_id, entity_id) LEFT JOIN (SELECT graph_id, subject_id AS entity_id, count(DISTINCT object_id) AS n FROM relations WHERE predicate = 'atOrganization' AND status = 'active' GROUP BY ALL) o USING (graph_id, entity_id) WHERE e.status = 'active'""")
def resolution_pool(k):
    pool = identity.resolution_pool(k.entities, k.facts, k.relations, k.entity_keys)
    return pool.select("graph_id", "id", "class_type", *[F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}") for c in ("facts", "keys", "orgs")])


@query()
def entity_resolution(k):
    pool = identity.resolution_pool(k.entities, k.facts, k.relations, k.entity_keys)
    stored = F.crc32(F.col("id").cast("binary")) % 2 == 0
    rows = pool.select("graph_id", "id", "class_type", F.crc32(F.col("id").cast("binary")).alias("ord"), stored.alias("stored"), F.lit(None).cast("string").alias("forced_id"), "facts", "keys", "orgs")
    return identity.resolve_entities(rows)


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9_]+', '', 'g') AS key FROM supplier")
def organization_keys(k):
    return k.supplier.select("s_suppkey", identity.organization_key(F.col("s_name")).alias("key"))


@query("""SELECT graph_id, entity_id, predicate, string_agg(value_str, '|' ORDER BY updated, value_str) AS held FROM facts GROUP BY ALL""")
def extraction_index(k):
    rows = k.facts.select("graph_id", "entity_id", "predicate", "value_str", F.col("updated").alias("ord"))
    index = documents.extraction_index(rows, ["graph_id", "entity_id"])
    return index.select("graph_id", "entity_id", F.explode("held").alias("predicate", "v")).select("graph_id", "entity_id", "predicate", F.array_join("v", "|").alias("held"))


# Layout
_LAYOUT = "SELECT doc_id, line, length(text) AS n, line % 40 AS page_line, CAST(floor(line / 40) AS BIGINT) AS page, line * 14 + CASE WHEN length(text) < 30 THEN 12 ELSE 0 END AS top, line * 14 + 10 AS bottom, CASE WHEN length(text) < 15 THEN length(text) % 3 + 1 END AS heading_level, text LIKE '- %' AS is_list FROM doc_lines"


@query(f"SELECT doc_id, line, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM ({_LAYOUT})")
def line_gaps(k):
    return documents.line_gaps(k.sql(_LAYOUT), ["doc_id"], "page", "line").select("doc_id", "line", "gap")


@query(f"""WITH g AS (SELECT *, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap_before, lag(heading_level) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM ({_LAYOUT}))
 SELECT doc_id, line, CASE WHEN heading_level IS NOT NULL THEN NOT coalesce(before < heading_level, false) WHEN before IS NOT NULL THEN false WHEN is_list THEN false ELSE coalesce(gap_before >= 12, false) END AS starts FROM g""")
def item_starts(k):
    lines = documents.line_gaps(k.sql(_LAYOUT), ["doc_id"], "page", "line").withColumnRenamed("gap", "gap_before")
    bare = lines.withColumns({"table": F.lit(None).cast("string"), "blank_before": F.lit(False), "keep_with_next": F.lit(False)})
    return documents.item_starts(bare, ["doc_id"], "line").select("doc_id", "line", "starts")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Top ' || doc_id END AS section FROM docs")
def locator_sections(k):
    locator = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("block:1;section_path=Top "), "doc_id", F.lit(" > Sub"))).otherwise("block:1")
    return k.docs.select("doc_id", documents.top_section(locator).alias("section"))


# Page databases
@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2024-01-0' || (1 + event_id % 9) || CASE WHEN event_id % 2 = 0 THEN ' ~ 2025' ELSE '' END WHEN 1 THEN 'ab' END AS shown FROM events")
def database_properties(k):
    from kgloom.sources import databases

    e = F.col("event_id")
    date = F.concat(F.lit('[["‣",[["d",{"start_date":"2024-01-0'), 1 + e % 9, F.lit('"'), F.when(e % 2 == 0, ',"end_date":"2025"').otherwise(""), F.lit("}]]]]"))
    value = F.when(e % 3 == 0, date).when(e % 3 == 1, '[[" a"],["b",[["b"]]],"x"]').otherwise("7")
    return k.events.select("event_id", databases.property_text(value, F.when(e % 3 == 0, "date").otherwise("text")).alias("shown"))


@query("SELECT page, row_id, first FROM (SELECT user_id AS page, event_id % 1000 AS row_id, min(event_id) AS first FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY first) <= 50")
def database_rows(k):
    from kgloom.sources import databases

    rows = k.events.select(F.col("user_id").alias("page"), F.col("event_type").alias("view"), (F.col("event_id") % 1000).alias("row_id"), F.col("event_id").alias("ord"))
    return databases.distinct_rows(rows).select("page", "row_id", F.col("ord").alias("first"))


@query("SELECT user_id AS page, lower(replace(event_type || '-' || event_id % 7, '-', '')) AS id, max(event_id) AS ord FROM events GROUP BY ALL")
def block_index(k):
    from kgloom.sources import databases

    rows = k.events.select(F.col("user_id").alias("page"), F.concat_ws("-", "event_type", F.col("event_id") % 7).alias("id"), F.col("event_id").alias("ord"), F.lit("page").alias("kind"))
    return databases.block_index(rows).select("page", "id", "ord")


@query("SELECT DISTINCT user_id, event_id % 20 AS n FROM events")
def stream_dedupe(k):
    from kgloom.streaming.snapshots import replay_distinct

    return replay_distinct(k.events.select("user_id", (F.col("event_id") % 20).alias("n"), F.col("ts").cast("timestamp").alias("fetched")), ["user_id", "n"])


# Seeds and whole sources
_SEED = """SELECT c_custkey AS graph_id, CASE WHEN c_custkey % 10 = 9 THEN '1.0' ELSE '2.1' END AS ontology_version FROM customer"""
_SEED_FACTS = """SELECT c_custkey AS graph_id, concat('F', c_custkey % 3, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'b' END) AS fact_id, CASE WHEN c_custkey % 5 = 1 THEN 'gone' ELSE concat('P:', c_custkey) END AS entity_id,
  CASE c_custkey % 6 WHEN 0 THEN 'salary' WHEN 1 THEN 'role' ELSE 'name' END AS predicate, CASE WHEN c_custkey % 7 = 0 THEN 'date' ELSE 'string' END AS value_type, CASE WHEN c_custkey % 8 = 3 THEN ' ' ELSE c_name END AS value_str FROM customer"""


@query(f"""WITH g AS ({_SEED}), k AS (SELECT graph_id FROM g WHERE ontology_version = '2.1'), f AS (SELECT * FROM ({_SEED_FACTS}) WHERE graph_id IN (SELECT graph_id FROM k))
 SELECT graph_id, code, count(*) AS n FROM (SELECT graph_id, 'UNSUPPORTED_ONTOLOGY_VERSION' AS code FROM g WHERE ontology_version <> '2.1' UNION ALL SELECT graph_id, 'INVALID_PERSON_COUNT' FROM k WHERE graph_id % 9 = 2 UNION ALL SELECT graph_id, 'DUPLICATE_ID' FROM k WHERE graph_id % 11 = 1 AND graph_id % 9 <> 2
  UNION ALL SELECT graph_id, 'INVALID_PERSON_COUNT' FROM k WHERE graph_id % 11 = 1 AND graph_id % 9 <> 2
  UNION ALL SELECT graph_id, 'GRAPH_MISMATCH' FROM k WHERE graph_id % 13 = 4 AND graph_id % 9 <> 2 AND graph_id % 11 <> 1 UNION ALL SELECT graph_id, 'GRAPH_MISMATCH' FROM k, range(2) WHERE graph_id % 13 = 4 AND graph_id % 9 <> 2 AND graph_id % 11 = 1
  UNION ALL SELECT graph_id, CASE WHEN entity_id = 'gone' OR graph_id % 9 = 2 THEN 'MISSING_ENTITY' WHEN predicate = 'salary' THEN 'INVALID_PROPERTY' END FROM f UNION ALL SELECT graph_id, CASE WHEN value_type = 'date' THEN 'INVALID_VALUE_TYPE' END FROM f WHERE entity_id <> 'gone' AND graph_id % 9 <> 2 AND predicate <> 'salary'
  UNION ALL SELECT graph_id, CASE WHEN value_str = ' ' THEN 'EMPTY_FACT_VALUE' END FROM f WHERE entity_id <> 'gone' AND graph_id % 9 <> 2 AND predicate <> 'salary' UNION ALL SELECT graph_id, CASE WHEN predicate = 'role' THEN 'INVALID_PROPERTY_VALUE' END FROM f WHERE entity_id <> 'gone' AND graph_id % 9 <> 2
  UNION ALL SELECT graph_id, 'MISSING_ENTITY' FROM k UNION ALL SELECT graph_id, CASE WHEN graph_id % 9 = 2 THEN 'MISSING_ENTITY' END FROM k) WHERE code IS NOT NULL GROUP BY ALL""")
def seed_validation(k):
    from kgloom.operators import seeds

    g = k.sql(_SEED)
    i = F.col("graph_id")
    own = g.where(i % 9 != 2).select("graph_id", F.when(i % 13 == 4, -1).otherwise(i).alias("of_graph"), F.concat(F.lit("P:"), i).alias("entity_id"), F.lit("Person").alias("class_type"))
    entities = own.union(own.where(i % 11 == 1))
    relations = g.select("graph_id", i.alias("of_graph"), F.lit("r").alias("relation_id"), F.concat(F.lit("P:"), i).alias("subject_id"), F.lit("hasSkill").alias("predicate"), F.lit("none").alias("object_id"))
    return seeds.seed_issues(g, entities, k.sql(_SEED_FACTS), relations).groupBy("graph_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS graph_id, CASE WHEN c_custkey % 4 = 0 THEN 'insert' WHEN c_custkey % 3 = 0 THEN 'update' ELSE 'reuse' END AS action FROM customer")
def seed_actions(k):
    from kgloom.operators import seeds

    seed = k.customer.select(F.col("c_custkey").alias("graph_id"), F.lit("name").alias("predicate"), F.col("c_name").alias("value_str"))
    stored = seed.where("graph_id % 4 <> 0").withColumn("value_str", F.when(F.col("graph_id") % 3 == 0, "old").otherwise(F.col("value_str")))
    return seeds.ensure_seed(stored, seed, ["predicate"], "value_str")


@query("SELECT c_custkey AS graph_id, c_name AS value_str, 'profile' AS provenance, 'active' AS status, 1.0::DOUBLE AS confidence FROM customer")
def seed_rows(k):
    from kgloom.operators import seeds

    return seeds.profile_rows(k.customer.select(F.col("c_custkey").alias("graph_id"), F.col("c_name").alias("value_str")))


@query("SELECT o_custkey AS graph_id, 'u' || (o_orderkey % 3) AS url, CASE WHEN count(DISTINCT o_orderkey) = 1 THEN 'added' ELSE 'ambiguous' END AS outcome, CASE WHEN count(DISTINCT o_orderkey) = 1 THEN min('W:' || o_orderkey) END AS work_id FROM orders GROUP BY ALL")
def repository_url_facts(k):
    from kgloom.operators import seeds

    return seeds.canonical_url_facts(k.orders.select(F.col("o_custkey").alias("graph_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 3).alias("url"), F.concat(F.lit("W:"), "o_orderkey").alias("work_id")))


@query("""SELECT o_custkey AS graph_id, o_orderkey AS position, CASE WHEN o_orderkey % 9 = 0 AND o_orderkey > first THEN 'DUPLICATE_ABOUT_BLOCK' WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0 THEN 'EMPTY_BLOCK' END AS code FROM orders LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1) USING (o_custkey)
 WHERE (o_orderkey % 9 = 0 AND o_orderkey > first) OR (o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0) UNION ALL SELECT o_custkey, NULL, 'MISSING_ABOUT_BLOCK' FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 9 = 0) = 0""")
def block_shapes(k):
    from kgloom.operators import seeds

    o = F.col("o_orderkey")
    return seeds.block_shape_issues(k.orders.select(F.col("o_custkey").alias("graph_id"), o.alias("position"), F.when(o % 9 == 0, "About").otherwise("Works").alias("type"), (o % 4).alias("n_items")))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'g' || c_custkey WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey END AS image FROM customer")
def image_fill(k):
    from kgloom.operators import seeds

    c = k.customer.select(F.col("c_custkey").alias("key"))
    return seeds.first_available(c, *[c.where(F.col("key") % m == 0).select("key", F.concat(F.lit(p), "key").alias("image")) for m, p in ((2, "g"), (3, "n"))])


@query("SELECT graph_id, class_type, count(*) FILTER (entity_id LIKE '%3') AS n_new, count(*) AS n FROM entities GROUP BY ALL HAVING n_new > 0 AND n >= 2")
def link_jobs(k):
    from kgloom.operators import seeds

    return seeds.link_jobs(k.entities.select("graph_id", "class_type", F.col("entity_id").alias("id"), F.endswith("entity_id", F.lit("3")).alias("is_new")))


@query("""WITH e AS (SELECT o_orderkey AS source_id, o_orderkey % 3 AS c, o_orderkey % 2 = 0 AS named, o_orderkey % 5 <> 0 AS affiliated, o_orderkey % 7 <> 0 AS org_named FROM orders)
 SELECT source_id, 'o' AS ref FROM e WHERE NOT org_named UNION ALL SELECT source_id, 'x' FROM e WHERE c <> 2 AND NOT named AND NOT (affiliated AND org_named) UNION ALL SELECT source_id, 'x' FROM e WHERE c = 2 AND NOT named""")
def identity_cascade(k):
    from kgloom.operators import seeds

    o = F.col("o_orderkey")
    kind = F.when(o % 3 == 0, "Education").when(o % 3 == 1, "Experience").otherwise("Work")
    prop = F.when(o % 3 == 0, "major").when(o % 3 == 1, "role").otherwise("title")
    base = k.orders.select(o.alias("source_id"), o, kind.alias("class_type"), prop.alias("predicate"))
    entities = base.select("source_id", F.lit("x").alias("ref"), "class_type").union(base.select("source_id", F.lit("o"), F.lit("Organization")))
    facts = base.where(o % 2 == 0).select("source_id", F.lit("x").alias("ref"), "class_type", "predicate").union(base.where(o % 7 != 0).select("source_id", F.lit("o"), F.lit("Organization"), F.lit("name")))
    relations = base.where(o % 5 != 0).select("source_id", F.lit("x").alias("subject_ref"), F.lit("atOrganization").alias("predicate"), F.lit("o").alias("object_ref"))
    return seeds.affiliated_identity(entities, facts, relations, {"Education": "major", "Experience": "role"})


@query()
def applied_sources(k):
    from kgloom.operators import seeds

    f = k.candidate_facts.withColumn("claim", F.concat_ws(":", "ref", "predicate"))
    r = k.candidate_relations.withColumn("claim", F.concat_ws(":", "subject_ref", "object_ref"))
    claims = f.select("source_id", "claim", F.concat(F.lit("l"), F.col("ord") % 5).alias("locator"))
    evidence = f.select("source_id").distinct().select("source_id", F.explode(F.array(*[F.lit(f"l{i}") for i in range(4)])).alias("locator"), F.lit("x").alias("snippet"))
    out = seeds.apply_sources(f, r, claims, evidence, evidence.select("source_id", F.lit("axb").alias("content")).distinct())
    return out["issues"].groupBy("code").agg(F.count(F.lit(1)).alias("n")).union(out["facts"].agg(F.lit("facts"), F.count(F.lit(1)))).union(out["relations"].agg(F.lit("relations"), F.count(F.lit(1))))


@query("SELECT o_custkey, o_orderkey AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'short' || chr(10) || chr(10) ELSE '' END || 'a.md' || chr(10) || 'text' AS content FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 3 <> 0) WHERE rn <= 5".replace("o_custkey, o_orderkey AS repo", "o_orderkey AS repo"))
def readme_supplements(k):
    from kgloom.operators import seeds

    o = F.col("o_orderkey")
    repos = k.orders.select(F.col("o_custkey").alias("owner"), o.alias("repo"), o.alias("ord"), F.when(o % 3 == 0, F.repeat(F.lit("word "), 100)).when(o % 2 == 0, "short").otherwise("").alias("readme"))
    files = k.orders.select(o.alias("repo"), F.lit(1).alias("position"), F.lit("a.md").alias("path"), F.lit("text").alias("text"))
    return seeds.readme_supplements(repos, files)


@query("SELECT page_id AS page, CASE WHEN page_id % 2 = 0 THEN 'b.png' ELSE 'c.png' END AS image FROM pages WHERE page_id % 5 <> 0")
def page_pictures(k):
    from kgloom.operators import seeds

    p = F.col("page_id")
    none, section = F.lit(None), F.when(p % 5 == 0, "My profile").otherwise("Work")
    shown = [(F.lit(1), F.lit("Awards"), none), (none, F.lit("x"), F.lit("a.png")), (F.lit(1), section, none), (none, F.lit("x"), F.when(p % 2 == 0, "b.png").otherwise("badge.png")), (none, F.lit("x"), F.lit("c.png"))]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), level.cast("int").alias("level"), text.alias("text"), image.cast("string").alias("image")) for i, (level, text, image) in enumerate(shown)])
    return seeds.page_image(k.pages.select(p.alias("page"), F.explode(rows).alias("b")).select("page", "b.*"))


# Operators on their own
_DAYS = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN substr(d, 1, 4) WHEN 1 THEN substr(d, 1, 7) ELSE d END AS a, CASE WHEN o_orderkey % 2 = 0 THEN d ELSE concat(substr(d, 1, 7), '-28') END AS b, concat(substr(d, 1, 4), '.', substr(d, 6, 2)) AS s,
  CASE o_orderkey % 5 WHEN 0 THEN 'Present' WHEN 1 THEN NULL ELSE concat(CAST(1990 + o_orderkey % 12 AS STRING), '.06') END AS e FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders) x"""
_SE = "(try_cast(substr(s, 1, 4) AS INT) * 100 + try_cast(substr(s, 6, 2) AS INT) > try_cast(substr(e, 1, 4) AS INT) * 100 + try_cast(substr(e, 6, 2) AS INT))"


@query(f"SELECT o_orderkey, starts_with(a, b) OR starts_with(b, a) AS prefixed, a = b OR starts_with(a, b || '-') OR starts_with(b, a || '-') AS equal, NOT coalesce(e <> 'Present' AND {_SE}, false) AS overlap, coalesce(e <> 'Present' AND {_SE}, false) AS inverted FROM ({_DAYS})")
def date_rules(k):
    from kgloom.functions import dates

    d = k.sql(_DAYS)
    s, e, none = F.col("s"), F.col("e"), F.lit(None).cast("string")
    return d.select("o_orderkey", dates.prefix_compatible(F.array("a", "b")).alias("prefixed"), dates.dates_may_equal(F.array("a"), F.array("b")).alias("equal"), dates.bounds_overlap(s, none, none, e).alias("overlap"), dates.inverted(s, e).alias("inverted"))


@query(f"SELECT o_orderkey, CASE WHEN e = 'Present' THEN CASE WHEN o_orderkey % 2 = 0 THEN e END WHEN e = s THEN e WHEN o_orderkey % 3 = 0 THEN s END AS kept FROM ({_DAYS})")
def evidenced_ends(k):
    from kgloom.operators import assembly

    o = F.col("o_orderkey")
    ends = F.when(o % 3 == 0, F.array("s")).otherwise(F.array("s", F.lit("x")))
    return k.sql(_DAYS).select("o_orderkey", assembly.evidenced_end(F.col("e"), ends, o % 2 == 0).alias("kept"))


@query("SELECT graph_id, entity_id, 'W' || row_number() OVER (PARTITION BY graph_id ORDER BY title, entity_id) AS dense_id FROM (SELECT graph_id, entity_id, value_str AS title FROM facts WHERE predicate = 'title' AND updated % 6 <> 0)")
def dense_ids(k):
    from kgloom.operators import resolution

    f = k.facts.where("predicate = 'title'").select("graph_id", "entity_id", F.when(F.col("updated") % 6 != 0, F.col("value_str")).alias("title"))
    return resolution.dense_ids(f, "W", ["title", "entity_id"]).select("graph_id", "entity_id", "dense_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 6 THEN ['GitHub', 'PPT', 'Paper', 'Video', 'Notion', 'Link'][o_orderkey % 7 + 1] END AS label, o_orderkey % 3 = 0 AS is_attachment FROM orders""")
def link_labels(k):
    from kgloom.functions import urls

    o = F.col("o_orderkey")
    hosts = ("https://www.github.com/a", "http://x.example/talk.PPTX", "https://arxiv.org/abs/1", "https://youtu.be/x", "https://a.notion.site/p", "https://example.org/", "mailto:a@b")
    url = F.element_at(F.array(*[F.lit(h) for h in hosts]), (o % 7 + 1).cast("int"))
    store = F.when(o % 3 == 0, "https://b.s3.ap-northeast-2.amazonaws.com/d/a.pdf").when(o % 3 == 1, "https://b.s3.amazonaws.com/a.docx").otherwise("http://b.s3.amazonaws.com/a.pdf")
    return k.orders.select("o_orderkey", urls.label(url).alias("label"), urls.attachment_ok(store, F.lit("application/pdf")).alias("is_attachment"))


@query("SELECT graph_id, ref AS entity_id, key_type, key_value FROM (SELECT o_custkey AS graph_id, 'X:' || o_orderkey AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'work_url' WHEN 1 THEN 'organization_homepage' END AS key_type, 'https://e.example/' || o_orderkey AS key_value, o_orderkey FROM orders) WHERE key_type IS NOT NULL AND o_orderkey % 4 <> 0")
def derived_keys(k):
    from kgloom.operators import resolution

    o = F.col("o_orderkey")
    facts = k.orders.select(F.col("o_custkey").alias("graph_id"), F.concat(F.lit("X:"), o).alias("entity_id"), F.when(o % 3 == 0, "url").when(o % 3 == 1, "homepage").otherwise("title").alias("predicate"), F.concat(F.when(o % 4 == 0, "ftp").otherwise("https"), F.lit("://e.example/"), o).alias("value_str"))
    return resolution.strong_keys(facts)


@query("SELECT o_custkey AS graph_id, 'e' || (o_orderkey % 3) AS entity_id, coalesce(min(s), '') AS start, coalesce(arg_min(e, o_orderkey) FILTER (e IS NOT NULL), '') AS end FROM (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) END AS s, CASE WHEN o_orderkey % 5 < 3 THEN '20' || (10 + o_orderkey % 9) END AS e FROM orders) WHERE s IS NOT NULL OR e IS NOT NULL GROUP BY 1, 2, coalesce(s, '~' || e)")
def merged_periods(k):
    from kgloom.operators import content

    o = F.col("o_orderkey")
    rows = k.orders.select(F.col("o_custkey").alias("graph_id"), F.concat(F.lit("e"), o % 3).alias("entity_id"), o.alias("ordinal"), F.when(o % 4 != 0, F.date_format("o_orderdate", "yyyy")).alias("start"), F.when(o % 5 < 3, F.concat(F.lit("20"), 10 + o % 9)).alias("end"))
    return content.merge_periods(rows).select("graph_id", "entity_id", F.coalesce("start", F.lit("")).alias("start"), F.coalesce("end", F.lit("")).alias("end"))


@query("SELECT doc_id, line, CASE line % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN text || ' (http://a.b)' ELSE '> ' || text END AS shown FROM doc_lines WHERE text <> ''")
def markdown_lines(k):
    from kgloom.sources import blocks

    kind = F.element_at(F.array(*[F.lit(x) for x in ("header", "bulleted_list", "text", "quote")]), (F.col("line") % 4 + 1).cast("int"))
    body = blocks.rich_text(F.array(F.struct(F.col("text").alias("text"), F.when(F.col("line") % 4 == 2, "http://a.b").alias("url"))))
    return k.doc_lines.where("text <> ''").select("doc_id", "line", blocks.line_of(kind, body).alias("shown"))


@query("SELECT d.doc_id, c.chunk, d.line FROM doc_lines d JOIN (SELECT doc_id, line // 10 AS chunk, min(line) AS lo, max(line) AS hi FROM doc_lines GROUP BY ALL) c ON d.doc_id = c.doc_id AND d.line BETWEEN c.lo - 5 AND c.hi")
def chunk_overlap(k):
    chunked = k.doc_lines.select("doc_id", "line", F.floor(F.col("line") / 10).alias("chunk"))
    return documents.overlap(chunked, "doc_id", "line")


@query("SELECT p_partkey, CASE WHEN len(m) < 2 THEN false ELSE true END AS alike FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS m FROM part)")
def same_descriptions(k):
    n = F.lower("p_name")
    return k.part.select("p_partkey", text.similar_description(n, n).alias("alike"))
