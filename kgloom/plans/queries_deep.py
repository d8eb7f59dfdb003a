"""Registered queries of whole mechanisms: overlapping chunks, file layout, fetching, seeds, sources applied."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kgloom.functions import urls
from kgloom.operators import applying, content, documents, fetching, graph_store, identity, overlap, seeds, trees, validation
from kgloom.plans.queries import _CHECKED, _MERGED, _REL_CHECKED, query
from kgloom.plans.staging import shared_dir
from kgloom.sources import paged, pieces, repositories
from kgloom.streaming import sources

# Overlapping chunks: line items of an order are entities of one source, named by their part's type, cited by where they stand
_OVERLAP = """SELECT source_id, concat('e', n) AS ref, n, CASE flag WHEN 'N' THEN 'Organization' WHEN 'A' THEN 'Work' ELSE 'Activity' END AS class_type, CASE WHEN n < 3 THEN 0 WHEN n < 5 THEN 1 ELSE 2 END AS chunk,
  CASE WHEN flag = 'A' THEN 'title' ELSE 'name' END AS predicate, p_type AS value, line, kind, tax FROM (SELECT l_orderkey AS source_id, l_partkey, l_returnflag AS flag, l_linestatus AS line, CASE WHEN l_quantity > 25 THEN 'project' ELSE 'publication' END AS kind, l_tax AS tax,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) l JOIN part ON l_partkey = p_partkey"""


def _extracted(k):
    rows = k.sql(_OVERLAP)
    entities = rows.select("source_id", "ref", "n", "class_type", "chunk")
    named = rows.select("source_id", (F.col("n") * 2).alias("fact_ord"), "ref", "predicate", "value", F.array(F.concat(F.lit("line:"), "line")).alias("locators"))
    # of Works only, of one value each
    kinds = rows.where("class_type = 'Work'").select("source_id", (F.col("n") * 2 + 1).alias("fact_ord"), "ref", F.lit("kind").alias("predicate"), F.col("kind").alias("value"), F.array(F.lit("line:F")).alias("locators"))
    at = rows.where("class_type <> 'Organization' AND tax > 0.03").alias("s").join(rows.where("class_type = 'Organization'").alias("o"), "source_id").where("s.chunk = o.chunk")
    relations = at.select("source_id", F.col("s.ref").alias("subject_ref"), F.lit("atOrganization").alias("predicate"), F.col("o.ref").alias("object_ref"))
    lines = rows.where("tax < 0.08").select("source_id", F.concat(F.lit("line:"), "line").alias("locator")).distinct()
    return entities, named.union(kinds), relations, lines


@query()
def overlap_roots(k):
    return overlap.overlap_roots(*_extracted(k))


# Layout of files
_PAGES = """SELECT doc_id, line AS ord, 1 + CAST(floor(line / 40) AS BIGINT) AS page, text, CASE WHEN length(text) < 12 THEN 14.0E0 WHEN length(text) < 30 THEN 12.0E0 ELSE 10.0E0 END AS size,
  40.0E0 + 6 * (length(text) % 4) AS x0, 46.0E0 + 6 * (length(text) % 4) + 5 * length(text) AS x1, 40.0E0 + 14 * (line % 40) + CASE WHEN length(text) < 30 THEN 3 ELSE 0 END AS top, 50.0E0 + 14 * (line % 40) AS bottom, 640.0E0 AS height FROM doc_lines WHERE trim(text) <> ''"""


@query()
def page_text(k):
    url = F.regexp_extract_all("text", F.lit(r"https?://\S+"), F.lit(0))
    return documents.page_text(k.sql(_PAGES).withColumn("links", url))


_LINKS = f"SELECT doc_id, page, ord AS link, x0 + 2 * (length(text) % 9) - 6 AS x0, top + 3 * (length(text) % 11) - 12 AS top, bottom + 3 * (length(text) % 7) - 6 AS bottom FROM ({_PAGES})"


@query(f"""WITH p AS ({_PAGES}), k AS ({_LINKS}), m AS (SELECT k.doc_id, k.page, k.link, p.ord, abs((p.top + p.bottom) / 2 - (k.top + k.bottom) / 2) AS away FROM k JOIN p ON p.doc_id = k.doc_id AND p.page = k.page
  AND k.x0 BETWEEN p.x0 - 3 AND p.x1 + 3 AND (k.top + k.bottom) / 2 BETWEEN p.top - 3 AND p.bottom + 3) SELECT doc_id, page, link, arg_min(ord, (away, ord)) AS ord FROM m GROUP BY ALL""")
def link_lines(k):
    return documents.nearest_line(k.sql(_LINKS), k.sql(_PAGES))


_FILE = f"""SELECT doc_id, ord, page, x0 AS indent, size, text LIKE '- %' AS is_list, CASE WHEN length(text) < 12 THEN 1 WHEN length(text) < 30 THEN 2 END AS heading_level, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY ord) AS gap_before, ord = 0 AS is_title FROM ({_PAGES})"""


@query(f"""WITH RECURSIVE f AS ({_FILE}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, lag(heading_level) OVER w AS bh, lag(page) OVER w AS bp, lag(indent) OVER w AS bi FROM f WHERE NOT is_title WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 s AS (SELECT *, pos = 0 OR CASE WHEN heading_level IS NOT NULL THEN NOT coalesce(bh < heading_level, false) WHEN bh IS NOT NULL THEN false WHEN is_list THEN false
   ELSE coalesce(bp = page AND (gap_before >= greatest(12, 1.2 * size) OR (bi - indent >= 6 AND gap_before >= 6)), false) END AS starts FROM b),
 i AS (SELECT *, sum(starts::INT) OVER w AS item, last_value(CASE WHEN starts THEN pos END IGNORE NULLS) OVER w AS item_pos, last_value(CASE WHEN starts THEN ord END IGNORE NULLS) OVER w AS item_ord,
   last_value(CASE WHEN heading_level = 1 THEN ord END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN heading_level = 2 THEN ord END IGNORE NULLS) OVER w AS h2 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 parts AS (SELECT doc_id, item, (pos - item_pos) // 30 AS part, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY item, (pos - item_pos) // 30) AS k FROM i GROUP BY doc_id, item, (pos - item_pos) // 30),
 packed(doc_id, k, chunk, used) AS (SELECT doc_id, k, 0, n FROM parts WHERE k = 1 UNION ALL SELECT p.doc_id, p.k, CASE WHEN q.used + p.n > 30 THEN q.chunk + 1 ELSE q.chunk END, CASE WHEN q.used + p.n > 30 THEN p.n ELSE q.used + p.n END FROM packed q JOIN parts p ON p.doc_id = q.doc_id AND p.k = q.k + 1),
 c AS (SELECT i.*, packed.chunk FROM i JOIN parts ON parts.doc_id = i.doc_id AND parts.item = i.item AND parts.part = (i.pos - i.item_pos) // 30 JOIN packed ON packed.doc_id = parts.doc_id AND packed.k = parts.k),
 first AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, chunk ORDER BY pos) = 1),
 context AS (SELECT doc_id, chunk, h1 AS ord FROM first WHERE h1 < ord UNION SELECT doc_id, chunk, h2 FROM first WHERE h2 < ord AND h2 > coalesce(h1, -1) UNION SELECT doc_id, chunk, item_ord FROM first WHERE item_ord < ord
  UNION SELECT f.doc_id, f.chunk, c.ord FROM first f JOIN c ON c.doc_id = f.doc_id AND c.chunk = f.chunk - 1 AND c.pos >= f.pos - 5 WHERE NOT (f.pos = f.item_pos AND f.heading_level IS NOT NULL))
 SELECT doc_id, chunk, ord, 'own' AS role FROM c UNION ALL SELECT doc_id, chunk, ord, 'context' FROM context UNION ALL SELECT first.doc_id, first.chunk, f.ord, 'title' FROM first JOIN f ON f.doc_id = first.doc_id AND f.is_title""")
def file_chunks(k):
    bare = k.sql(_FILE).withColumns({"table": F.lit(None).cast("string"), "blank_before": F.lit(False), "keep_with_next": F.lit(False)})
    items = documents.item_starts(bare.where("NOT is_title"), ["doc_id"], "ord").unionByName(bare.where("is_title").withColumn("starts", F.lit(True)))
    return documents.file_chunks(items, "doc_id", "ord")


# Fetching: regions hold nations, these customers, and these orders; what stands after J is only fetched when it is asked for
@query("""WITH n AS (SELECT n_regionkey AS page, n_nationkey, concat('N:', n_nationkey) AS id, CASE WHEN n_name < 'N' THEN 0 ELSE 1 END AS round FROM nation),
 c AS (SELECT n.page, c_custkey, c_mktsegment, concat('C:', c_custkey) AS id, n.round + 1 AS round FROM customer JOIN n ON n.n_nationkey = c_nationkey), o AS (SELECT c.page, concat('O:', o_orderkey) AS id, c.round + 1 AS round FROM orders JOIN c ON c.c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'),
 a AS (SELECT page, id, round FROM n WHERE round > 0 UNION ALL SELECT page, id, round FROM c UNION ALL SELECT page, id, round FROM o)
 SELECT page, id, round, ((row_number() OVER (PARTITION BY page, round ORDER BY id) - 1) // 100)::INT AS batch FROM a""")
def fetched_children(k):
    none = F.array().cast("array<string>")

    def block(df, page, ident, kind, children):
        return df.select(page.alias("page"), ident.alias("id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), children.alias("children"))

    def kids(df, parent, letter, child):
        return df.groupBy(F.col(parent).alias("parent")).agg(F.collect_list(F.concat(F.lit(letter), child)).alias("kids"))

    nation, customer = k.nation, k.customer.join(k.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    roots = k.region.select(F.col("r_regionkey").alias("page"), F.lit("root").alias("id"))
    root = block(k.region.join(kids(nation, "n_regionkey", "N:", "n_nationkey"), F.col("r_regionkey") == F.col("parent"), "left"), F.col("r_regionkey"), F.lit("root"), "page", F.coalesce("kids", none))
    nations = block(nation.join(kids(customer, "c_nationkey", "C:", "c_custkey"), F.col("n_nationkey") == F.col("parent"), "left"), F.col("n_regionkey"), F.concat(F.lit("N:"), "n_nationkey"), "text", F.coalesce("kids", none))
    customers = block(customer.join(kids(k.orders, "o_custkey", "O:", "o_orderkey"), F.col("c_custkey") == F.col("parent"), "left"), F.col("n_regionkey"), F.concat(F.lit("C:"), "c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "page").otherwise("text"), F.coalesce("kids", none))
    orders = block(k.orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("n_regionkey"), F.concat(F.lit("O:"), "o_orderkey"), "text", none)
    early = nation.where("n_name < 'N'").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"))
    stored = nations.union(customers).union(orders)
    held = root.union(nations.join(F.broadcast(early), "id", "left_semi").select(*root.columns))
    return fetching.fetch_missing(held, roots, lambda asked: stored.join(asked.select("page", "id"), ["page", "id"], "left_semi"))[1]


# Trees
_TREE = """WITH r AS (SELECT graph_id, subject_id, predicate, object_id FROM relations WHERE provenance = 'profile' AND status = 'active'),
 e AS (SELECT DISTINCT e.graph_id, e.entity_id, e.class_type FROM entities e JOIN (SELECT graph_id, subject_id AS entity_id FROM r UNION SELECT graph_id, object_id FROM r) USING (graph_id, entity_id)),
 ok AS (SELECT graph_id FROM (SELECT e.graph_id, e.class_type, count(r.object_id) AS n FROM e LEFT JOIN r ON r.graph_id = e.graph_id AND r.object_id = e.entity_id GROUP BY e.graph_id, e.entity_id, e.class_type) GROUP BY graph_id HAVING bool_and(n = CASE WHEN class_type = 'Person' THEN 0 ELSE 1 END) AND count(*) FILTER (class_type = 'Person') = 1),
 pf AS (SELECT graph_id, entity_id, predicate, value_str, updated FROM facts WHERE provenance = 'profile')"""


@query(_TREE + """, v AS (SELECT graph_id, predicate || value_str AS a FROM pf JOIN e USING (graph_id, entity_id)), gone AS (SELECT DISTINCT pf.graph_id FROM pf JOIN e USING (graph_id, entity_id) JOIN facts f ON f.graph_id = pf.graph_id AND f.entity_id = pf.entity_id AND f.predicate = pf.predicate AND f.status <> 'active')
 SELECT graph_id, ok.graph_id IS NOT NULL AS is_tree, ok.graph_id IS NOT NULL AND gone.graph_id IS NULL AS same FROM (SELECT DISTINCT graph_id FROM e) g LEFT JOIN ok USING (graph_id) LEFT JOIN gone USING (graph_id)""")
def canonical_tree_equality(k):
    r = k.relations.where("provenance = 'profile' AND status = 'active'")
    ends = r.select("graph_id", F.col("subject_id").alias("entity_id")).union(r.select("graph_id", "object_id")).distinct()
    e = k.entities.join(ends, ["graph_id", "entity_id"], "left_semi")
    f = k.facts.where("provenance = 'profile'").join(ends, ["graph_id", "entity_id"], "left_semi")
    left = trees.canonical_trees(e, f, r, store=k.by_graph)
    # the other version has new ids throughout and only active facts
    renamed = lambda df, *cols: df.withColumns({c: F.reverse(c) for c in cols})
    right = trees.canonical_trees(renamed(e, "entity_id"), renamed(f.where("status = 'active'"), "entity_id"), renamed(r, "subject_id", "object_id"), store=k.by_graph)
    return trees.same_content(left, right).join(left, "graph_id").select("graph_id", F.col("tree").isNotNull().alias("is_tree"), "same")


# Seeds: a person with a channel and, at a company named after the nation, an experience; the next version of the profile follows from the account
_SEED = """SELECT c_custkey AS graph_id, c_name AS name, n_name AS org, c_mktsegment AS segment, c_acctbal AS acct, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Professor' ELSE 'Professional' END AS role FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def _seed(k, version: str):
    """One version of the seeds: ids begin with `version`; the second has other names, organisations, and channels only on credit."""
    p = k.sql(_SEED)
    second = version == "b"
    name = F.when(F.col("acct") < 0, F.upper("name")).otherwise(F.col("name")) if second else F.col("name")
    org = F.when(F.col("acct") > 8000, F.concat("org", F.lit(" AND SONS"))).otherwise(F.col("org")) if second else F.col("org")
    dept = F.when(F.col("acct").between(0, 2000), F.concat("segment", F.lit(" II"))).otherwise(F.col("segment")) if second else F.col("segment")
    p = p.withColumns({"name": name, "org": org, "dept": dept})
    ident = lambda letter: F.concat(F.lit(f"{version}{letter}:"), "graph_id")
    with_channel = (F.col("acct") < 5000) if second else F.lit(True)
    row = lambda *v: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(v)])
    e = F.array(row(ident("P"), F.lit("Person")), row(ident("O"), F.lit("Organization")), row(ident("X"), F.lit("Experience")), F.when(with_channel, row(ident("C"), F.lit("Channel"))))
    f = F.array(
        row(ident("P"), F.lit("name"), F.col("name")), row(ident("P"), F.lit("role"), F.col("role")), row(ident("O"), F.lit("name"), F.col("org")), row(ident("O"), F.lit("type"), F.lit("company")),
        row(ident("X"), F.lit("department"), F.col("dept")), F.when(with_channel, row(ident("C"), F.lit("kind"), F.lit("email"))), F.when(with_channel, row(ident("C"), F.lit("value"), F.col("name"))),
    )
    r = F.array(row(ident("P"), F.lit("hasExperience"), ident("X")), row(ident("X"), F.lit("atOrganization"), ident("O")), F.when(with_channel, row(ident("P"), F.lit("hasChannel"), ident("C"))))

    def rows(array, *names):
        return p.select("graph_id", F.explode(array).alias("x")).where("x IS NOT NULL").select("graph_id", *[F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)])

    facts, relations = rows(f, "entity_id", "predicate", "value_str"), rows(r, "subject_id", "predicate", "object_id")
    return {
        "entities": rows(e, "entity_id", "class_type"), "facts": facts.withColumn("fact_id", F.concat_ws("/", "entity_id", "predicate")), "relations": relations.withColumn("relation_id", F.concat_ws("/", "subject_id", "predicate")),
    }


def _updated_seeds(k):
    old, new = _seed(k, "a"), _seed(k, "b")
    old = {n: df.withColumn("updated", F.lit(1).cast("long")) for n, df in old.items()}
    old |= {n: old[n].withColumn("locked", F.col("predicate").isin("role", "hasChannel")) for n in ("facts", "relations")}
    graphs = k.graphs.select("graph_id", "version", F.lit(1).cast("long").alias("updated"))
    kept = k.sql(_SEED).where("segment = 'AUTOMOBILE'").select("graph_id", F.explode(F.array(F.concat(F.lit("aC:"), "graph_id"), F.concat(F.lit("aO:"), "graph_id"))).alias("entity_id"))
    return seeds.update_seeds(graphs, old, new, kept, F.lit(2).cast("long"))


_SEED_SQL = f"""WITH p AS (SELECT *, CASE WHEN acct < 0 THEN upper(name) ELSE name END AS name2, CASE WHEN acct > 8000 THEN org || ' AND SONS' ELSE org END AS org2, CASE WHEN acct BETWEEN 0 AND 2000 THEN segment || ' II' ELSE segment END AS dept2, acct < 5000 AS chan2 FROM ({_SEED})),
 x AS (SELECT *, org2 <> org AS moved, name2 <> name AS renamed, dept2 <> segment AS redept FROM p)"""


@query(_SEED_SQL + """ SELECT graph_id, CASE WHEN moved OR renamed OR redept OR NOT chan2 THEN 1 ELSE 0 END AS version, CASE WHEN moved OR renamed OR redept OR NOT chan2 THEN 2 ELSE 1 END AS updated FROM x""")
def updated_seed_graphs(k):
    return _updated_seeds(k)["graphs"].select("graph_id", F.col("version").cast("int").alias("version"), F.col("updated").cast("int").alias("updated"))


@query(_SEED_SQL + """ SELECT graph_id, 'aP:' || graph_id AS entity_id, 'name' AS predicate, name2 AS value_str, false AS locked, CASE WHEN renamed THEN 2 ELSE 1 END AS updated FROM x UNION ALL SELECT graph_id, 'aP:' || graph_id, 'role', role, true, 1 FROM x
 UNION ALL SELECT graph_id, CASE WHEN moved THEN 'bO:' ELSE 'aO:' END || graph_id, 'name', org2, false, CASE WHEN moved THEN 2 ELSE 1 END FROM x UNION ALL SELECT graph_id, CASE WHEN moved THEN 'bO:' ELSE 'aO:' END || graph_id, 'type', 'company', false, CASE WHEN moved THEN 2 ELSE 1 END FROM x
 UNION ALL SELECT graph_id, CASE WHEN moved THEN 'bX:' ELSE 'aX:' END || graph_id, 'department', dept2, false, CASE WHEN moved OR redept THEN 2 ELSE 1 END FROM x
 UNION ALL SELECT graph_id, 'aC:' || graph_id, 'kind', 'email', false, 1 FROM x WHERE chan2 UNION ALL SELECT graph_id, 'aC:' || graph_id, 'value', name2, false, CASE WHEN renamed THEN 2 ELSE 1 END FROM x WHERE chan2""")
def updated_seed_facts(k):
    return _updated_seeds(k)["facts"].select("graph_id", "entity_id", "predicate", "value_str", "locked", F.col("updated").cast("int").alias("updated"))


@query(_SEED_SQL + """ SELECT graph_id, 'aP:' || graph_id AS entity_id, 'Person' AS class_type, CASE WHEN renamed OR moved OR NOT chan2 THEN 2 ELSE 1 END AS updated FROM x
 UNION ALL SELECT graph_id, CASE WHEN moved THEN 'bO:' ELSE 'aO:' END || graph_id, 'Organization', CASE WHEN moved THEN 2 ELSE 1 END FROM x UNION ALL SELECT graph_id, CASE WHEN moved THEN 'bX:' ELSE 'aX:' END || graph_id, 'Experience', CASE WHEN moved OR redept THEN 2 ELSE 1 END FROM x
 UNION ALL SELECT graph_id, 'aC:' || graph_id, 'Channel', CASE WHEN chan2 AND renamed THEN 2 ELSE 1 END FROM x WHERE chan2 OR segment = 'AUTOMOBILE' UNION ALL SELECT graph_id, 'aO:' || graph_id, 'Organization', 1 FROM x WHERE moved AND segment = 'AUTOMOBILE'""")
def updated_seed_entities(k):
    return _updated_seeds(k)["entities"].select("graph_id", "entity_id", "class_type", F.col("updated").cast("int").alias("updated"))


# Evidence nested in the whole graph
_NESTED = """WITH cur AS (SELECT e.graph_id, e.evidence_id, {'evidence_id': e.evidence_id, 'document_id': e.document_id, 'locator': e.locator, 'snippet': e.snippet} AS item FROM evidence e JOIN source_documents d ON d.graph_id = e.graph_id AND d.document_id = e.document_id WHERE e.content_hash = d.processed_hash),
 fe AS (SELECT l.graph_id, fact_id, list(item ORDER BY evidence_id) AS evidence FROM fact_evidence l JOIN cur USING (graph_id, evidence_id) GROUP BY l.graph_id, fact_id), re AS (SELECT l.graph_id, relation_id, list(item ORDER BY evidence_id) AS evidence FROM relation_evidence l JOIN cur USING (graph_id, evidence_id) GROUP BY l.graph_id, relation_id),
 ee AS (SELECT l.graph_id, entity_id, list(item ORDER BY evidence_id) AS evidence FROM entity_evidence l JOIN cur USING (graph_id, evidence_id) GROUP BY l.graph_id, entity_id), alive AS (SELECT graph_id, entity_id FROM entities WHERE status = 'active'),
 e AS (SELECT graph_id, list({'entity_id': entity_id, 'class_type': class_type, 'status': status, 'evidence': CASE WHEN class_type IN ('Work', 'Activity') THEN coalesce(evidence, []) ELSE [] END} ORDER BY entity_id) AS entities FROM entities LEFT JOIN ee USING (graph_id, entity_id) WHERE status = 'active' GROUP BY graph_id),
 f AS (SELECT graph_id, list({'fact_id': fact_id, 'entity_id': entity_id, 'predicate': predicate, 'value_str': value_str, 'evidence': coalesce(evidence, [])} ORDER BY fact_id) AS facts FROM facts JOIN alive USING (graph_id, entity_id) LEFT JOIN fe USING (graph_id, fact_id) WHERE status = 'active' AND (provenance = 'profile' OR (provenance = 'source' AND evidence IS NOT NULL)) GROUP BY graph_id),
 r AS (SELECT r.graph_id, list({'relation_id': r.relation_id, 'subject_id': subject_id, 'predicate': predicate, 'object_id': object_id, 'evidence': coalesce(evidence, [])} ORDER BY r.relation_id) AS relations FROM relations r JOIN alive s ON s.graph_id = r.graph_id AND s.entity_id = subject_id JOIN alive o ON o.graph_id = r.graph_id AND o.entity_id = object_id
  LEFT JOIN re ON re.graph_id = r.graph_id AND re.relation_id = r.relation_id WHERE status = 'active' AND (provenance = 'profile' OR (provenance = 'source' AND evidence IS NOT NULL)) GROUP BY r.graph_id)
 SELECT g.graph_id, to_json({'graph_id': g.graph_id, 'entities': coalesce(entities, []), 'facts': coalesce(facts, []), 'relations': coalesce(relations, [])})::VARCHAR AS graph_json FROM graphs g LEFT JOIN e USING (graph_id) LEFT JOIN f USING (graph_id) LEFT JOIN r USING (graph_id)"""


@query(_NESTED)
def nested_sink(k):
    links = {n: graph_store.current_links(b, k.evidence, k.source_documents) for n, b in (("entities", k.entity_evidence), ("facts", k.fact_evidence), ("relations", k.relation_evidence))}
    nested = graph_store.nested_evidence(k.graphs, k.entities, k.facts, k.relations, links)
    return nested.select("graph_id", F.to_json(F.struct("graph_id", "entities", "facts", "relations")).alias("graph_json"))


# Streams
@query("SELECT graph_id, source_key, arg_max(content_hash, event_id) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, source_key ORDER BY fetched DESC, event_id DESC) AS rn FROM snapshots WHERE content_hash IS NOT NULL) WHERE rn = 1 GROUP BY graph_id, source_key")
def stream_applied_sources(k):
    """The second attempt at a batch succeeds: what is applied is what one batch over all rows applies."""
    calls = []

    def apply(fresh):
        calls.append(1)
        if len(calls) == 2:  # the second batch fails once, before its marks
            raise RuntimeError("injected")
        return fresh.select("graph_id", "source_key", "event_id")

    return sources.replay(k.snapshots, apply)[0].select("graph_id", "source_key", "content_hash")


@query("SELECT graph_id, source_key, last(content_hash ORDER BY fetched, event_id) AS content_hash, count(*) FILTER (changed) AS changes FROM (SELECT *, content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY graph_id, source_key ORDER BY fetched, event_id) AS changed FROM snapshots WHERE content_hash IS NOT NULL) GROUP BY graph_id, source_key")
def stream_version_counts(k):
    return sources.replay_changes(k.snapshots).where("content_hash IS NOT NULL")


# All rules over the candidate tables
@query(f"""SELECT code, n FROM ({_CHECKED} SELECT issue AS code, count(*) AS n FROM checked WHERE issue IS NOT NULL GROUP BY issue) UNION ALL SELECT code, n FROM ({_REL_CHECKED} SELECT 'RELATION_' || issue AS code, count(*) AS n FROM checked WHERE issue IS NOT NULL GROUP BY issue)
 UNION ALL SELECT 'CONFLICTING_VALUES', count(*) FROM (SELECT DISTINCT source_id, ref, predicate FROM ({_MERGED}) WHERE uncertain)
 UNION ALL SELECT 'MISSING_IDENTITY', count(*) FROM ({_CHECKED}, named AS (SELECT DISTINCT source_id, ref FROM checked WHERE issue IS NULL AND ((class_type = 'Work' AND predicate = 'title') OR (class_type IN ('Skill', 'Organization') AND predicate = 'name')))
  SELECT DISTINCT c.source_id, c.ref, c.class_type FROM candidate_facts c WHERE class_type IN ('Work', 'Skill', 'Organization') AND NOT EXISTS (SELECT 1 FROM named n WHERE n.source_id = c.source_id AND n.ref = c.ref))
 UNION ALL SELECT 'DUPLICATE_REF', count(*) FROM (SELECT source_id, ref FROM (SELECT DISTINCT source_id, ref, class_type FROM candidate_facts WHERE class_type IS NOT NULL) GROUP BY source_id, ref HAVING count(*) > 1)
 UNION ALL SELECT 'UNSUPPORTED_EVIDENCE', count(*) FROM (SELECT f.graph_id, f.fact_id FROM fact_evidence f JOIN evidence e ON e.graph_id = f.graph_id AND e.evidence_id = f.evidence_id JOIN docs d ON e.document_id = concat('D:', d.doc_id) GROUP BY f.graph_id, f.fact_id HAVING NOT bool_and(sha256(d.text) = e.content_hash AND contains(d.text, e.snippet)))""")
def rule_violations(k):
    """(code, n): what check_facts(), check_relations(), merge_facts(), unidentified(), duplicate_refs() and grounded() find in all candidates and claims."""
    c = k.candidate_facts
    classes = c.where("class_type IS NOT NULL").select("source_id", "ref", "class_type").distinct()
    checked, linked = validation.check_facts(c), validation.check_relations(k.candidate_relations, classes)

    def named(df, code):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")

    by_code = lambda df, code: df.where("issue IS NOT NULL").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    # a claim is a fact; its locators are its evidence, whose text has to be the version that the evidence is of
    e = k.evidence.select(F.col("graph_id").alias("source_id"), "document_id", F.col("evidence_id").alias("locator"), "snippet", "content_hash")
    body = k.docs.select(F.concat(F.lit("D:"), "doc_id").alias("document_id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))
    claims = k.fact_evidence.select(F.col("graph_id").alias("source_id"), F.col("fact_id").alias("claim"), F.col("evidence_id").alias("locator"))
    parts = [
        by_code(linked, F.concat(F.lit("RELATION_"), "issue")), named(validation.merge_facts(checked).where("uncertain").select("source_id", "ref", "predicate").distinct(), "CONFLICTING_VALUES"),
        named(validation.unidentified(classes, checked.where("issue IS NULL")), "MISSING_IDENTITY"), named(validation.duplicate_refs(classes).select("source_id", "ref").distinct(), "DUPLICATE_REF"),
        named(validation.grounded(claims, e, body, "document_id", "content_hash").where("NOT grounded"), "UNSUPPORTED_EVIDENCE"),
    ]
    out = by_code(checked, F.col("issue"))
    for p in parts:
        out = out.union(p)
    return out


# Labels of the links that stand in pages
_HREFS = "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)=\"([^\"\\s]+)\"', 1))) AS url FROM pages"


@query(f"""WITH u AS ({_HREFS} UNION SELECT page_id, url FROM pages), h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/?#:]+)', 1)), '^www[.]', '') AS host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS path FROM u)
 SELECT page_id, url, CASE WHEN NOT regexp_matches(url, '^(?i)https?://[^\\s/?#]+[^\\s]*$') THEN NULL WHEN host = 'github.com' THEN 'GitHub' WHEN regexp_matches(path, '[.]pptx?$') OR host IN ({", ".join(repr(x) for x in urls.SLIDES)}) OR (host = 'docs.google.com' AND path LIKE '/presentation/%') THEN 'PPT'
 """ + " ".join(f"WHEN {' OR '.join(f"host = '{d}' OR host LIKE '%.{d}'" for d in hosts)} THEN '{shown}'" for hosts, shown in ((urls.PAPERS, "Paper"), (urls.VIDEOS, "Video"), (urls.NOTES, "Notion"), (urls.DEMOS, "Demo"))) + """ WHEN host = 'huggingface.co' AND path LIKE '/spaces/%' THEN 'Demo' ELSE 'Link' END AS label FROM h""")
def page_link_labels(k):
    found = k.pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"\s]+)"'), F.lit(1)))).alias("url"))
    return found.union(k.pages.select("page_id", "url")).distinct().select("page_id", "url", urls.label(F.col("url")).alias("label"))


# CV: an order is an entry of the kind that its priority says, at its suppliers, with its parts as skills
_CAREER = """SELECT o_custkey AS graph_id, concat(substr('XDWAC', CAST(substr(o_orderpriority, 1, 1) AS INT), 1), ':', o_orderkey) AS entity_id, o_orderkey AS k, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Experience' WHEN '2' THEN 'Education' WHEN '3' THEN 'Work' WHEN '4' THEN 'Activity' ELSE 'Credential' END AS class_type,
  o_orderstatus AS st, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(CAST(o_orderdate AS DATE) + 400 AS STRING) AS later FROM orders"""
_CAREER_LINES = f"SELECT DISTINCT c.graph_id, c.entity_id, c.class_type, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, p_name, p_type, s_name FROM lineitem JOIN ({_CAREER}) c ON l_orderkey = c.k JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"

# the same two in Spark, from what is stored by graph
_STORED_CAREER = _CAREER.replace("o_custkey AS graph_id", "graph_id").replace("FROM orders", "FROM placed")
_STORED_LINES = """SELECT graph_id, concat(substr('XDWAC', kind, 1), ':', o_orderkey) AS entity_id, CASE kind WHEN 1 THEN 'Experience' WHEN 2 THEN 'Education' WHEN 3 THEN 'Work' WHEN 4 THEN 'Activity' ELSE 'Credential' END AS class_type,
  n, partkey AS part, supp, p_name, p_type, s_name FROM career_lines"""


def _career(k):
    e, lines = k.sql(_STORED_CAREER), k.sql(_STORED_LINES)
    c, st, price = F.col("class_type"), F.col("st"), F.col("price")
    said = {
        "role": F.when(c.isin("Experience", "Activity", "Work") & (price > 150000), F.concat(F.lit("Role "), st)), "department": F.when((c == "Experience") & (price < 250000), F.concat(F.lit("Dept "), st)),
        "title": F.when(c.isin("Work", "Credential") & (price > 20000), F.concat(F.lit("Title "), "k")), "name": F.when((c == "Activity") & (price > 200000), F.concat(F.lit("Club "), "k")),
        "kind": F.when(c == "Work", F.when(st == "F", "publication").otherwise("project")).when((c == "Activity") & (st == "O"), "volunteer").when(c == "Credential", F.when(st == "F", "award").otherwise("certification")),
        "start": F.col("day"), "end": F.when(st == "F", F.col("later")), "isCurrent": F.when(st == "O", "True"), "date": F.when(c == "Credential", F.col("day")), "grade": F.when((c == "Credential") & (price > 250000), "A"), "issuerName": F.when((c == "Credential") & (st != "P"), F.concat(F.lit("Board "), st)),
        "url": F.when(c == "Work", F.concat(F.when(price > 100000, "https").otherwise("ftp"), F.lit("://w.example/"), "k")),
    }
    pairs = F.array(*[F.struct(F.lit(p).alias("predicate"), v.alias("value_str")) for p, v in said.items()])
    own = e.select("graph_id", "entity_id", "k", F.explode(pairs).alias("x")).select("graph_id", F.concat_ws("/", "entity_id", "x.predicate").alias("fact_id"), "entity_id", "x.*", F.col("k").alias("updated")).where("value_str IS NOT NULL")
    majors = lines.where("class_type = 'Education'").select("graph_id", F.concat_ws("/", "entity_id", "part").alias("fact_id"), "entity_id", F.lit("major").alias("predicate"), F.col("p_type").alias("value_str"), F.col("part").alias("updated")).distinct()
    named = lambda letter, key, name: lines.select("graph_id", F.concat(F.lit(letter), key).alias("fact_id"), F.concat(F.lit(letter), key).alias("entity_id"), F.lit("name").alias("predicate"), F.col(name).alias("value_str"), F.col(key).alias("updated")).distinct()
    # unions are written and read back in buckets: what groups and joins them meets there
    facts = k.by_graph(own.union(majors).union(named("O:", "supp", "s_name")).union(named("S:", "part", "p_name")), "career_facts")
    others = facts.where("predicate = 'name' AND (entity_id LIKE 'O:%' OR entity_id LIKE 'S:%')").select("graph_id", "entity_id", F.when(F.startswith("entity_id", F.lit("O:")), "Organization").otherwise("Skill").alias("class_type"))
    edge = lambda df, predicate, number, target: df.select("graph_id", F.concat_ws(":", F.lit(predicate), F.lpad(F.col(number).cast("string"), 9, "0"), target).alias("relation_id"), F.col("entity_id").alias("subject_id"), F.lit(predicate).alias("predicate"), target.alias("object_id"))
    at, uses = edge(lines, "atOrganization", "n", F.concat(F.lit("O:"), "supp")), edge(lines.where("class_type IN ('Work', 'Experience')"), "usesSkill", "n", F.concat(F.lit("S:"), "part"))
    posts = e.where("class_type = 'Experience'").select("graph_id", "st", F.col("entity_id").alias("post"), F.col("k").alias("pk"))
    part_of = edge(e.where("class_type = 'Work'").join(posts, ["graph_id", "st"]), "partOf", "pk", F.col("post"))
    evidence = lines.select("graph_id", "entity_id", F.lit(0).alias("rank"), F.col("n").alias("ord"), F.concat_ws(" ", "p_name", "p_type").alias("snippet"))
    entities, relations = k.by_graph(e.select("graph_id", "entity_id", "class_type").union(others), "career_entities"), k.by_graph(at.union(uses).union(part_of), "career_relations").distinct()
    return entities, facts, relations, evidence


_CV_ALL = f"""WITH e AS ({_CAREER}), l AS ({_CAREER_LINES}), org AS (SELECT graph_id, entity_id, arg_min(s_name, concat('atOrganization:', lpad(n::VARCHAR, 9, '0'), ':O:', supp)) AS org FROM l GROUP BY ALL),
 sk AS (SELECT graph_id, entity_id, list(p_name ORDER BY first) AS skills FROM (SELECT graph_id, entity_id, p_name, min(concat('usesSkill:', lpad(n::VARCHAR, 9, '0'), ':S:', part)) AS first FROM l GROUP BY ALL) GROUP BY graph_id, entity_id),
 mj AS (SELECT graph_id, entity_id, string_agg(p_type, ', ' ORDER BY first) AS major FROM (SELECT graph_id, entity_id, p_type, min((-part, concat(entity_id, '/', part))) AS first FROM l GROUP BY ALL) GROUP BY graph_id, entity_id),
 sn AS (SELECT graph_id, entity_id, list(snippet ORDER BY n, snippet) AS snippets FROM (SELECT graph_id, entity_id, concat(p_name, ' ', p_type) AS snippet, min(n) AS n FROM l GROUP BY ALL) GROUP BY graph_id, entity_id),
 part AS (SELECT w.graph_id, w.entity_id, w.k, w.price, arg_min(x.entity_id, concat(lpad(x.k::VARCHAR, 9, '0'), ':', x.entity_id)) AS post FROM e w JOIN e x ON w.graph_id = x.graph_id AND w.st = x.st AND w.class_type = 'Work' AND x.class_type = 'Experience' GROUP BY w.graph_id, w.entity_id, w.k, w.price),
 lent AS (SELECT p.graph_id, p.post AS entity_id, flatten(list(list_transform(snippets, lambda s: (CASE WHEN price > 20000 THEN 'Title ' || p.k ELSE 'None' END) || ': ' || s) ORDER BY p.entity_id DESC)) AS lent FROM part p JOIN sn ON sn.graph_id = p.graph_id AND sn.entity_id = p.entity_id GROUP BY ALL),
 j AS (SELECT e.*, org, skills, major, snippets, lent, CASE WHEN price > 150000 THEN 'Role ' || st END AS role, CASE WHEN price < 250000 THEN 'Dept ' || st END AS dept FROM e LEFT JOIN org USING (graph_id, entity_id) LEFT JOIN sk USING (graph_id, entity_id) LEFT JOIN mj USING (graph_id, entity_id) LEFT JOIN sn USING (graph_id, entity_id) LEFT JOIN lent USING (graph_id, entity_id)
  WHERE (e.graph_id, e.entity_id) NOT IN (SELECT graph_id, entity_id FROM part))
 SELECT * FROM (SELECT graph_id, entity_id, CASE class_type WHEN 'Education' THEN 'education' WHEN 'Experience' THEN 'experience' WHEN 'Work' THEN CASE WHEN st = 'F' THEN 'publications' ELSE 'projects' END WHEN 'Activity' THEN CASE WHEN st = 'O' THEN 'volunteering' ELSE 'activities' END ELSE CASE WHEN st = 'F' THEN 'awards' ELSE 'certifications' END END AS section,
  CASE class_type WHEN 'Education' THEN org WHEN 'Experience' THEN coalesce(org, role) WHEN 'Activity' THEN coalesce(CASE WHEN price > 200000 THEN 'Club ' || k END, org) ELSE CASE WHEN price > 20000 THEN 'Title ' || k END END AS title,
  CASE class_type WHEN 'Education' THEN major WHEN 'Experience' THEN nullif(concat_ws(' · ', CASE WHEN role <> coalesce(org, role) THEN role END, CASE WHEN dept <> coalesce(org, role) THEN dept END), '') WHEN 'Activity' THEN role WHEN 'Work' THEN role END AS subtitle,
  CASE WHEN class_type <> 'Credential' THEN substr(day, 1, 4) || '.' || substr(day, 6, 2) END AS start, CASE WHEN class_type <> 'Credential' THEN CASE st WHEN 'F' THEN substr(later, 1, 4) || '.' || substr(later, 6, 2) WHEN 'O' THEN 'Present' END END AS "end",
  CASE WHEN class_type = 'Credential' THEN substr(day, 1, 4) || '.' || substr(day, 6, 2) END AS date, CASE WHEN class_type = 'Credential' AND price > 250000 THEN 'A' END AS grade, CASE WHEN class_type = 'Credential' AND st <> 'P' THEN 'Board ' || st END AS issuer,
  CASE WHEN class_type = 'Work' AND price > 100000 THEN 'https://w.example/' || k END AS link, CASE WHEN class_type IN ('Work', 'Experience') THEN coalesce(array_to_string(skills, '|'), '') ELSE '' END AS skills,
  coalesce(array_to_string((coalesce(CASE WHEN class_type = 'Experience' THEN lent END, []) || coalesce(snippets, []))[:8], '|'), '') AS snippets FROM j) WHERE title IS NOT NULL"""


def _cv(k):
    return content.cv_candidates(*_career(k))


@query(_CV_ALL.replace("CAST(CAST(o_orderdate AS DATE) + 400 AS STRING)", "CAST(CAST(o_orderdate AS DATE) + 400 AS VARCHAR)"))
def cv_all_candidates(k):
    df = _cv(k)
    return df.withColumns({"skills": F.array_join("skills", "|"), "snippets": F.array_join("snippets", "|")})


@query(f"""SELECT graph_id, entity_id, section, position FROM (SELECT graph_id, entity_id, section, row_number() OVER (PARTITION BY graph_id, section ORDER BY CASE WHEN section = 'projects' THEN '' WHEN "end" = 'Present' THEN '9999' ELSE coalesce("end", start, date, '') END DESC, entity_id)::INT AS position FROM ({_CV_ALL}))
 WHERE position <= CASE section WHEN 'education' THEN 3 WHEN 'volunteering' THEN 4 WHEN 'awards' THEN 8 WHEN 'certifications' THEN 8 ELSE 6 END""")
def cv_all_top(k):
    return content.top_sections(_cv(k).withColumn("ordinal", F.col("entity_id"))).select("graph_id", "entity_id", "section", "position")


# Paged answers: customers of a nation, saved by hundreds and read back through the data source
@query("SELECT c_nationkey::VARCHAR AS owner, ((rn - 1) // 100)::INT AS page, ((rn - 1) % 100)::INT AS position, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)")
def paged_answers(k):
    folder = f"{shared_dir(k.spark)}/kgloom-pages-{uuid.uuid4().hex}"
    items = k.customer.select(F.col("c_nationkey").cast("string").alias("owner"), F.col("c_custkey").alias("ord"), F.to_json(F.struct("c_custkey", "c_name")).alias("item"))
    paged.save(items, folder)
    item = F.from_json("item", "c_custkey bigint, c_name string")
    return paged.read(k.spark, folder).select("owner", "page", "position", item.alias("x")).select("owner", "page", "position", "x.*")


# Repositories of an owner: orders of a nation, the latest first; lines that were sent back are commits, orders without lines could not be looked at
_REPOS = """SELECT c_nationkey AS owner, o_orderkey AS repo, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS ord, o_orderstatus = 'P' AS private, o_orderpriority >= '3' AS fork, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey"""
_ANSWERS = """SELECT l_orderkey AS repo, CASE WHEN max(l_quantity) > 49 AND max(l_returnflag) = 'A' THEN 'rate_limited' WHEN max(l_returnflag) = 'R' THEN 'found' ELSE 'none' END AS answer FROM lineitem GROUP BY l_orderkey"""
_PICK = f"""WITH r AS (SELECT r.*, CASE WHEN NOT private AND fork THEN coalesce(answer, 'failed') END AS a FROM ({_REPOS}) r LEFT JOIN ({_ANSWERS}) USING (repo)), b AS (SELECT *, coalesce(max((a = 'rate_limited')::INT) OVER w = 1, false) AS blocked FROM r WINDOW w AS (PARTITION BY owner ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT *, NOT private AND NOT (NOT blocked AND coalesce(a = 'none', false)) AS taken FROM b), n AS (SELECT *, coalesce(sum(taken::INT) OVER (PARTITION BY owner ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS n FROM t),
 o AS (SELECT *, (SELECT min(ord) FROM n m WHERE m.owner = n.owner AND NOT m.private AND m.n >= 20) AS stop FROM n)"""


@query(_PICK + " SELECT owner, repo, n + 1 AS position FROM o WHERE taken AND n < 20")
def picked_repositories(k):
    return repositories.pick_repositories(k.sql(_REPOS), k.sql(_ANSWERS))[0]


@query(_PICK + """ SELECT owner, repo, code FROM (SELECT owner, repo, CASE WHEN ord = stop THEN 'repository_limit' WHEN private THEN 'unsupported_content' WHEN a IN ('failed', 'rate_limited') AND NOT blocked THEN 'fork_unverified' END AS code FROM o WHERE ord <= coalesce(stop, ord)) WHERE code IS NOT NULL""")
def repository_warnings(k):
    return repositories.pick_repositories(k.sql(_REPOS), k.sql(_ANSWERS))[1]


# Addresses of public pages: a document's hash is a page's id, in one of the ways that addresses are written
_PAGE_URLS = """SELECT doc_id, concat(CASE WHEN doc_id % 5 = 4 THEN 'http' ELSE 'HTTPS' END, '://', CASE doc_id % 4 WHEN 0 THEN 'www.Notion.so/' WHEN 1 THEN 'me.notion.site/Some-Title-' WHEN 2 THEN 'notion.site.example.org/' ELSE 'notion.so/team/' END,
  CASE WHEN doc_id % 3 = 0 THEN upper(substr(now_hash, 1, 32)) WHEN doc_id % 3 = 1 THEN concat(substr(now_hash, 1, 8), '-', substr(now_hash, 9, 4), '-', substr(now_hash, 13, 4), '-', substr(now_hash, 17, 4), '-', substr(now_hash, 21, 12)) ELSE substr(now_hash, 1, 31) END, CASE doc_id % 2 WHEN 0 THEN '/?pvs=4#x' ELSE '' END) AS url, lower(substr(now_hash, 1, 32)) AS want FROM docs"""


@query(f"""SELECT doc_id, CASE WHEN ok THEN want END AS page_id, CASE WHEN ok THEN 'https://' || lower(regexp_extract(url, '://([^/]+)', 1)) || regexp_replace(regexp_extract(url, '://[^/]+([^?#]*)', 1), '/+$', '') END AS source_url FROM (SELECT *, doc_id % 5 <> 4 AND doc_id % 4 <> 2 AND doc_id % 3 <> 2 AS ok FROM ({_PAGE_URLS}))""")
def public_page_targets(k):
    return k.sql(_PAGE_URLS).select("doc_id", urls.public_page(F.col("url")).alias("t")).select("doc_id", "t.*")


# Whole sources: a document says that its order is a project, and that its own source is a tool which that project uses
_APPLY = """WITH ok AS (SELECT doc_id, graph_id, source, now_hash FROM docs WHERE doc_id % 13 <> 0 AND NOT (doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0)), n AS (SELECT doc_id, count(*) AS n FROM doc_lines GROUP BY doc_id),
 work AS (SELECT ok.*, n.n, e.entity_id IS NOT NULL AS known, coalesce(e.entity_id, ok.doc_id || ':e1') AS work FROM ok JOIN n USING (doc_id) LEFT JOIN (SELECT e.graph_id, e.entity_id, t.value_str AS title, x.value_str AS kind FROM entities e JOIN facts t ON t.graph_id = e.graph_id AND t.entity_id = e.entity_id AND t.predicate = 'title' AND t.status = 'active'
   JOIN facts x ON x.graph_id = e.graph_id AND x.entity_id = e.entity_id AND x.predicate = 'kind' AND x.status = 'active' WHERE e.status = 'active') e ON e.graph_id = ok.graph_id AND e.title = 'Order ' || ok.doc_id AND (n.n < 2 OR e.kind = 'project')),
 tool AS (SELECT doc_id, graph_id, first_value(doc_id) OVER (PARTITION BY graph_id, source ORDER BY doc_id) || ':e2' AS skill, source FROM ok WHERE source IS NOT NULL)"""


def _applied_whole(k):
    d = k.docs.select("doc_id", "graph_id", "source", "text")
    row = lambda *v: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(v)])
    one, sure = F.lit("e1"), F.lit(0.9)

    def rows(array, *names):
        return d.select(F.col("doc_id").alias("source_id"), F.explode(array).alias("x")).where("x.c2 IS NOT NULL").select("source_id", *[F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)])

    order, at = F.concat(F.lit("Order "), F.col("doc_id").cast("string")), F.col("doc_id") * 10
    # where a document has a source, it is a tool
    tool = lambda *v: F.when(F.col("source").isNotNull(), row(*v))
    entities = rows(F.array(row(one, F.lit("Work"), at), tool(F.lit("e2"), F.lit("Skill"), at + 1)), "ref", "class_type", "ord")
    facts = rows(
        F.array(
            row(one, at, F.lit("Work"), F.lit("title"), order, sure, F.lit("a")), row(one, at + 1, F.lit("Work"), F.lit("kind"), F.lit("project"), sure, F.lit("b")), row(one, at + 2, F.lit("Work"), F.lit("salary"), order, sure, F.lit("a")),
            tool(F.lit("e2"), at + 3, F.lit("Skill"), F.lit("name"), F.col("source"), sure, F.lit("a")), tool(F.lit("e2"), at + 4, F.lit("Skill"), F.lit("kind"), F.lit("tool"), sure, F.lit("c")),
        ), "ref", "ord", "class_type", "predicate", "value_str", "confidence", "claim",
    )
    relations = rows(F.array(tool(at, one, F.lit("usesSkill"), F.lit("e2"), sure, F.lit("b"))), "ord", "subject_ref", "predicate", "object_ref", "confidence", "claim")
    claims = rows(F.array(row(F.lit("a"), F.lit("line:0"), one), row(F.lit("b"), F.lit("line:1"), one), row(F.lit("c"), F.lit("line:2"), one)), "claim", "locator", "of")
    lines = k.doc_lines.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("line:"), "line").alias("locator"), F.col("text").alias("snippet"))
    docs = k.source_documents.select("graph_id", "source_key", F.col("doc_id").alias("source_id"), "processed_hash", "processed_ontology").join(d.select("graph_id", F.col("doc_id").alias("source_id"), "text"), ["graph_id", "source_id"])
    # what no document is about stays as it is
    about = d.select("graph_id").distinct()
    of_entities, of_facts, of_relations, of_keys = (df.join(about, "graph_id", "left_semi") for df in (k.entities, k.facts, k.relations, k.entity_keys))
    stored = {
        "pool": identity.resolution_pool(of_entities, of_facts, of_relations, of_keys), "stale_facts": k.facts.where("false").select("graph_id", "entity_id", "predicate"), "stale_relations": k.relations.where("false").select("graph_id", "subject_id", "predicate"),
        "facts": of_facts.select("graph_id", "entity_id", "predicate", "value_str", "status", (F.col("status") == "active").alias("blocks")), "relations": of_relations.select("graph_id", "subject_id", "predicate", "object_id", "status", (F.col("status") == "active").alias("blocks")),
    }
    return applying.apply_whole(k.graphs.select("graph_id", "version"), docs, k.source_snapshots, {"entities": entities, "facts": facts, "relations": relations, "claims": claims.drop("of")}, lines, stored, store=k.by_graph, place=k.placed_by_graph)


@query(_APPLY + """ SELECT graph_id, work AS entity_id, 'title' AS predicate, 'Order ' || doc_id AS value_str, CASE WHEN known THEN 'reuse' ELSE 'active' END AS decision FROM work UNION ALL SELECT graph_id, work, 'kind', 'project', CASE WHEN known THEN 'reuse' ELSE 'active' END FROM work WHERE n > 1
 UNION ALL SELECT DISTINCT graph_id, skill, 'name', source, 'active' FROM tool UNION ALL SELECT DISTINCT graph_id, skill, 'kind', 'tool', 'active' FROM tool JOIN n USING (doc_id) WHERE n > 2""")
def applied_facts(k):
    return _applied_whole(k)["facts"]


@query(_APPLY + """ SELECT graph_id, 'P:' || graph_id AS subject_id, 'participatedIn' AS predicate, work AS object_id, CASE WHEN known THEN 'reuse' ELSE 'active' END AS decision FROM work UNION ALL SELECT work.graph_id, work, 'usesSkill', skill, 'active' FROM tool JOIN work USING (doc_id) WHERE n > 1""")
def applied_relations(k):
    return _applied_whole(k)["relations"]


@query(_APPLY + """ SELECT d.graph_id, d.source_key, CASE WHEN ok.doc_id IS NOT NULL THEN ok.now_hash ELSE d.processed_hash END AS processed_hash, CASE WHEN ok.doc_id IS NOT NULL THEN '2.1' ELSE d.processed_ontology END AS processed_ontology, (SELECT count(*) FROM ok o WHERE o.graph_id = d.graph_id) AS version FROM source_documents d LEFT JOIN ok ON ok.doc_id = d.doc_id""")
def applied_marks(k):
    out = _applied_whole(k)
    return out["documents"].select("graph_id", "source_key", "processed_hash", "processed_ontology").join(out["graphs"], "graph_id")


@query(_APPLY + """ SELECT code, count(*) AS n FROM (SELECT CASE WHEN d.doc_id % 13 = 0 THEN 'NOT_STORED' ELSE 'ALREADY_PROCESSED' END AS code FROM docs d LEFT JOIN ok USING (doc_id) WHERE ok.doc_id IS NULL UNION ALL SELECT 'INVALID_PROPERTY' FROM ok
 UNION ALL SELECT 'UNSUPPORTED_EVIDENCE' FROM ok JOIN n USING (doc_id) WHERE n < 2 UNION ALL SELECT 'UNSUPPORTED_EVIDENCE' FROM ok JOIN n USING (doc_id) WHERE n < 3) GROUP BY code""")
def applied_issues(k):
    return _applied_whole(k)["issues"].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# Pieces of files: suppliers as styles based on each other, line items as paragraphs and cells
_STYLES = """SELECT s_nationkey % 5 AS file, s_suppkey AS style, CASE WHEN s_acctbal > 0 THEN lag(s_suppkey) OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) ELSE lead(s_suppkey) OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) END AS based_on, CASE WHEN s_acctbal > 8000 THEN s_acctbal END AS left_indent, CASE WHEN s_acctbal < 500 THEN s_acctbal END AS space_before,
  CASE WHEN s_acctbal BETWEEN 3000 AND 4500 THEN s_acctbal END AS space_after, CASE WHEN s_acctbal > 9000 THEN true WHEN s_acctbal < 1000 THEN false END AS keep_with_next FROM supplier"""
_PARAGRAPHS = """SELECT s_nationkey % 5 AS file, l_orderkey, l_linenumber, l_partkey, l_suppkey AS style, CASE WHEN l_discount > 0.07 THEN l_quantity END AS left_indent, CASE WHEN l_tax > 0.06 THEN l_quantity END AS space_before, CAST(NULL AS DOUBLE) AS space_after, CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN true END AS keep_with_next FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


@query(f"""WITH RECURSIVE s AS ({_STYLES}), c(file, style, above, path, left_indent, space_before, space_after, keep_with_next) AS (SELECT file, style, based_on, [style], left_indent, space_before, space_after, keep_with_next FROM s
  UNION ALL SELECT c.file, c.style, s.based_on, list_append(c.path, s.style), coalesce(c.left_indent, s.left_indent), coalesce(c.space_before, s.space_before), coalesce(c.space_after, s.space_after), coalesce(c.keep_with_next, s.keep_with_next) FROM c JOIN s ON s.file = c.file AND s.style = c.above AND NOT list_contains(c.path, s.style)),
 f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file, style ORDER BY len(path) DESC) = 1)
 SELECT l_orderkey, l_linenumber, l_partkey, p.style, coalesce(p.left_indent, f.left_indent) AS left_indent, coalesce(p.space_before, f.space_before) AS space_before, coalesce(p.space_after, f.space_after) AS space_after, coalesce(p.keep_with_next, f.keep_with_next) AS keep_with_next FROM ({_PARAGRAPHS}) p JOIN f USING (file, style)""")
def paragraph_settings(k):
    return pieces.inherited_settings(k.sql(_PARAGRAPHS), k.sql(_STYLES), ["file"]).drop("file")


@query("""SELECT l_orderkey, l_linenumber AS "row", string_agg(p_name, ' | ' ORDER BY position, l_suppkey) AS text FROM (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_extendedprice) AS position, arg_min(CASE WHEN p_size > 45 THEN '' ELSE p_name END, (l_extendedprice, CASE WHEN p_size > 45 THEN '' ELSE p_name END)) AS p_name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) WHERE p_name <> '' GROUP BY ALL""")
def table_lines(k):
    cells = k.lineitem.join(k.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").alias("row"), F.col("l_extendedprice").alias("position"), F.col("l_suppkey").alias("cell"), F.when(F.col("p_size") > 45, "").otherwise(F.col("p_name")).alias("text"))
    return pieces.table_lines(cells, ["l_orderkey"])
