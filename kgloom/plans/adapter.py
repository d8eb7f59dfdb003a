"""Knowledge-graph frames derived from the driver's tables, as SQL that Spark and DuckDB both run.

Every frame carries graph_id, so one plan serves all graphs at once.

In Spark the large frames are stored by their numbers, bucketed by graph_id, and their texts (ids, classes) are made where they are read. So what
joins or groups frames by graph_id and more meets within its bucket, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from kgloom.plans.staging import bucketed

TABLES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "documents", "events", "pages")

_FRAMES = {
    "graphs": "SELECT c_custkey AS graph_id, c_custkey AS user_id, 0 AS version FROM customer",
    "owned": """SELECT o_custkey AS graph_id, l_orderkey, l_partkey, l_suppkey, max(1 - l_discount) AS confidence, max(l_linestatus) AS line_status, min(l_returnflag) AS flag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_partkey, l_suppkey""",
    "entities": """SELECT c_custkey AS graph_id, concat('P:', c_custkey) AS entity_id, 'Person' AS class_type, 'active' AS status FROM customer
        UNION ALL SELECT o_custkey, concat('W:', o_orderkey), 'Work', CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'active' END FROM orders
        UNION ALL SELECT DISTINCT graph_id, concat('S:', graph_id, ':', l_partkey), 'Skill', 'active' FROM owned
        UNION ALL SELECT DISTINCT graph_id, concat('O:', graph_id, ':', l_suppkey), 'Organization', 'active' FROM owned""",
    "relations": """SELECT o_custkey AS graph_id, concat('R1:', o_orderkey) AS relation_id, concat('P:', o_custkey) AS subject_id, 'participatedIn' AS predicate, concat('W:', o_orderkey) AS object_id,
          CAST(1 AS DOUBLE) AS confidence, 'active' AS status, 'profile' AS provenance FROM orders
        UNION ALL SELECT graph_id, concat('R2:', l_orderkey, ':', l_partkey), concat('W:', l_orderkey), 'usesSkill', concat('S:', graph_id, ':', l_partkey), max(confidence),
          CASE WHEN max(line_status) = 'O' THEN 'active' ELSE 'candidate' END, CASE WHEN min(flag) = 'N' THEN 'profile' ELSE 'source' END FROM owned GROUP BY graph_id, l_orderkey, l_partkey
        UNION ALL SELECT graph_id, concat('R3:', l_orderkey, ':', l_suppkey), concat('W:', l_orderkey), 'atOrganization', concat('O:', graph_id, ':', l_suppkey), max(confidence),
          CASE WHEN max(line_status) = 'O' THEN 'active' ELSE 'candidate' END, CASE WHEN min(flag) = 'N' THEN 'profile' ELSE 'source' END FROM owned GROUP BY graph_id, l_orderkey, l_suppkey""",
    "facts": """SELECT graph_id, concat('F:', entity_id, ':', predicate) AS fact_id, entity_id, predicate, value_str, status, provenance, updated FROM (
        SELECT c_custkey AS graph_id, concat('P:', c_custkey) AS entity_id, 'name' AS predicate, c_name AS value_str, 'active' AS status, 'profile' AS provenance, c_custkey AS updated FROM customer
        UNION ALL SELECT c_custkey, concat('P:', c_custkey), 'role', CASE c_mktsegment WHEN 'BUILDING' THEN 'Student' WHEN 'MACHINERY' THEN 'Professor' ELSE 'Professional' END, 'active', 'profile', c_custkey FROM customer
        UNION ALL SELECT o_custkey, concat('W:', o_orderkey), 'title', concat('Order ', o_orderkey), CASE WHEN o_orderkey % 7 = 0 THEN 'candidate' ELSE 'active' END, CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'profile' END, o_orderkey FROM orders
        UNION ALL SELECT o_custkey, concat('W:', o_orderkey), 'kind', CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'project' WHEN '2' THEN 'publication' WHEN '3' THEN 'opensource' WHEN '4' THEN 'project' ELSE 'thesis' END, 'active', 'source', o_orderkey FROM orders
        UNION ALL SELECT o_custkey, concat('W:', o_orderkey), 'start', CAST(CAST(o_orderdate AS DATE) AS STRING), 'active', 'source', o_orderkey FROM orders
        UNION ALL SELECT graph_id, concat('S:', graph_id, ':', p_partkey), 'name', p_name, 'active', 'profile', p_partkey FROM (SELECT DISTINCT graph_id, l_partkey FROM owned) o JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT graph_id, concat('S:', graph_id, ':', p_partkey), 'kind', CASE WHEN p_size % 2 = 0 THEN 'tool' ELSE 'method' END, 'active', 'profile', p_partkey FROM (SELECT DISTINCT graph_id, l_partkey FROM owned) o JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT graph_id, concat('S:', graph_id, ':', p_partkey), 'category', CASE p_size % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'database' WHEN 2 THEN 'frontend' WHEN 3 THEN 'backend' ELSE 'unlisted' END, 'active', 'profile', p_partkey FROM (SELECT DISTINCT graph_id, l_partkey FROM owned) o JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT graph_id, concat('O:', graph_id, ':', s_suppkey), 'name', s_name, 'active', 'source', s_suppkey FROM (SELECT DISTINCT graph_id, l_suppkey FROM owned) o JOIN supplier ON l_suppkey = s_suppkey) f""",
    "docs": """SELECT doc_id, doc_id % (SELECT 1 + CAST(floor(count(*) / 4) AS BIGINT) FROM customer) AS graph_id, text, source, {sha}(text{bits}) AS now_hash, {sha}(concat(text, 'v0'){bits}) AS old_hash FROM documents WHERE text IS NOT NULL""",
    "source_documents": """SELECT graph_id, concat('D:', doc_id) AS document_id, doc_id, CASE doc_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'notion' WHEN 2 THEN 'pdf' ELSE 'docx' END AS source_type,
        concat('src:', doc_id) AS source_key, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN old_hash ELSE now_hash END AS processed_hash,
        CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '2.0' ELSE '2.1' END AS processed_ontology FROM docs""",
    "source_snapshots": """SELECT graph_id, concat('src:', doc_id) AS source_key, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE now_hash END AS content_hash, CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE 'success' END AS fetch_status FROM docs""",
    "doc_lines": "{lines}",
    "evidence": """SELECT l.graph_id, concat('E:', l.doc_id, ':', l.line) AS evidence_id, concat('D:', l.doc_id) AS document_id, CASE WHEN l.line % 5 = 4 THEN d.old_hash ELSE d.now_hash END AS content_hash,
        l.text AS snippet, concat('line:', l.line) AS locator, l.doc_id * 1000000 + l.line AS ord FROM doc_lines l JOIN docs d ON l.doc_id = d.doc_id""",
    "evidence_counts": "SELECT graph_id, count(*) AS n FROM evidence GROUP BY graph_id",
    "numbered_evidence": "SELECT graph_id, evidence_id, row_number() OVER (PARTITION BY graph_id ORDER BY ord) - 1 AS rn FROM evidence",
    "numbered_facts": """SELECT f.graph_id, fact_id, row_number() OVER (PARTITION BY f.graph_id ORDER BY fact_id) - 1 AS rn, n FROM facts f JOIN evidence_counts c ON f.graph_id = c.graph_id WHERE provenance = 'source'""",
    "fact_evidence": """SELECT f.graph_id, f.fact_id, e.evidence_id FROM (
        SELECT graph_id, fact_id, rn % n AS at FROM numbered_facts UNION SELECT graph_id, fact_id, (rn + 7) % n FROM numbered_facts) f JOIN numbered_evidence e ON f.graph_id = e.graph_id AND f.at = e.rn""",
    "relation_evidence": """SELECT f.graph_id, f.relation_id, e.evidence_id FROM (
        SELECT r.graph_id, relation_id, ((row_number() OVER (PARTITION BY r.graph_id ORDER BY relation_id) - 1) * 3) % n AS at FROM relations r JOIN evidence_counts c ON r.graph_id = c.graph_id WHERE provenance = 'source') f
        JOIN numbered_evidence e ON f.graph_id = e.graph_id AND f.at = e.rn""",
    "entity_evidence": """SELECT f.graph_id, f.entity_id, e.evidence_id FROM (
        SELECT r.graph_id, entity_id, ((row_number() OVER (PARTITION BY r.graph_id ORDER BY entity_id) - 1) * 5) % n AS at FROM entities r JOIN evidence_counts c ON r.graph_id = c.graph_id WHERE class_type = 'Work') f
        JOIN numbered_evidence e ON f.graph_id = e.graph_id AND f.at = e.rn""",
    "entity_keys": """SELECT o_custkey AS graph_id, concat('W:', o_orderkey) AS entity_id, 'work_url' AS key_type, concat('https://example.org/w/', o_orderkey % 5000) AS key_value, o_orderkey % 3 <> 0 AS is_strong FROM orders""",
    "candidate_facts": """SELECT l_orderkey AS source_id, concat('e', l_linenumber) AS ref, l_orderkey * 10 + l_linenumber AS ord,
        CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'Skill' WHEN l_linenumber % 3 = 1 THEN 'Work' ELSE 'Organization' END AS class_type,
        CASE WHEN l_partkey % 9 = 0 THEN 'salary' WHEN l_linenumber % 3 = 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'kind' ELSE 'title' END ELSE CASE l_partkey % 2 WHEN 0 THEN 'name' ELSE 'kind' END END AS predicate,
        CASE WHEN l_suppkey % 10 = 0 THEN ' ' WHEN l_partkey % 3 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) WHEN l_partkey % 3 = 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Project' WHEN 1 THEN 'tool' ELSE 'Something' END ELSE concat('Part ', l_partkey % 50) END AS value_str,
        1 - l_discount AS confidence FROM lineitem""",
    "candidate_relations": """SELECT l_orderkey AS source_id, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_partkey % 5 = 0 THEN 'self' ELSE concat('e', l_linenumber) END AS subject_ref,
        CASE l_suppkey % 4 WHEN 0 THEN 'usesSkill' WHEN 1 THEN 'atOrganization' WHEN 2 THEN 'participatedIn' ELSE 'knows' END AS predicate, concat('e', 1 + l_suppkey % 5) AS object_ref, 1 - l_tax AS confidence FROM lineitem""",
    "snapshots": """SELECT user_id AS graph_id, event_type AS source_key, event_id, ts AS fetched, CASE WHEN event_type = 'error' OR event_id % 9 = 0 THEN NULL ELSE {sha}(concat('v', event_id % 5){bits}) END AS content_hash FROM events""",
}
_SPARK_LINES = "SELECT graph_id, doc_id, source, pos AS line, col AS text FROM docs LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, col"

_BY_GRAPH = "/*+ REPARTITION({n}, graph_id) */"
_ENTITY = "CASE WHEN kind IN ('S', 'O') THEN concat(kind, ':', graph_id, ':', key) ELSE concat(kind, ':', key) END"
#: Stored in Spark, by numbers: what their frames' texts follow from.
_STORED = {
    "placed": f"SELECT {_BY_GRAPH} o_custkey AS graph_id, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
    "owned": f"""SELECT graph_id, l_orderkey, l_partkey, l_suppkey, max(1 - l_discount) AS confidence, max(l_linestatus) AS line_status, min(l_returnflag) AS flag FROM (
        SELECT {_BY_GRAPH} o_custkey AS graph_id, l_orderkey, l_partkey, l_suppkey, l_discount, l_linestatus, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY graph_id, l_orderkey, l_partkey, l_suppkey""",
    "career_lines": f"""SELECT DISTINCT * FROM (SELECT {_BY_GRAPH} o_custkey AS graph_id, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS kind, l_linenumber AS n, l_partkey AS partkey, l_suppkey AS supp, p_name, p_type, s_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "entity_rows": f"""SELECT {_BY_GRAPH} c_custkey AS graph_id, 'P' AS kind, c_custkey AS key, 'active' AS status FROM customer
        UNION ALL SELECT graph_id, 'W', o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'active' END FROM placed
        UNION ALL SELECT DISTINCT graph_id, 'S', l_partkey, 'active' FROM owned
        UNION ALL SELECT DISTINCT graph_id, 'O', l_suppkey, 'active' FROM owned""",
    "relation_rows": """SELECT graph_id, 'R1' AS kind, o_orderkey AS key, graph_id AS other, CAST(1 AS DOUBLE) AS confidence, 'active' AS status, 'profile' AS provenance FROM placed
        UNION ALL SELECT graph_id, 'R2', l_orderkey, l_partkey, max(confidence), CASE WHEN max(line_status) = 'O' THEN 'active' ELSE 'candidate' END, CASE WHEN min(flag) = 'N' THEN 'profile' ELSE 'source' END FROM owned GROUP BY graph_id, l_orderkey, l_partkey
        UNION ALL SELECT graph_id, 'R3', l_orderkey, l_suppkey, max(confidence), CASE WHEN max(line_status) = 'O' THEN 'active' ELSE 'candidate' END, CASE WHEN min(flag) = 'N' THEN 'profile' ELSE 'source' END FROM owned GROUP BY graph_id, l_orderkey, l_suppkey""",
    "fact_rows": f"""SELECT graph_id, 'P' AS kind, key, x.predicate, x.value_str, 'active' AS status, 'profile' AS provenance FROM (SELECT {_BY_GRAPH} c_custkey AS graph_id, c_custkey AS key, c_name, c_mktsegment FROM customer)
          LATERAL VIEW explode(array(named_struct('predicate', 'name', 'value_str', c_name), named_struct('predicate', 'role', 'value_str', CASE c_mktsegment WHEN 'BUILDING' THEN 'Student' WHEN 'MACHINERY' THEN 'Professor' ELSE 'Professional' END))) AS x
        UNION ALL SELECT graph_id, 'W', o_orderkey, x.predicate, x.value_str, CASE WHEN x.predicate = 'title' AND o_orderkey % 7 = 0 THEN 'candidate' ELSE 'active' END, CASE WHEN x.predicate <> 'title' OR o_orderkey % 2 = 0 THEN 'source' ELSE 'profile' END FROM placed
          LATERAL VIEW explode(array(named_struct('predicate', 'title', 'value_str', concat('Order ', o_orderkey)), named_struct('predicate', 'start', 'value_str', CAST(o_orderdate AS STRING)),
            named_struct('predicate', 'kind', 'value_str', CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'project' WHEN '2' THEN 'publication' WHEN '3' THEN 'opensource' WHEN '4' THEN 'project' ELSE 'thesis' END))) AS x
        UNION ALL SELECT graph_id, 'S', p_partkey, x.predicate, x.value_str, 'active', 'profile' FROM (SELECT {_BY_GRAPH} graph_id, p_partkey, p_name, p_size FROM (SELECT DISTINCT graph_id, l_partkey FROM owned) o JOIN part ON l_partkey = p_partkey)
          LATERAL VIEW explode(array(named_struct('predicate', 'name', 'value_str', p_name), named_struct('predicate', 'kind', 'value_str', CASE WHEN p_size % 2 = 0 THEN 'tool' ELSE 'method' END),
            named_struct('predicate', 'category', 'value_str', CASE p_size % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'database' WHEN 2 THEN 'frontend' WHEN 3 THEN 'backend' ELSE 'unlisted' END))) AS x
        UNION ALL SELECT graph_id, 'O', s_suppkey, 'name', s_name, 'active', 'source' FROM (SELECT {_BY_GRAPH} graph_id, s_suppkey, s_name FROM (SELECT DISTINCT graph_id, l_suppkey FROM owned) o JOIN supplier ON l_suppkey = s_suppkey)""",
    "docs": f"""SELECT {_BY_GRAPH} doc_id, graph_id, text, source, sha2(text, 256) AS now_hash, sha2(concat(text, 'v0'), 256) AS old_hash
        FROM (SELECT doc_id, doc_id % (SELECT 1 + CAST(floor(count(*) / 4) AS BIGINT) FROM customer) AS graph_id, text, source FROM documents WHERE text IS NOT NULL)""",
    "fact_evidence": """SELECT f.graph_id, f.fact_id, e.evidence_id FROM (SELECT graph_id, fact_id, explode(array_distinct(array(rn % n, (rn + 7) % n))) AS at FROM numbered_facts) f JOIN numbered_evidence e ON f.graph_id = e.graph_id AND f.at = e.rn""",
    "relation_evidence": _FRAMES["relation_evidence"],
    "entity_evidence": _FRAMES["entity_evidence"],
}
#: Frames that read what is stored; all others are read from the driver's tables as they are.
_VIEWS = {
    "entities": f"""SELECT graph_id, {_ENTITY} AS entity_id, CASE kind WHEN 'P' THEN 'Person' WHEN 'W' THEN 'Work' WHEN 'S' THEN 'Skill' ELSE 'Organization' END AS class_type, status FROM entity_rows""",
    "relations": """SELECT graph_id, CASE WHEN kind = 'R1' THEN concat('R1:', key) ELSE concat(kind, ':', key, ':', other) END AS relation_id, CASE WHEN kind = 'R1' THEN concat('P:', graph_id) ELSE concat('W:', key) END AS subject_id,
        CASE kind WHEN 'R1' THEN 'participatedIn' WHEN 'R2' THEN 'usesSkill' ELSE 'atOrganization' END AS predicate,
        CASE kind WHEN 'R1' THEN concat('W:', key) WHEN 'R2' THEN concat('S:', graph_id, ':', other) ELSE concat('O:', graph_id, ':', other) END AS object_id, confidence, status, provenance FROM relation_rows""",
    "facts": f"""SELECT graph_id, concat('F:', {_ENTITY}, ':', predicate) AS fact_id, {_ENTITY} AS entity_id, predicate, value_str, status, provenance, key AS updated FROM fact_rows""",
    "entity_keys": _FRAMES["entity_keys"].replace("o_custkey AS graph_id", "graph_id").replace("FROM orders", "FROM placed"),
    "evidence": """SELECT graph_id, concat('E:', doc_id, ':', pos) AS evidence_id, concat('D:', doc_id) AS document_id, CASE WHEN pos % 5 = 4 THEN old_hash ELSE now_hash END AS content_hash, col AS snippet, concat('line:', pos) AS locator, doc_id * 1000000 + pos AS ord
        FROM docs LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, col""",
}
_GRAPHS_A_BUCKET = 2500
_DUCK_LINES = "SELECT graph_id, doc_id, source, line - 1 AS line, text FROM (SELECT graph_id, doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM docs)"


def _needed(sql: str) -> list[str]:
    """The frames that a text uses, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _FRAMES:
            if name not in out and re.search(rf"\b{name}\b", text):
                body = _FRAMES[name] if name != "doc_lines" else _SPARK_LINES
                out.append(name)
                visit(body)

    visit(sql)
    return sorted(out, key=list(_FRAMES).index)


def duck_ctes(sql: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({_FRAMES[n].format(sha='sha256', bits='', lines=_DUCK_LINES)})" for n in _needed(sql)]
    return ", ".join(parts)


def oracle(sql: str) -> str:
    """A query over frames as a whole statement for DuckDB. sql may begin with WITH [RECURSIVE]."""
    ctes = duck_ctes(sql)
    for head in ("WITH RECURSIVE", "WITH"):
        if sql.lstrip().startswith(head):
            body = sql.lstrip()[len(head) :]
            return f"{head} {ctes}, {body}" if ctes else sql
    return f"WITH {ctes} {sql}" if ctes else sql


#: The tables of a data folder's stored frames, by application, and how many buckets they have.
_MADE: dict[tuple[str, str, str], str | int] = {}


class Frames:
    """The frames of one data folder: frames.facts, frames.evidence and so on; base tables likewise. What is stored is made on first use and kept in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # what lies in buckets of graph_id also meets there when it is joined on graph_id and more
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _FRAMES:
            return self.sql(f"SELECT * FROM {name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, make) -> str | int:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _MADE:
            _MADE[key] = make()
        return _MADE[key]

    def _buckets(self) -> int:
        """As many as keep some thousand graphs in each, at any size."""
        return self._once("buckets", lambda: max(4, -(-self.customer.count() // _GRAPHS_A_BUCKET)))

    def by_graph(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back in the frames' buckets of graph_id, so that loops over what came from them keep meeting there. df has to come from frames by joins and groups on graph_id and more."""
        return self.spark.table(bucketed(df, name, self._buckets(), "graph_id"))

    def placed_by_graph(self, df: DataFrame, name: str) -> DataFrame:
        """The same of df in any order, by one shuffle."""
        return self.by_graph(df.repartition(self._buckets(), "graph_id"), name)

    def _body(self, name: str) -> str:
        if name in _STORED:
            return f"SELECT * FROM {self._once(name, lambda: bucketed(self.sql(_STORED[name].replace('{n}', str(self._buckets()))), f'frame_{name}', self._buckets(), 'graph_id'))}"
        if name in TABLES:
            return f"SELECT * FROM parquet.`{self.sf_dir}/{name}.parquet`"
        return _VIEWS.get(name) or _FRAMES[name].format(sha="sha2", bits=", 256", lines=_SPARK_LINES)

    def sql(self, text: str) -> DataFrame:
        """A query over frames and base tables."""
        parts: dict[str, str] = {}

        def visit(body: str) -> None:
            for name in dict.fromkeys((*_FRAMES, *_STORED, *TABLES)):
                if name not in parts and re.search(rf"\b{name}\b", body):
                    own = self._body(name)
                    if name not in _STORED and name not in TABLES:
                        visit(own)
                    parts[name] = f"{name} AS ({own})"

        visit(text)
        return self.spark.sql("WITH " + ", ".join(parts.values()) + " " + text)
