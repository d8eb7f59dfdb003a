"""Freshness, provenance, staleness and status decisions over the evidence-backed store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def current_links(links: DataFrame, evidence: DataFrame, documents: DataFrame, source_keys: list[str] | None = None) -> DataFrame:
    """Links whose evidence is of the version its document was last processed at. None: all sources; an empty list: none."""
    docs = documents if source_keys is None else documents.where(F.col("source_key").isin(*source_keys) if source_keys else F.lit(False))
    now = evidence.join(docs.select("graph_id", "document_id", "processed_hash"), ["graph_id", "document_id"]).where(F.col("content_hash") == F.col("processed_hash"))
    return links.join(now.select("graph_id", "evidence_id", "snippet", "locator", "document_id"), ["graph_id", "evidence_id"])


def _supported(items: DataFrame, key: str, links: DataFrame) -> DataFrame:
    n = links.groupBy("graph_id", key).agg(F.count(F.lit(1)).alias("n_evidence"))
    return items.join(n, ["graph_id", key], "left").where((F.col("provenance") == "profile") | ((F.col("provenance") == "source") & F.col("n_evidence").isNotNull())).withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def active_facts(entities: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """Active facts of active entities that the profile or current evidence supports."""
    alive = entities.where("status = 'active'").select("graph_id", "entity_id")
    return _supported(facts.where("status = 'active'").join(alive, ["graph_id", "entity_id"], "left_semi"), "fact_id", links)


def active_relations(entities: DataFrame, relations: DataFrame, links: DataFrame) -> DataFrame:
    alive = entities.where("status = 'active'").select("graph_id", "entity_id")
    kept = relations.where("status = 'active'")
    for end in ("subject_id", "object_id"):
        kept = kept.join(alive.select("graph_id", F.col("entity_id").alias(end)), ["graph_id", end], "left_semi")
    return _supported(kept, "relation_id", links)


def stale_keys(items: DataFrame, key: str, group: list[str], links: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Keys whose item has evidence of a superseded version and none that still holds."""
    e = evidence.join(documents.select("graph_id", "document_id", "processed_hash"), ["graph_id", "document_id"])
    holds = F.coalesce(F.col("content_hash") == F.col("processed_hash"), F.lit(False))
    judged = links.join(e.select("graph_id", "evidence_id", holds.alias("holds")), ["graph_id", "evidence_id"]).groupBy("graph_id", key).agg(F.bool_or(~F.col("holds")).alias("old"), F.bool_or("holds").alias("held"))
    return items.join(judged.where("old AND NOT held"), ["graph_id", key]).select("graph_id", *group).distinct()


def decide(candidates: DataFrame, existing: DataFrame, stale: DataFrame, multi: list[str], key: list[str], value: str) -> DataFrame:
    """What becomes of each candidate: reuse, promote, active or candidate.

    existing: key, value, status, blocks (active, and by profile or current evidence). All are judged
    against the state as loaded, so candidates of one batch don't see each other but for equal values.
    """
    once = candidates.groupBy(*key, value).agg(F.max("forced").alias("forced"))
    state = existing.groupBy(*key).agg(F.count_if("blocks").alias("n_blocks"))
    same = existing.groupBy(*key, value).agg(F.max("status").alias("same_status"), F.min("status").alias("least_status"), F.count_if("blocks").alias("own_blocks"))
    out = once.join(state, key, "left").join(same, [*key, value], "left").join(stale.withColumn("is_stale", F.lit(True)), key, "left")
    others = F.coalesce("n_blocks", F.lit(0)) - F.coalesce("own_blocks", F.lit(0))
    open_ = F.col(key[-1]).isin(*multi) | (others == 0) | F.coalesce("is_stale", F.lit(False))
    is_new = F.col("same_status").isNull()
    decision = (
        F.when(~is_new & (F.col("least_status") == "active"), "reuse").when(~is_new & ~F.col("forced") & (F.col(key[-1]).isin(*multi) | (others == 0)), "promote").when(~is_new, "reuse")
        .when(F.col("forced"), "candidate").when(open_, "active").otherwise("candidate")
    )
    return out.select(*key, value, decision.alias("decision"))


def nested_graph(graphs: DataFrame, entities: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per graph with ordered arrays of its items; empty arrays, never null."""
    def nest(df, key, name, cols):
        return df.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(key, *cols))).alias(name))

    out = graphs
    for df, key, name, cols in ((entities, "entity_id", "entities", ["class_type"]), (facts, "fact_id", "facts", ["entity_id", "predicate", "value_str"]), (relations, "relation_id", "relations", ["subject_id", "predicate", "object_id"])):
        nested = nest(df, key, name, cols)
        out = out.join(nested, "graph_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def nested_evidence(graphs: DataFrame, entities: DataFrame, facts: DataFrame, relations: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """One row per graph: entities, facts and relations in the order of their ids, each with its evidence in the order of evidence ids.

    links: current_links() for "entities", "facts" and "relations". Facts and relations from sources stand only with current evidence, those of the profile also without; only works and
    activities show evidence of their own. Both levels are aggregated on the key of what they belong to before they are joined; nothing is null, arrays may be empty.
    """
    alive = entities.where("status = 'active'")
    kept = {"entities": alive, "facts": active_facts(entities, facts, links["facts"]), "relations": active_relations(entities, relations, links["relations"])}
    shown = {"entities": ("entity_id", ["class_type", "status"]), "facts": ("fact_id", ["entity_id", "predicate", "value_str"]), "relations": ("relation_id", ["subject_id", "predicate", "object_id"])}
    out = graphs.select("graph_id")
    for name, (key, cols) in shown.items():
        items = links[name].groupBy("graph_id", key).agg(F.sort_array(F.collect_list(F.struct("evidence_id", "document_id", "locator", "snippet"))).alias("evidence"))
        df = kept[name].join(items, ["graph_id", key], "left")
        cites = F.col("class_type").isin("Work", "Activity") if name == "entities" else F.lit(True)
        none = F.array().cast(items.schema["evidence"].dataType)
        df = df.withColumn("evidence", F.when(cites, F.coalesce("evidence", none)).otherwise(none))
        nested = df.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(key, *cols, "evidence"))).alias(name))
        out = out.join(nested, "graph_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def orphans(entities: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that no fact and no relation refers to."""
    out = entities.join(facts, ["graph_id", "entity_id"], "left_anti")
    for end in ("subject_id", "object_id"):
        out = out.join(relations.select("graph_id", F.col(end).alias("entity_id")), ["graph_id", "entity_id"], "left_anti")
    return out


def first_matching(df: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """df with `issue`: the code of the first failing rule, or null."""
    issue = None
    for code, fails in rules:
        issue = F.when(fails, code) if issue is None else issue.when(fails, code)
    return df.withColumn("issue", issue)


def violations(graphs: DataFrame, entities: DataFrame, relations: DataFrame, keys: DataFrame, documents: DataFrame, snapshots: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(code, n) of integrity constraints; each would be empty in a sound store."""
    def count(code, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")

    ends = relations.select("graph_id", F.col("subject_id").alias("entity_id")).union(relations.select("graph_id", "object_id"))
    parts = [
        count("C1", graphs.groupBy("user_id").count().where("count > 1")),
        count("C2", entities.where("class_type = 'Person' AND status = 'active'").groupBy("graph_id").count().where("count > 1")),
        count("C3", keys.where("is_strong").groupBy("graph_id", "key_type", "key_value").count().where("count > 1")),
        count("C4", ends.join(entities, ["graph_id", "entity_id"], "left_anti")),
        count("C5", evidence.join(documents, ["graph_id", "document_id"], "left_anti")),
        count("C6", links.join(evidence, ["graph_id", "evidence_id"], "left_anti")),
        count("C7", snapshots.where("fetch_status = 'success' AND content_hash IS NULL")),
        count("C10", documents.where("processed_ontology IS NOT NULL AND processed_hash IS NULL")),
        count("C12", relations.where("confidence < 0 OR confidence > 1 OR trim(predicate) = '' OR status NOT IN ('active', 'candidate', 'retracted')")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
