"""Seed graphs and whole-source changes: validation, comparison, rows to store, and what one application of a source does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.plans import ontology
from kgloom.plans.staging import stage

from . import graph_store, incremental, validation


def seed_issues(graphs: DataFrame, entities: DataFrame, facts: DataFrame, relations: DataFrame, version: str = ontology.VERSION) -> DataFrame:
    """(graph_id, code, item) of all that is wrong with seed graphs.

    graphs: graph_id, ontology_version; entities: graph_id, of_graph, entity_id, class_type; facts: graph_id, fact_id, entity_id, predicate, value_type, value_str;
    relations: graph_id, of_graph, relation_id, subject_id, predicate, object_id. A graph of another ontology version gets that one issue only.
    """
    spark = graphs.sparkSession
    known = graphs.where(F.col("ontology_version") == version).select("graph_id")
    entities, facts, relations = (df.join(known, "graph_id", "left_semi") for df in (entities, facts, relations))

    def found(df: DataFrame, code: str | Column, item: str) -> DataFrame:
        code = F.lit(code) if isinstance(code, str) else code
        return df.select("graph_id", code.alias("code"), F.col(item).alias("item")).where("code IS NOT NULL")

    def repeated(df: DataFrame, key: str) -> DataFrame:
        more = df.groupBy("graph_id", key).agg((F.count(F.lit(1)) - 1).cast("int").alias("n")).where("n > 0")
        return found(more.select("graph_id", key, F.explode(F.array_repeat(F.lit(0), F.col("n")))), "DUPLICATE_ID", key)

    people = known.join(entities.groupBy("graph_id").agg(F.count_if(F.col("class_type") == "Person").alias("n")), "graph_id", "left").where("coalesce(n, 0) <> 1")
    first = entities.groupBy("graph_id", "entity_id").agg(F.first("class_type").alias("class_type"))
    types = F.broadcast(ontology.properties(spark).groupBy("class_type", "predicate").agg(F.collect_set("value_type").alias("types")))
    values = F.broadcast(ontology.values(spark).groupBy("class_type", "predicate").agg(F.collect_set("allowed").alias("allowed")))
    f = facts.join(first, ["graph_id", "entity_id"], "left").join(types, ["class_type", "predicate"], "left").join(values, ["class_type", "predicate"], "left")
    typed = f.where("types IS NOT NULL")
    pairs = F.broadcast(ontology.pairs(spark).withColumn("fits", F.lit(True)))
    r = relations
    for side in ("subject", "object"):
        r = r.join(first.select("graph_id", F.col("entity_id").alias(f"{side}_id"), F.col("class_type").alias(f"{side}_class")), ["graph_id", f"{side}_id"], "left")
    r = r.join(pairs, ["predicate", "subject_class", "object_class"], "left")
    out = [
        found(graphs.where(F.col("ontology_version") != version).withColumn("_i", F.lit("")), "UNSUPPORTED_ONTOLOGY_VERSION", "_i"), found(people.withColumn("_i", F.lit("")), "INVALID_PERSON_COUNT", "_i"),
        repeated(entities, "entity_id"), repeated(facts, "fact_id"), repeated(relations, "relation_id"),
        found(entities.where("of_graph <> graph_id"), "GRAPH_MISMATCH", "entity_id"), found(relations.where("of_graph <> graph_id"), "GRAPH_MISMATCH", "relation_id"),
        found(f, F.when(F.col("class_type").isNull(), "MISSING_ENTITY").when(F.col("types").isNull(), "INVALID_PROPERTY"), "fact_id"),
        found(typed, F.when(~F.array_contains("types", F.col("value_type")), "INVALID_VALUE_TYPE"), "fact_id"), found(typed, F.when(F.trim("value_str") == "", "EMPTY_FACT_VALUE"), "fact_id"),
        found(typed, F.when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value_str")), "INVALID_PROPERTY_VALUE"), "fact_id"),
        found(r, F.when(F.col("subject_class").isNull(), "MISSING_ENTITY"), "relation_id"), found(r, F.when(F.col("object_class").isNull(), "MISSING_ENTITY"), "relation_id"),
        found(r, F.when(F.col("subject_class").isNotNull() & F.col("object_class").isNotNull() & F.col("fits").isNull(), "INVALID_RELATION_DIRECTION"), "relation_id"),
    ]
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.union(df)
    return all_


def ensure_seed(stored: DataFrame, seed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(graph_id, action): insert where nothing is stored, reuse where both are equal, else update. Both: graph_id, keys, value."""
    change = incremental.diff(stored, seed, ["graph_id", *keys], value)
    have = stored.select("graph_id").distinct().withColumn("have", F.lit(True))
    per = change.groupBy("graph_id").agg(F.bool_and(F.col("change") == "same").alias("same")).join(have, "graph_id", "left")
    return per.select("graph_id", F.when(F.col("have").isNull(), "insert").when(F.col("same"), "reuse").otherwise("update").alias("action"))


def profile_rows(items: DataFrame) -> DataFrame:
    """Seed items as they are stored: from the profile, active, certain."""
    return items.withColumns({"provenance": F.lit("profile"), "status": F.lit("active"), "confidence": F.lit(1.0)})


def canonical_url_facts(proofs: DataFrame) -> DataFrame:
    """proofs (graph_id, url, work_id): the one Work that a repository proves gets its URL as a fact; several make it ambiguous.

    (graph_id, url, outcome, work_id): added or ambiguous; repositories without a proof are not in it.
    """
    per = proofs.groupBy("graph_id", "url").agg(F.countDistinct("work_id").alias("n"), F.min("work_id").alias("work_id"))
    return per.select("graph_id", "url", F.when(F.col("n") == 1, "added").otherwise("ambiguous").alias("outcome"), F.when(F.col("n") == 1, F.col("work_id")).alias("work_id"))


def affiliated_identity(entities: DataFrame, facts: DataFrame, relations: DataFrame, by_org: dict[str, str]) -> DataFrame:
    """(source_id, ref) of entities that can't be told: without their identity property and, for classes in by_org, without an organisation that can.

    entities: source_id, ref, class_type; facts: source_id, ref, class_type, predicate; relations: source_id, subject_ref, predicate, object_ref; by_org: class to its own identity property.
    """
    base = validation.unidentified(entities.where(~F.col("class_type").isin(*by_org)), facts).select("source_id", "ref")
    rule = F.broadcast(facts.sparkSession.createDataFrame(list(by_org.items()), "class_type string, predicate string"))
    named = facts.join(rule, ["class_type", "predicate"], "left_semi").select("source_id", "ref").distinct()
    org = relations.where("predicate = 'atOrganization'").join(base.withColumnRenamed("ref", "object_ref"), ["source_id", "object_ref"], "left_anti").select("source_id", F.col("subject_ref").alias("ref")).distinct()
    loose = entities.where(F.col("class_type").isin(*by_org)).join(named, ["source_id", "ref"], "left_anti").join(org, ["source_id", "ref"], "left_anti").select("source_id", "ref")
    return base.union(loose)


def apply_sources(facts: DataFrame, relations: DataFrame, claims: DataFrame, evidence: DataFrame, content: DataFrame) -> dict[str, DataFrame]:
    """What sources bring in, checked in order: grounding, rules, identity, merging. One failed part never lets another through.

    facts: candidates as check_facts() takes them, with claim; relations likewise, with claim; claims: source_id, claim, locator. Returns facts, uncertain (facts in conflict), relations and issues.
    """
    sound = validation.grounded(claims, evidence, content)
    bad = sound.where("NOT grounded").select("source_id", "claim")
    checked = validation.check_facts(facts.join(bad, ["source_id", "claim"], "left_anti"))
    known = facts.where("class_type IS NOT NULL").select("source_id", "ref", "class_type").distinct()
    linked = validation.check_relations(relations.join(bad, ["source_id", "claim"], "left_anti"), known)
    lost = validation.unidentified(known, checked.where("issue IS NULL")).select("source_id", "ref")
    kept = validation.merge_facts(checked).join(lost, ["source_id", "ref"], "left_anti")
    edges = validation.merge_relations(linked)
    for end in ("subject_ref", "object_ref"):
        edges = edges.join(lost.withColumnRenamed("ref", end), ["source_id", end], "left_anti")
    issues = (
        bad.select("source_id", F.lit("UNSUPPORTED_EVIDENCE").alias("code")).union(checked.where("issue IS NOT NULL").select("source_id", "issue"))
        .union(linked.where("issue IS NOT NULL").select("source_id", "issue")).union(lost.select("source_id", F.lit("MISSING_IDENTITY")))
        .union(kept.where("uncertain").select("source_id", "ref", "predicate").distinct().select("source_id", F.lit("CONFLICTING_VALUES")))
    )
    return {"facts": kept.where("NOT uncertain"), "uncertain": kept.where("uncertain"), "relations": edges, "issues": issues}


def seed_keys(entities: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, entity_id, key): what tells seed entities of a graph apart across versions, whatever their ids.

    A channel is told by its kind and scope, an organisation by type and name, education and experience by the person's role and their organisation, others by class.
    """
    of = ["graph_id", "entity_id"]
    named = ("kind", "scope", "type", "name", "role")
    v = facts.where(F.col("predicate").isin(*named)).groupBy(*of).agg(*[F.max(F.when(F.col("predicate") == p, F.col("value_str"))).alias(p) for p in named])
    e = entities.select(*of, "class_type").join(v, of, "left")
    role = e.where("class_type = 'Person'").groupBy("graph_id").agg(F.max("role").alias("own_role"))
    orgs = e.where("class_type = 'Organization'").select("graph_id", F.col("entity_id").alias("object_id"), F.to_json(F.struct("type", "name")).alias("org"))
    at = relations.where("predicate = 'atOrganization'").join(orgs, ["graph_id", "object_id"]).groupBy("graph_id", F.col("subject_id").alias("entity_id")).agg(F.max("org").alias("org"))
    e = e.join(role, "graph_id", "left").join(at, of, "left")
    c = F.col("class_type")
    more = (
        F.when(c == "Channel", F.to_json(F.struct("kind", "scope"))).when(c == "Organization", F.to_json(F.struct("type", "name")))
        .when(c.isin("Education", "Experience"), F.to_json(F.struct("own_role", "org"))).otherwise("")
    )
    return e.select(*of, F.concat_ws("|", "class_type", more).alias("key"))


def update_seeds(graphs: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame], others: DataFrame, now) -> dict[str, DataFrame]:
    """Seeds after new profiles: graphs, entities, facts and relations as they are stored then, and the graphs that were refused.

    graphs: graph_id, version, updated. old: entities (graph_id, entity_id, class_type, updated), facts (graph_id, fact_id, entity_id, predicate, value_str, locked, updated) and relations
    (graph_id, relation_id, subject_id, predicate, object_id, locked, updated); new: the same without locked and updated. others: graph_id, entity_id of
    entities that other sources refer to. What is matched keeps its id, its lock and, unchanged, its time; an entity is new where its facts or its
    edges are. A graph with equal content keeps its version, any other goes up by one. Entities that left the profile go too, but for those in others.
    Where two entities have one key, the graph is refused and stays as it was.
    """
    of = ["graph_id", "entity_id"]
    now = F.lit(now)
    # each of these is read several times
    old, new = ({n: stage(df, f"seed-{n}") for n, df in s.items()} for s in (old, new))
    keys = {n: stage(seed_keys(s["entities"], s["facts"], s["relations"]), "seed-keys") for n, s in (("old", old), ("new", new))}
    twice = [k.groupBy("graph_id", "key").count().where("count > 1").select("graph_id") for k in keys.values()]
    refused = stage(twice[0].union(twice[1]).distinct(), "seed-refused")
    touched = stage(new["entities"].select("graph_id").distinct().join(refused, "graph_id", "left_anti"), "seed-touched")

    def taken(df: DataFrame) -> DataFrame:
        return df.join(touched, "graph_id", "left_semi")

    ids = stage(taken(keys["new"]).join(keys["old"].select("graph_id", "key", F.col("entity_id").alias("_old")), ["graph_id", "key"], "left").select(*of, F.coalesce("_old", "entity_id").alias("_id")), "seed-ids")

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids.withColumnRenamed("entity_id", column), ["graph_id", column]).drop(column).withColumnRenamed("_id", column)

    facts = moved(taken(new["facts"]), "entity_id").select("graph_id", "fact_id", "entity_id", "predicate", "value_str")
    before = old["facts"].select("graph_id", "entity_id", "predicate", F.col("fact_id").alias("_fact"), F.col("value_str").alias("_value"), F.col("locked").alias("_locked"), F.col("updated").alias("_updated"))
    facts = facts.join(before, [*of, "predicate"], "left")
    facts = facts.select("graph_id", F.coalesce("_fact", "fact_id").alias("fact_id"), "entity_id", "predicate", "value_str", F.coalesce("_locked", F.lit(False)).alias("locked"), F.when(F.col("value_str") == F.col("_value"), F.col("_updated")).otherwise(now).alias("updated"))
    facts = stage(facts, "seed-facts")
    edge = ["graph_id", "subject_id", "predicate", "object_id"]
    edges = moved(moved(taken(new["relations"]), "subject_id"), "object_id").select(*edge, "relation_id")
    edges = edges.join(old["relations"].select(*edge, F.col("relation_id").alias("_relation"), F.col("locked").alias("_locked"), F.col("updated").alias("_updated")), edge, "left")
    edges = edges.select("graph_id", F.coalesce("_relation", "relation_id").alias("relation_id"), *edge[1:], F.coalesce("_locked", F.lit(False)).alias("locked"), F.coalesce("_updated", now).alias("updated"))
    edges = stage(edges, "seed-edges")

    def content(f: DataFrame, r: DataFrame) -> DataFrame:
        """An entity's facts and edges, one row each."""
        return f.select(*of, F.concat_ws("=", "predicate", "value_str").alias("what")).union(r.select("graph_id", "subject_id", F.concat_ws(">", "predicate", "object_id")))

    was, is_ = taken(content(old["facts"], old["relations"])), content(facts, edges)
    differs = was.exceptAll(is_).select(*of).union(is_.exceptAll(was).select(*of)).distinct().withColumn("_differs", F.lit(True))
    differs = stage(differs, "seed-differs")
    entities = moved(taken(new["entities"]).select(*of, "class_type"), "entity_id").join(old["entities"].select(*of, F.col("updated").alias("_updated")), of, "left").join(differs, of, "left")
    entities = entities.select(*of, "class_type", F.when(F.col("_differs").isNull() & F.col("_updated").isNotNull(), F.col("_updated")).otherwise(now).alias("updated"))
    gone = taken(old["entities"]).join(entities.select(*of), of, "left_anti")
    kept = gone.join(others, of, "left_semi").select(*of, "class_type", "updated")
    changed = differs.select("graph_id").union(gone.select("graph_id")).union(entities.join(old["entities"], of, "left_anti").select("graph_id")).distinct().withColumn("_changed", F.lit(True))
    after = graphs.join(changed, "graph_id", "left").select("graph_id", (F.col("version") + F.coalesce(F.col("_changed").cast("int"), F.lit(0))).alias("version"), F.when(F.col("_changed"), now).otherwise(F.col("updated")).alias("updated"))

    def rest(df: DataFrame) -> DataFrame:
        return df.join(touched, "graph_id", "left_anti")

    return {
        "graphs": after, "entities": entities.unionByName(kept).unionByName(rest(old["entities"]).select(*of, "class_type", "updated")), "facts": facts.unionByName(rest(old["facts"]).select(*facts.columns)),
        "relations": edges.unionByName(rest(old["relations"]).select(*edges.columns)), "refused": refused,
    }


def block_shape_issues(blocks: DataFrame) -> DataFrame:
    """(graph_id, position, code): exactly one About block, and no other without items. blocks: graph_id, position, type, n_items; graphs without blocks aren't in it."""
    n = blocks.where("type = 'About'").groupBy("graph_id").agg(F.min("position").alias("first"))
    df = blocks.join(n, "graph_id", "left")
    missing = df.where("first IS NULL").select("graph_id").distinct().select("graph_id", F.lit(None).cast(blocks.schema["position"].dataType).alias("position"), F.lit("MISSING_ABOUT_BLOCK").alias("code"))
    code = F.when((F.col("type") == "About") & (F.col("position") > F.col("first")), "DUPLICATE_ABOUT_BLOCK").when((F.col("type") != "About") & (F.col("n_items") == 0), "EMPTY_BLOCK")
    return missing.union(df.select("graph_id", "position", code.alias("code")).where("code IS NOT NULL"))


def first_available(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """wanted (key) plus image: from the first source (key, image) that has one."""
    out = wanted
    for i, s in enumerate(sources):
        out = out.join(s.select("key", F.col("image").alias(f"_{i}")), "key", "left")
    return out.select("key", F.coalesce(*[F.col(f"_{i}") for i in range(len(sources))]).alias("image"))


def link_jobs(items: DataFrame, least: int = 2) -> DataFrame:
    """(graph_id, class_type, n_new, n) worth judging: something new, and something to compare it with. items: graph_id, class_type, id, is_new."""
    per = items.groupBy("graph_id", "class_type").agg(F.count_if("is_new").alias("n_new"), F.count(F.lit(1)).alias("n"))
    return per.where((F.col("n_new") > 0) & (F.col("n") >= least))


def readme_supplements(repositories: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(repo, content): READMEs that say too little, of the first `most` repositories of an owner, with their chosen files after them.

    repositories: owner, repo, ord, readme; files: repo, position, path, text.
    """
    from kgloom.sources.repositories import readme_insufficient

    poor = graph_store.latest(repositories.where(readme_insufficient(F.col("readme"))), ["owner", "repo"], ["ord"])
    chosen = poor.withColumn("_n", F.row_number().over(graph_store.Window.partitionBy("owner").orderBy("ord", "repo"))).where(F.col("_n") <= most)
    added = files.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("position", F.concat_ws("\n", "path", "text").alias("t")))).alias("f"))
    whole = F.concat_ws("\n\n", F.nullif("readme", F.lit("")), F.array_join(F.transform("f", lambda x: x["t"]), "\n\n"))
    return chosen.join(added, "repo").select("repo", whole.alias("content"))


def page_image(blocks: DataFrame) -> DataFrame:
    """(page, image): the first picture in reading order that stands under no excluded section and isn't a mere badge.

    blocks: page, ord, level (of a heading), text, image.
    """
    from kgloom.operators import documents

    outline = documents.section_path(blocks, ["page"], "ord", "level", "text")
    bad = F.col("section_path").rlike(f"(?i){EXCLUDED_SECTIONS}")
    good = outline.where(F.col("image").isNotNull() & ~bad & ~F.lower("image").rlike(r"badge|avatar|\.svg"))
    return good.groupBy("page").agg(F.min_by("image", "ord").alias("image"))


#: Fixed value: words in the names of sections whose pictures don't show a work.
EXCLUDED_SECTIONS = "award|honor|certif|license|about|intro|profile|수상|상장|자격|소개|프로필"
