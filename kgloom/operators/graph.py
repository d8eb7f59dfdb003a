"""Reachability and induced subgraphs, for all graphs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.plans import ontology

#: Words in a requirement that ask for a class of content.
TERMS = {
    "Work": ("프로젝트", "작업", "project", "work"), "Skill": ("기술", "스킬", "기술스택", "skill", "stack"), "Experience": ("경력", "경험", "career", "experience"),
    "Activity": ("활동", "대외활동", "동아리", "봉사", "프로그램", "발표", "activity", "activities"), "Education": ("학력", "교육", "전공", "education"),
    "Credential": ("수상", "자격", "credential", "award", "certification"),
}


def requested_classes(text: Column) -> Column:
    """array<string> of the classes whose terms occur in a requirement, as plain substrings."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in ts]), c) for c, ts in TERMS.items()]), lambda c: c.isNotNull())


def traversable(requested: tuple[str, ...] = ()) -> list[str]:
    content = set(requested) or set(ontology.CONTENT)
    return sorted(content | set(ontology.CONTEXT) | ({"Work", "Experience"} if "Skill" in content else set()))


def reachable(entities: DataFrame, relations: DataFrame, requested: tuple[str, ...] = (), max_rounds: int = 32, store=None) -> DataFrame:
    """(graph_id, entity_id) reachable from Persons along edge direction through allowed classes.

    A breadth-first loop: each round joins only the frontier and drops what was
    seen, so cycles end it. Rounds are as many as the longest shortest path,
    at most three under the ontology's relation pairs. store(df, name) writes a round and reads it back; plain files unless given.
    """
    if store is None:
        from kgloom.plans.staging import stage as store

    allowed = entities.where(F.col("class_type").isin(*traversable(requested))).select("graph_id", F.col("entity_id").alias("object_id"))
    edges = store(relations.select("graph_id", "subject_id", "object_id").join(allowed, ["graph_id", "object_id"], "left_semi").distinct(), "edges")
    frontier = store(entities.where("class_type = 'Person'").select("graph_id", "entity_id").distinct(), "frontier")
    seen = frontier
    for _ in range(max_rounds):
        step = edges.join(frontier.withColumnRenamed("entity_id", "subject_id"), ["graph_id", "subject_id"], "left_semi").select("graph_id", F.col("object_id").alias("entity_id")).distinct()
        frontier = store(step.join(seen, ["graph_id", "entity_id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = store(seen.union(frontier), "seen")
    raise RuntimeError(f"paths are longer than {max_rounds}")


def induced(relations: DataFrame, kept: DataFrame) -> DataFrame:
    for end in ("subject_id", "object_id"):
        relations = relations.join(kept.select("graph_id", F.col("entity_id").alias(end)), ["graph_id", end], "left_semi")
    return relations


def add_ownership(entities: DataFrame, relations: DataFrame, owner: dict[str, str]) -> DataFrame:
    """Missing edges from the Person to entities of the given classes; a Skill that something uses is left out."""
    rule = entities.sparkSession.createDataFrame(list(owner.items()), "class_type string, predicate string")
    person = entities.where("class_type = 'Person'").select("graph_id", F.col("entity_id").alias("subject_id"))
    wanted = entities.join(F.broadcast(rule), "class_type").join(person, "graph_id").select("graph_id", "subject_id", "predicate", F.col("entity_id").alias("object_id"), "class_type")
    used = relations.where("predicate = 'usesSkill'").select("graph_id", "object_id").distinct().withColumn("used", F.lit(True))
    return (
        wanted.join(relations.select("graph_id", "subject_id", "predicate", "object_id"), ["graph_id", "subject_id", "predicate", "object_id"], "left_anti")
        .join(used, ["graph_id", "object_id"], "left").where("class_type <> 'Skill' OR used IS NULL").select("graph_id", "subject_id", "predicate", "object_id").withColumn("confidence", F.lit(0.55))
    )


def missing_children(blocks: DataFrame) -> DataFrame:
    """blocks: page, id, children. Ids that are referred to but absent, by page."""
    named = blocks.select("page", F.explode("children").alias("id")).distinct()
    return named.join(blocks.select("page", "id"), ["page", "id"], "left_anti")


def walk(blocks: DataFrame, roots: DataFrame, max_depth: int = 50) -> DataFrame:
    """Depth-first order of block trees: (page, id, depth, path). Child pages aren't entered; a repeated id keeps its first place. Deeper trees are an error."""
    from kgloom.plans.staging import stage

    kids = blocks.select("page", F.col("id").alias("parent"), "kind", F.posexplode("children").alias("n", "id"))
    kinds = blocks.select("page", "id", "kind")
    level = stage(roots.select("page", "id", F.array().cast("array<int>").alias("path")), "walk")
    out = level
    for _ in range(max_depth):
        nxt = level.join(kinds, ["page", "id"]).where((F.col("kind") != "page") | (F.size("path") == 0)).select("page", F.col("id").alias("parent"), "path")
        nxt = nxt.join(kids, ["page", "parent"]).select("page", "id", F.array_append("path", F.col("n")).alias("path")).join(kinds.select("page", "id"), ["page", "id"], "left_semi")
        level = stage(nxt.join(out.select("page", "id"), ["page", "id"], "left_anti"), "walk")
        if level.isEmpty():
            break
        out = out.union(level)
    else:
        raise RuntimeError(f"blocks are nested deeper than {max_depth}")
    return out.groupBy("page", "id").agg(F.min("path").alias("path")).withColumn("depth", F.size("path"))
