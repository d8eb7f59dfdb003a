"""Row validation: each candidate gets the first rule it breaks, and is accepted or reported, never both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import dates, urls
from kgloom.plans import ontology

from .graph_store import first_matching


def check_facts(candidates: DataFrame) -> DataFrame:
    """candidates: source_id, ref, ord, class_type, predicate, value_str, confidence; adds issue and the normalised value.

    Codes: SELF_FACT, MISSING_ENTITY, INVALID_PROPERTY, INVALID_VALUE, INVALID_PROPERTY_VALUE.
    """
    spark = candidates.sparkSession
    props = ontology.properties(spark).groupBy("class_type", "predicate").agg(F.collect_set("value_type").alias("types"))
    allowed = ontology.values(spark).groupBy("class_type", "predicate").agg(F.collect_set("allowed").alias("allowed"))
    df = candidates.join(F.broadcast(props), ["class_type", "predicate"], "left").join(F.broadcast(allowed), ["class_type", "predicate"], "left")
    v = F.col("value_str")
    has = lambda t: F.array_contains("types", t)
    blank = F.coalesce(F.trim(v) == "", F.lit(True))
    wellformed = ~blank & (has("string") | (has("date") & dates.is_iso_date(v)) | (has("uri") & urls.is_http_url(v)) | (has("boolean") & v.isin("true", "false")))
    folded = F.regexp_replace(F.lower(F.trim(v)), r"\s+", "_")
    fitting = F.filter("allowed", lambda a: F.lower(a) == folded)
    df = df.withColumn("value", F.when(F.size("allowed") > 0, F.get(fitting, F.lit(0))).otherwise(v))
    return first_matching(df, [
        ("SELF_FACT", F.col("ref") == "self"),
        ("MISSING_ENTITY", F.col("class_type").isNull()),
        ("INVALID_PROPERTY", F.col("types").isNull()),
        ("INVALID_VALUE", ~wellformed),
        ("INVALID_PROPERTY_VALUE", F.col("allowed").isNotNull() & F.col("value").isNull()),
    ]).drop("types", "allowed")


def check_relations(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds issue: MISSING_ENTITY, INVALID_RELATION or INVALID_RELATION_DIRECTION. classes: source_id, ref, class_type; `self` is the Person."""
    spark = candidates.sparkSession
    pairs = ontology.pairs(spark)
    known = pairs.select("predicate").distinct().withColumn("known", F.lit(True))
    df = candidates
    for side in ("subject", "object"):
        c = classes.select("source_id", F.col("ref").alias(f"{side}_ref"), F.col("class_type").alias(f"{side}_found"))
        df = df.join(c, ["source_id", f"{side}_ref"], "left").withColumn(f"{side}_class", F.when(F.col(f"{side}_ref") == "self", "Person").otherwise(F.col(f"{side}_found"))).drop(f"{side}_found")
    df = df.join(F.broadcast(known), "predicate", "left").join(F.broadcast(pairs.withColumn("fits", F.lit(True))), ["predicate", "subject_class", "object_class"], "left")
    return first_matching(df, [
        ("MISSING_ENTITY", F.col("subject_class").isNull() | F.col("object_class").isNull()),
        ("INVALID_RELATION", F.col("known").isNull()),
        ("INVALID_RELATION_DIRECTION", F.col("fits").isNull()),
    ]).drop("known", "fits")


def merge_facts(checked: DataFrame) -> DataFrame:
    """Accepted facts, one per (source, ref, predicate, value): highest confidence, first of equals; uncertain where a single-valued property has several values."""
    ok = checked.where("issue IS NULL")
    best = ok.groupBy("source_id", "ref", "class_type", "predicate", "value").agg(F.max_by("ord", F.struct("confidence", -F.col("ord"))).alias("ord"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    multi = F.lit(False)
    for c, p in ontology.MULTI_VALUED:
        multi = multi | ((F.col("class_type") == c) & (F.col("predicate") == p))
    several = F.count(F.lit(1)).over(Window.partitionBy("source_id", "ref", "predicate")) > 1
    return best.withColumn("uncertain", ~multi & several)


def merge_relations(checked: DataFrame) -> DataFrame:
    return checked.where("issue IS NULL").groupBy("source_id", "subject_ref", "predicate", "object_ref").agg(F.max_by("ord", F.struct("confidence", -F.col("ord"))).alias("ord"), F.max("confidence").alias("confidence"))


def duplicate_refs(entities: DataFrame) -> DataFrame:
    """Every occurrence of a reference that a source uses more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id", "ref"))
    return entities.withColumn("n_ref", n).where("n_ref > 1")


def unidentified(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities of classes with identity properties that have none of them."""
    keys = facts.sparkSession.createDataFrame([(c, p) for c, ps in ontology.IDENTITY.items() for p in ps], "class_type string, predicate string")
    having = facts.join(F.broadcast(keys), ["class_type", "predicate"], "left_semi").select("source_id", "ref").distinct()
    return entities.join(F.broadcast(keys.select("class_type").distinct()), "class_type", "left_semi").join(having, ["source_id", "ref"], "left_anti")


def grounded(claims: DataFrame, evidence: DataFrame, content: DataFrame, *document: str) -> DataFrame:
    """claims (source_id, claim, locator): a claim is grounded if every locator is a candidate's whose snippet is in the content.

    document: columns, besides source_id, by which evidence finds its own content.
    """
    usable = evidence.join(content, [*document] or "source_id").where(F.contains("content", "snippet")).select("source_id", "locator").distinct().withColumn("found", F.lit(True))
    return claims.join(usable, ["source_id", "locator"], "left").groupBy("source_id", "claim").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("grounded"))


def same_members(asked: DataFrame, held: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, equal): whether both sides have the same members under a key."""
    a, b = (df.select(*keys, member).distinct().withColumn(name, F.lit(True)) for df, name in ((asked, "_a"), (held, "_b")))
    return a.join(b, [*keys, member], "full").groupBy(*keys).agg(F.bool_and(F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False))).alias("equal"))


def apply_precondition(documents: DataFrame, snapshots: DataFrame, version: str) -> DataFrame:
    """documents (graph_id, source_key, processed_hash, processed_ontology, text) plus issue: why a source can't be applied now; null if it can."""
    s = snapshots.where("fetch_status = 'success' AND content_hash IS NOT NULL").select("graph_id", "source_key", "content_hash")
    known = F.col("content_hash").isNotNull()
    issue = (
        F.when(~known, "NOT_STORED").when(F.sha2("text", 256) != F.col("content_hash"), "HASH_MISMATCH")
        .when((F.col("processed_hash") == F.col("content_hash")) & (F.col("processed_ontology") == version), "ALREADY_PROCESSED")
    )
    return documents.join(s, ["graph_id", "source_key"], "left").withColumn("issue", issue)


def credential_works(facts: DataFrame) -> DataFrame:
    """(source_id, ref) of Works whose kind, as it was said, is a Credential's."""
    kinds = ontology.VALUES["Credential", "kind"]
    said = F.array_join(F.filter(F.split(F.lower("value_str"), r"\s+"), lambda w: w != ""), "_")
    return facts.where((F.col("class_type") == "Work") & (F.col("predicate") == "kind") & said.isin(*kinds)).select("source_id", "ref").distinct()
