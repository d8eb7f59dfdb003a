"""Generated items against the facts of the entity that each names: issues, normal forms, payloads. Set-based, for all graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import dates, urls

#: What each block looks at besides organisation and period; an optional organisation may be absent, a named entity stands in for one.
BLOCKS = {"Education": (), "Experience": ("kind", "organization optional"), "Activity": ("kind", "role", "own name")}
WORK_KINDS = ("project", "publication", "opensource")


def role_parts(role: Column) -> Column:
    return F.filter(F.transform(F.split(role, r"[,;\n]+"), lambda p: F.trim(p)), lambda p: p != "")


def held_values(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, entity_id): sets of starts and ends in output form, kinds, roles, titles, urls, names, whether current, and the names of its organisations and skills."""
    out = {"starts": "start", "ends": "end", "kinds": "kind", "roles": "role", "titles": "title", "links": "url", "names": "name"}
    shown = F.coalesce(dates.iso_to_output(F.col("value_str")), F.col("value_str"))
    own = facts.groupBy("graph_id", "entity_id").agg(
        *[F.collect_set(F.when(F.col("predicate") == p, shown if p in ("start", "end") else F.col("value_str"))).alias(n) for n, p in out.items()],
        F.coalesce(F.bool_or((F.col("predicate") == "isCurrent") & (F.col("value_str") == "true")), F.lit(False)).alias("current"))
    names = facts.where("predicate = 'name'").select("graph_id", F.col("entity_id").alias("object_id"), F.col("value_str").alias("name"))
    linked = relations.where("predicate IN ('atOrganization', 'usesSkill')").join(names, ["graph_id", "object_id"])
    linked = linked.groupBy("graph_id", F.col("subject_id").alias("entity_id")).agg(
        F.collect_set(F.when(F.col("predicate") == "atOrganization", F.col("name"))).alias("organizations"), F.collect_set(F.when(F.col("predicate") == "usesSkill", F.col("name"))).alias("skills"))
    both = own.join(linked, ["graph_id", "entity_id"], "full")
    none = F.array().cast("array<string>")
    return both.select("graph_id", "entity_id", F.coalesce("current", F.lit(False)).alias("current"), *[F.coalesce(c, none).alias(c) for c in (*out, "organizations", "skills")])


def _has(values: str, value: str) -> Column:
    return F.coalesce(F.array_contains(values, F.col(value)), F.lit(False))


def _listed(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(path).alias("path"), code.alias("code"))) for path, code, bad in checks]))
    return df.select("graph_id", "ordinal", F.explode(found).alias("x")).select("graph_id", "ordinal", "x.*")


def _held(items: DataFrame, held: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    arrays = [c for c in held.columns if c not in ("graph_id", "entity_id", "current")]
    return items.join(held, ["graph_id", "entity_id"], "left").withColumns({c: F.coalesce(c, none) for c in arrays} | {"current": F.coalesce("current", F.lit(False))})


def timeline_issues(items: DataFrame, held: DataFrame) -> DataFrame:
    """(graph_id, ordinal, path, code) for Education, Experience and Activity items.

    items: graph_id, ordinal, block, entity_id, organization, role, kind, start_date, end_date; held: what held_values() gives.
    """
    df = _held(items, held)

    def of(option: str) -> Column:
        return F.col("block").isin(*[b for b, o in BLOCKS.items() if option in o])

    df = df.withColumn("_orgs", F.when(of("own name") & (F.size("organizations") == 0), F.col("names")).otherwise(F.col("organizations")))
    asked = ~(of("organization optional") & F.col("organization").isNull())
    roles = F.flatten(F.transform("roles", role_parts))
    role_held = _has("roles", "role") | ((F.size(role_parts(F.col("role"))) > 0) & (F.size(F.array_except(role_parts(F.col("role")), roles)) == 0))
    present = F.col("end_date") == dates.PRESENT
    checks = [
        ("organization", "ORGANIZATION_NOT_FOUND", asked & (F.size("_orgs") == 0)),
        ("organization", "ORGANIZATION_MISMATCH", asked & (F.size("_orgs") > 0) & ~_has("_orgs", "organization")),
        ("startDate", "START_DATE_UNSUPPORTED", F.col("start_date").isNotNull() & ~_has("starts", "start_date")),
        ("endDate", "PRESENT_WITHOUT_CURRENT", present & ~F.col("current")),
        ("endDate", "END_DATE_UNSUPPORTED", F.col("end_date").isNotNull() & ~present & ~_has("ends", "end_date")),
        ("", "DATE_RANGE_INVALID", dates.inverted(F.col("start_date"), F.col("end_date"))),
        ("kind", "KIND_UNSUPPORTED", of("kind") & F.col("kind").isNotNull() & ~_has("kinds", "kind")),
        ("role", "ROLE_UNSUPPORTED", of("role") & F.col("role").isNotNull() & ~F.coalesce(role_held, F.lit(False))),
    ]
    return _listed(df, [(path, F.concat_ws("_", F.upper("block"), F.lit(code)), F.coalesce(bad, F.lit(False))) for path, code, bad in checks])


def work_issues(items: DataFrame, held: DataFrame) -> DataFrame:
    """(graph_id, ordinal, path, code) for Work items: graph_id, ordinal, entity_id, title, kind, role, skills, links (arrays)."""
    df = _held(items.withColumnsRenamed({"skills": "own_skills", "links": "own_links"}), held)
    checks = [
        ("title", "WORK_TITLE_UNSUPPORTED", ~_has("titles", "title")), ("kind", "WORK_KIND_UNSUPPORTED", ~_has("kinds", "kind")),
        ("role", "WORK_ROLE_UNSUPPORTED", F.col("role").isNotNull() & ~_has("roles", "role")),
        ("skills", "WORK_SKILL_UNSUPPORTED", F.size(F.array_except("own_skills", "skills")) > 0), ("links", "WORK_LINK_UNSUPPORTED", F.size(F.array_except("own_links", "links")) > 0),
    ]
    return _listed(df, [(path, F.lit(code), F.coalesce(bad, F.lit(False))) for path, code, bad in checks])


def normalise_works(items: DataFrame, held: DataFrame) -> DataFrame:
    """Works with evidenced title and kind only; skills and links that facts hold, and the links that items lack after them, sorted."""
    df = _held(items.withColumnsRenamed({"skills": "own_skills", "links": "own_links"}), held)

    def evidenced(value: str, values: str) -> Column:
        return F.when(_has(values, value), F.col(value)).when(F.size(values) == 1, F.get(values, F.lit(0)))

    df = df.withColumns({"title": evidenced("title", "titles"), "kind": evidenced("kind", "kinds")}).where(F.col("title").isNotNull() & F.col("kind").isin(*WORK_KINDS))
    kept = F.array_distinct(F.filter("own_links", lambda u: F.array_contains(F.col("links"), u)))
    missing = F.array_sort(F.array_except("links", kept))
    return df.select("graph_id", "ordinal", "entity_id", "title", "kind", F.when(_has("roles", "role"), F.col("role")).alias("role"),
                     F.filter("own_skills", lambda x: F.array_contains(F.col("skills"), x)).alias("skills"), F.concat(kept, missing).alias("links"))


def normalise_timeline(items: DataFrame, held: DataFrame) -> DataFrame:
    """Timeline items whose organisation the facts hold, or whose only one replaces it; dates, kinds and roles without evidence become null."""
    df = _held(items, held).withColumn("_orgs", F.when((F.col("block") == "Activity") & (F.size("organizations") == 0), F.col("names")).otherwise(F.col("organizations")))
    org = F.when(_has("_orgs", "organization"), F.col("organization")).when(F.size("_orgs") == 1, F.get("_orgs", F.lit(0)))
    end = F.when(F.col("end_date") == dates.PRESENT, F.when(F.col("current"), F.col("end_date"))).when(_has("ends", "end_date"), F.col("end_date")).when(F.size("ends") == 1, F.get("ends", F.lit(0)))
    start = F.when(_has("starts", "start_date"), F.col("start_date")).when(F.size("starts") == 1, F.get("starts", F.lit(0)))
    out = df.withColumns({"organization": org, "start_date": start, "end_date": end, "kind": F.when(_has("kinds", "kind"), F.col("kind")), "role": F.when(_has("roles", "role"), F.col("role"))})
    return out.where(F.col("organization").isNotNull() | (F.col("block") == "Experience")).select(*items.columns)


def normalise_blocks(blocks: DataFrame) -> DataFrame:
    """One About block a graph, the first, or an empty one before all; other blocks only with items. blocks: graph_id, position, type, n_items, description."""
    first = F.row_number().over(Window.partitionBy("graph_id", "type").orderBy("position"))
    kept = blocks.withColumn("_n", first).where("(type = 'About' AND _n = 1) OR (type <> 'About' AND n_items > 0)").drop("_n")
    bare = blocks.select("graph_id").distinct().join(blocks.where("type = 'About'").select("graph_id").distinct(), "graph_id", "left_anti")
    return kept.unionByName(bare.select("graph_id", F.lit(-1).alias("position"), F.lit("About").alias("type"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("description")))


def representative(works: DataFrame, keys: list[str]) -> DataFrame:
    """Of works under the same keys the one that says most: with a description, with a role, of the longest title; the first of equals."""
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    best = F.max_by(F.struct(*[c for c in works.columns if c not in keys]), F.struct(said("description"), said("role"), F.length("title"), -F.col("ordinal")))
    return works.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.*")


def first_distinct(df: DataFrame, keys: list[str], value: str, order: str, most: int) -> DataFrame:
    """The first `most` different values by key in order: keys, value, position."""
    seen = df.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return seen.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", value))).where(F.col("position") <= most).drop("_o")


def scalar_or_list(values: Column) -> Column:
    """JSON text of an array: its only value by itself, or the list."""
    text = F.to_json(values)
    return F.when(F.size(values) == 1, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def payload(fields: dict[str, Column], required: tuple[str, ...] = ()) -> Column:
    """A JSON object without null and empty values, but for required ones, which are null then."""
    parts = []
    for name, value in fields.items():
        body = F.to_json(F.struct(value.alias("v")))
        body = F.substring(body, F.lit(6), F.length(body) - 6)
        empty = value.isNull() | body.isin("", '""', "[]", "{}")
        shown = F.concat(F.lit(f'"{name}":'), body)
        parts.append(F.when(~empty, shown).otherwise(F.lit(f'"{name}":null') if name in required else F.lit(None)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def url_list(values: Column) -> Column:
    """Trimmed values, or null if one of them isn't an http(s) URL with a host."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.when(F.forall(trimmed, lambda v: urls.is_http_url(v)), trimmed)
