"""Order-dependent folds of generated items, one graph at a time, and set-based checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import dates, titles
from kgloom.operators.folds import fold_by


def works_compatible(kinds: Column, periods: Column) -> Column:
    """Publications mix only with publications, and periods overlap."""
    known = F.array_distinct(F.filter(kinds, lambda k: k.isNotNull()))
    mixed = F.array_contains(known, "publication") & (F.size(known) > 1)
    return ~mixed & dates.periods_overlap(periods)


def at_most_one(values: Column) -> Column:
    """No two values that differ after folding case and white space."""
    return F.size(F.array_distinct(F.transform(values, lambda v: F.lower(F.regexp_replace(F.trim(v), r"\s+", " "))))) <= 1


def generic_participation(role: Column, text: Column) -> Column:
    """Without a role, a text that only says that someone took part, and not what they made."""
    took_part = text.rlike(r"(?i)(participat\w*|참여|수행).{0,24}(project|프로젝트)|(project|프로젝트).{0,24}(participat\w*|참여|수행)")
    made = text.rlike(r"(?i)(built|develop|implement|design|구현|개발|설계|제작)")
    return (F.coalesce(F.trim(role), F.lit("")) == "") & took_part & ~made


def evidenced_end(value: Column, ends: Column, current: Column) -> Column:
    """Present only while a fact says so; otherwise a value the facts hold, or their only one."""
    return F.when(value == dates.PRESENT, F.when(F.coalesce(current, F.lit(False)), value)).when(F.array_contains(ends, value), value).when(F.size(ends) == 1, F.get(ends, F.lit(0)))


def timeline_dedupe(items: DataFrame) -> DataFrame:
    """Merges each item into the first earlier one of the same identity. items: graph_id, ordinal, entity_id, org, role, start, end.

    Identity: one entity, or one organisation and role with periods that may overlap. The merged item takes what it lacks; its entity is the one
    that covers more: longer span, more dates, more fields.
    """
    def span(x) -> tuple:
        return (int(bool(x["start"] and x["end"])), sum(bool(x[f]) for f in ("start", "end")), sum(bool(x[f]) for f in ("org", "role")), len(x["org"] or ""))

    def overlap(a, b) -> bool:
        return not ((a["start"] and b["end"] and a["start"] > b["end"]) or (b["start"] and a["end"] and b["start"] > a["end"]))

    def fold(rows: list[dict]) -> list[tuple]:
        out: list[dict] = []
        for row in rows:
            for have in out:
                if have["entity_id"] == row["entity_id"] or (have["org"] and have["org"] == row["org"] and have["role"] == row["role"] and overlap(have, row)):
                    best = have if span(have) >= span(row) else row
                    have.update({f: have[f] or row[f] for f in ("org", "role", "start", "end")} | {"entity_id": best["entity_id"]})
                    break
            else:
                out.append(row)
        return [tuple(r.values()) for r in out]

    return fold_by(items, "graph_id", [F.col("ordinal").asc_nulls_last()], fold, items.schema)


def work_dedupe(items: DataFrame) -> DataFrame:
    """Works that are one entity, or of one kind with a common URL, become the first of them, with all URLs. items: graph_id, ordinal, entity_id, kind, urls."""
    def fold(rows: list[dict]) -> list[tuple]:
        out: list[dict] = []
        for row in rows:
            for have in out:
                if have["entity_id"] == row["entity_id"] or (have["kind"] == row["kind"] and set(have["urls"]) & set(row["urls"])):
                    have["urls"] = list(dict.fromkeys(have["urls"] + row["urls"]))
                    break
            else:
                out.append(row)
        return [tuple(r.values()) for r in out]

    return fold_by(items, "graph_id", [F.col("ordinal").asc_nulls_last()], fold, items.schema)


def absorb_activities(activities: DataFrame, works: DataFrame, pairs: DataFrame) -> DataFrame:
    """activities plus the first work (by ordinal) of the same graph that each is alike; pairs: what resolution.similar_title_pairs() gives over both."""
    equal = pairs.where("equal").select("graph_id", F.col("b").alias("entity_id"), F.col("a").alias("rep"))

    def named(items: DataFrame) -> DataFrame:
        return items.join(equal, ["graph_id", "entity_id"], "left").withColumn("rep", F.coalesce("rep", "entity_id"))

    best = named(works).groupBy("graph_id", F.col("rep").alias("like")).agg(F.min(F.struct("ordinal", "entity_id")).alias("best"))
    near = pairs.where("NOT equal")
    # one join for each way to be alike: a union would lose the buckets
    out = named(activities).join(best.select("graph_id", F.col("like").alias("rep"), F.col("best").alias("_own")), ["graph_id", "rep"], "left")
    for end, other in ("ab", "ba"):
        first = near.select("graph_id", F.col(end).alias("rep"), F.col(other).alias("like")).join(best, ["graph_id", "like"]).groupBy("graph_id", "rep").agg(F.min("best").alias(f"_{end}"))
        out = out.join(first, ["graph_id", "rep"], "left")
    return out.withColumn("absorbed_by", F.least("_own", "_a", "_b")["entity_id"]).drop("rep", "_own", "_a", "_b")


def absorb_by_title(items: DataFrame) -> DataFrame:
    """(graph_id, entity_id, absorbed_by) of items (graph_id, entity_id, title, ordinal, is_work) that are no works: absorb_activities() by their titles, in one pass."""
    def place(r: dict) -> tuple:
        return (r["ordinal"] is not None, r["ordinal"], r["entity_id"])

    def fold(rows: list[dict]) -> list[tuple]:
        heads, near = titles.met((r["entity_id"], r["title"]) for r in rows)
        best: dict = {}
        for r in rows:
            if r["is_work"]:
                head = heads.get(r["entity_id"], r["entity_id"])
                best[head] = min(best.get(head, place(r)), place(r))
        out = []
        for r in rows:
            if not r["is_work"]:
                head = heads.get(r["entity_id"], r["entity_id"])
                found = [best[h] for h in (head, *near.get(head, ())) if h in best]
                out.append((r["graph_id"], r["entity_id"], min(found)[2] if found else None))
        return out

    return fold_by(items, "graph_id", ["entity_id"], fold, "graph_id bigint, entity_id string, absorbed_by string")


def merge_chunk_results(results: DataFrame) -> DataFrame:
    """results: source_id, chunk, refs (array of e1, e2, ...). Renumbers references so that chunks follow each other; one failed chunk fails its source."""
    from kgloom.operators.documents import ref_offsets

    sizes = results.groupBy("source_id", "chunk").agg(F.max(F.coalesce(F.array_max(F.transform("refs", lambda r: F.substring(r, 2, 9).cast("int"))), F.lit(0))).alias("size"), F.bool_or(F.col("refs").isNull()).alias("failed"))
    bad = sizes.where("failed").select("source_id")
    moved = results.join(bad, "source_id", "left_anti").join(ref_offsets(sizes, ["source_id"], "chunk", "size").select("source_id", "chunk", "offset"), ["source_id", "chunk"])
    return moved.select("source_id", "chunk", F.explode("refs").alias("ref"), "offset").select("source_id", "chunk", "ref", F.concat(F.lit("e"), F.substring("ref", 2, 9).cast("int") + F.col("offset")).alias("new_ref"))


def score(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, field, value frames. Share of expected fields met, and which are not."""
    met = expected.join(actual.select("case_id", "field", F.col("value").alias("found")), ["case_id", "field"], "left").withColumn("ok", F.col("value").eqNullSafe(F.col("found")))
    return met.groupBy("case_id").agg(F.avg(F.col("ok").cast("double")).alias("score"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("field")))), ",").alias("mismatches"))
