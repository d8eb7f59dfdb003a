"""Entity resolution: strong keys, similar titles, link groups, and the order-dependent folds per graph."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import text, titles, urls
from kgloom.operators.folds import fold_by
from kgloom.plans.staging import stage


def strong_key_matches(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates (graph_id, ref, key_type, key_value) that meet exactly one stored entity by a strong key; more make them ambiguous."""
    hit = candidates.join(keys.where("is_strong").select("graph_id", "key_type", "key_value", "entity_id"), ["graph_id", "key_type", "key_value"])
    per = hit.groupBy("graph_id", "ref").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    return per.select("graph_id", "ref", F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("outcome"), "entity_id")


def strong_keys(facts: DataFrame) -> DataFrame:
    kind = F.when(F.col("predicate") == "url", "work_url").when(F.col("predicate") == "homepage", "organization_homepage")
    return facts.where(kind.isNotNull() & urls.is_http_url(F.col("value_str"))).select("graph_id", "entity_id", kind.alias("key_type"), F.col("value_str").alias("key_value"))


def similar_title_pairs(items: DataFrame, keys: list[str], ident: str, title: str, store: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """(keys, a, b, equal): under the same keys, each item with the smallest one of its title (equal), and these with each other where
    their titles are alike. Titles without letters or digits are like nothing.

    Two items are alike if their titles' smallest items are, so groups of equal titles make no pairs among themselves. Two alike
    titles share a word, so titles meet on words only. store keeps what is read several times; with buckets of one of the keys all steps stay within a bucket.
    """
    # what Python makes is stored before anything meets: Spark doesn't know that it stays where it was
    folded = store(items.select(*keys, ident, text.nfkc_fold(F.col(title)).alias("_f")), "titles")
    firsts = folded.groupBy(*keys, "_f").agg(F.min(ident).alias("_rep")).withColumn("_p", text.title_parts(F.col("_f"))).where(F.size("_p.words") > 0)
    firsts = store(firsts, "titles")
    same = folded.join(firsts.select(*keys, "_f", "_rep"), [*keys, "_f"]).where(F.col(ident) != F.col("_rep")).select(*keys, F.col("_rep").alias("a"), F.col(ident).alias("b"), F.lit(True).alias("equal"))
    words = firsts.select(*keys, "_rep", F.explode("_p.words").alias("_w"))
    met = words.withColumnRenamed("_rep", "a").join(words.withColumnRenamed("_rep", "b"), [*keys, "_w"]).where("a < b").select(*keys, "a", "b").distinct()
    for end in "ab":
        met = met.join(firsts.select(*keys, F.col("_rep").alias(end), F.col("_p").alias(f"_p{end}")), [*keys, end])
    judged = met.select(*keys, "a", "b", F.col("_pa.normal").alias("_na"), F.col("_pb.normal").alias("_nb"), text.title_verdict(F.col("_pa"), F.col("_pb")).alias("_sure")).where("coalesce(_sure, true)")
    judged = store(judged.withColumns({n: F.when(F.col("_sure").isNull(), F.col(n)) for n in ("_na", "_nb")}), "titles")
    # only what words and lengths leave open goes to Python
    near = judged.where("_sure IS NULL").where(text.near_spelling(F.col("_na"), F.col("_nb")))
    alike = store(judged.where("_sure").union(near).select(*keys, "a", "b"), "titles")
    return same.union(alike.withColumn("equal", F.lit(False)))


def _met(pairs: list[dict]) -> tuple[dict, dict]:
    """What titles.met() gives, from the pairs that similar_title_pairs() gives for one graph."""
    near: dict = {}
    for p in pairs:
        if not p["equal"]:
            near.setdefault(p["a"], set()).add(p["b"])
            near.setdefault(p["b"], set()).add(p["a"])
    return {p["b"]: p["a"] for p in pairs if p["equal"]}, near


def accept_links(groups: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Greedy by group order: confident groups of at least two unused members, at most one of them stored, no two from one source.

    groups: graph_id, group_ord, confidence, ids; members: graph_id, id, is_new, source_id.
    """
    info = members.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("is_new", "source_id")))).alias("info"))
    df = groups.where(F.col("confidence") >= least).join(info, "graph_id")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for row in pdf.sort_values("group_ord").itertuples():
            ids = [i for i in dict.fromkeys(row.ids) if i not in used and i in row.info]
            facts = [row.info[i] for i in ids]
            new = [i for i, f in zip(ids, facts, strict=True) if f["is_new"]]
            sources = [f["source_id"] for f in facts if f["is_new"]]
            stored = [i for i in ids if i not in new]
            if len(ids) < 2 or len(stored) > 1 or not new or len(set(sources)) < len(sources):
                continue
            used.update(ids)
            out += [(row.graph_id, i, stored[0] if stored else min(new)) for i in new]
        return pd.DataFrame(out, columns=["graph_id", "id", "target"])

    return df.groupBy("graph_id").applyInPandas(fold, "graph_id bigint, id string, target string")


def _in_order(rows: list[dict], heads: dict, near: dict) -> list[tuple]:
    """(graph_id, id, outcome, entity_id) of the new ones among rows (graph_id, id, is_new), in their order."""
    members: dict = {}  # what is in the pool, by head: the entity of each id

    def add(ident, entity) -> None:
        members.setdefault(heads.get(ident, ident), {})[ident] = entity

    for r in rows:
        if not r["is_new"]:
            add(r["id"], r["id"])
    out = []
    for r in rows:
        if not r["is_new"]:
            continue
        graph, ident = r["graph_id"], r["id"]
        head = heads.get(ident, ident)
        hits = {h: targets for h in (head, *near.get(head, ())) if h in members and (targets := {e for i, e in members[h].items() if i != ident})}
        targets = set().union(*hits.values())
        # those of one head are alike
        one = len(targets) == 1 or all(y in near.get(x, ()) or (hits[x] == hits[y] and len(hits[x]) == 1) for x, y in combinations(hits, 2))
        if not targets:
            add(ident, ident)
            out.append((graph, ident, "new", ident))
        elif one:
            add(ident, min(targets))
            out.append((graph, ident, "matched", min(targets)))
        else:
            out.append((graph, ident, "ambiguous", None))
    return out


_RESOLVED = "graph_id bigint, ref string, outcome string, entity_id string"


def sequential_resolve(candidates: DataFrame, stored: DataFrame, same: DataFrame) -> DataFrame:
    """Matches candidates in order against a pool that grows with each new one.

    candidates: graph_id, ord, ref; stored: graph_id, entity_id; same: what similar_title_pairs() gives over refs and ids.
    No match: new. One: matched. Several that all match each other: the smallest id; else ambiguous.
    """
    pool = candidates.select("graph_id", F.col("ord").cast("long").alias("ord"), F.col("ref").alias("id"), F.lit(True).alias("is_new")).union(stored.select("graph_id", F.lit(-1).cast("long"), "entity_id", F.lit(False)))

    def fold(found: list[dict]) -> list[tuple]:
        return _in_order([r for r in found if r["id"] is not None], *_met([r for r in found if r["a"] is not None]))

    both = pool.unionByName(same.select("graph_id", "a", "b", "equal"), allowMissingColumns=True)
    return fold_by(both, "graph_id", ["ord", "id"], fold, _RESOLVED)


def resolve_titles(items: DataFrame) -> DataFrame:
    """sequential_resolve() of items (graph_id, ord, id, is_new, title) by their titles, in one pass: pairs are found within the fold."""
    return fold_by(items, "graph_id", ["ord", "id"], lambda rows: _in_order(rows, *titles.met((r["id"], r["title"]) for r in rows)), _RESOLVED)


def _united(rows: list[dict], pairs: set[tuple]) -> list[tuple]:
    group = {r["id"]: r["id"] for r in rows}
    members = {r["id"]: [r["id"]] for r in rows}
    chunks = {r["id"]: {r["chunk"]} for r in rows}
    for a, b in sorted(pairs):
        x, y = group.get(a), group.get(b)
        if x is None or y is None or x == y or chunks[x] & chunks[y]:
            continue
        x, y = min(x, y), max(x, y)
        chunks[x] |= chunks.pop(y)
        for i in members[y]:
            group[i] = x
        members[x] += members.pop(y)
    return [(r["graph_id"], r["id"], group[r["id"]]) for r in rows]


_COMPONENTS = "graph_id bigint, id string, component string"


def constrained_components(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Union by ascending pair, unless it would put two items of one chunk together. items: graph_id, id, chunk."""
    both = items.select("graph_id", "id", "chunk").unionByName(pairs.select("graph_id", "a", "b"), allowMissingColumns=True)
    return fold_by(both, "graph_id", ["id"], lambda found: _united([r for r in found if r["id"] is not None], {(r["a"], r["b"]) for r in found if r["a"] is not None}), _COMPONENTS)


def title_components(items: DataFrame) -> DataFrame:
    """constrained_components() of items (graph_id, id, chunk, title) by their titles, in one pass: pairs are found within the fold."""
    def fold(rows: list[dict]) -> list[tuple]:
        heads, near = titles.met((r["id"], r["title"]) for r in rows)
        return _united(rows, {(h, i) for i, h in heads.items() if i != h} | {(a, b) for a, others in near.items() for b in others if a < b})

    return fold_by(items, "graph_id", ["id"], fold, _COMPONENTS)


def dense_ids(entities: DataFrame, prefix: str, order: list) -> DataFrame:
    """W1, W2, ... per graph; rows without a title take no number."""
    named = entities.where("title IS NOT NULL")
    return named.withColumn("dense_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("graph_id").orderBy(*order))))
