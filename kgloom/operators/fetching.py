"""Late children of pages: asked for in batches, round by round, until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.plans.staging import stage

#: Ids in one request, and rounds of requests.
BATCH, ROUNDS = 100, 20


def fetch_missing(held: DataFrame, roots: DataFrame, answer: Callable[[DataFrame], DataFrame], batch: int = BATCH, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(blocks, requests): held and all blocks that answers brought, and what was asked: page, id, round, batch.

    held and answers: page, id, kind, children; roots: page, id. Each round walks from what is new to the children that are held, all pages side by side, and
    asks for those that aren't, each once. Child pages aren't entered. answer() gets the requests of a round and gives blocks; unknown ids
    just stay out. More rounds than `rounds` are an error.
    """
    cols = ["page", "id", "kind", "children"]
    held = stage(held.select(*cols).dropDuplicates(["page", "id"]), "held")
    root = roots.select("page", "id").withColumn("root", F.lit(True))
    frontier = stage(held.join(root, ["page", "id"], "left_semi"), "frontier")
    seen = stage(roots.select("page", "id").distinct(), "seen")
    asked: list[DataFrame] = []
    for number in range(1, rounds + 2):
        wanted: list[DataFrame] = []
        while True:
            inner = frontier.join(root, ["page", "id"], "left").where("kind <> 'page' OR root")
            kids = inner.select("page", F.explode("children").alias("id")).distinct().join(seen, ["page", "id"], "left_anti")
            kids = stage(kids.join(held.select("page", "id", F.lit(True).alias("known")), ["page", "id"], "left"), "kids")
            if kids.isEmpty():
                break
            # the kids of one step; unions of staged tables, so lineage stays short
            seen = seen.union(kids.select("page", "id"))
            wanted.append(kids.where("known IS NULL").select("page", "id"))
            frontier = held.join(kids.where("known"), ["page", "id"], "left_semi")
        todo = None
        for w in wanted:
            todo = w if todo is None else todo.union(w)
        if todo is None or todo.isEmpty():
            break
        if number > rounds:
            raise RuntimeError(f"children are still missing after {rounds} rounds")
        place = F.row_number().over(Window.partitionBy("page").orderBy("id")) - 1
        requests = stage(todo.select("page", "id", F.lit(number).alias("round"), F.floor(place / batch).cast("int").alias("batch")), "requests")
        asked.append(requests)
        new = stage(answer(requests).select(*cols).dropDuplicates(["page", "id"]).join(held.select("page", "id"), ["page", "id"], "left_anti"), "answers")
        if new.isEmpty():
            break
        frontier, held = new, held.union(new)
    out = asked[0] if asked else roots.select("page", "id", F.lit(0).alias("round"), F.lit(0).alias("batch")).where("false")
    for a in asked[1:]:
        out = out.union(a)
    return held, out
