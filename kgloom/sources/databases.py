"""Databases inside pages: typed properties, distinct rows of several views, block records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Views of a page and rows of all of them that are read at most.
MOST_VIEWS, MOST_ROWS = 20, 50


def property_text(value: Column, kind: Column) -> Column:
    """A property's JSON as text: the joined fragments, or start ~ end of the first date among the annotations; null without either."""
    fragments = F.from_json(value, "array<string>")
    said = F.transform(fragments, lambda f: F.get(F.from_json(f, "array<string>"), F.lit(0)))
    plain = F.nullif(F.trim(F.array_join(F.array_compact(said), "")), F.lit(""))
    notes = F.flatten(F.array_compact(F.transform(fragments, lambda f: F.from_json(F.get(F.from_json(f, "array<string>"), F.lit(1)), "array<string>"))))
    dated = F.transform(F.filter(F.transform(notes, lambda n: F.from_json(n, "array<string>")), lambda n: F.get(n, F.lit(0)) == "d"), lambda n: F.from_json(F.get(n, F.lit(1)), "start_date string, end_date string"))
    date = F.get(F.filter(dated, lambda d: d["start_date"].isNotNull()), F.lit(0))
    return F.when(kind == "date", F.concat_ws(" ~ ", date["start_date"], date["end_date"])).otherwise(plain)


def distinct_rows(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """rows: page, view, row_id, ord. Each row once, where it stands first, and the first `most` of a page."""
    first = rows.groupBy("page", "row_id").agg(F.min_by("view", "ord").alias("view"), F.min("ord").alias("ord"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


def block_index(records: DataFrame) -> DataFrame:
    """records: page, id, ord and more columns. The last record of each id, which is without dashes and in lower case."""
    rest = [c for c in records.columns if c not in ("page", "id")]
    named = records.where("id <> ''").withColumn("id", F.lower(F.replace("id", F.lit("-"))))
    return named.groupBy("page", "id").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("page", "id", "r.*")


def root_issue(index: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (page, id) plus issue where the root isn't in the index as a page."""
    hit = index.where("kind = 'page'").select("page", "id", F.lit(True).alias("_found"))
    return roots.join(hit, ["page", "id"], "left").select("page", "id", F.when(F.col("_found").isNull(), "invalid_response").alias("issue"))
