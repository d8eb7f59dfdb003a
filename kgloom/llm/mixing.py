"""Mixing sources to target weights (native).

Tokens are summed per source, target sizes follow from the weights, and
each document is emitted floor(rate) times plus one more time with
probability frac(rate), decided by a seeded hash of its id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, SPACE_WORD, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
SALTS = 32


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target and rate.

    Sources in code point order (null last) take the weights in turn.
    Water filling: a source's target is min(most * size, level * weight),
    with one level for all, which is what resharing the excess of capped
    sources again and again converges to. One row per source, so the two
    ordered windows see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(most).cast("long") * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    s = s.withColumns({
        "total": F.lit(share) * F.sum("source_size").over(all_),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_rest": F.sum("w").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("cap_before")) / F.col("w_rest")
    s = s.withColumn("open_level", F.when(F.col("cap") > F.col("w") * level, level))
    s = s.withColumn("level", F.max("open_level").over(all_))
    # without an open source every cap is reached
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")), F.col("cap").cast("double")))
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def unit(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a seeded hash; 52 bits, so it is exact as a double."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(key.cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs plus mix_size, mix_source_size, mix_target and mix_copies; columns of docs with these names are replaced, all others pass through.

    Null or blank text has size 0. A null source is a source of its own.
    Rows that share doc_id and text share their draw, so reruns and repeated rows
    agree; a null doc_id draws as the empty id. An empty table stays
    empty. Sources are few, which is
    checked: beyond BROADCAST_ROWS of them the join is salted instead.
    """
    own = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    plain = [c for c in docs.columns if c not in own]
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), n_tokens(docs["text"]).alias("mix_size"))
    source = F.col("row.source")
    plan = stage(targets(sized.groupBy(source.alias("source")).agg(F.sum("mix_size").alias("source_size"))), "mix")
    plan = plan.select("source", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "rate")
    if plan.count() <= BROADCAST_ROWS:
        joined = sized.join(F.broadcast(plan), source.eqNullSafe(F.col("source")))
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = sized.withColumn("row_salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, source.eqNullSafe(F.col("source")) & (F.col("row_salt") == F.col("salt")))
    whole = F.floor("rate")
    extra = (unit(F.col("row.doc_id"), F.col("row.text"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("mix_copies", whole + extra).select("row.*", *own)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: docs' columns, each document as often as drawn."""
    boxed = docs.select("doc_id", "source", "text", F.struct("*").alias("whole"))
    out = with_copies(boxed, **options).where("mix_copies > 0").select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy"))
    return out.select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def sql(docs: str = "documents", columns: str = "doc_id, size, source_size, target, size * copies AS taken") -> str:
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH mix_sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs}
), mix_per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM mix_sized GROUP BY source
), mix_weighed AS (
  SELECT *, ({weights})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS w, {MOST} * source_size AS cap FROM mix_per
), mix_levels AS (
  SELECT *, {SHARE}::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_rest
  FROM mix_weighed
), mix_open AS (
  SELECT *, max(CASE WHEN cap > w * ((total - cap_before) / w_rest) THEN (total - cap_before) / w_rest END) OVER () AS level FROM mix_levels
), mix_plan AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, w * level), cap::DOUBLE) AS target FROM mix_open
), mix_rated AS (
  SELECT source AS mix_source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM mix_plan
), mix_drawn AS (
  SELECT d.*, source_size, target,
    (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM mix_sized d JOIN mix_rated p ON d.source IS NOT DISTINCT FROM p.mix_source
)
SELECT {columns} FROM mix_drawn"""
