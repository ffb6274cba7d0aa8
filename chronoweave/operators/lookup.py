"""Lookups in labelled mappings: forward, inverse, by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.nearest import nearest_targets
from chronoweave.operators.scan import INDEX_SLICE, scan
from chronoweave.sources.shared import written

#: Rows that an inverse lookup without an exact match chooses from.
NEARBY = 20

def _preference():
    """Primary rows first, then by rank, then by distance in time; unknown ones last."""
    return [F.desc("is_primary"), F.coalesce("rank", F.lit(1e6)), F.coalesce(F.abs("delta_ms"), F.lit(1e6))]


def best_rows(mapping: DataFrame, key: list[str]) -> DataFrame:
    """The preferred row of each key."""
    order = W.partitionBy(key).orderBy(*_preference(), "target_sample_index", "source_sample_index")
    return mapping.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def target_of_source(mapping: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The preferred target of each wanted source (keys, source_sample_index); unmapped ones are left out."""
    return best_rows(mapping.join(wanted, [*keys, "source_sample_index"], "left_semi"), [*keys, "source_sample_index"])


def source_of_target(mapping: DataFrame, wanted: DataFrame, keys: list[str], strict_nearest: bool = False) -> DataFrame:
    """The source of each wanted target (keys, target_sample_index).

    Exact matches if there are any, by preference. Else the NEARBY rows nearest in
    target index compete, so a primary row beats a nearer one, unless strict_nearest.

    Mapped targets are numbered in slices of their index; a wanted target meets the
    NEARBY mapped ones on either side by their numbers. Each brings its best row, for an
    exact match, and its first NEARBY rows.
    """
    key = [*keys, "target_sample_index"]
    row = F.struct(*[F.col(c) for c in mapping.columns])
    preferred = F.struct(
        F.when(F.col("is_primary"), 0).when(~F.col("is_primary"), 1).otherwise(2).alias("p"), F.coalesce("rank", F.lit(1e6)).alias("r"), F.coalesce(F.abs("delta_ms"), F.lit(1e6)).alias("d"),
        F.col("source_sample_index").alias("s"), row.alias("row"),
    )
    # of the rows of one target the smaller sources are nearer
    first = W.partitionBy(key).orderBy("source_sample_index", "rank")
    near = mapping.where(F.col("target_sample_index").isNotNull()).withColumns({"_n": F.row_number().over(first), "_x": preferred}).where(F.col("_n") <= NEARBY)
    targets = near.groupBy(key).agg(F.collect_list("_x").alias("_near"))
    best = mapping.where(F.col("target_sample_index").isNotNull()).withColumn("_x", preferred).groupBy(key).agg(F.min("_x").alias("_best"))
    targets = targets.join(best, key).withColumn("_kind_of", F.lit(0))

    asked = wanted.select(key).where(F.col("target_sample_index").isNotNull()).distinct().withColumn("_kind_of", F.lit(1))
    placed = scan(targets.unionByName(asked, allowMissingColumns=True), keys, F.floor(F.col("target_sample_index") / INDEX_SLICE), ["target_sample_index", "_kind_of"], sums={"_p": 1 - F.col("_kind_of")}, of=[mapping, wanted])
    placed = written(placed, "placed-targets")  # both sides of the join read it
    around = F.explode(F.sequence(F.col("_p") - NEARBY + 1, F.col("_p") + NEARBY))
    meets = placed.where("_kind_of = 1").select(*keys, F.col("target_sample_index").alias("_want"), around.alias("_p"))
    met = meets.join(placed.where("_kind_of = 0").select(*keys, "_p", F.col("target_sample_index").alias("_t"), "_near", "_best"), [*keys, "_p"])

    away = F.abs(F.col("_t") - F.col("_want")).alias("distance")
    choices = F.transform("_near", lambda x: F.struct(away, x["s"].alias("s"), F.col("_t").alias("t"), x["r"].alias("r"), x.alias("x")))
    found = met.groupBy(*keys, "_want").agg(F.max(F.when(F.col("_t") == F.col("_want"), F.col("_best"))).alias("_hit"), F.flatten(F.collect_list(F.when(F.col("_t") != F.col("_want"), choices))).alias("_near"))
    others = F.slice(F.array_sort("_near"), 1, 1 if strict_nearest else NEARBY)
    # the same order as among exact matches, then the smaller target
    pick = F.array_min(F.transform(others, lambda o: F.struct(o["x"]["p"].alias("p"), o["x"]["r"].alias("r"), o["x"]["d"].alias("d"), o["s"].alias("s"), o["t"].alias("t"), o["distance"].alias("distance"), o["x"]["row"].alias("row"))))
    out = found.withColumn("_other", pick).withColumn("_row", F.coalesce("_hit.row", "_other.row")).where("_row is not null")
    distance = F.when(F.col("_hit").isNotNull(), F.lit(0)).otherwise(F.col("_other.distance")).cast("long").alias("distance")
    columns = [F.col(f"_row.{c}").alias("matched_target_index" if c == "target_sample_index" else c) for c in mapping.columns]
    return out.select(*columns, F.col("_want").alias("target_sample_index"), distance)


def nearest_by_time(samples: DataFrame, wanted: DataFrame, keys: list[str], query: str) -> DataFrame:
    """The sample nearest in time to each wanted moment (keys, query, t); the earlier one on a tie."""
    asked = wanted.withColumnRenamed(query, "sample_index")
    found = nearest_targets(asked, samples, keys, 1)
    return found.select(*keys, F.col("source_sample_index").alias(query), F.col("target_sample_index").alias("sample_index"), "delta_us")
