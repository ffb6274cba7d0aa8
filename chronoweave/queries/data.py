"""The driver's tables in the roles of the data model.

events: a user is a subject, an event type a device, an event a sample at `ts`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import micros
from chronoweave.operators.scan import scan
from chronoweave.operators.timelines import sample_index
from chronoweave.sources.shared import written

RUN = ["user_id", "event_type"]
#: Events of a run lie hours or days apart: slices of time for scans, in microseconds.
SPARSE = 90 * 86_400_000_000

#: The samples of events in DuckDB.
SAMPLES = """
samples AS (
  SELECT user_id, event_type, event_id, value, props, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS sample_index
  FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(*RUN, "event_id", "value", "props", "ts", micros(F.col("ts")).alias("t"))
    return sample_index(rows, RUN, ["ts", "event_id"], slice_width=SPARSE).drop("ts")


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples as a table of its own, for queries that read them several times."""
    return written(samples(spark, sf_dir), "samples")


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("event_type") == kind).drop("event_type")


def anchors(rows: DataFrame) -> DataFrame:
    """Every click of a user with the purchase of the same number, less those that do not come after the last one kept in both times."""
    click, buy = (of_type(rows, k) for k in ("click", "purchase"))
    pairs = click.select("user_id", "sample_index", (F.col("t") / 1e6).alias("source_time")).join(buy.select("user_id", "sample_index", (F.col("t") / 1e6).alias("target_time")), ["user_id", "sample_index"])
    # both times never fall as numbers rise, so a pair later than its predecessor in both is kept whatever came before
    before = pairs.select("user_id", (F.col("sample_index") + 1).alias("sample_index"), F.struct("source_time", "target_time").alias("b"))
    pairs = pairs.join(before, ["user_id", "sample_index"], "left")
    later = F.col("b").isNull() | ((F.col("source_time") > F.col("b.source_time")) & (F.col("target_time") > F.col("b.target_time")))
    sure = F.when(later, F.col("sample_index"))
    runs = scan(pairs, ["user_id"], F.floor(F.col("sample_index") / 65_536), ["sample_index"], lasts={"start": sure}, of=[click])
    # the few pairs from one that is sure to the next, one after the other
    lists = runs.groupBy("user_id", "start").agg(F.array_sort(F.collect_list(F.struct("sample_index", "source_time", "target_time"))).alias("p"))

    def step(kept, x):
        last = F.get(kept, F.size(kept) - 1)
        later = (x["source_time"] > last["source_time"]) & (x["target_time"] > last["target_time"])
        return F.when(later, F.concat(kept, F.array(x))).otherwise(kept)

    kept = lists.select("user_id", F.explode(F.aggregate(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1), step)).alias("a"))
    several = kept.groupBy("user_id").count().where("count >= 2").select("user_id")
    return kept.join(several, "user_id", "left_semi").select("user_id", F.concat(F.lit("a"), F.lpad(F.col("a.sample_index").cast("string"), 6, "0")).alias("anchor_id"), "a.*")


ANCHORS = """
pairs AS (
  SELECT c.user_id, 'a' || lpad(CAST(c.sample_index AS VARCHAR), 6, '0') AS anchor_id, c.sample_index,
         c.t / 1e6 AS source_time, b.t / 1e6 AS target_time
  FROM samples c JOIN samples b ON c.user_id = b.user_id AND c.sample_index = b.sample_index
  WHERE c.event_type = 'click' AND b.event_type = 'purchase'
),
walk AS (
  SELECT user_id, sample_index, source_time, target_time, TRUE AS kept FROM pairs WHERE sample_index = 0
  UNION ALL
  SELECT user_id, sample_index, CASE WHEN later THEN ps ELSE ws END, CASE WHEN later THEN pt ELSE wt END, later FROM (
    SELECT p.user_id, p.sample_index, p.source_time AS ps, p.target_time AS pt, w.source_time AS ws, w.target_time AS wt,
           p.source_time > w.source_time AND p.target_time > w.target_time AS later
    FROM walk w JOIN pairs p ON p.user_id = w.user_id AND p.sample_index = w.sample_index + 1)
),
thinned AS (SELECT pairs.* FROM pairs JOIN walk USING (user_id, sample_index) WHERE kept),
anchors AS (SELECT * FROM thinned WHERE user_id IN (SELECT user_id FROM thinned GROUP BY user_id HAVING count(*) >= 2))"""

SEGMENTS = """
segments AS (
  SELECT *, (target_end - target_start) / (source_end - source_start) AS slope FROM (
    SELECT user_id, row_number() OVER w - 1 AS segment_index, anchor_id AS left_anchor_id, lead(anchor_id) OVER w AS right_anchor_id,
           source_time AS source_start, lead(source_time) OVER w AS source_end, target_time AS target_start, lead(target_time) OVER w AS target_end
    FROM anchors WINDOW w AS (PARTITION BY user_id ORDER BY source_time, anchor_id))
  WHERE source_end IS NOT NULL
)"""
