"""Small lookups around a mapping: its context, subject, roles, rates, assets and their places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.names import normalise_asset_ref

#: Rates where a run names none.
CAMERA_FPS, OTHER_FPS = 15.0, 20.0
RUN = ["subject_id", "run_id", "device_type"]


def mapping_context(versions: DataFrame, subject: str, version: str) -> dict[str, object]:
    """The row of a mapping version; KeyError where there is none."""
    found = versions.where((F.col("subject_id") == subject) & (F.col("mapping_version_id") == version)).limit(1).collect()
    if not found:
        raise KeyError(f"no mapping version {version!r} of {subject!r}")
    return found[0].asDict()


def unique_subject(versions: DataFrame, version: str) -> str:
    """The one subject that has a mapping version of this id; none or several is an error."""
    found = versions.where(F.col("mapping_version_id") == version).agg(F.min("subject_id").alias("a"), F.max("subject_id").alias("b")).first()
    if found["a"] is None:
        raise ValueError(f"no subject has mapping version {version!r}")
    if found["a"] != found["b"]:
        raise ValueError(f"several subjects have mapping version {version!r}; name one")
    return found["a"]


def available_roles(artifacts: DataFrame) -> DataFrame:
    """RUN, sample_index and the sorted payload roles of each sample."""
    return artifacts.groupBy(*RUN, "sample_index").agg(F.array_sort(F.collect_set("artifact_role")).alias("roles"))


def run_limits(runs: DataFrame, samples: DataFrame, camera: str = "kinect_rgb") -> DataFrame:
    """RUN, max_sample (0 without samples) and nominal_fps (the default of the device where it is not positive)."""
    last = samples.groupBy(RUN).agg(F.max("sample_index").alias("_last"))
    default = F.when(F.col("device_type") == camera, CAMERA_FPS).otherwise(OTHER_FPS)
    fps = F.col("nominal_fps").try_cast("double")
    return runs.join(last, RUN, "left").select(*RUN, F.coalesce("_last", F.lit(0)).cast("long").alias("max_sample"), F.when(fps > 0, fps).otherwise(default).alias("nominal_fps"))


def asset_rows(assets: DataFrame, subject: str, run: str, device: str, role: str | None = None) -> DataFrame:
    rows = assets.where((F.col("subject_id") == subject) & (F.col("run_id") == run) & (F.col("device_type") == device))
    return rows if role is None else rows.where(F.col("asset_role") == role)


def asset_ref(assets: DataFrame, subject: str, run: str, device: str, role: str) -> str:
    """The reference of a run's asset, the first by id; KeyError without one."""
    found = asset_rows(assets, subject, run, device, role).orderBy("asset_id").limit(1).collect()
    if not found:
        raise KeyError(f"no asset of {subject}/{run}/{device} in role {role!r}")
    return found[0]["asset_ref"]


def asset_candidates(assets: DataFrame, roots: dict[str, Sequence[str]]) -> DataFrame:
    """assets with `candidates`: places under the storage key's roots, then under the default ones, each once."""
    own = F.create_map(*[x for k, v in roots.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if roots else F.create_map().cast("map<string,array<string>>")
    none = F.array().cast("array<string>")
    places = F.array_distinct(F.concat(F.coalesce(F.try_element_at(own, F.col("storage_key")), none), F.coalesce(F.try_element_at(own, F.lit("default")), none)))
    return assets.withColumn("candidates", F.transform(places, lambda root: F.concat_ws("/", F.rtrim(root, F.lit("/")), normalise_asset_ref(F.col("asset_ref")))))


def first_existing(spark: SparkSession, assets: DataFrame, roots: dict[str, Sequence[str]], files: DataFrame | None = None) -> DataFrame:
    """assets with `path`: the first candidate that is there, null without one.

    files: one column `path` of what the roots hold; without it the roots are listed by the file source.
    """
    if files is None:
        every = [r for v in roots.values() for r in v]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(every).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    tried = asset_candidates(assets, roots).withColumn("_id", F.monotonically_increasing_id())
    each = tried.select("_id", F.posexplode("candidates").alias("_at", "path"))
    hit = each.join(files.select("path").distinct(), "path", "left_semi").groupBy("_id").agg(F.min_by("path", "_at").alias("path"))
    return tried.join(hit, "_id", "left").drop("_id", "candidates")


def resolve_run_asset(spark: SparkSession, assets: DataFrame, roots: dict[str, str], subject: str, run: str, device: str, role: str, must_exist: bool = True) -> str:
    """The place of a run's asset under its storage key's one root; an unknown key or a missing file is an error."""
    found = asset_rows(assets, subject, run, device, role).orderBy("asset_id").select("storage_key", normalise_asset_ref(F.col("asset_ref")).alias("ref")).limit(1).collect()
    if not found:
        raise KeyError(f"no asset of {subject}/{run}/{device} in role {role!r}")
    root = roots.get(found[0]["storage_key"] or "")
    if root is None:
        raise KeyError(f"no root for storage key {found[0]['storage_key']!r}; known: {sorted(roots)}")
    path = f"{root.rstrip('/')}/{found[0]['ref']}"
    if must_exist:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(path)
    return path


def common_features(a: DataFrame, b: DataFrame, feature: str = "feature") -> DataFrame:
    """Names that both tables have, sorted."""
    return a.select(feature).intersect(b.select(feature)).orderBy(feature)


def json_ready(row: Column) -> Column:
    """A struct as JSON with its nulls; non-finite numbers become null."""
    return F.regexp_replace(F.to_json(row, {"ignoreNullFields": "false"}), '"(NaN|Infinity|-Infinity)"', "null")


def safe_path_component(name: Column) -> Column:
    """A name as one part of a path: runs of other characters become _; nothing left gives unnamed."""
    cut = F.regexp_replace(F.regexp_replace(name.cast("string"), "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(cut == "", "unnamed").otherwise(F.coalesce(cut, F.lit("unnamed")))
