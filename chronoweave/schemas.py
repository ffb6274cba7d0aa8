"""The canonical tables: typed schemas, required columns and logical keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "t": T.TimestampType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}


@dataclass(frozen=True)
class TableSpec:
    """One table. Columns are written `name:type`, `*` for a key column, `!` for another required one."""

    name: str
    columns: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.split(":")[0], _TYPES[c.rstrip("*!").split(":")[1]]) for c in self.columns])

    @property
    def key(self) -> list[str]:
        return [c.split(":")[0] for c in self.columns if c.endswith("*")]

    @property
    def required(self) -> list[str]:
        return [c.split(":")[0] for c in self.columns if c[-1] in "*!"]


_RUN = "subject_id:s* run_id:s* device_type:s*"
_PAIR = "source_run_id:s! source_device_type:s! target_run_id:s! target_device_type:s!"
#: Table and column names of the data model.
_TABLES = {
    "SUBJECT": "subject_id:s* experiment_date:s notes:s",
    "DEVICE_RUN": f"{_RUN} start_wallclock_est:t end_wallclock_est:t nominal_fps:d notes:s",
    "RUN_SAMPLE": f"{_RUN} sample_index:l* sample_kind:s! notes:s",
    "RUN_ASSET": "asset_id:s* subject_id:s! run_id:s! device_type:s! asset_role:s! storage_key:s asset_ref:s! notes:s",
    "SAMPLE_ARTIFACT": f"{_RUN} sample_index:l* artifact_role:s* artifact_id:s storage_key:s artifact_ref:s! artifact_member_key:s artifact_format:s payload_shape:s payload_dtype:s payload_bytes:l created_at:t notes:s",
    "SAMPLE_SUMMARY": f"{_RUN} sample_index:l* num_people:l num_2d:l num_3d:l point_count:l point_count_filtered:l has_pose2d:b has_conf2d:b has_pose3d:b has_activity:b has_points:b created_at:t notes:s",
    "RUN_TIMELINE_MODEL": f"{_RUN} timeline_model_id:s* timeline_model_name:s timeline_model_type:s! source_time_basis:s parameters_json:s created_at:t notes:s",
    "SAMPLE_TIME_ESTIMATE": f"{_RUN} timeline_model_id:s* sample_index:l* time_value_datetime:t time_value_sec:d time_kind:s! reference_time_datetime:t residual_ms:d notes:s",
    "ANCHOR": "subject_id:s* anchor_id:s* anchor_type:s! label:s confidence:d notes:s",
    "ANCHOR_MEMBER": "subject_id:s* anchor_id:s* run_id:s* device_type:s* sample_index:l* member_role:s confidence:d notes:s",
    "SYNC_MODEL": f"subject_id:s* sync_model_id:s* {_PAIR} source_timeline_model_id:s target_timeline_model_id:s model_name:s model_type:s! extrapolation_policy:s parameters_json:s notes:s",
    "MODEL_ANCHOR": "subject_id:s* sync_model_id:s* anchor_id:s*",
    "MAPPING_VERSION": f"subject_id:s* mapping_version_id:s* {_PAIR} mapping_name:s mapping_method:s! created_at:t parent_mapping_version_id:s source_sync_model_id:s parameters_json:s notes:s",
    "SAMPLE_MAPPING": "subject_id:s* mapping_version_id:s* source_run_id:s* source_device_type:s* source_sample_index:l* target_run_id:s* target_device_type:s* target_sample_index:l* predicted_minus_estimated_ms:d rank:i is_primary:b mapping_region_type:s support_status:s confidence_score:d",
}
TABLES = {name: TableSpec(name, tuple(columns.split())) for name, columns in _TABLES.items()}


def spec(name: str) -> TableSpec:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return TABLES[name]


def align(name: str, df: DataFrame) -> DataFrame:
    """Exactly the table's columns in order: missing ones null, others dropped, types cast."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec(name).schema])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], spec(name).schema)


def empty_tables(spark: SparkSession, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: empty(spark, n) for n in names or TABLES}
