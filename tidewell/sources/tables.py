"""Reading tables, and bringing them to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def align_schema(df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the target's columns in order; a missing one gets its default or NULL, others go."""
    defaults = defaults or {}
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
OPTIMIZATIONS = _fields(
    id=_L, run_id=_S, round=_I, hotspot=_S, bound=_S, tier=_I, technique=_S, ceiling_pct=_D, visible_gain_pct=_D,
    tokens_spent=_L, model=_S, patch_text=_S,
)
EVENTS = _fields(ts=_L, run_id=_S, kind=_S, detail=_S)
SESSIONS = ("run", "unit", "session_id", "omp", "phoenix", "tripwire")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events; lines that are not events are left out."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", EVENTS, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.select("e.*").filter("ts IS NOT NULL AND run_id IS NOT NULL")


def read_session_map(spark: SparkSession, path: str) -> DataFrame:
    """CSV without quoting: lines of six columns, empty fields NULL, the last of equal keys wins."""
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
        .filter(F.trim("value") != "")
    )
    parts = F.split("value", ",", -1)
    rows = lines.withColumn("p", parts).filter((F.size("p") == len(SESSIONS)) & ~F.col("value").startswith("run,"))
    named = rows.select(*[F.nullif(F.trim(F.col("p")[i]), F.lit("")).alias(c) for i, c in enumerate(SESSIONS)], "line")
    rest = [c for c in SESSIONS if c not in ("run", "unit")]
    return named.groupBy("run", "unit").agg(F.max_by(F.struct(*rest), "line").alias("s")).select("run", "unit", "s.*")


def read_download_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a snapshot file with their rank by downloads; equal counts keep their order."""
    ddl = "last_update string, source string, rows array<struct<project:string,download_count:bigint>>"
    rows = spark.read.schema(ddl).json(path, multiLine=True).select(F.posexplode("rows").alias("pos", "r"))
    from pyspark.sql import Window

    # a snapshot is one small file: its rows are ranked in one task
    rank = F.row_number().over(Window.orderBy(F.col("r.download_count").desc(), "pos"))
    return rows.select("r.project", "r.download_count", rank.alias("rank"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, NULLs kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_split_by_license(df: DataFrame, license_col: str, path: str) -> None:
    """Two folders: gpl=true has the records whose license names GPL."""
    df.withColumn("gpl", F.contains(F.upper(F.coalesce(license_col, F.lit(""))), F.lit("GPL"))).write.partitionBy("gpl").json(path)
