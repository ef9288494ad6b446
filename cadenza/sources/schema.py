"""Reading, cleaning and writing the play table.

The canonical table ``plays`` has one row per play:

``user_id LONG, play_id LONG, ts TIMESTAMP_NTZ (UTC wall clock), ms_played LONG,
track, artist, album STRING, skipped, shuffle, offline, incognito_mode BOOLEAN,
reason_start, reason_end, conn_country, platform STRING,
year, month, hour_utc, weekday (Mon=0) INT``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import constants as C

# Export field -> canonical column.
EXPORT_FIELDS = {
    "ts": "ts",
    "ms_played": "ms_played",
    "master_metadata_track_name": "track",
    "master_metadata_album_artist_name": "artist",
    "master_metadata_album_album_name": "album",
    "skipped": "skipped",
    "shuffle": "shuffle",
    "offline": "offline",
    "incognito_mode": "incognito_mode",
    "reason_start": "reason_start",
    "reason_end": "reason_end",
    "conn_country": "conn_country",
    "platform": "platform",
}

# Explicit read schema for the JSON exports: no inference pass, missing
# fields come back null.  Everything but user_id stays text, because exports
# hold times, numbers and flags in several spellings (1234.0, "5000", 1, true)
# that a typed read would turn into nulls; ``clean_plays`` coerces them.
EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("ms_played", T.StringType()),
        T.StructField("master_metadata_track_name", T.StringType()),
        T.StructField("master_metadata_album_artist_name", T.StringType()),
        T.StructField("master_metadata_album_album_name", T.StringType()),
        T.StructField("skipped", T.StringType()),
        T.StructField("shuffle", T.StringType()),
        T.StructField("offline", T.StringType()),
        T.StructField("incognito_mode", T.StringType()),
        T.StructField("reason_start", T.StringType()),
        T.StructField("reason_end", T.StringType()),
        T.StructField("conn_country", T.StringType()),
        T.StructField("platform", T.StringType()),
    ]
)

FLAG_COLUMNS = ("skipped", "shuffle", "offline", "incognito_mode")
DEFAULTED_STRINGS = ("reason_start", "reason_end", "conn_country", "platform")
RAW_COLUMNS = (
    "user_id", "play_id", "ts", "ms_played", "track", "artist", "album",
    *FLAG_COLUMNS, *DEFAULTED_STRINGS,
)
PLAY_COLUMNS = (*RAW_COLUMNS, "year", "month", "hour_utc", "weekday")

PLAY_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("play_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("ms_played", T.LongType(), False),
        T.StructField("track", T.StringType(), False),
        T.StructField("artist", T.StringType(), False),
        T.StructField("album", T.StringType()),
        *[T.StructField(c, T.BooleanType(), False) for c in FLAG_COLUMNS],
        *[T.StructField(c, T.StringType(), False) for c in DEFAULTED_STRINGS],
        T.StructField("year", T.IntegerType(), False),
        T.StructField("month", T.IntegerType(), False),
        T.StructField("hour_utc", T.IntegerType(), False),
        T.StructField("weekday", T.IntegerType(), False),
    ]
)

def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _ts_expr(df: DataFrame) -> Column:
    """Any ts representation -> UTC wall-clock TIMESTAMP_NTZ (null if bad)."""
    dt = df.schema["ts"].dataType
    col = F.col("ts")
    if isinstance(dt, T.TimestampNTZType):
        return col
    if isinstance(dt, T.TimestampType):
        # an instant -> its UTC wall clock, whatever the session time zone
        return F.timestamp_add("MICROSECOND", F.unix_micros(col), _epoch_ntz())
    if isinstance(dt, T.DateType):
        return col.cast("timestamp_ntz")
    # text such as 2024-01-01T10:00:00Z: parse as an instant (zone honoured)
    instant = F.try_to_timestamp(col.cast("string"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch_ntz())


def _ms_expr(df: DataFrame) -> Column:
    """Whole milliseconds of a number or of text that holds one (fractions
    cut off); anything else is 0."""
    if "ms_played" not in df.columns:
        return F.lit(0).cast("bigint")
    ms = F.col("ms_played")
    return F.coalesce(ms.try_cast("bigint"), ms.cast("string").try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def _flag_expr(df: DataFrame, name: str) -> Column:
    """P5: a boolean, or text or a number that means one (numbers: not 0);
    anything else is false."""
    if name not in df.columns:
        return F.lit(False)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    # words first: a failed parse of a number raises inside the cast, which costs
    # more than all other columns of a row; 0 and 1 mean the same both ways
    text = F.trim(F.col(name).cast("string"))
    return F.coalesce(text.try_cast("boolean"), text.try_cast("double") != 0, F.lit(False))


def from_export(df: DataFrame) -> DataFrame:
    """Rename export fields (``master_metadata_*``) to canonical names (U1 safe)."""
    for src, dst in EXPORT_FIELDS.items():
        if src in df.columns and src != dst:
            df = df.withColumnRenamed(src, dst)
    return df


def clean_plays(df: DataFrame, user_id: int | None = None) -> DataFrame:
    """Coerce a raw play frame (canonical names) to the canonical table.

    * missing columns are added (P2); ``user_id`` absent -> constant
    * unparseable ``ts`` and null / empty track names are dropped (P1, P3, P8)
    * ``ms_played`` as a number or as text, bad/null -> 0 (P4); flags as
      booleans, numbers or text, bad/null -> false (P5)
    * artist null/empty -> ``'Unknown'``; album kept null (D9)
    * reasons, country, platform null/empty -> ``'Unknown'`` (P6)
    * year, month, hour_utc, weekday (Mon=0) derived from ``ts`` (P7)
    """
    cols = set(df.columns)

    def has(c: str) -> bool:
        return c in cols

    if not has("ts"):
        raise ValueError("play table needs a 'ts' column")
    uid = (
        F.coalesce(F.col("user_id").try_cast("bigint"), F.lit(-1))
        if has("user_id")
        else F.lit(user_id if user_id is not None else 0).cast("bigint")
    )
    out = [
        uid.alias("user_id"),
        (F.col("play_id").try_cast("bigint") if has("play_id") else F.lit(None).cast("bigint")).alias("play_id"),
        _ts_expr(df).alias("ts"),
        _ms_expr(df).alias("ms_played"),
        (F.col("track").cast("string") if has("track") else F.lit(None).cast("string")).alias("track"),
        F.coalesce(
            F.nullif(F.col("artist").cast("string"), F.lit("")) if has("artist") else F.lit(None).cast("string"),
            F.lit(C.UNKNOWN),
        ).alias("artist"),
        (F.col("album").cast("string") if has("album") else F.lit(None).cast("string")).alias("album"),
    ]
    for c in FLAG_COLUMNS:
        out.append(_flag_expr(df, c).alias(c))
    for c in DEFAULTED_STRINGS:
        v = F.nullif(F.col(c).cast("string"), F.lit("")) if has(c) else F.lit(None).cast("string")
        out.append(F.coalesce(v, F.lit(C.UNKNOWN)).alias(c))
    typed = df.select(*out).filter(
        F.col("ts").isNotNull() & F.col("track").isNotNull() & (F.length("track") > 0)
    )
    return typed.select(
        *RAW_COLUMNS,
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.hour("ts").alias("hour_utc"),
        F.weekday("ts").alias("weekday"),
    )


def read_plays(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "json",
    multiline: bool = True,
) -> DataFrame:
    """Scan exports (JSON arrays, JSON lines, Parquet, CSV) -> ``plays``.

    JSON is read with the explicit export schema (no inference).  Pretty-printed
    arrays need ``multiline=True``; such files are not splittable, so convert
    them once with :func:`write_plays` and scan the Parquet afterwards.  A
    multi-line file whose payload is not a list is skipped.  An empty list of
    paths, and a pattern (``*``, ``?``, ``[``, ``{``) that matches nothing,
    give no rows; a named path that is missing raises.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    paths = [p for p in paths if not _GLOB.search(p) or _matches(spark, p)]
    if not paths:
        return spark.createDataFrame([], PLAY_SCHEMA)  # no exports: empty typed table
    if fmt == "json":
        raw = spark.read.schema(EXPORT_SCHEMA).option("multiLine", multiline).json(paths)
        if multiline:
            raw = raw.withColumn("_file", F.col("_metadata.file_path")).join(
                _list_files(spark, paths), "_file", "left_semi").drop("_file")
    elif fmt == "parquet":
        raw = spark.read.parquet(*paths)
    elif fmt == "csv":
        raw = spark.read.schema(EXPORT_SCHEMA).option("header", True).csv(paths)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return clean_plays(from_export(raw))


_GLOB = re.compile(r"[*?\[{]")


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def _list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files whose first character that is not blank opens a list."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.translate("value", " \t\r\ufeff", "").alias("_line"))
    first = lines.filter(F.col("_line") != "").groupBy("_file").agg(
        F.min_by(F.substring("_line", 1, 1), F.struct("_block", "_row")).alias("_open"))
    return first.filter(F.col("_open") == "[").select("_file")


def union_exports(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of files whose columns differ (missing -> null)."""
    frames = [from_export(f) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def from_records(spark: SparkSession, records: list[dict], user_id: int | None = None) -> DataFrame:
    """In-memory export records -> ``plays`` (no temp file involved).

    Values are taken as they come (numbers as floats or text, numeric flags,
    ``datetime`` times) and coerced like those of a JSON export; records that
    have no user_id get ``user_id``."""
    text = [f.name for f in EXPORT_SCHEMA if f.name != "user_id"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("user_id", *text)])
    rows = [tuple(_as_text(r.get(c)) for c in ("user_id", *text)) for r in records]
    raw = from_export(spark.createDataFrame(rows, schema))
    if user_id is not None:
        raw = raw.withColumn("user_id", F.coalesce("user_id", F.lit(str(user_id))))
    return clean_plays(raw)


def _as_text(value) -> str | None:  # noqa: ANN001 - any JSON value
    """A record's value as an export would spell it; missing and NaN: null."""
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value).lower() if isinstance(value, bool) else str(value)


def from_pandas(spark: SparkSession, pdf) -> DataFrame:  # noqa: ANN001 - pandas optional
    """S3: pandas frame -> ``plays``; derived columns must be present."""
    missing = [c for c in ("year", "month", "hour_utc", "weekday") if c not in pdf.columns]
    if missing:
        raise ValueError(f"DataFrame must include {missing!r}")
    return clean_plays(from_export(spark.createDataFrame(pdf)))


def write_plays(df: DataFrame, root: str, mode: str = "overwrite") -> str:
    """Write ``plays`` as Parquet partitioned by year, month.

    Repartitioning on the partition columns first gives one writer per
    (year, month) directory instead of one file per task per directory.
    """
    (
        df.repartition("year", "month")
        .write.mode(mode)
        .partitionBy("year", "month")
        .parquet(root)
    )
    return root


def read_plays_table(
    spark: SparkSession,
    root: str,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
) -> DataFrame:
    """Read a partitioned play table; year/month filters prune directories."""
    df = spark.read.parquet(root)
    if years is not None:
        df = df.filter(F.col("year").isin(list(years)))
    if months is not None:
        df = df.filter(F.col("month").isin(list(months)))
    return df.select(*PLAY_COLUMNS)


#: Rows of one text file: gzip can't be split, so a file is read by one task.
TEXT_FILE_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", compression: str = "gzip") -> str:
    """Flat JSON / Parquet / CSV sinks.  Text is compressed (field names
    and defaults repeat in every line), unless ``compression`` is ``none``."""
    w = df.write.mode(mode)
    text = w.option("compression", compression).option("maxRecordsPerFile", TEXT_FILE_ROWS)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        text.json(path)
    elif fmt == "csv":
        text.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def to_export(df: DataFrame) -> DataFrame:
    """Canonical (raw or clean) plays -> export-shaped records (``ts`` as
    ISO-8601 UTC text with a ``Z``), e.g. to write JSON exports."""
    back = {v: k for k, v in EXPORT_FIELDS.items()}
    cols = []
    for c in df.columns:
        if c == "ts":
            cols.append(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"))
        elif c in back:
            cols.append(F.col(c).alias(back[c]))
        elif c == "user_id":
            cols.append(F.col(c))
    return df.select(*cols)
