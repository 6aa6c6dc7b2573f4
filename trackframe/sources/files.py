"""File sources and sinks for tracking data (io1-io9, u1).

Reading is one multi-file scan with a declared schema (no inference), so a
season of weekly files is a single distributed read; the week comes from each
row's file name through the ``_metadata`` column, and a week filter is a plain
predicate on it.  Sinks are keyed: predictions are joined to the request ids,
never aligned by position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from trackframe.operators.quality import InvalidSubmission

# Declared schemas of the input (pre-pass), output (targets) and
# test (request) files; file name patterns of the weekly files.
INPUT_SCHEMA = StructType([
    StructField("game_id", LongType()), StructField("play_id", LongType()),
    StructField("player_to_predict", BooleanType()), StructField("nfl_id", LongType()),
    StructField("frame_id", LongType()), StructField("play_direction", StringType()),
    StructField("absolute_yardline_number", DoubleType()), StructField("player_name", StringType()),
    StructField("player_height", StringType()), StructField("player_weight", DoubleType()),
    StructField("player_birth_date", StringType()), StructField("player_position", StringType()),
    StructField("player_side", StringType()), StructField("player_role", StringType()),
    StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("s", DoubleType()),
    StructField("a", DoubleType()), StructField("dir", DoubleType()), StructField("o", DoubleType()),
    StructField("num_frames_output", LongType()),
    StructField("ball_land_x", DoubleType()), StructField("ball_land_y", DoubleType()),
])
OUTPUT_SCHEMA = StructType([
    StructField("game_id", LongType()), StructField("play_id", LongType()), StructField("nfl_id", LongType()),
    StructField("frame_id", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType()),
])
TEST_SCHEMA = StructType([
    StructField("id", StringType()), StructField("game_id", LongType()), StructField("play_id", LongType()),
    StructField("nfl_id", LongType()), StructField("frame_id", LongType()),
])
INPUT_PATTERN = "input_2023_w*.csv"
OUTPUT_PATTERN = "output_2023_w*.csv"
WEEK_FROM_NAME = r"_w(\d+)\.csv(?:/[^/]*)?$"


WEEK_DIR = "file"


class NoTrackingFiles(FileNotFoundError):
    """No file matched the pattern (io3)."""


class UnusableRequest(ValueError):
    """The request rows themselves cannot be scored (v11)."""

    error_type = "GATEWAY_RAISED_EXCEPTION"


class TooManyMalformed(ValueError):
    """More malformed lines than the reader was told to bear (io1)."""


CORRUPT = "_malformed_line"


def read_by_name(spark: SparkSession, path: str, schema: StructType, quarantine: str | None = None, most: int = 0) -> DataFrame:
    """CSV columns bound by the header's names, in any order (io1, io4, io6).

    A file whose header differs from the first one's fails the read; a declared column that the header lacks is null, and
    an undeclared one is left out.  So does a line that does not parse, unless ``quarantine`` names a folder: the lines
    then go there as a table (file, line, parsed_fields), and if there are more than ``most`` of them ``TooManyMalformed`` is raised,
    with the table left in place.
    """
    header = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f for f in schema.fields}
    in_file = [declared.get(c, StructField(c, StringType())) for c in header]
    cols = [F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    file = F.col("_metadata.file_path").alias("_file")
    if quarantine is None:
        return spark.read.schema(StructType(in_file)).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path).select(*cols, file)
    lines = spark.read.schema(StructType([*in_file, StructField(CORRUPT, StringType())])).options(
        header=True, enforceSchema=False, columnPruning=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path).select("*", file)
    parsed = sum((F.col(c).isNotNull().cast("int") for c in header), F.lit(0))
    lines.where(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("line"), parsed.alias("parsed_fields")).write.mode(
        "append").parquet(quarantine)
    found = spark.read.parquet(quarantine).count()
    if found > most:
        raise TooManyMalformed(f"{found} malformed lines, {most} allowed; see {quarantine}")
    return lines.where(F.col(CORRUPT).isNull() & (parsed >= 0)).select(*cols, "_file")  # Spark refuses a query that reads the corrupt record alone


def _glob_exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = path.getFileSystem(conf).globStatus(path)
    return statuses is not None and len(statuses) > 0


def week_of(file: str) -> Column:
    """The week in a weekly file's name."""
    return F.regexp_extract(file, WEEK_FROM_NAME, 1).cast("int")


def read_weekly(spark: SparkSession, folder: str, pattern: str, schema: StructType, weeks: list[int] | None = None,
                quarantine: str | None = None, most: int = 0) -> DataFrame:
    """All weekly CSVs under ``folder`` in one scan, tagged with ``week`` (io1, u1); ``quarantine`` as in ``read_by_name``.

    A week is a file or, as ``write_weekly_csv`` leaves it, a folder of parts that bears the file's name.
    """
    glob = f"{folder.rstrip('/')}/{{,{WEEK_DIR}=}}{pattern}"
    if not _glob_exists(spark, glob):
        raise NoTrackingFiles(glob)
    df = read_by_name(spark, glob, schema, quarantine, most).withColumn("week", week_of("_file")).drop("_file")
    if weeks:
        df = df.where(F.col("week").isin(list(weeks)))
    return df


def load_training_data(spark: SparkSession, folder: str, weeks: list[int] | None = None
                       ) -> tuple[DataFrame, DataFrame]:
    """(input, output) frames of the selected weeks (io1-io3).  A missing
    output folder gives an empty frame with the output schema (io2)."""
    inp = read_weekly(spark, folder, INPUT_PATTERN, INPUT_SCHEMA, weeks)
    try:
        out = read_weekly(spark, folder, OUTPUT_PATTERN, OUTPUT_SCHEMA, weeks)
    except NoTrackingFiles:
        out = spark.createDataFrame([], StructType([*OUTPUT_SCHEMA.fields, StructField("week", IntegerType())]))
    return inp, out


def load_test_data(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(test rows, test inputs) (io4, io6); the request rows must carry ``id``."""
    folder = folder.rstrip("/")
    if "id" not in spark.read.option("header", True).csv(f"{folder}/test.csv").columns:
        raise UnusableRequest(f"{folder}/test.csv carries no request ids (column id)")
    return (read_by_name(spark, f"{folder}/test.csv", TEST_SCHEMA).drop("_file"),
            read_by_name(spark, f"{folder}/test_input.csv", INPUT_SCHEMA).drop("_file"))


def write_weekly_csv(df: DataFrame, folder: str, pattern: str) -> None:
    """Every week of ``df`` in one job: for each a folder of CSV parts, which ``read_weekly`` takes like a file."""
    name = F.format_string(pattern.replace("*", "%02d"), F.col("week"))
    df.withColumn(WEEK_DIR, name).drop("week").write.mode("overwrite").partitionBy(WEEK_DIR).option("header", True).csv(folder)


def write_request_csv(requests: DataFrame, inputs: DataFrame, folder: str) -> None:
    """The test pair ``test.csv`` and ``test_input.csv`` that ``load_test_data`` reads (io4, io6)."""
    for df, name in ((requests, "test.csv"), (inputs, "test_input.csv")):
        df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def write_predictions_csv(pred: DataFrame, path: str) -> None:
    """``id, x, y`` with a header (io7)."""
    pred.select("id", "x", "y").write.mode("overwrite").option("header", True).csv(path)


def submission(pred: DataFrame, row_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The request ids first, then the predicted columns, joined on the id (io8, j16).  A prediction column named like an
    id column is replaced by the request's value; an id predicted twice fails the query instead of doubling its row."""
    ids = row_ids.columns
    rest = [c for c in pred.columns if c not in ids]
    twice = F.raise_error(F.concat(F.lit("predicted twice: "), F.col(id_col).cast("string")))
    one = pred.groupBy(id_col).agg(F.first(F.struct(*rest)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    one = one.where(F.when(F.col("_n") > 1, twice.cast("boolean")).otherwise(F.lit(True)))
    return row_ids.join(one, id_col, "left").select(*ids, *[F.col(f"_p.{c}").alias(c) for c in rest])


def write_submission(pred: DataFrame, row_ids: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """``submission`` as Parquet (io8)."""
    out = submission(pred, row_ids, id_col)
    out.write.mode("overwrite").parquet(path)
    return out


POINTER = "CURRENT"


def _publish(spark: SparkSession, folder: str, version: str) -> None:
    """Let ``CURRENT`` name ``version``: written beside it and moved over it in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    beside, final = place(f"{folder}/_{POINTER}-{version}"), place(f"{folder}/{POINTER}")
    fs = final.getFileSystem(conf)
    with_text = fs.create(beside, True)
    with_text.write(bytearray(version.encode()))
    with_text.close()
    options = jvm.org.apache.hadoop.fs.Options
    over = spark.sparkContext._gateway.new_array(options.Rename, 1)
    over[0] = options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, final, over)


def publish_submission(spark: SparkSession, pred: DataFrame, row_ids: DataFrame, folder: str, id_col: str = "id") -> str:
    """Submission and run record as one commit (io8, io9); the version's name.

    Both are written to a folder of their own, the record last, with the number of rows that the written submission
    has.  Only then does the pointer move, in one step, so a reader sees the version before or this one, and what a lost
    driver leaves behind is never read.  A failing submission leaves its record, and the pointer where it was.
    """
    folder, version = folder.rstrip("/"), uuid.uuid4().hex
    stage = f"{folder}/version={version}"
    try:
        submission(pred, row_ids, id_col).write.parquet(f"{stage}/submission")
    except Exception as error:
        write_result(spark, f"{stage}/result", InvalidSubmission(str(error)))
        raise
    write_result(spark, f"{stage}/result", rows=spark.read.parquet(f"{stage}/submission").count())
    _publish(spark, folder, version)
    return version


def read_published(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(submission, run record) of the published version; the record's rows are checked against the submission's."""
    folder = folder.rstrip("/")
    version = spark.read.text(f"{folder}/{POINTER}").first()["value"]
    rows, result = spark.read.parquet(f"{folder}/version={version}/submission"), read_result(spark, f"{folder}/version={version}/result")
    if (want := result.first()["rows"]) != (got := rows.count()):
        raise InvalidSubmission(f"{folder} has {got} rows, its record {want}")
    return rows, result


RESULT = "succeeded boolean, error_type string, error_name string, error_details string, rows bigint"


def write_result(spark: SparkSession, path: str, error: BaseException | None = None, rows: int | None = None) -> None:
    """One-row run record: success flag, error class and name, detail cut to
    8000 characters, rows written (io9, v11)."""
    if error is None:
        row = (True, None, None, None, rows)
    else:
        kind = getattr(error, "error_type", UnusableRequest.error_type)
        row = (False, kind, type(error).__name__, str(error)[:8000], rows)
    spark.createDataFrame([row], RESULT).coalesce(1).write.mode("overwrite").json(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)
