"""Streaming forms of the batch operators.

Sinks are keyed by the number of the micro-batch: a batch that is run again after a failure
overwrites what it wrote before, so every result holds each input row once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from careflow.functions import scalars as S
from careflow.operators.admission import ACCEPTED
from careflow.operators.joins import join_unique
from careflow.operators.ordered import last_wins, rank_in_group
from careflow.plans import inventory
from careflow.plans.labs import abnormal_results

VERSION = "version"
NOW = "__now"
DAY = ["patient_id", "session_date"]
STOCK = "id bigint, quantity bigint"
# Micro-batches from one that writes the whole state to the next.
WHOLE_EVERY = 16


def daily_session_counts(sessions: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Sessions per day of a stream. In append mode a day appears once the watermark has passed it,
    in update mode with every micro-batch that adds to it."""
    return (
        sessions.withWatermark(time, late)
        .groupBy(F.window(time, "1 day"))
        .agg(F.count(F.lit(1)).alias("session_count"))
        .select(F.col("window.start").cast("date").alias("session_date"), "session_count")
    )


def critical_alerts(results: DataFrame, patients: DataFrame, types: DataFrame) -> DataFrame:
    """Abnormal results of a stream, joined to the static patients and test types."""
    return abnormal_results(results, patients, types)


class DayRules(NamedTuple):
    """A stream of sessions with day, reason of refusal and time of the micro-batch, and how to judge it."""

    sessions: DataFrame
    order: list[str]
    keep: int


def one_session_a_day(
    sessions: DataFrame, time: str, as_of: S.DateLike, order: list[str] | None = None, keep: str = "30 days"
) -> DayRules:
    """Every row with its day and `verdict`: accepted for the first session per patient and day (in a
    micro-batch the first by time and `order`), else second session, missing patient, missing time or
    future date.

    A patient's day is remembered for `keep` of processing time (days, hours, minutes or seconds).
    Run it with `run_split`, which keeps what is remembered in its folder.
    """
    dated = sessions.withColumn("session_date", F.to_date(time))
    refused = (
        F.when(F.col("patient_id").isNull(), "missing patient")
        .when(F.col("session_date").isNull(), "missing time")
        .when(F.col("session_date") > S.as_date(as_of), "future date")
    )
    # The time of a micro-batch stays the same when it is run again.
    judged = dated.withColumns({"verdict": refused, NOW: F.unix_millis(F.current_timestamp())})
    return DayRules(judged, [time, *(order or [])], _milliseconds(keep))


UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(duration: str) -> int:
    number, unit = duration.split()
    return int(number) * UNITS[unit.removesuffix("s")]


def _judged_days(batch: DataFrame, order: list[str], seen: DataFrame) -> DataFrame:
    """The rows of a micro-batch with their verdicts. `seen` has the days that are remembered."""
    nulls_last = [F.col(c).asc_nulls_last() for c in order]
    ranked = rank_in_group(batch.where("verdict IS NULL"), DAY, nulls_last, "__nth")
    ranked = join_unique(ranked, seen.withColumn("__seen", F.lit(True)), DAY)
    first = (F.col("__nth") == 1) & F.col("__seen").isNull()
    ranked = ranked.withColumn("verdict", F.when(first, ACCEPTED).otherwise("second session"))
    # Refused rows are not ranked; they would only gather under a few keys.
    return ranked.select(*batch.columns).unionByName(batch.where("verdict IS NOT NULL"))


def _given(spark: SparkSession, batch: DataFrame, folder: str) -> DataFrame:
    """The rows of a micro-batch, read from the source once. Plans of the stream's own session are not adaptive."""
    batch.write.mode("overwrite").parquet(f"{folder}/given")
    return spark.read.schema(batch.schema).parquet(f"{folder}/given")


def _before(
    spark: SparkSession, folder: str, name: str, schema: str, keys: list[str], number: int, first: DataFrame, live: Column
) -> DataFrame:
    """The live state that the micro-batches before `number` left in `folder`: per key the row they wrote
    last to `name`, or else that of `first`.

    Each `WHOLE_EVERY`th micro-batch writes the whole of it, in turn to one of two places, so the
    others read no more versions than that, and one that is run again finds what it read before.
    """

    def whole(base: int) -> str:
        return f"{folder}/before/{base // WHOLE_EVERY % 2}"

    def read(base: int, to: int) -> DataFrame:
        began = spark.read.schema(schema).parquet(whole(base))
        if base == to:
            return began.where(live)
        paths = [f"{folder}/{name}/{VERSION}={n}" for n in range(base, to)]
        later = spark.read.schema(f"{schema}, {VERSION} bigint").option("basePath", f"{folder}/{name}").parquet(*paths)
        rows = later.unionByName(began.withColumn(VERSION, F.lit(-1).cast("bigint")))
        rest = [c for c in began.columns if c not in keys]
        return rows.groupBy(*keys).agg(*[F.max_by(c, VERSION).alias(c) for c in rest]).where(live)

    base = number - number % WHOLE_EVERY
    if number == base:
        (read(base - WHOLE_EVERY, base) if base else first).write.mode("overwrite").parquet(whole(base))
    return read(base, number)


def ledger_stream(
    spark: SparkSession, movements: DataFrame, supplies: DataFrame, folder: str, order: list[str]
) -> StreamingQuery:
    """Applies a stream of movements (supply_id, change_amount, …) as they come, each micro-batch by the
    batch ledger. It writes its log and the quantities of the supplies it changed; `ledger_stock` reads
    the quantities, and so does the next micro-batch. They start from `supplies` with the first one.
    """
    opening = inventory.opening_stock(supplies).groupBy("supply_id").agg(F.min("quantity").alias("quantity"))
    opening = opening.withColumnRenamed("supply_id", "id")

    def write(batch: DataFrame, number: int) -> None:
        log = f"{folder}/log/{VERSION}={number}"
        stock = _before(spark, folder, "stock", STOCK, ["id"], number, opening, F.lit(True)).withColumnRenamed("id", "supply_id")
        judged = inventory.judged_movements(_given(spark, batch, folder), stock, order)
        judged.write.mode("overwrite").parquet(log)
        accepted = spark.read.schema(judged.schema).parquet(log).where(F.col("status") == ACCEPTED)
        change = accepted.groupBy("supply_id").agg(F.sum("change_amount").alias("__change"))
        closing = change.join(stock, "supply_id").select(
            F.col("supply_id").alias("id"), (F.col("quantity") + F.col("__change")).alias("quantity")
        )
        closing.write.mode("overwrite").parquet(f"{folder}/stock/{VERSION}={number}")

    return _run(movements, f"{folder}/progress", write)


def ledger_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/log").drop(VERSION)


def ledger_stock(spark: SparkSession, supplies: DataFrame, folder: str) -> DataFrame:
    """The supplies with the quantity that the last micro-batch left of each."""
    changed = spark.read.schema(f"id bigint, quantity bigint, {VERSION} bigint").parquet(f"{folder}/stock")
    latest = changed.groupBy("id").agg(F.max_by("quantity", VERSION).alias("__left"))
    quantity = F.coalesce("__left", "quantity", F.lit(0)).cast("bigint")
    return join_unique(supplies, latest, ["id"]).withColumn("quantity", quantity).select(*supplies.columns)


def _run(stream: DataFrame, progress: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs an update-mode stream over all available input into a keyed table and reads it: per key
    the row of the last micro-batch that had it. A micro-batch writes only the keys it changed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{VERSION}={number}")

    _run(stream, f"{folder}/progress", write, "update").awaitTermination()
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, {VERSION} bigint"
    rows = stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    return last_wins(rows, keys, [VERSION]).drop(VERSION)


def run_split(rules: DayRules, folder: str) -> tuple[DataFrame, DataFrame]:
    """Judges a stream of sessions over all available input into two tables: accepted rows, and
    rejected ones with their verdict."""
    accepted, rejected = f"{folder}/accepted", f"{folder}/rejected"
    ok = F.col("verdict") == ACCEPTED
    spark, kinds = rules.sessions.sparkSession, dict(rules.sessions.dtypes)
    schema = f"patient_id {kinds['patient_id']}, session_date date, at bigint"
    nothing = spark.createDataFrame([], schema)

    def write(batch: DataFrame, number: int) -> None:
        judged = f"{folder}/judged/{VERSION}={number}"
        given = _given(spark, batch, folder)
        now = given.agg(F.max(NOW)).first()[0] or 0
        seen = _before(spark, folder, "seen", schema, DAY, number, nothing, F.col("at") > now - rules.keep)
        rows = _judged_days(given.drop(NOW), rules.order, seen.select(*DAY))
        rows.write.mode("overwrite").parquet(judged)
        rows = spark.read.schema(rows.schema).parquet(judged)
        rows.where(ok).drop("verdict").write.mode("overwrite").parquet(f"{accepted}/{VERSION}={number}")
        rows.where(~ok).write.mode("overwrite").parquet(f"{rejected}/{VERSION}={number}")
        new = rows.where(ok).select(*DAY, F.lit(now).cast("bigint").alias("at"))
        new.write.mode("overwrite").parquet(f"{folder}/seen/{VERSION}={number}")

    _run(rules.sessions, f"{folder}/progress", write).awaitTermination()
    return spark.read.parquet(accepted).drop(VERSION), spark.read.parquet(rejected).drop(VERSION)


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all available input into parquet files and reads them back."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
