from datetime import date, datetime

from pyspark.sql import functions as F

from careflow.session import shared_path
from careflow.streaming import streams
from tests.conftest import rows


def files(spark, batches, schema):
    """One file per batch, read one at a time."""
    folder = shared_path(spark, "stream-input")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ledger_carries_stock_from_batch_to_batch_and_over_a_restart(spark):
    schema = "supply_id bigint, t int, change_amount bigint"
    folder, stream = files(spark, [[(1, 2, -4), (1, 1, -3), (9, 1, 5)], [(1, 3, 2), (1, 4, -4), (2, 1, 1), (2, 2, None)]], schema)
    supplies = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 8, "c")], "id bigint, quantity bigint, name string")
    out = shared_path(spark, "ledger")
    streams.ledger_stream(spark, stream, supplies, out, ["t"]).awaitTermination()
    assert rows(streams.ledger_log(spark, out), "supply_id", "t", "status", "new_quantity") == [
        (1, 1, "accepted", 2), (1, 2, "negative", None), (1, 3, "accepted", 4), (1, 4, "accepted", 0),
        (2, 1, "accepted", 1), (2, 2, "bad amount", None), (9, 1, "unknown supply", None),
    ]

    spark.createDataFrame([(1, 5, -1), (1, 6, 7)], schema).coalesce(1).write.mode("append").parquet(folder)
    streams.ledger_stream(spark, stream, supplies, out, ["t"]).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/log").where("version = 2"), "t", "status", "new_quantity") == [
        (5, "negative", None), (6, "accepted", 7),
    ]
    assert rows(streams.ledger_stock(spark, supplies, out)) == [(1, 7, "a"), (2, 1, "b"), (3, 8, "c")]
    # A micro-batch writes the supplies it changed only.
    written = spark.read.parquet(f"{out}/stock")
    assert rows(written, "version", "id", "quantity") == [(0, 1, 2), (1, 1, 0), (1, 2, 1), (2, 1, 7)]


def test_one_session_a_day_accepts_or_rejects_every_row(spark):
    schema = "patient_id bigint, ts timestamp, n int"
    at = datetime(2025, 1, 1, 8)
    _, stream = files(
        spark,
        [
            [(1, at.replace(hour=9), 1), (1, at, 2), (1, at, 3), (None, at, 4), (5, None, 5)],
            [(1, at.replace(hour=7), 6), (2, at, 7), (3, datetime(2025, 2, 1), 8), (1, datetime(2025, 1, 2), 9)],
        ],
        schema,
    )
    judged = streams.one_session_a_day(stream, "ts", "2025-01-31", ["n"])
    accepted, rejected = streams.run_split(judged, shared_path(spark, "stream"))
    assert rows(accepted, "n", "patient_id", "session_date") == [
        (2, 1, date(2025, 1, 1)), (7, 2, date(2025, 1, 1)), (9, 1, date(2025, 1, 2)),
    ]
    assert rows(rejected, "n", "verdict") == [
        (1, "second session"), (3, "second session"), (4, "missing patient"), (5, "missing time"),
        (6, "second session"), (8, "future date"),
    ]


def test_a_timer_frees_a_remembered_day(spark):
    at = datetime(2025, 1, 1, 8)
    _, stream = files(spark, [[(1, at)], [(2, at)], [(1, at)]], "patient_id bigint, ts timestamp")
    judged = streams.one_session_a_day(stream, "ts", "2025-01-31", keep="0 seconds")
    accepted, rejected = streams.run_split(judged, shared_path(spark, "stream"))
    assert (accepted.count(), rejected.count()) == (3, 0)


DAYS = [datetime(2025, 1, d, 12) for d in (1, 1, 2, 5)]


def test_daily_counts_in_append_mode_hold_final_days_only(spark):
    _, stream = files(spark, [[(d,) for d in DAYS]], "ts timestamp")
    got = streams.run_to_folder(streams.daily_session_counts(stream, "ts"), shared_path(spark, "stream"))
    assert rows(got) == [(date(2025, 1, 1), 2), (date(2025, 1, 2), 1)]


def test_daily_counts_as_a_table_hold_every_day(spark):
    batches = [[(d,) for d in DAYS], [(datetime(2025, 1, 5, 1),)], [(datetime(2025, 1, 6),)]]
    folder, stream = files(spark, batches, "ts timestamp")
    out, counts = shared_path(spark, "stream"), streams.daily_session_counts(stream, "ts")
    expected = [(date(2025, 1, 1), 2), (date(2025, 1, 2), 1), (date(2025, 1, 5), 2), (date(2025, 1, 6), 1)]
    assert rows(streams.run_to_table(counts, out, ["session_date"])) == expected
    # Run again, nothing is counted twice; new rows add to their day.
    assert rows(streams.run_to_table(counts, out, ["session_date"])) == expected
    spark.createDataFrame([(datetime(2025, 1, 6, 2),)], "ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    assert rows(streams.run_to_table(counts, out, ["session_date"])) == [*expected[:3], (date(2025, 1, 6), 2)]


def test_alerts_equal_the_batch(spark):
    types = spark.createDataFrame(
        [(1, "K", "mmol", "number", 4.0, 6.0, None)],
        "id bigint, test_name string, unit string, result_type string, normal_range_low double, normal_range_high double, normal_value_text string",
    )
    who = spark.createDataFrame([(1, "p", "m")], "id bigint, name string, medical_id string")
    schema = "id bigint, patient_id bigint, test_id bigint, result_value string, result_date date"
    _, stream = files(spark, [[(1, 1, 1, "7", date(2025, 1, 1))], [(2, 1, 1, "5", date(2025, 1, 1)), (3, 1, 1, "x", date(2025, 1, 2))]], schema)
    got = streams.run_to_folder(streams.critical_alerts(stream, who, types), shared_path(spark, "stream"))
    assert rows(got.select(F.col("id"))) == [(1,), (3,)]


def test_state_is_whole_again_after_every_few_batches(spark, monkeypatch):
    monkeypatch.setattr(streams, "WHOLE_EVERY", 2)
    _, stream = files(spark, [[(1, n, -1), (2, n, 1)] for n in range(6)], "supply_id bigint, t int, change_amount bigint")
    supplies = spark.createDataFrame([(1, 4), (2, None)], "id bigint, quantity bigint")
    out = shared_path(spark, "ledger")
    streams.ledger_stream(spark, stream, supplies, out, ["t"]).awaitTermination()
    assert rows(streams.ledger_log(spark, out).where("supply_id = 1"), "t", "new_quantity") == [
        (0, 3), (1, 2), (2, 1), (3, 0), (4, None), (5, None),
    ]
    assert rows(streams.ledger_stock(spark, supplies, out)) == [(1, 0), (2, 6)]

    at = datetime(2025, 1, 1, 8)
    _, stream = files(spark, [[(1, at, n), (n, at, n)] for n in range(2, 7)], "patient_id bigint, ts timestamp, n int")
    judged = streams.one_session_a_day(stream, "ts", "2025-01-31", ["n"])
    accepted, rejected = streams.run_split(judged, shared_path(spark, "stream"))
    assert rows(accepted, "patient_id", "n") == [(1, 2), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert rows(rejected, "patient_id", "n", "verdict") == [(1, n, "second session") for n in range(3, 7)]
