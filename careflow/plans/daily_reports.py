"""Confirmed daily reports kept as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careflow.functions import scalars as S
from careflow.operators.changes import conform, with_new_ids
from careflow.operators.ordered import order_value

# The state of a saved report and who saves it if nobody is named.
CONFIRMED, DEFAULT_USER = "CONFIRMED", "SYSTEM"


def confirm_reports(reports: DataFrame, confirmed: DataFrame, now: str, order: list[str] | None = None) -> DataFrame:
    """Saves reports (report_date, final_data struct, user), one per date.

    A new report leaves `confirmed_at` NULL; confirming again, also within the batch, sets
    it to `now`. Of several confirmations of a date the last in `order` counts (without an
    order, the greatest text). A missing user is SYSTEM.
    """
    named = confirmed.select(
        "report_date",
        F.struct(F.to_json("final_data").alias("json"), S.label_or_default("user", DEFAULT_USER).alias("user")).alias("__new"),
        *(order or []),
    )
    incoming = named.groupBy("report_date").agg(
        F.max_by("__new", order_value(order or ["__new"])).alias("__new"), F.count(F.lit(1)).alias("__times")
    )
    incoming = incoming.select(
        "report_date", F.col("__new.json").alias("__json"), F.col("__new.user").alias("__user"), "__times"
    )
    hit = F.col("__json").isNotNull()
    updated = reports.join(incoming, "report_date", "left").select(
        *[
            {
                "report_status": F.when(hit, CONFIRMED).otherwise(F.col("report_status")),
                "final_data": F.coalesce("__json", "final_data"),
                "confirmed_by_user": F.when(hit, F.col("__user")).otherwise(F.col("confirmed_by_user")),
                "confirmed_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("confirmed_at")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in reports.columns
        ]
    )
    fresh = incoming.join(reports.select("report_date"), "report_date", "left_anti").select(
        "report_date",
        F.lit(CONFIRMED).alias("report_status"),
        F.col("__json").alias("final_data"),
        F.col("__user").alias("confirmed_by_user"),
        F.when(F.col("__times") > 1, F.lit(now).cast("timestamp")).alias("confirmed_at"),
    )
    added = with_new_ids(fresh, reports, ["report_date"])
    return updated.unionByName(conform(added, reports))


def load_report(reports: DataFrame, day: S.DateLike, schema: str) -> DataFrame:
    """The report of a date with its JSON parsed by the given schema."""
    rows = reports.where(F.col("report_date") == S.as_date(day))
    return rows.withColumn("final_data", F.from_json("final_data", schema))
