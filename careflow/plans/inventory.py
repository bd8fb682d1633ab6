"""Supplies, stock ledger, purchase orders."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from careflow.functions import filters, scalars as S
from careflow.operators.changes import conform, require, split_valid, with_new_ids
from careflow.operators.joins import join_many, join_unique
from careflow.operators.ledger import apply_movements
from careflow.operators.ordered import (
    BLOCK, HOT_ROWS, PLACE_BITS, first_wins, hot_keys, place_rows, running_sum, split_hot,
)
from careflow.operators.paging import ordered_listing
from careflow.session import materialise, stored

# Order states and the log note of a receipt, which the order's number follows.
PENDING, COMPLETED = "Pending", "Completed"
RECEIPT_NOTE = "استلام أمر شراء رقم "


def supply_list(
    supplies: DataFrame, term: str | None = None, status: str | None = None, as_of: S.DateLike | None = None
) -> DataFrame:
    """Supplies by name, with a search and one of low_stock, expired, expiring_soon."""
    rows = filters.search(supplies, term, ["name", "type"])
    if status == "low_stock":
        rows = filters.low_stock(rows)
    elif status:
        rows = filters.expiry_status(rows, "expiry_date", as_of, {"expiring_soon": "expiring"}.get(status, status))
    return ordered_listing(rows, ["name", "id"])


def orders_with_supplier(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    joined = orders.join(names, "supplier_id").select(*orders.columns, "supplier_name")
    return ordered_listing(joined, ["-order_date", "-id"])


def order_detail(
    orders: DataFrame, suppliers: DataFrame, items: DataFrame, supplies: DataFrame, order_id: Any = None
) -> DataFrame:
    """A row per item with its order, supplier and supply; an order without items has one
    row with NULL item columns. Without an id, all orders."""
    head = filters.equals_if_given(orders, {"id": order_id})
    lines = filters.equals_if_given(items, {"purchase_order_id": order_id})
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    goods = supplies.select(F.col("id").alias("supply_id"), F.col("name").alias("supply_name"))
    lines = lines.join(goods, "supply_id").select(
        F.col("purchase_order_id").alias("id"), F.col("id").alias("item_id"),
        "supply_id", "supply_name", "quantity_ordered", "unit_price",
    )
    return join_many(head.join(names, "supplier_id"), lines, ["id"]).select(
        "id", "supplier_id", "supplier_name", "order_date", "status",
        "item_id", "supply_id", "supply_name", "quantity_ordered", "unit_price",
    )


def running_balance(
    log: DataFrame, key: str, order: list[str], amount: str, name: str = "new_quantity", **hot: int
) -> DataFrame:
    """Quantity after each movement, starting at 0."""
    return running_sum(log, [key], order, amount, name, **hot)


def opening_stock(supplies: DataFrame) -> DataFrame:
    """(supply_id, quantity) of supplies; no quantity counts as none in stock."""
    return supplies.select(F.col("id").alias("supply_id"), F.coalesce("quantity", F.lit(0)).cast("bigint").alias("quantity"))


def judged_movements(
    movements: DataFrame, stock: DataFrame, order: list[str], hot_rows: int = HOT_ROWS, blocks: int | None = None
) -> DataFrame:
    """The log of `stock_ledger`, not written yet. `stock` has (supply_id, quantity) before the movements."""
    stock = stock.withColumnRenamed("quantity", "__opening")
    known = movements.withColumn("change_amount", S.int_part("change_amount")).join(stock, "supply_id", "left")
    can_apply = F.col("__opening").isNotNull() & F.col("change_amount").isNotNull()
    walked = apply_movements(
        known.where(can_apply), "supply_id", order, "change_amount", "__opening", hot_rows, blocks,
        hot=hot_keys(movements, ["supply_id"], hot_rows),
    )
    judged = walked.withColumn("status", F.when(F.col("applied"), "accepted").otherwise("negative"))
    refused = known.where(~can_apply).withColumn(
        "status", F.when(F.col("__opening").isNull(), "unknown supply").otherwise("bad amount")
    )
    return judged.withColumnRenamed("balance", "new_quantity").drop("applied", "__opening").unionByName(
        refused.withColumn("new_quantity", F.lit(None).cast("bigint")).drop("__opening")
    )


def stock_ledger(
    supplies: DataFrame, movements: DataFrame, order: list[str], hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Applies signed movements (supply_id, change_amount) in order.

    Log per movement: `status` accepted, negative, unknown supply or bad amount,
    and `new_quantity` of the accepted ones. Quantities are whole numbers; a
    fraction in the amount is cut off.
    """
    log = judged_movements(movements, opening_stock(supplies), order, hot_rows, blocks)
    # Walked once: the log is written and the stock is worked out from it.
    log = stored(log, "stock-log")
    return apply_changes(supplies, log.where("status = 'accepted'")), log


def apply_changes(supplies: DataFrame, accepted: DataFrame) -> DataFrame:
    """Supplies with the accepted amounts added; amounts are summed before the join."""
    change = accepted.groupBy(F.col("supply_id").alias("id")).agg(F.sum("change_amount").alias("__change"))
    quantity = F.coalesce("quantity", F.lit(0)) + F.coalesce("__change", F.lit(0))
    return (
        supplies.join(change, "id", "left")
        .withColumn("quantity", quantity.cast("bigint"))
        .select(*supplies.columns)
    )


def create_orders(
    orders: DataFrame, items: DataFrame, headers: DataFrame, lines: DataFrame, order: list[str],
    line_order: list[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New orders and items from headers (request, supplier_id, order_date, …) and their
    lines (request, …), numbered in `order` and, within an order, `line_order`. A header
    without supplier, date or lines is refused.

    Returns orders, items, log (request, action, id).
    """
    requested = lines.select("request").distinct().withColumn("__lines", F.lit(True))
    checked = require(
        headers.join(requested, "request", "left"), ["supplier_id", "order_date"], {"no items": F.col("__lines")}
    ).drop("__lines")
    valid, bad = split_valid(checked)
    numbered = with_new_ids(valid, orders, order)
    new_lines = lines.join(numbered.select("request", F.col("id").alias("purchase_order_id")), "request")
    new_items = with_new_ids(new_lines, items, ["purchase_order_id", *line_order])
    log = numbered.select("request", F.lit("created").alias("action"), "id").unionByName(
        bad.select("request", F.array_join("reasons", "; ").alias("action")), allowMissingColumns=True
    )
    return (
        orders.unionByName(conform(numbered, orders, {"status": PENDING})),
        items.unionByName(conform(new_items, items, {"quantity_ordered": 1, "unit_price": 0.0})),
        log,
    )


def receive_orders(
    orders: DataFrame, items: DataFrame, supplies: DataFrame, receipts: DataFrame, item_order: list[str],
    hot_rows: int = HOT_ROWS, blocks: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Receives orders whole or not at all. `receipts` has request (arrival order) and
    order_id.

    Returns supplies, orders, inventory log rows, verdict per receipt: received,
    unknown order, already completed, no items or unknown supply.
    """
    first = materialise(first_wins(receipts, ["order_id"], ["request"]))
    head = orders.select(F.col("id").alias("order_id"), F.col("status").alias("__status"))
    mine = join_unique(
        items.withColumnRenamed("purchase_order_id", "order_id"), first.select("order_id", "request"), ["order_id"], "inner"
    )
    stock = supplies.select(
        F.col("id").alias("supply_id"), F.col("quantity").alias("__opening"), F.lit(True).alias("__known")
    )
    # The items of the receipts, read once: contents, hot supplies and balances come from these rows.
    wanted = list(dict.fromkeys(["order_id", "request", "supply_id", "quantity_ordered", *item_order]))
    mine = stored(mine.join(stock, "supply_id", "left").select(*wanted, "__opening", "__known"), "received-items")
    contents = mine.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("__items"), F.count_if(F.col("__known").isNull()).alias("__unknown")
    )
    verdict = (
        F.when(F.col("__status").isNull(), "unknown order")
        .when(F.col("__status") == COMPLETED, "already completed")
        .when(F.col("__items").isNull(), "no items")
        .when(F.col("__unknown") > 0, "unknown supply")
        .otherwise("received")
    )
    judged = (
        first.join(head, "order_id", "left").join(contents, "order_id", "left").withColumn("verdict", verdict)
    )
    judged = materialise(judged)
    received = judged.where("verdict = 'received'").select("order_id")

    stocked = running_sum(
        join_unique(mine, received, ["order_id"], "left_semi"),
        ["supply_id"], ["request", *item_order], "quantity_ordered", "__added", hot_rows, blocks,
        hot=hot_keys(mine, ["supply_id"], hot_rows),
    )
    log = stocked.select(
        "supply_id",
        F.col("quantity_ordered").alias("change_amount"),
        (F.coalesce("__opening", F.lit(0)) + F.col("__added")).alias("new_quantity"),
        F.concat(F.lit(RECEIPT_NOTE), F.col("order_id").cast("string")).alias("notes"),
    )
    new_orders = (
        orders.join(received.select(F.col("order_id").alias("id"), F.lit(True).alias("__done")), "id", "left")
        .withColumn("status", F.when(F.col("__done"), COMPLETED).otherwise(F.col("status")))
        .select(*orders.columns)
    )
    repeated = F.col("first_request") != F.col("request")
    verdicts = receipts.join(
        judged.select("order_id", F.col("request").alias("first_request"), "verdict"), "order_id"
    ).select(
        "request",
        "order_id",
        F.when(repeated & (F.col("verdict") == "received"), "already completed")
        .otherwise(F.col("verdict"))
        .alias("verdict"),
    )
    return apply_changes(supplies, log), new_orders, log, verdicts


def reconcile_ledger(
    supplies: DataFrame, log: DataFrame, order: list[str], hot_rows: int = HOT_ROWS, blocks: int | None = None
) -> DataFrame:
    """Per logged supply: does every entry follow from the one before, and is the last
    logged quantity the current one?

    Each entry is compared with the one before it. A hot supply is cut into blocks of the order;
    the first entry of a block is compared with the last one of the block before.
    """
    columns = ["supply_id", *order, "change_amount", "new_quantity"]
    rows = log.select(*dict.fromkeys(columns))
    hot = hot_keys(rows, ["supply_id"], hot_rows)
    if hot.isEmpty():
        cut = rows.withColumn(BLOCK, F.lit(0).cast("bigint"))
    else:
        large, rest = split_hot(rows, ["supply_id"], hot)
        placed = place_rows(large, ["supply_id", *order], "__place", blocks)
        placed = placed.withColumn(BLOCK, F.shiftright("__place", PLACE_BITS)).drop("__place")
        cut = placed.unionByName(rest.withColumn(BLOCK, F.lit(0).cast("bigint")))
    by = Window.partitionBy("supply_id", BLOCK).orderBy(*order)
    before = F.lag(F.struct("new_quantity")).over(by)
    seen = cut.withColumn("__before", before).withColumn("__last", F.lead(F.lit(1)).over(by).isNull())
    opening = F.col("new_quantity") - F.col("change_amount")
    first = F.col("__before").isNull()
    parts = seen.groupBy("supply_id", BLOCK).agg(
        F.count(F.lit(1)).alias("entries"),
        F.bool_and(first | F.coalesce(F.col("__before.new_quantity") == opening, F.lit(False))).alias("joined"),
        F.max(F.when(first, opening)).alias("opens"),
        F.max(F.when(F.col("__last"), F.col("new_quantity"))).alias("closes"),
    )
    # One row per block of a supply.
    chain = Window.partitionBy("supply_id").orderBy(BLOCK)
    parts = parts.withColumn("__closed", F.lag(F.struct("closes")).over(chain)).withColumn(
        "__end", F.lead(F.lit(1)).over(chain).isNull()
    )
    follows = F.col("__closed").isNull() | F.coalesce(F.col("__closed.closes") == F.col("opens"), F.lit(False))
    per_supply = parts.groupBy("supply_id").agg(
        F.sum("entries").alias("entries"),
        F.max(F.when(F.col("__end"), F.col("closes"))).alias("last_logged"),
        F.bool_and(F.col("joined") & follows).alias("gap_free"),
    )
    current = supplies.select(F.col("id").alias("supply_id"), "quantity")
    return per_supply.join(current, "supply_id", "left").select(
        "supply_id", "entries", "last_logged", "quantity", "gap_free",
        F.coalesce(F.col("last_logged") == F.col("quantity"), F.lit(False)).alias("matches_stock"),
    )


def use_supplies(
    supplies: DataFrame, usage: DataFrame, order: list[str], hot_rows: int = HOT_ROWS, blocks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Withdraws used quantities (supply_id, quantity_used) in order. The quantity must be a positive
    number; its whole part is taken from the stock and logged as a negative change.

    Log: as of `stock_ledger`; status bad quantity for what is no positive number.
    """
    used = S.column("quantity_used").cast("string").try_cast("double")
    good = F.coalesce((used > 0) & ~F.isnan(used), F.lit(False))
    asked = usage.withColumn("__good", good)
    moves = asked.where("__good").withColumn("change_amount", -S.int_part("quantity_used"))
    state, log = stock_ledger(supplies, moves.drop("quantity_used", "__good"), order, hot_rows, blocks)
    refused = asked.where("NOT __good").drop("quantity_used", "__good").withColumns(
        {"change_amount": F.lit(None).cast("bigint"), "status": F.lit("bad quantity"), "new_quantity": F.lit(None).cast("bigint")}
    )
    return state, log.unionByName(refused)

