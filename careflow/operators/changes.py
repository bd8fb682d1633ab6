"""Validation and table changes as whole-table jobs.

A change takes the current state and a batch and returns the new state and a
change log. Keys of a batch are made distinct by an aggregate before they meet
the state, so the shuffle never carries a hot key's copies and the small side
can be broadcast when Spark measures it to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from careflow.functions import scalars as S
from careflow.operators.admission import admit_first_come
from careflow.operators.joins import join_unique, key_summary
from careflow.operators.ordered import HOT_ROWS, first_wins, last_wins, number_rows, order_value, rank_in_group
from careflow.schemas import DEFAULTS, REQUIRED, UNIQUE
from careflow.session import materialise, stored


def require(
    df: DataFrame, cols: Sequence[str], rules: dict[str, Column] | None = None
) -> DataFrame:
    """Adds `reasons`: 'missing <col>' for blank required columns and the names of broken rules."""
    checks = [F.when(~S.non_blank(c), F.lit(f"missing {c}")).otherwise("") for c in cols]
    checks += [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise("") for name, ok in (rules or {}).items()]
    # Compiled by Spark, as a filter of an array is not.
    return df.withColumn("reasons", F.array_remove(F.array(*checks), ""))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with reasons."""
    return (
        checked.where(F.size("reasons") == 0).drop("reasons"),
        checked.where(F.size("reasons") > 0),
    )


def unique(
    batch: DataFrame, keysets: dict[str, list[str]], order: list[str], existing: DataFrame | None = None
) -> DataFrame:
    """Adds `verdict`: 'accepted', or the key set already used by the table or an earlier row."""
    taken = {name: existing for name in keysets} if existing is not None else None
    return admit_first_come(batch, keysets, order, taken)


def orphans(fact: DataFrame, dim: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """References whose parent is gone."""
    parents = dim.select(F.col(pk).alias(fk))
    return fact.where(F.col(fk).isNotNull()).join(parents, fk, "left_anti").select(*fact.columns)


def max_id(state: DataFrame, id_col: str = "id") -> int:
    return state.agg(F.max(id_col)).first()[0] or 0


def with_new_ids(rows: DataFrame, state: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Ids after the largest id of the state, in the order."""
    return number_rows(rows, order, id_col, start=max_id(state, id_col))


def conform(rows: DataFrame, state: DataFrame, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Rows in the state's columns; missing ones take their default or NULL, as do NULLs
    of columns with a default."""
    defaults = defaults or {}
    out = []
    for field in state.schema:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        out.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*out)


def append(
    state: DataFrame,
    batch: DataFrame,
    order: list[str],
    required: Sequence[str],
    keysets: dict[str, list[str]] | None = None,
    rules: dict[str, Column] | None = None,
    defaults: dict[str, Any] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Validated inserts with new ids. Log: order columns, action, reason."""
    checked = require(batch, required, rules)
    valid, bad = split_valid(materialise(checked) if keysets else checked)
    if keysets:
        judged = materialise(unique(valid, keysets, order, state))
        clash = judged.where("verdict <> 'accepted'").select(
            *order, F.lit("rejected").alias("action"), F.concat(F.lit("duplicate "), "verdict").alias("reason")
        )
        valid = judged.where("verdict = 'accepted'").drop("verdict")
    added = with_new_ids(valid, state, order)
    log = added.select(*order, F.lit("added").alias("action"), F.lit(None).cast("string").alias("reason"))
    log = log.unionByName(
        bad.select(*order, F.lit("rejected").alias("action"), F.array_join("reasons", "; ").alias("reason"))
    )
    if keysets:
        log = log.unionByName(clash)
    return state.unionByName(conform(added, state, defaults)), log


def append_to(
    table: str, state: DataFrame, batch: DataFrame, order: list[str], rules: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Validated inserts under the required fields, unique keys and defaults of a table."""
    return append(
        state, batch, order, REQUIRED.get(table, []), UNIQUE.get(table), rules, DEFAULTS.get(table)
    )


def without(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The state's rows whose key is not among the given distinct ones."""
    return join_unique(state, gone.select(*keys), keys, "left_anti")


def insert_if_absent(
    state: DataFrame, batch: DataFrame, keys: list[str], defaults: dict[str, Any] | None = None,
    order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Adds the keys the state lacks, each once. Log: keys, action."""
    asked = materialise(first_wins(batch, keys, order) if order else batch.select(*keys).distinct())
    fresh = asked.join(key_summary(state, asked, keys), keys, "left_anti")
    added = with_new_ids(fresh, state, order or keys)
    log = added.select(*keys, F.lit("added").alias("action"))
    return state.unionByName(conform(added, state, defaults)), log


def upsert(
    state: DataFrame,
    batch: DataFrame,
    keys: list[str],
    cols: list[str],
    order: list[str],
    defaults: dict[str, Any] | None = None,
    id_col: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Sets `cols` on the row of the key (the one with the least id), or inserts it.

    The last batch row of a key counts. Log per batch row: order columns, keys,
    action added / updated / failed (blank key).
    """
    valid, bad = split_valid(require(batch, keys))
    # Keys and order alone are aggregated; the new values follow by a join on both.
    ends = valid.groupBy(*keys).agg(
        F.max(order_value(order)).alias("__last"), F.min(order_value(order)).alias("__arrived")
    )
    given = valid.select(*keys, order_value(order).alias("__last"), F.struct(*cols).alias("__new"))
    latest = stored(given.join(ends, [*keys, "__last"]).drop("__last"), "upsert-latest")
    target = key_summary(state, latest, keys, F.min(id_col).alias("__target"))
    # Batch-sized, and read by the update, the inserts and the log.
    merged = stored(latest.join(target, keys, "left"), "upsert-merged")

    update = merged.where(F.col("__target").isNotNull()).select(
        F.col("__target").alias(id_col), F.col("__new"), F.lit(True).alias("__hit")
    )
    kept = join_unique(state, update, [id_col]).select(
        *[
            F.when(F.col("__hit"), F.col("__new")[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in cols
            else F.col(c)
            for c in state.columns
        ]
    )
    fresh = merged.where(F.col("__target").isNull()).select(*keys, "__new.*", F.col("__arrived"))
    added = with_new_ids(fresh, state, ["__arrived"], id_col)
    new_state = kept.unionByName(conform(added, state, defaults))

    seen = merged.select(*keys, F.col("__target").isNull().alias("__absent"), "__arrived")
    log = join_unique(valid, seen, keys, "inner").select(
        *order,
        *keys,
        F.when(F.col("__absent") & (order_value(order) == F.col("__arrived")), "added")
        .otherwise("updated")
        .alias("action"),
    )
    log = log.unionByName(bad.select(*order, *keys, F.lit("failed").alias("action")))
    return new_state, log


def replace_by_key(
    state: DataFrame, batch: DataFrame, keys: list[str], order: list[str],
    defaults: dict[str, Any] | None = None, new_ids: bool = True, id_col: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """The whole row of the key is replaced; columns the batch lacks are reset.

    The last batch row of a key counts; every batch row uses up an id. Log: keys,
    action replaced / added.
    """
    if new_ids:
        batch = with_new_ids(batch, state, order, id_col)
    latest = stored(last_wins(batch, keys, order), "replace-latest")
    present = key_summary(state, latest, keys).withColumn("__hit", F.lit(True))
    log = latest.join(present, keys, "left").select(
        *keys, F.when(F.col("__hit"), "replaced").otherwise("added").alias("action")
    )
    kept = without(state, latest, keys)
    return kept.unionByName(conform(latest, state, defaults)), log


def toggle(
    state: DataFrame, events: DataFrame, keys: list[str], defaults: dict[str, Any] | None = None,
    id_col: str = "id", hot_rows: int = HOT_ROWS, blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Each event deletes one row of its key or, if there is none, creates one.

    n rows and k events leave n - k rows, or (k - n) mod 2 when k exceeds n. Log
    per key: rows_before, events, deleted, created.
    """
    asked = materialise(events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events")))
    held = materialise(key_summary(state, asked, keys, F.count(F.lit(1)).alias("rows_before")))
    log = (
        asked.join(held, keys, "left")
        .withColumn("rows_before", F.coalesce("rows_before", F.lit(0)))
        .withColumn("deleted", F.least("rows_before", "events"))
        .withColumn("created", (F.greatest(F.col("events") - F.col("rows_before"), F.lit(0)) % 2).cast("bigint"))
    )
    touched = join_unique(state.select(id_col, *keys), asked, keys, "inner")
    hot = held.where(F.col("rows_before") > hot_rows).select(*keys)
    ranked = rank_in_group(touched, keys, [id_col], "__rank", blocks=blocks, hot=hot)
    dropped = materialise(ranked.where(F.col("__rank") <= F.col("events")).select(id_col))
    created = with_new_ids(log.where("created = 1").select(*keys), state, keys, id_col)
    new_state = without(state, dropped, [id_col]).unionByName(conform(created, state, defaults))
    return new_state, log.select(*keys, "rows_before", "events", "deleted", "created")


def apply_delta(
    state: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str],
    defaults: dict[str, Any] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Deletes the removed keys, then adds the keys still absent. Log: keys, action, rows."""
    gone = materialise(removed.select(*keys).distinct())
    deleted = key_summary(state, gone, keys, F.count(F.lit(1)).alias("rows")).select(
        *keys, F.lit("removed").alias("action"), "rows"
    )
    kept = without(state, gone, keys)
    new_state, log = insert_if_absent(kept, added, keys, defaults)
    return new_state, deleted.unionByName(log.withColumn("rows", F.lit(1).cast("bigint")))


def delete_by_key(state: DataFrame, asked: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Removes rows. Log: key, action deleted / not_found."""
    wanted = materialise(asked.select(key).distinct())
    return without(state, wanted, [key]), _found_log(state, wanted, key, "deleted")


def update_by_key(
    state: DataFrame, batch: DataFrame, key: str, cols: list[str], order: list[str],
    required: Sequence[str] = (), rules: dict[str, Column] | None = None,
    keysets: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sets `cols` on existing rows, NULL included; the last valid batch row of a key counts.

    An edit that would take a unique key (`keysets`) of another row, or of an edit before
    it, is rejected whole; the keys rows had count as held until the batch is through. Log:
    key, action updated / not_found / duplicate <key>, or the reasons of an invalid row.
    """
    valid, bad = split_valid(require(batch, required, rules))
    # Key and order alone are aggregated; the new values follow by a join on both.
    ends = valid.groupBy(key).agg(F.max(order_value(order)).alias("__at"))
    given = valid.select(key, order_value(order).alias("__at"), F.struct(*cols).alias("__new"))
    # A NULL key is one more key that no row has.
    ends = ends.toDF("__key", "__last")
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__at").eqNullSafe(F.col("__last"))
    latest = stored(given.join(ends, same, "left_semi"), "update-latest")
    clash = None
    changed = {name: cs for name, cs in (keysets or {}).items() if set(cs) & set(cols)}
    if changed:
        judged = materialise(_judge_edits(state, latest, key, cols, changed))
        clash = judged.where("verdict <> 'accepted'").select(
            key, F.concat(F.lit("duplicate "), "verdict").alias("action")
        )
        latest = materialise(latest.join(clash.select(key), key, "left_anti"))
    joined = join_unique(state, latest.withColumn("__hit", F.lit(True)), [key])
    new_state = joined.select(
        *[
            F.when(F.col("__hit"), F.col("__new")[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in cols
            else F.col(c)
            for c in state.columns
        ]
    )
    log = _found_log(state, latest.select(key), key, "updated")
    if clash is not None:
        log = log.unionByName(clash)
    if required or rules:
        log = log.unionByName(bad.select(key, F.array_join("reasons", "; ").alias("action")))
    return new_state, log


def _judge_edits(state: DataFrame, latest: DataFrame, key: str, cols: list[str], keysets: dict[str, list[str]]) -> DataFrame:
    """The edits of existing rows with a verdict on the unique keys they change."""
    wanted = list(dict.fromkeys(c for cs in keysets.values() for c in cs))
    old = state.select(key, F.struct(*wanted).alias("__old"))
    edits = join_unique(old, latest, [key], "inner")
    for name, cs in keysets.items():
        new = {c: (F.col("__new")[c] if c in cols else F.col("__old")[c]).cast(state.schema[c].dataType) for c in cs}
        same = F.struct(*[new[c].alias(c) for c in cs]).eqNullSafe(F.struct(*[F.col("__old")[c].alias(c) for c in cs]))
        # A key that stays is held by the row itself and conflicts with nothing.
        edits = edits.withColumns({c: F.when(~same, new[c]) for c in cs})
    return admit_first_come(edits.select(key, "__at", *wanted), keysets, ["__at", key], {name: state for name in keysets})


def edit_in(
    table: str, state: DataFrame, batch: DataFrame, order: list[str], rules: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Edits by id under the required fields and unique keys of a table; sets the batch's columns."""
    cols = [c for c in state.columns if c in batch.columns and c != "id"]
    required = [c for c in REQUIRED.get(table, []) if c in cols]
    return update_by_key(state, batch, "id", cols, order, required, rules, UNIQUE.get(table))


def _found_log(state: DataFrame, wanted: DataFrame, key: str, action: str) -> DataFrame:
    present = key_summary(state, wanted, [key]).withColumn("__hit", F.lit(True))
    return wanted.join(present, key, "left").select(
        key, F.when(F.col("__hit"), action).otherwise("not_found").alias("action")
    )
