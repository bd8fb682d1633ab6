"""First come, first served over several unique keys at once.

A request is accepted when none of its keys is held by the current state or by a
request accepted before it. With one key that is a minimum per key. With several
keys an early rejection frees keys for later requests, so acceptance is worked
out in rounds on narrow rows (request number, key): every open request that is
first on all its keys is accepted, and the requests that share a key with it are
rejected. The first round is a filter on one row per request, with the first request
of each of its keys; only what it leaves open goes through further rounds. Requests that wait for one other request only form chains; where rounds
settle few requests, whole chains are settled at once by doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from careflow.operators.joins import join_unique, key_summary
from careflow.operators.ordered import order_value, place_rows
from careflow.session import materialise, stored

ACCEPTED = "accepted"
# Chains are followed when a round has left more than this share of its rows open.
SLOW_SHARE = 0.75

PLACE = "__place"


def admit_first_come(
    requests: DataFrame,
    rules: dict[str, list[str]],
    order: list[str],
    taken: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Adds `verdict`: 'accepted' or the name of the first rule broken.

    `rules` maps a name to the columns that must be unique together; a NULL in
    them never conflicts. `taken` gives rows of the current state per rule.
    `order` must be unique. The requests are read twice, so they should be cheap
    to read. The number of rounds depends on how requests wait for each other, not
    on a cap; a chain in which each waits for one other takes one round.
    """
    taken = taken or {}
    if len(rules) == 1:
        ((name, keys),) = rules.items()
        return _first_per_key(requests, name, keys, order, taken.get(name))

    kinds = {f.name: f.dataType for f in requests.schema}
    named = F.lit(ACCEPTED)
    for i, name in enumerate(rules):
        named = F.when(F.col("rule") == i, F.lit(name)).otherwise(named)
    if len(order) == 1 and isinstance(kinds[order[0]], T.IntegralType):
        # A whole number is its own place in the order.
        narrow = requests.select(*dict.fromkeys([*order, *(k for keys in rules.values() for k in keys)]))
        placed = stored(narrow.withColumn(PLACE, F.coalesce(F.col(order[0]).cast("bigint"), F.lit(-(2**63)))), "requests")
        once, again, twice = None, requests, placed
    else:
        placed = place_rows(requests, order, PLACE)
        once, twice = _by_order_count(placed, order)
        again = twice
    broken = stored(_refusals(_firsts(placed, rules, taken, kinds)), "requests-refused")
    broken = broken.withColumnRenamed("place", PLACE)

    columns, parts = requests.columns, []
    if once is not None:
        parts.append(once.join(broken, PLACE, "left").select(*columns, named.alias("verdict")))
    if again is not None:
        refused = twice.join(broken, PLACE).select("rule", *[F.col(c).alias(f"__{c}") for c in order])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order])
        parts.append(again.join(refused, same, "left").select(*columns, named.alias("verdict")))
    return reduce(DataFrame.unionByName, parts)


def _by_order_count(placed: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows alone at their value of the order and, if there are any, those that share it."""
    number = F.xxhash64(*order).alias("__order")
    counts = placed.groupBy(number).agg(F.count(F.lit(1)).alias("n"))
    shared = stored(counts.where("n > 1").select("__order"), "requests-shared-order")
    if not shared.limit(1).count():
        return placed, None
    numbered = placed.withColumn("__order", number)
    return tuple(numbered.join(shared, "__order", how).drop("__order") for how in ("left_anti", "left_semi"))


def _firsts(
    placed: DataFrame, rules: dict[str, list[str]], taken: dict[str, DataFrame], kinds: dict[str, T.DataType]
) -> DataFrame:
    """A row per request: place and, per rule, a struct of the place of the key's first request and whether the
    state holds the key; NULL without a key. `kinds` are the requests' types."""
    plain = (T.IntegralType, T.DateType, T.StringType, T.BooleanType)

    def values(keys: list[str]) -> list[Column]:
        cast = [F.col(k).try_cast(kinds[k]) for k in keys]
        # Values are compared as they are written.
        cast = [v if isinstance(kinds[k], plain) else v.cast("string") for v, k in zip(cast, keys)]
        return [v.alias(f"__key{j}") for j, v in enumerate(cast)]

    rows = placed.select(F.col(PLACE).alias("place"), *dict.fromkeys(k for keys in rules.values() for k in keys))
    firsts = []
    for i, (name, keys) in enumerate(rules.items()):
        key, kept = [f"__key{j}" for j in range(len(keys))], [c for c in rows.columns if c.startswith("rule")]
        asked = placed.select(*values(keys), F.col(PLACE).alias("first"), F.lit(False).alias("held")).dropna(subset=key)
        if name in taken:
            state = taken[name].select(*values(keys), F.lit(None).cast("bigint").alias("first"), F.lit(True).alias("held"))
            asked = asked.unionByName(state.dropna(subset=key))
        found = asked.groupBy(*key).agg(F.min("first").alias("first"), F.max("held").alias("held")).where("first IS NOT NULL")
        later = list(dict.fromkeys(k for more in list(rules.values())[i + 1 :] for k in more))
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        keyed = rows.select("place", *kept, *later, *values(keys))
        joined = keyed.where(whole).join(found, key).select("place", *kept, F.struct("first", "held").alias(f"rule{i}"), *later)
        # Requests without the key need no partner and would all meet in one task.
        none = keyed.where(~whole).select("place", *kept, F.lit(None).cast(joined.schema[f"rule{i}"].dataType).alias(f"rule{i}"), *later)
        rows = joined.unionByName(none)
        firsts.append(f"rule{i}")
    return stored(rows.select("place", *firsts), "requests-firsts")


def _refusals(rows: DataFrame) -> DataFrame:
    """(place, rule) of the requests that are refused: the first rule broken."""
    rules = [F.col(c) for c in rows.columns if c != "place"]
    place = F.col("place")
    keys = reduce(lambda a, b: a + b, [r.isNotNull().cast("int") for r in rules])
    held = reduce(lambda a, b: a | b, [F.coalesce(r["held"], F.lit(False)) for r in rules])
    leads = reduce(lambda a, b: a & b, [F.coalesce(r["first"] == place, F.lit(True)) for r in rules])

    def each(df: DataFrame, wanted) -> DataFrame:
        """A row (place, keys, rule, first) per request and rule that is wanted of it."""
        parts = [
            F.when(r.isNotNull() & wanted(r), F.struct(F.lit(i).alias("rule"), r["first"].alias("first")))
            for i, r in enumerate(rules)
        ]
        return df.select("place", keys.alias("keys"), F.inline(F.array(*parts))).where("rule IS NOT NULL")

    # First on all keys, none of them held: accepted. Who then shares a key with it is refused.
    won = rows.where(leads & ~held).select(place.alias("first"))
    waits = each(rows, lambda r: (r["first"] < place) & ~r["held"])
    lost = stored(waits.join(won, "first", "left_semi").select("place", "rule"), "requests-lost")
    broken = each(rows.where(held), lambda r: r["held"]).select("place", "rule").unionByName(lost)
    open_rows = each(rows.where(~leads & ~held), lambda r: F.lit(True))
    open_rows = stored(open_rows.join(lost.select("place").distinct(), "place", "left_anti"), "requests-waiting")
    accepted = _accept_in_rounds(open_rows)
    if accepted is not None:
        holders = open_rows.join(accepted, "place", "left_semi").select("rule", "first", F.col("place").alias("holder"))
        late = waits.join(holders, ["rule", "first"]).where("holder < place").select("place", "rule")
        broken = broken.unionByName(late)
    return broken.groupBy("place").agg(F.min("rule").alias("rule"))


def _first_per_key(
    requests: DataFrame, name: str, keys: list[str], order: list[str], state: DataFrame | None
) -> DataFrame:
    firsts = materialise(requests.dropna(subset=keys).groupBy(*keys).agg(F.min(order_value(order)).alias("__by")))
    firsts = firsts.withColumn("__taken", F.lit(False))
    if state is not None:
        held = key_summary(state, firsts, keys).withColumn("__held", F.lit(True))
        flag = F.coalesce("__held", F.lit(False))
        firsts = materialise(firsts.join(held, keys, "left").withColumn("__taken", flag).drop("__held"))
    judged = join_unique(requests, firsts, keys)
    broken = F.coalesce(F.col("__taken") | (F.col("__by") < order_value(order)), F.lit(False))
    return judged.withColumn("verdict", F.when(broken, F.lit(name)).otherwise(ACCEPTED)).select(
        *requests.columns, "verdict"
    )


def _accept_in_rounds(rows: DataFrame) -> DataFrame | None:
    """The accepted among open requests (place, keys: how many it has, rule and first: the key), if there are any."""
    accepted, left, slow = [], rows.count(), False
    key = ["rule", "first"]
    while left:
        # The first of every key, combined before the shuffle.
        leads = rows.groupBy(*key).agg(F.min("place").alias("place"), F.min_by("keys", "place").alias("keys"))
        winners = leads.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.max("keys").alias("keys"))
        winners = winners.where("n = keys").select("place")
        winners = stored(_with_chains(rows, winners) if slow else winners, "requests-accepted")
        accepted.append(winners)
        lost = rows.join(rows.join(winners, "place", "left_semi").select(*key), key, "left_semi")
        rows = stored(rows.join(lost.select("place").distinct(), "place", "left_anti"), "requests-open")
        before, left = left, rows.count()
        slow = left > SLOW_SHARE * before
    return reduce(DataFrame.unionByName, accepted) if accepted else None


def _with_chains(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The winners and, along chains that start at one, every second request.

    A request waits for one other only when it is first or second on all its keys and the
    firsts it waits for are the same request. It is accepted exactly when that one is not.
    """
    winners, key = stored(winners, "requests-first"), ["rule", "first"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    # Spark keeps two rows per key and task before the shuffle.
    near = stored(rows.withColumn("rank", rank).where("rank <= 2").select("place", "keys", *key), "requests-near")
    pairs = near.groupBy(*key).agg(F.min("place").alias("ahead"), F.max("place").alias("place")).where("ahead < place")
    one = pairs.groupBy("place").agg(F.min("ahead").alias("ahead"), F.max("ahead").alias("last")).where("ahead = last")
    seen = near.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.max("keys").alias("keys")).where("n = keys")
    links = stored(one.join(seen.select("place"), "place").select("place", "ahead", F.lit(True).alias("odd")), "requests-links")
    while True:
        on = links.select(F.col("place").alias("ahead"), F.col("ahead").alias("__ahead"), F.col("odd").alias("__odd"))
        longer = links.join(on, "ahead", "left").select(
            "place",
            F.coalesce("__ahead", "ahead").alias("ahead"),
            (F.col("odd") != F.coalesce("__odd", F.lit(False))).alias("odd"),
            F.col("__ahead").isNotNull().alias("moved"),
        )
        links = stored(longer, "requests-links")
        if not links.where("moved").limit(1).count():
            break
    won = links.where("NOT odd").join(winners.withColumnRenamed("place", "ahead"), "ahead", "left_semi")
    return winners.unionByName(won.select("place"))
