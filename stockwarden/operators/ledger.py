"""Proposals: keys, policy, commitments, changes between runs, re-checks and follow-up."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.config import (
    ACTIVE_STATES, EXECUTED_STATES, FIRM_STATES, MONEY_KINDS, PENDING_STATES, PLAN_KINDS, QTY_KINDS, SETTLED_DOC_STATES, Policy, SupplyConfig,
)
from stockwarden.functions.maths import round_unit
from stockwarden.functions.text import proposal_key, unit_decimals
from stockwarden.operators.series import KEYS

PLACES = ("origin", "destination", "location", "lot")

# Order of criticalities and kinds in the decision list.
URGENCY_RANK = {"out_of_stock": 0, "critical": 1, "reorder": 2}
KIND_RANK = {"transfer": 0, "purchase": 1, "reorder_rule": 2, "activity": 3, "note": 4, "alert": 5}


def with_key(proposals: DataFrame) -> DataFrame:
    payload = {c: F.col(c) for c in proposals.columns}
    return proposals.withColumn("key", proposal_key(F.col("kind"), payload, F.col("title"), PLAN_KINDS))


def _lookup(col: str, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(col) == k, v).otherwise(out)
    return out


def pending(proposals: DataFrame) -> DataFrame:
    return proposals.filter(F.col("status").isin(*PENDING_STATES))


def active(proposals: DataFrame, firm: bool = False, reported_refs: DataFrame | None = None) -> DataFrame:
    """Proposals that still hold stock: undecided and approved ones, and executed ones the source does not report yet.

    For approvals only firm ones count: an undecided proposal may still be rejected and must not block another.
    """
    states = FIRM_STATES if firm else ACTIVE_STATES
    open_rows = proposals.filter(F.col("status").isin(*states))
    done = proposals.filter(F.col("status").isin(*EXECUTED_STATES) & ~F.coalesce("doc_state", F.lit("draft")).isin(*SETTLED_DOC_STATES))
    if reported_refs is not None:
        done = done.join(reported_refs.select(F.col("ref").alias("doc_ref")), "doc_ref", "left_anti")
    return open_rows.unionByName(done).filter(F.col("kind").isin(*QTY_KINDS) & (F.col("qty") > 0) & F.col("product_id").isNotNull())


def commitments(rows: DataFrame) -> dict[str, DataFrame]:
    """Committed quantities out of origins, into destinations, and bought for the network."""
    leaving = rows.filter(F.col("kind").isin("transfer", "quarantine") & F.col("origin").isNotNull())
    arriving = rows.filter((F.col("kind") == "transfer") & F.col("destination").isNotNull())
    total = F.sum("qty").alias("qty")
    return {
        "origin": leaving.groupBy("product_id", F.col("origin").alias("location")).agg(total),
        "destination": arriving.groupBy("product_id", F.col("destination").alias("location")).agg(total),
        "network": rows.filter("kind = 'purchase'").groupBy("product_id").agg(total),
    }


def evaluate(proposals: DataFrame, policy: Policy) -> DataFrame:
    """Allowed or not, risk class and the reasons, against the policy."""
    c = F.col
    qty, amount = F.coalesce("qty", F.lit(0.0)), F.coalesce("amount", F.lit(0.0))
    kind_off = ~c("kind").isin(*policy.allowed_kinds)
    checks = [
        F.when(kind_off, F.concat(F.lit("kind not allowed: "), c("kind"))),
        F.when(qty > policy.max_qty, F.format_string("quantity above %.0f", F.lit(policy.max_qty))),
        F.when(amount > policy.max_amount, F.format_string("amount above %.2f", F.lit(policy.max_amount))),
    ]
    for place in ("origin", "destination", "location"):
        name = F.lower(F.coalesce(place, F.lit("")))
        within = lambda texts: F.array(*[F.lit(x.lower()) for x in texts])
        if policy.allowed_locations:
            listed = F.exists(within(policy.allowed_locations), lambda x: name.contains(x))
            checks.append(F.when((name != "") & ~listed, F.concat(c(place), F.lit(" is not an allowed location"))))
        if policy.blocked_locations:
            listed = F.exists(within(policy.blocked_locations), lambda x: name.contains(x))
            checks.append(F.when((name != "") & listed, F.concat(c(place), F.lit(" is blocked"))))
    rows = proposals.withColumn("blockers", F.array_compact(F.array(*checks)))
    large = (amount >= policy.high_risk_amount) | (qty >= policy.max_qty * 0.5)
    risk = (
        F.when(c("kind").isin(*policy.low_risk_kinds), "low").when(c("kind") == "validate_receipt", "high").when(large, "high")
        .when(c("kind").isin(*policy.medium_risk_kinds), "medium").when(amount < policy.high_risk_amount * 0.2, "low").otherwise("medium")
    )
    note = F.when(risk == "high", F.array(F.lit("high risk: an administrator must approve"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"allowed": F.size("blockers") == 0, "risk": risk, "reasons": F.concat("blockers", note)}).drop("blockers")


def money_by_stage(proposals: DataFrame) -> DataFrame:
    stages = {"proposed": PENDING_STATES, "approved": FIRM_STATES, "executed": ("executed", "concluded", "late")}
    moves_money = F.col("kind").isin(*MONEY_KINDS)
    aggs = []
    for name, states in stages.items():
        inside = F.col("status").isin(*states)
        aggs += [F.coalesce(F.sum(F.when(inside & moves_money, F.col("amount"))), F.lit(0.0)).alias(name), F.count_if(inside).alias(f"n_{name}")]
    return proposals.agg(*aggs)


def count_by_status(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("status").agg(F.count("*").alias("n"))


def superseded(proposals: DataFrame) -> DataFrame:
    """Undecided plan proposals with a newer one for the same need. The newest per key is an aggregate, so a key with
    very many copies stays one row on the joined side."""
    rows = with_key(pending(proposals).filter(F.col("kind").isin(*PLAN_KINDS)))
    newest = rows.groupBy("key").agg(F.max("id").alias("kept_id"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(newest, "key").filter(F.col("id") < F.col("kept_id")).select("id", "key", "kept_id")


def no_longer_needed(proposals: DataFrame, needed_keys: DataFrame, run_id: int) -> DataFrame:
    """Undecided plan proposals of earlier runs whose need the current run does not have."""
    rows = with_key(pending(proposals).filter(F.col("kind").isin(*PLAN_KINDS))).filter(F.col("last_run") != run_id)
    return rows.join(needed_keys.select("key"), "key", "left_anti")


def changes(new: DataFrame, stored: DataFrame, policy: Policy) -> DataFrame:
    """New needs against undecided stored ones by key: new, updated (a material change), unchanged, or absent now.

    A change is material above the tolerance; the places are part of the key.
    """
    c = F.col
    old = with_key(pending(stored)).groupBy("key").agg(F.max_by(F.struct("id", "qty"), "id").alias("o")).select(
        "key", c("o.id").alias("stored_id"), c("o.qty").alias("old_qty"))
    fresh = new.select("key", c("qty").alias("new_qty"))
    both = fresh.join(old, "key", "full_outer")
    q0, q1 = F.coalesce("old_qty", F.lit(0.0)), F.coalesce("new_qty", F.lit(0.0))
    moved = F.when(q0 != 0, F.abs(q1 - q0) / q0 * 100 > policy.dedupe_tolerance_pct).otherwise(q1 != 0)
    state = F.when(c("stored_id").isNull(), "new").when(c("new_qty").isNull(), "absent").when(moved, "updated").otherwise("unchanged")
    return both.withColumn("change", state)


def recheck(proposals: DataFrame, stock: DataFrame, recent_purchases: DataFrame, policy: Policy, as_of: datetime) -> DataFrame:
    """Is an undecided proposal still good: age, policy, stock at the origin less firm commitments, recent duplicates."""
    c = F.col
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    own_firm = commitments(active(proposals, firm=True))["origin"].withColumnsRenamed({"location": "origin", "qty": "firm_qty"})
    free = F.sum(c("qty") - c("reserved")).alias("free")
    by_place = stock.groupBy("product_id", c("location").alias("origin")).agg(free)
    by_lot = stock.groupBy("product_id", c("location").alias("origin"), "lot").agg(free.alias("free_lot"))
    dup_from = now - F.make_dt_interval(F.lit(14))
    duplicate = recent_purchases.filter((c("created_at") >= dup_from) & (c("created_at") <= now)).select("product_id").distinct().withColumn("bought", F.lit(True))
    rows = evaluate(pending(proposals), policy).join(by_place, ["product_id", "origin"], "left").join(by_lot, ["product_id", "origin", "lot"], "left")
    rows = rows.join(own_firm, ["product_id", "origin"], "left").join(duplicate, "product_id", "left")
    moves = c("kind").isin("transfer", "quarantine")
    on_hand = F.coalesce(F.when((c("kind") == "quarantine") & c("lot").isNotNull(), c("free_lot")).otherwise(c("free")), F.lit(0.0))
    available = on_hand - F.coalesce("firm_qty", F.lit(0.0))
    capped = round_unit(available, unit_decimals(c("unit")), "down")
    cut_pct = 100 * (c("qty") - available) / c("qty")
    age = c("created_at") < now - F.make_dt_interval(F.lit(policy.valid_days))
    short = moves & (available < c("qty"))
    verdict = (
        F.when(age, "expired").when(~c("allowed"), "blocked").when(moves & (available <= 0), "needs_review")
        .when(short & ((cut_pct > policy.recheck_tolerance_pct) | (capped <= 0)), "needs_review")
        .when((c("kind") == "purchase") & F.coalesce("bought", F.lit(False)), "needs_review").otherwise("ok")
    )
    judged = ~age & c("allowed") & short & (available > 0)
    return rows.select("id", "kind", verdict.alias("verdict"), F.when(moves, available).alias("available"),
                       F.when(judged, capped).otherwise(c("qty")).alias("qty"))


def follow_up(proposals: DataFrame, documents: DataFrame, as_of: datetime) -> DataFrame:
    """Executed proposals against the state of their documents."""
    c = F.col
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = proposals.filter(c("status").isin(*EXECUTED_STATES))
    docs = documents.select(c("ref").alias("doc_ref"), c("state").alias("seen_state"), "ordered", "received", "planned", F.lit(True).alias("exists"))
    both = rows.join(docs, "doc_ref", "left")
    finished = F.when(c("doc_kind") == "purchase", (c("ordered") > 0) & (c("received") >= c("ordered"))).otherwise(c("seen_state") == "done")
    due = F.coalesce(c("needed_on").cast("timestamp_ntz"), "planned")
    state = (
        F.when((c("kind") == "alert") & c("exists").isNull(), "concluded").when(c("exists").isNull() | (c("seen_state") == "cancel"), "cancelled_at_source")
        .when(finished, "concluded").when((due < now) & (c("status") != "late"), "late").otherwise(c("status"))
    )
    return both.select("id", "kind", "status", state.alias("new_status"), "seen_state")


def with_priority(proposals: DataFrame, as_of: date) -> DataFrame:
    """Days to need, priority class and what a decision depends on."""
    c = F.col
    days = F.datediff("needed_on", F.lit(as_of))
    severe = F.coalesce(c("criticality").isin("out_of_stock", "critical"), F.lit(False))
    priority = (
        F.when(days.isNull(), F.when(severe, "high").otherwise("normal")).when(days <= 1, "immediate").when(days <= 3, "high")
        .when(days <= 7, "medium").otherwise("normal")
    )
    notes = F.array_compact(F.array(
        F.when(~c("in_time"), "arrives after the stockout: depends on a transfer or on claiming a delivery"),
        F.when(c("origin_short") & (c("kind") == "transfer"), "the origin does not cover everything: depends on a purchase for the rest"),
        F.when(c("covered_before") > 0, "adds to what is already proposed for the same destination")))
    return proposals.withColumns({"days_to_need": days, "priority": priority, "depends_on": notes})


def decision_order(proposals: DataFrame) -> list[Column]:
    return [F.coalesce("days_to_need", F.lit(999)), _lookup("criticality", URGENCY_RANK, 5), _lookup("kind", KIND_RANK, 9), F.desc("amount"), F.col("id")]


def decision_groups(prioritised: DataFrame) -> DataFrame:
    """Undecided proposals grouped by kind and destination, most urgent group first."""
    c = F.col
    label = F.when(c("kind") == "transfer", F.concat_ws(": ", "kind", F.coalesce("destination", F.lit("?")))).otherwise(c("kind"))
    days = F.coalesce("days_to_need", F.lit(999))
    risk = _lookup("risk", {"low": 0, "medium": 1, "high": 2}, 0)
    groups = prioritised.groupBy(label.alias("title")).agg(
        F.count("*").alias("proposals"), F.sum("amount").alias("amount"),
        F.least(F.lit(9), F.min(days), F.min(_lookup("criticality", URGENCY_RANK, 5)) + 10).alias("urgency"), F.least(F.lit(999), F.min(days)).alias("days_to_need"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.max(risk) + 1).alias("highest_risk"))
    return groups.orderBy("urgency", F.desc("amount"))


def resolve_locations(names: DataFrame, locations: DataFrame) -> DataFrame:
    """Location id per name: the exact name, else the same name in other case, else a location path that ends with it.

    Every location is listed under each tail of its path, so all three tiers are one equi-join.
    """
    c = F.col
    parts = F.split(F.lower("name"), "/")
    tails = locations.select("location_id", "name", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    wanted = names.select(c("name").alias("wanted"), F.lower("name").alias("tail")).distinct()
    tier = F.when(c("name") == c("wanted"), 0).when(F.lower("name") == c("tail"), 1).otherwise(2)
    best = wanted.join(tails, "tail").groupBy("wanted").agg(F.min(F.struct(tier.alias("tier"), "location_id")).alias("b"))
    return best.select(c("wanted").alias("name"), c("b.location_id").alias("location_id"), c("b.tier").alias("tier"))


def propose_from_plan(plan: DataFrame, transfers: DataFrame, classes: DataFrame, stored: DataFrame, committed_network: DataFrame, known_suppliers: DataFrame,
                      locations: DataFrame) -> DataFrame:
    """Needs of a run as proposals: transfers, residual purchases, and min/max rules where demand is steady (X or Y).

    A quantity already waiting under the same key is added to the residual the plan computed after deducting it. Transfers and
    rules whose place the installation does not know are blocked, with the reason.
    """
    c = F.col
    null = lambda kind: F.lit(None).cast(kind)
    waiting = with_key(pending(stored)).groupBy("key").agg(F.max_by("qty", "id").alias("waiting_qty"))
    common = {"criticality": "string", "needed_on": "date", "in_time": "boolean"}
    known = resolve_locations(plan.select(c("location").alias("name")), locations).select(c("name").alias("place"), "location_id")

    moved = transfers.join(known.withColumnRenamed("place", "origin").withColumnRenamed("location_id", "origin_id"), "origin", "left").join(
        known.withColumnRenamed("place", "destination").withColumnRenamed("location_id", "destination_id"), "destination", "left").filter("qty > 0")
    moved = moved.select(
        F.lit("transfer").alias("kind"), "product_id", "product", "unit", "qty", "origin", "destination", null("string").alias("location"), null("string").alias("lot"),
        c("unit_cost"), c("destination_criticality").alias("criticality"), c("need_date").alias("needed_on"), "in_time", null("double").alias("buy_qty"), null("string").alias("buy_unit"),
        null("double").alias("minimum"), null("double").alias("maximum"), (c("origin_id").isNull() | c("destination_id").isNull()).alias("blocked"), F.lit(False).alias("no_supplier"))

    net = plan.filter("level = 'network' and suggested > 0").join(committed_network.select("product_id", c("qty").alias("committed_qty")), "product_id", "left")
    net = net.join(known_suppliers.select("product_id").distinct().withColumn("has_supplier", F.lit(True)), "product_id", "left")
    residual = round_unit(F.greatest(F.lit(0.0), c("suggested") - F.coalesce("committed_qty", F.lit(0.0))), unit_decimals(c("unit")), "up")
    packs = F.when(c("suggested_packs") > 0, c("suggested") / c("suggested_packs"))
    bought = net.withColumn("qty", residual).withColumn("pack", packs).filter("qty > 0").select(
        F.lit("purchase").alias("kind"), "product_id", "product", "unit", "qty", *[null("string").alias(p) for p in PLACES], "unit_cost", "criticality",
        c("need_date").alias("needed_on"), "in_time", F.when(c("pack") > 1, c("pack")).alias("buy_qty"), c("purchase_unit").alias("buy_unit"), null("double").alias("minimum"),
        null("double").alias("maximum"), F.coalesce("conversion_missing", F.lit(False)).alias("blocked"), c("has_supplier").isNull().alias("no_supplier"))

    steady = classes.filter(c("xyz").isin("X", "Y")).select("product_id")
    low = round_unit(c("reorder_point"), unit_decimals(c("unit")), "up")
    high = round_unit(c("reorder_point") + c("daily_demand") * 14, unit_decimals(c("unit")), "up")
    rules = plan.filter((c("level") == "local") & c("criticality").isin(*URGENCY_RANK)).join(steady, "product_id", "left_semi").join(
        known.withColumnRenamed("place", "location"), "location", "left").select(
        F.lit("reorder_rule").alias("kind"), "product_id", "product", "unit", high.alias("qty"), null("string").alias("origin"), null("string").alias("destination"), "location",
        null("string").alias("lot"), "unit_cost", "criticality", null(common["needed_on"]).alias("needed_on"), null("boolean").alias("in_time"), null("double").alias("buy_qty"),
        null("string").alias("buy_unit"), low.alias("minimum"), high.alias("maximum"), c("location_id").isNull().alias("blocked"), F.lit(False).alias("no_supplier"))

    rows = with_key(moved.unionByName(bought).unionByName(rules).withColumn("title", F.col("kind")))
    rows = rows.join(waiting, "key", "left").withColumn("qty", c("qty") + F.when(c("kind") == "reorder_rule", 0.0).otherwise(F.coalesce("waiting_qty", F.lit(0.0))))
    return rows.withColumns({
        "block_reason": F.when(c("blocked"), F.when(c("kind") == "purchase", "the purchase unit can't be converted").otherwise("a place is unknown")),
        "reused": c("waiting_qty").isNotNull(), "amount": c("qty") * c("unit_cost"),
        "buy_qty": F.when(c("buy_qty").isNotNull(), F.ceil(c("qty") / c("buy_qty") - 1e-9).cast("double"))}).drop("waiting_qty", "title")


def within_run_limit(needs: DataFrame, policy: Policy) -> DataFrame:
    """All proposals; with a limit of the policy only so many new ones, transfers before purchases before rules."""
    if policy.max_per_run is None:
        return needs
    c = F.col
    fresh = needs.filter(~c("reused")).orderBy(_lookup("kind", KIND_RANK, 9), _lookup("criticality", URGENCY_RANK, 5), F.desc("amount"), "key").limit(policy.max_per_run)
    return needs.filter("reused").unionByName(fresh)


def still_valid(stored: DataFrame, plan: DataFrame) -> DataFrame:
    """Keys of undecided proposals whose need still exists, even when nothing more has to be added."""
    c = F.col
    rows = with_key(pending(stored).filter(c("kind").isin(*PLAN_KINDS)))
    needy = plan.filter((c("level") == "local") & c("criticality").isin(*URGENCY_RANK) & (c("suggested") > 0)).select("product_id", c("location").alias("place"))
    short = plan.filter("level = 'network' and suggested > 0").select("product_id")
    place = F.when(c("kind") == "transfer", c("destination")).otherwise(c("location"))
    local = rows.filter(c("kind") != "purchase").withColumn("place", place).join(needy, ["product_id", "place"], "left_semi").drop("place")
    return local.unionByName(rows.filter("kind = 'purchase'").join(short, "product_id", "left_semi")).select("key").distinct()


def free_at_origin(local: DataFrame, committed_origin: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Usable stock less operating reserve and commitments, never negative."""
    from stockwarden.operators.rebalance import operating_reserve

    rows = operating_reserve(local, cfg).join(committed_origin.select(*KEYS, F.col("qty").alias("committed_qty")), KEYS, "left")
    committed = F.coalesce("committed_qty", F.lit(0.0))
    return rows.filter(F.col("stock").isNotNull()).select(
        *KEYS, "criticality", "stock", "reserve", committed.alias("committed"), F.greatest(F.lit(0.0), F.col("stock") - F.col("reserve") - committed).alias("free"))


def adjust_quantities(proposals: DataFrame, requested: DataFrame, local: DataFrame, policy: Policy, cfg: SupplyConfig) -> DataFrame:
    """Requested quantities for undecided transfers and purchases: capped at what the origin can give, money and risk redone.

    Commitments of the proposal itself do not count against it.
    """
    c = F.col
    rows = pending(proposals).filter(c("kind").isin(*MONEY_KINDS)).join(requested.select("id", c("qty").alias("asked")), "id")
    free = free_at_origin(local, commitments(active(proposals))["origin"], cfg).select("product_id", c("location").alias("origin"), "free", "stock", "reserve", "committed")
    rows = rows.join(free, ["product_id", "origin"], "left")
    decimals = unit_decimals(c("unit"))
    asked = round_unit(c("asked"), decimals, "up")
    # an origin without a stock record sets no cap
    room = F.when((c("kind") == "transfer") & c("stock").isNotNull(), F.greatest(F.lit(0.0), c("stock") - c("reserve") - (c("committed") - c("qty"))))
    capped = F.when(room.isNotNull() & (asked > room), round_unit(room, decimals, "down")).otherwise(asked)
    missing = F.when(room.isNotNull() & (asked > room), round_unit(asked - room, decimals, "up")).otherwise(0.0)
    unit_cost = F.try_divide(c("amount"), c("qty"))
    changed = (capped > 0) & (F.abs(capped - c("qty")) >= 1.0)
    rows = rows.select(
        "id", "kind", "product_id", "product", "unit", "origin", "destination", "location", "lot", c("qty").alias("old_qty"), F.when(changed, capped).otherwise(c("qty")).alias("qty"),
        missing.alias("missing_at_origin"), changed.alias("changed"), unit_cost.alias("unit_cost"))
    return evaluate(rows.withColumn("amount", c("qty") * c("unit_cost")), policy)


def newest_version(rows: DataFrame, key: str, moment: str) -> DataFrame:
    """Latest version per id by write time; the aggregate keeps one row per id on the map side already."""
    others = [c for c in rows.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*others), moment).alias("v"))
    return latest.select(key, *[F.col(f"v.{c}").alias(c) for c in others])

