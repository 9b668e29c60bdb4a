"""Evidence for the findings and patterns worth investigating, gathered for all of them by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig
from stockwarden.functions.text import contains_text, present
from stockwarden.operators.adhoc import top_per_group
from stockwarden.operators.features import is_night
from stockwarden.operators.history import typical_cases
from stockwarden.operators.patterns import days_before, last_moment
from stockwarden.operators.quantiles import grouped_quantiles
from stockwarden.session import materialize

#: Kinds of cause that evidence can speak for or against: kind -> (hypothesis, check).
CAUSES = {
    "capture": ("the entry does not say what happened", "compare the entry with readings and records of the case"),
    "loss": ("stock left without a record", "count the stock and compare it with the book"),
    "surgery": ("the case itself was out of the ordinary", "read course and duration of the case"),
    "incomplete": ("data of the case is missing", "have the case completed"),
    "move": ("stock changed places without a record", "follow the lot through its places"),
    "": ("the consumption is real", "watch the cases that follow"),
}
#: Which kinds of cause come into question for a rule, likeliest first; an installation may pass its own table instead.
RULE_CAUSES = {
    "R01_OVER_CONTAINER": ("capture", ""), "R02_SCALE_IMPOSSIBLE": ("capture", "move"), "R03_SCALE_MISMATCH": ("loss", "capture"), "R04_NO_SURGERY": ("incomplete", "surgery", "loss"),
    "R06_CLINICAL_RATE": ("capture", "surgery", ""), "R07_TRAVELLING_LOT": ("move", "capture"), "R08_DUPLICATE": ("capture", "surgery"), "R09_EXPIRED_LOT": ("capture", "move"),
    "R10_LEVEL_SHIFT": ("surgery", "capture", "loss"), "R11_ACTOR_DEVIATION": ("surgery", "capture", "loss"), "R12_CASE_FREQUENCY": ("surgery", "capture"), "z": ("surgery", "capture", ""),
}


def default_hypotheses(spark) -> DataFrame:
    """(position, rule, hypothesis, check, about) from the causes that come into question for each rule."""
    rows = [(n, rule, *CAUSES[kind], kind) for rule, kinds in RULE_CAUSES.items() for n, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "position int, rule string, hypothesis string, check string, about string")


# Proposal kinds per rule.
CASE_ACTIONS = [
    ("R09_EXPIRED_LOT", "quarantine", "", "lot"),
    ("R09_EXPIRED_LOT", "team_notice", "quality", "lot"),
    ("R08_DUPLICATE", "team_notice", "billing", "case"),
    ("R04_NO_SURGERY", "team_notice", "billing", "case"),
    ("R01_OVER_CONTAINER", "team_notice", "billing", "case"),
    ("R10_LEVEL_SHIFT", "count_request", "", "place"),
    ("R11_ACTOR_DEVIATION", "count_request", "", "place"),
    ("R03_SCALE_MISMATCH", "count_request", "", "place"),
    ("R10_LEVEL_SHIFT", "team_notice", "operations", "product"),
    ("R11_ACTOR_DEVIATION", "team_notice", "operations", "product"),
    ("R03_SCALE_MISMATCH", "team_notice", "operations", "product"),
]


def targets(found: DataFrame, patterns: DataFrame, known: DataFrame, max_cases: int | None = None) -> DataFrame:
    """What to investigate: all severe patterns and findings that were not investigated before; the first `max_cases`,
    patterns before findings by money, if the caller sets it."""
    c = F.col
    null = lambda kind: F.lit(None).cast(kind)
    severe = c("severity").isin("critical", "high")
    some = patterns.filter(severe).select(
        F.concat_ws("|", F.lit("pattern"), "rule", F.coalesce(c("product_id").cast("string"), F.lit("None")), "key").alias("fingerprint"), F.lit("pattern").alias("kind"),
        F.array("rule").alias("methods"), "dimension", "key", null("string").alias("case_no"), "product_id", "product", "hospital",
        F.when(c("dimension") == "technician", c("actor")).alias("technician"), F.when(c("dimension") == "doctor", c("actor")).alias("doctor"), null("string").alias("lot"),
        F.when(c("dimension") == "sublocation", c("key")).alias("sublocation"), null("timestamp_ntz").alias("ts"), null("double").alias("qty"), "severity", "risk_amount", F.lit(0).alias("tier"))
    lines = found.filter(severe).select(
        "fingerprint", F.lit("finding").alias("kind"), "methods", null("string").alias("dimension"), null("string").alias("key"), "case_no", "product_id", "product", "hospital", "technician", "doctor",
        "lot", "sublocation", "ts", "qty", "severity", "risk_amount", F.lit(1).alias("tier"))
    rows = some.unionByName(lines).join(known.select("fingerprint"), "fingerprint", "left_anti")
    if max_cases is not None:
        rows = rows.orderBy("tier", F.desc("risk_amount"), "fingerprint").limit(max_cases)
    return rows.drop("tier")


def case_content(lines: DataFrame, target_rows: DataFrame) -> dict[str, DataFrame]:
    """Header totals and the lines of every target's case."""
    cases = target_rows.select("case_no").filter(F.col("case_no").isNotNull()).distinct()
    mine = lines.join(cases, "case_no", "left_semi")
    header = mine.groupBy("case_no").agg(
        F.min("ts").alias("ts"), *[F.min(x).alias(x) for x in ("hospital", "doctor", "technician", "sublocation", "duration_min")], F.count("*").alias("lines"),
        F.sum("amount").alias("amount"))
    return {"header": header, "lines": mine.select("case_no", "line_id", "product", "qty", "unit", "lot", "amount", "weight_start", "weight_end")}


def actors(target_rows: DataFrame) -> DataFrame:
    """The person each target is about: the pattern's actor, else the technician, else the doctor."""
    c = F.col
    by_pattern = F.when(c("dimension").isin("technician", "doctor"), c("dimension"))
    dimension = F.coalesce(by_pattern, F.when(present(c("technician")), "technician"), F.when(present(c("doctor")), "doctor"))
    rows = target_rows.withColumn("who", dimension).filter("who is not null")
    return rows.select(c("who").alias("dimension"), F.when(c("who") == "technician", c("technician")).otherwise(c("doctor")).alias("name"), "product").distinct()


def actor_history(lines: DataFrame, people: DataFrame, days: int = 90) -> DataFrame:
    """Cases, gaps and hours of each actor, and their rates for the product beside those of their peers.

    Peers are the other people who used the product in the actor's main hospital; each actor meets only those lines.
    """
    c = F.col
    recent = lines.withColumn("today", last_moment(lines)).filter(c("ts") > days_before(c("today"), days)).withColumns({
        "any_rate": F.when(c("duration_min") > 0, c("qty") / c("duration_min")), "odd": is_night(ConsumptionConfig()) | (F.weekday("ts") >= 5)})
    who = F.array(F.struct(F.lit("technician").alias("dimension"), c("technician").alias("name")), F.struct(F.lit("doctor").alias("dimension"), c("doctor").alias("name")))
    spread = recent.select("*", F.explode(who).alias("w")).select("*", "w.dimension", "w.name").drop("w")
    mine = spread.join(people.select("dimension", "name").distinct(), ["dimension", "name"])
    blank = ~present(c("doctor"))
    base = mine.groupBy("dimension", "name").agg(
        F.count_distinct("case_no").alias("cases"), F.sum("amount").alias("amount"), F.count_distinct(F.when(blank, c("case_no"))).alias("cases_no_doctor"), F.count_if("odd").alias("odd_lines"))
    homes = mine.groupBy("dimension", "name", "hospital").agg(F.count("*").alias("k")).groupBy("dimension", "name").agg(
        F.min_by("hospital", F.struct(-c("k"), "hospital")).alias("home"))
    keys = ["dimension", "name", "product"]
    own = mine.join(people, keys)
    probs = {"rate_p25": 0.25, "rate_median": 0.5, "rate_p75": 0.75}
    rates = grouped_quantiles(own, keys, "any_rate", probs).drop("total")
    late = c("ts") > days_before(c("today"), 28)
    counts = own.groupBy(*keys).agg(F.count("*").alias("lines"), F.avg(F.when(late, c("qty"))).alias("qty_last_28d"), F.avg(F.when(~late, c("qty"))).alias("qty_before"))
    group = people.join(homes, ["dimension", "name"]).select("dimension", c("name").alias("actor"), "product", c("home").alias("hospital"))
    peers = spread.join(group, ["dimension", "product", "hospital"]).filter(c("name") != c("actor"))
    peer_keys = ["dimension", "actor", "product"]
    peer_rates = grouped_quantiles(peers, peer_keys, "any_rate", {"peer_rate": 0.5}).drop("total")
    peer_count = peers.groupBy(*peer_keys).agg(F.count_distinct("name").alias("peers"))
    beside = peer_count.join(peer_rates, peer_keys, "left").withColumnRenamed("actor", "name")
    return base.join(homes, ["dimension", "name"]).join(counts, ["dimension", "name"], "left").join(rates, keys, "left").join(beside, keys, "left")


def scale_readings(lines: DataFrame, target_rows: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """Readings of the targets' cases and products against the captured quantity."""
    c = F.col
    wanted = target_rows.select("case_no", "product").filter("case_no is not null").distinct()
    rows = lines.filter("weight_start is not null").join(wanted, ["case_no", "product"])
    grams = c("weight_start") - c("weight_end")
    ml = grams / cfg.default_density
    return rows.select("case_no", "product", "line_id", "technician", grams.alias("grams"), ml.alias("implied_ml"), "qty",
                       F.when(c("qty") != 0, 100 * (ml - c("qty")) / c("qty")).alias("diff_pct"), (c("weight_end") > c("weight_start")).alias("inconsistent"))


def technician_mismatch(lines: DataFrame, target_rows: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """Share of weighings off by more than 15 % for the targets' technicians."""
    c = F.col
    people = target_rows.select("technician").filter(present(c("technician"))).distinct()
    rows = lines.filter("weight_start is not null and qty > 0").join(people, "technician", "left_semi")
    off = F.coalesce(F.abs((c("weight_start") - c("weight_end")) / cfg.default_density - c("qty")) / c("qty") > cfg.scale_tolerance_pct, F.lit(False))
    return rows.groupBy("technician").agg(F.count("*").alias("weighings"), (100 * F.count_if(off) / F.count("*")).alias("mismatch_pct"))


def lot_history(lines: DataFrame, target_rows: DataFrame, days: int = 120) -> DataFrame:
    """Where the targets' lots were used, with their usual hospital."""
    c = F.col
    lots = target_rows.select("lot").filter(present(c("lot"))).distinct()
    rows = lines.withColumn("today", last_moment(lines)).filter(c("ts") > days_before(c("today"), days)).join(lots, "lot", "left_semi")
    used = rows.groupBy("lot", "hospital").agg(F.count("*").alias("lines"), F.sum("qty").alias("qty"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    usual = used.groupBy("lot").agg(F.min_by("hospital", F.struct(-c("lines"), "hospital")).alias("usual_hospital"))
    return used.join(usual, "lot")


def lot_stock(stock: DataFrame, target_rows: DataFrame) -> DataFrame:
    lots = target_rows.select("lot").filter(present(F.col("lot"))).distinct()
    return stock.join(lots, "lot", "left_semi").select("lot", "product_id", "location", "qty", "reserved", "expiry")


def day_context(lines: DataFrame, target_rows: DataFrame) -> dict[str, DataFrame]:
    """The targets' hospital days: cases against the typical day, people and hours, and the products used most."""
    c = F.col
    days = target_rows.filter("ts is not null").select("hospital", c("ts").cast("date").alias("day")).distinct()
    mine = lines.withColumn("day", c("ts").cast("date")).join(days, ["hospital", "day"], "left_semi")
    typical = typical_cases(lines.join(days.select("hospital").distinct(), "hospital", "left_semi"))
    summary = mine.groupBy("hospital", "day").agg(
        F.count_distinct("case_no").alias("cases"), F.count_distinct(F.when(~present(c("doctor")), c("case_no"))).alias("cases_no_doctor"),
        F.array_sort(F.collect_set(F.hour("ts"))).alias("hours"), F.array_sort(F.collect_set(F.when(present(c("technician")), c("technician")))).alias("technicians"))
    used = mine.groupBy("hospital", "day", "product").agg(F.sum("qty").alias("qty"))
    return {"days": summary.join(typical, "hospital", "left"), "products": top_per_group(used, ["hospital", "day"], [F.desc("qty"), c("product")], 6)}


def compare_periods(lines: DataFrame, target_rows: DataFrame) -> DataFrame:
    """Each pattern's entity and product: the last 30 days, and the 90 days before per 30 days."""
    c = F.col
    wanted = target_rows.filter("dimension is not null").select("dimension", "key", "product").distinct()
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"), c(d).alias("key")) for d in ("technician", "doctor", "sublocation", "hospital")])
    recent = lines.withColumn("today", last_moment(lines)).filter(c("ts") > days_before(c("today"), 120))
    mine = recent.select("*", F.explode(entries).alias("e")).select("*", "e.dimension", "e.key").join(wanted, ["dimension", "key", "product"])
    mine = mine.withColumns({"now": c("ts") > days_before(c("today"), 30), "any_rate": F.when(c("duration_min") > 0, c("qty") / c("duration_min"))})
    keys = ["dimension", "key", "product"]
    rates = grouped_quantiles(mine, [*keys, "now"], "any_rate", {"m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(c("now"), c("m"))).alias("rate"), F.max(F.when(~c("now"), c("m"))).alias("rate_before"))
    n, b = c("now"), ~c("now")
    sums = mine.groupBy(*keys).agg(
        F.count_if(n).alias("lines"), F.count_distinct(F.when(n, c("case_no"))).alias("cases"), F.coalesce(F.sum(F.when(n, c("qty"))), F.lit(0.0)).alias("qty"),
        F.count_if(b).alias("raw_lines"), F.count_distinct(F.when(b, c("case_no"))).alias("raw_cases"), F.coalesce(F.sum(F.when(b, c("qty"))), F.lit(0.0)).alias("raw_qty"))
    return sums.join(rates, keys, "left").select(
        *keys, "lines", "cases", "qty", (c("qty") / F.greatest(c("cases"), F.lit(1))).alias("qty_per_case"), "rate", (c("raw_lines") / 3).alias("lines_before"),
        (c("raw_cases") / 3).alias("cases_before"), (c("raw_qty") / 3).alias("qty_before"), (c("raw_qty") / F.greatest(c("raw_cases"), F.lit(1))).alias("qty_per_case_before"), "rate_before",
        (c("raw_cases") < 5).alias("history_insufficient"))


ENTITIES = ("product", "hospital", "technician", "doctor", "lot")


def _entity_sets(rows: DataFrame, id_column: str, *more: str) -> DataFrame:
    """Every non-empty set of a row's entities: id, `entities` (sorted), and further columns."""
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(present(F.col(e)), F.col(e)) for e in ENTITIES]))))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("named")).cast("int") - 1)
    sets = F.transform(masks, lambda m: F.filter("named", lambda _, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))
    return rows.select(id_column, named.alias("named"), *more).filter(F.size("named") > 0).select(id_column, F.explode(sets).alias("entities"), *more)


def case_heads(target_sets: DataFrame, cases: DataFrame, top: int) -> DataFrame:
    """Index: for every set of entities some target has, the newest `top` resolved and the newest `top` other cases that share it.

    The rank limit is applied before the shuffle, so a set that very many cases share costs each task `top` rows.
    """
    c = F.col
    wanted = materialize(target_sets.select("entities").distinct(), "entity-sets")
    sets = _entity_sets(cases.withColumn("resolved", F.coalesce(c("status") == "resolved", F.lit(False))), "case_id", "resolved")
    return top_per_group(sets.join(wanted, "entities", "left_semi"), ["entities", "resolved"], [F.desc("case_id")], top).drop("rank")


def similar_cases(target_rows: DataFrame, cases: DataFrame, top: int = 5) -> DataFrame:
    """Earlier cases (one row per case_id) by number of shared entities, two more when resolved, newer ones first.

    A target looks up the heads of the sets of its own entities, at most 31 sets and two heads each. That is enough: a case not in
    the head of the very set it shares has `top` cases before it that share as much, are as resolved, and are newer.
    """
    c = F.col
    own = materialize(_entity_sets(target_rows, "fingerprint"), "target-sets")
    heads = materialize(case_heads(own, cases, top), "case-heads")
    score = F.max(F.size("entities") + F.when(c("resolved"), 2).otherwise(0)).cast("long").alias("score")
    scored = own.join(heads, "entities").groupBy("fingerprint", "case_id").agg(score)
    return top_per_group(scored, ["fingerprint"], [F.desc("score"), F.desc("case_id")], top)


#: Pairs of target and note that one task makes.
PAIRS = 2_000_000


def applicable_clarifications(target_rows: DataFrame, notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Statements people made whose scope covers the target: same actor, same product and hospital, or same hospital.

    With a `limit` the newest of each target. A target and a note of one row each meet in one way only, so their pairs, the bulk
    of the result, leave the join as they are; only pairs of repeated fingerprints or notes are compared with each other.
    """
    c = F.col
    named = ("technician", "doctor", "product", "hospital")

    def once(rows: DataFrame, key: str, *more: str) -> DataFrame:
        alone = F.count("*").over(Window.partitionBy(key)) == 1
        return rows.select(key, *more, *named).distinct().withColumn("alone", alone)

    left = materialize(once(target_rows, "fingerprint"), "clarified-targets")
    right = materialize(once(notes.filter(c("scope").isin("actor", "product_hospital", "hospital")), "note_id", "scope"), "clarifying-notes")
    # Targets of very many notes are dealt over as many tasks as their pairs take.
    pairs = left.groupBy("hospital").count().join(right.groupBy("hospital").agg(F.count("*").alias("n")), "hospital").agg(F.sum(c("count") * c("n"))).first()[0] or 0
    left = left.repartition(max(8, -(-int(pairs) // PAIRS)), "fingerprint")

    def matched(of: DataFrame, by: DataFrame, scope: str, *on: str) -> DataFrame:
        by = by.filter(c("scope") == scope)
        for column in on:
            by = by.filter(present(c(column)))
        met = of.select("fingerprint", *on, c("technician").alias("own")).join(by.select("note_id", *on, c("technician").alias("noted")), list(on))
        if on == ("doctor",):  # pairs that the technician has brought together already
            met = met.filter(~F.coalesce(present(c("noted")) & (c("own") == c("noted")), F.lit(False)))
        return met.select("fingerprint", "note_id")

    def all_scopes(of: DataFrame, by: DataFrame) -> DataFrame:
        parts = [matched(of, by, "actor", "technician"), matched(of, by, "actor", "doctor"), matched(of, by, "product_hospital", "product", "hospital"), matched(of, by, "hospital", "hospital")]
        return reduce(DataFrame.union, parts)

    single = right.filter("alone")
    rows = all_scopes(left.filter("alone"), single).union(all_scopes(left, right.filter("not alone")).union(all_scopes(left.filter("not alone"), single)).distinct())
    return rows if limit is None else top_per_group(rows, ["fingerprint"], [F.desc("note_id")], limit)


#: Signals of a target, one bit each.
SIGNALS = {"scale_ok": 1, "scale_off": 2, "no_doctor": 4, "odd_day": 8, "foreign_lot": 16}
#: Kind of cause -> signals that speak for it, signals that speak against it.
SPEAKS = {"capture": (2, 1), "loss": (2, 1), "surgery": (8, 0), "incomplete": (4, 0), "move": (16, 0)}


def signals(target_rows: DataFrame, readings: DataFrame, history: DataFrame, lots: DataFrame, days: DataFrame) -> DataFrame:
    """Five yes/no signals per target. An actor history or a day context existing at all is what the last three test."""
    c = F.col
    pct = F.rint("diff_pct")
    scale = readings.groupBy("case_no", "product").agg(F.bool_or(pct <= 0).alias("scale_ok"), F.bool_or(F.abs(pct) > 15).alias("scale_off"))
    seen = history.select("name").distinct().withColumn("has_actor", F.lit(True))
    known_lots = lots.select("lot").distinct().withColumn("has_lot", F.lit(True))
    known_days = days.select("hospital", "day").withColumn("has_day", F.lit(True))
    person = F.coalesce(F.when(present(c("technician")), c("technician")), c("doctor"))
    rows = target_rows.withColumns({"name": person, "day": c("ts").cast("date")}).join(scale, ["case_no", "product"], "left").join(seen, "name", "left")
    rows = rows.join(known_lots, "lot", "left").join(known_days, ["hospital", "day"], "left")
    flag = lambda x: F.coalesce(c(x), F.lit(False))
    return rows.select("fingerprint", "methods", flag("scale_ok").alias("scale_ok"), flag("scale_off").alias("scale_off"), (flag("has_actor") | flag("has_day")).alias("no_doctor"),
                       flag("has_day").alias("odd_day"), flag("has_lot").alias("foreign_lot"))


def rank_hypotheses(signal_rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Hypotheses of the target's rules, those with most evidence in favour first; equal texts appear once.

    `table` holds an installation's own (position, rule, hypothesis, check, about); `about` lists kinds of cause by commas. A kind
    is two masks over the signals: evidence is counted by the bits a target's signals share with them.
    """
    c = F.col
    bits = reduce(lambda a, b: a + b, (F.when(c(name), bit).otherwise(0) for name, bit in SIGNALS.items()))
    signal_rows = signal_rows.select("fingerprint", "methods", bits.cast("int").alias("signals"))
    table = default_hypotheses(signal_rows.sparkSession) if table is None else table
    masks = [F.create_map(*[F.lit(x) for kind, both in SPEAKS.items() for x in (kind, both[side])]) for side in (0, 1)]
    kinds = F.split("about", ",")
    looked_up = [F.transform(kinds, lambda k: F.coalesce(F.element_at(masks[0], k), F.lit(0))), F.transform(kinds, lambda k: F.coalesce(F.element_at(masks[1], k), F.lit(0)))]
    table = table.select("*", looked_up[0].alias("speaks_for"), looked_up[1].alias("speaks_against"))
    rule = F.when(F.startswith(c("method"), F.lit("z_")), "z").otherwise(c("method"))
    rows = signal_rows.select("*", F.posexplode("methods").alias("method_order", "method")).withColumn("rule", rule).join(table, "rule")
    count = lambda name: F.aggregate(name, F.lit(0), lambda n, m: n + F.bit_count(m.bitwiseAND(c("signals"))))
    rows = rows.withColumns({"in_favour": count("speaks_for"), "against": count("speaks_against")})
    once = rows.groupBy("fingerprint", "hypothesis").agg(F.min_by(F.struct("check", "in_favour", "against"), F.struct("method_order", "position")).alias("h"),
                                                         F.min(F.struct("method_order", "position")).alias("seen"))
    flat = once.select("fingerprint", "hypothesis", "h.*", "seen")
    plausible = F.when((c("in_favour") > 0) & (c("against") == 0), "high").when((c("against") > 0) & (c("in_favour") == 0), "low").otherwise("medium")
    best = Window.partitionBy("fingerprint").orderBy(F.desc(c("in_favour") - c("against")), "seen")
    return flat.withColumns({"plausibility": plausible, "rank": F.row_number().over(best)}).drop("seen")


def evidence_confidence(target_rows: DataFrame, readings: DataFrame, history: DataFrame, lots: DataFrame, days: DataFrame, mismatch: DataFrame, periods: DataFrame) -> DataFrame:
    """Number of quantified pieces of evidence; four or more with enough history make medium confidence."""
    c = F.col
    scale = readings.groupBy("case_no", "product").agg(F.least(F.count("*"), F.lit(2)).alias("n_scale"))
    person = F.coalesce(F.when(present(c("technician")), c("technician")), c("doctor"))
    beside = history.groupBy("name", "product").agg(F.max(F.when(c("rate_median").isNotNull() & c("peer_rate").isNotNull(), 1).otherwise(0)).alias("n_peers"))
    rows = target_rows.withColumns({"name": person, "day": c("ts").cast("date")}).join(scale, ["case_no", "product"], "left").join(beside, ["name", "product"], "left")
    rows = rows.join(lots.select("lot").distinct().withColumn("n_lot", F.lit(1)), "lot", "left").join(days.select("hospital", "day", F.lit(1).alias("n_day")), ["hospital", "day"], "left")
    rows = rows.join(mismatch.select("technician", F.lit(1).alias("n_rate")), "technician", "left")
    rows = rows.join(periods.select("dimension", "key", "product", "history_insufficient"), ["dimension", "key", "product"], "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    has_case = F.when(c("case_no").isNotNull(), 1).otherwise(0)
    pieces = (has_case + zero("n_scale") + F.when(has_case == 1, zero("n_rate")).otherwise(0) + F.when(c("n_peers").isNotNull(), 1).otherwise(0) + zero("n_peers") + zero("n_lot") + zero("n_day")
              + F.when(c("history_insufficient").isNotNull(), 1).otherwise(0))
    enough = (pieces >= 4) & ~F.coalesce("history_insufficient", F.lit(False))
    return rows.select("fingerprint", pieces.alias("evidence"), F.when(enough, "medium").otherwise("low").alias("confidence"))


def case_actions(target_rows: DataFrame, fallback: bool = False) -> DataFrame:
    """Proposals that follow from a case's rules: quarantine, notices and counts, each once per case."""
    c = F.col
    table = target_rows.sparkSession.createDataFrame(CASE_ACTIONS, "method string, action string, team string, needs string")
    rows = target_rows.select("fingerprint", "product_id", "lot", "sublocation", F.explode("methods").alias("method")).join(table, "method")
    has_product = c("product_id").isNotNull()
    fits = (
        F.when(c("needs") == "lot", has_product & present(c("lot"))).when(c("needs") == "case", F.lit(not fallback))
        .when(c("needs") == "place", has_product & present(c("sublocation"))).otherwise(has_product)
    )
    return rows.filter(fits).select("fingerprint", "action", "team").distinct()


def active_notes(notes: DataFrame, scope: str = "", text: str = "", limit: int | None = None) -> DataFrame:
    rows = notes.filter("active")
    if scope:
        rows = rows.filter(F.col("scope") == scope)
    if text:
        rows = rows.filter(contains_text(text, F.col("key"), F.col("note")))
    rows = rows.orderBy(F.desc("note_id"))
    return rows if limit is None else rows.limit(limit)


def responsible(methods: Column) -> Column:
    return F.when(F.array_contains(methods, "R08_DUPLICATE"), "billing").when(F.array_contains(methods, "R09_EXPIRED_LOT"), "quality").otherwise("operations")
