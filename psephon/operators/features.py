"""The long table (readings with outcomes attached) and the candidate table that models are fitted on.

The candidate table has a row for each contestant of each race. Everything that concerns one contestant is one aggregate
over the readings; dimensions are joined before or after it; what is relative to the race is windows over the aggregated
rows. Readings are shuffled by (race, contestant) once for that, and once for the trajectories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephon.functions import scalars as s
from psephon.operators import aggregates as agg
from psephon.operators import evaluation as ev
from psephon.operators import relations as rel
from psephon.operators import series as ser
from psephon.operators import windows as win

SEAT = ["year", "state", "office", "district"]
#: Figures of a candidate, in the order in which models take them (macro figures follow).
FEATURES = [
    "poll_avg", "poll_wavg", "poll_last", "poll_last30", "poll_std", "n_polls", "n_polls_over50", "frac_polls_over50", "race_total_polls", "avg_grade",
    "avg_pollscore", "avg_sample", "min_days", "poll_lead", "poll_share", "n_cands", "is_dem", "is_rep", "is_senate", "is_gov", "lean_cand",
    "prior_margin_cand", "is_incumbent", "is_inc_party_race", "twoparty_margin_cand", "abs_gap", "tossup", "undecided", "gap_x_recency", "natl_env_cand",
    "poll_momentum", "poll_wavg_adj", "n_lead_changes", "lead_changed", "avg_margin_over_time", "margin_volatility", "min_margin", "margin_trend",
    "is_president_party",
]


def seat_of(number: str | None, name: str | None, columns: list[str], longest: bool = True):
    """District of a seat: by its number, where there is one, else by its name; null where neither column tells."""
    found = [s.seat_number(F.col(c).cast("string"), longest) for c in (number, name) if c in columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def long_table(polls: DataFrame, results: DataFrame) -> DataFrame:
    """Readings with their outcome: a left join on seat and contestant, whether it matched, and the race's key.

    ``results`` has a row or more for each (seat, cand_key); the first by ``seq`` counts. All readings stay.
    """
    keys = [*SEAT, "cand_key"]
    outcome = rel.first_rows(results, keys, [F.col("seq")]).drop("seq")
    joined = rel.with_match(polls, outcome, keys, "has_result")
    return joined.withColumn("race_id", s.joined_key(F.col("year").cast("string"), F.col("state"), F.col("office"), district=F.col("district")))


def with_race_best(results: DataFrame, value: str = "vote_pct", name: str = "race_winning_pct") -> DataFrame:
    """The greatest share of each race beside every result."""
    best = results.groupBy(*SEAT).agg(F.max(value).alias(name))
    return results.join(best, SEAT)


def rollup(readings: DataFrame, effects: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (race_id, cand_key): descriptive columns of the earliest reading (by date, then ``seq``), and what
    readings add up to.

    ``effects`` (house, house_effect) are taken off the house-adjusted mean; a house that has none counts as 0, one whose
    figure is null makes its readings missing there.
    """
    r = rel.lookup(readings, effects, [*extra, "house"], "house_effect", F.lit(0.0))
    pct, days, h = F.col("pct"), F.col("days").cast("double"), F.col("house_effect")
    weight = s.reading_weight(F.col("days"), F.col("sample"), F.col("grade"))
    ties = [F.col("seq")]
    first = lambda c: agg.by_date(F.col(c), F.col("date"), *ties, last=False).alias(c)
    adjusted = {k: agg.weighted_mean(pct - F.lit(float(k)) * h, weight).alias(f"adjusted_{k + 1}") for k in (-1, 0, 1)}
    out = r.groupBy(*extra, "race_id", "cand_key").agg(
        *[first(c) for c in (*SEAT, "party", "won")], F.avg(pct).alias("poll_avg"), agg.weighted_mean(pct, weight).alias("poll_wavg"),
        agg.by_date(pct, F.col("date"), *ties, last=True).alias("poll_last"), agg.recent_mean(pct, F.col("days"), 30).alias("poll_last30"),
        F.stddev_samp(pct).alias("poll_std"), F.count("*").alias("n_polls"), F.count_if(pct > 50).alias("n_polls_over50"), F.avg("grade").alias("avg_grade"),
        F.avg("score").alias("avg_pollscore"), F.avg("sample").alias("avg_sample"), F.min("days").alias("min_days"),
        agg.slope(pct, -days, days <= 60, least=3).alias("poll_momentum"), *adjusted.values(),
    )
    sign = s.sign(F.col("party"))
    chosen = F.when(sign == 1, F.col("adjusted_2")).when(sign == -1, F.col("adjusted_0")).otherwise(F.col("adjusted_1"))
    return out.withColumn("sign", sign).withColumn("poll_wavg_adj", chosen).drop("adjusted_0", "adjusted_1", "adjusted_2")


def with_dimensions(cand: DataFrame, leans: DataFrame, holders: DataFrame, margins: DataFrame, climate: DataFrame) -> DataFrame:
    """Leans (by district for the House, by state else), incumbents, margins of an earlier cycle, and the cycle's climate.

    ``leans`` (state, district, lean) has '' as the district of whole states; ``holders`` (seat, inc_party) and ``margins``
    (seat, margin) have a row for each seat; ``climate`` (year, pres_party, natl_env) one for each cycle.
    """
    cand = cand.withColumn("lean_district", F.when(F.col("office") == "House", F.col("district")).otherwise(F.lit("")))
    cand = rel.lookup(cand, leans.withColumnRenamed("district", "lean_district"), ["state", "lean_district"], "lean")
    cand = rel.lookup(cand, holders, SEAT, "inc_party")
    earlier = rel.latest_before(cand.select(*SEAT).distinct(), margins, ["state", "office", "district"], "year", "margin")
    cand = cand.join(earlier, SEAT, "left").join(F.broadcast(climate), "year", "left")  # a row for each cycle
    return cand.select(
        "*", (F.col("sign") * F.col("lean")).alias("lean_cand"), (F.col("sign") * F.col("margin")).alias("prior_margin_cand"),
        s.flag(F.col("inc_party") == F.col("party")).alias("is_incumbent"), s.flag(F.col("inc_party").isin("DEM", "REP")).alias("is_inc_party_race"),
        (F.col("sign") * F.col("natl_env")).alias("natl_env_cand"), s.flag(F.col("party") == F.col("pres_party")).alias("is_president_party"),
    ).drop("lean_district", "lean", "inc_party", "margin", "natl_env", "pres_party")


def with_trajectories(cand: DataFrame, readings: DataFrame) -> DataFrame:
    """Lead changes of the race (0 where there are no dated readings) and the contestant's margins over time (null there)."""
    means = win.running_means(readings, "race_id", "cand_key", "date", "pct")
    changes = win.lead_changes(means, "race_id", "cand_key", "date")
    dynamics = win.margin_trajectory(readings, "race_id", "cand_key", "date", "pct").withColumnRenamed("avg_margin", "avg_margin_over_time")
    joined = cand.join(changes, "race_id", "left").join(dynamics, ["race_id", "cand_key"], "left")
    n = F.coalesce("n_lead_changes", F.lit(0))
    return joined.withColumns({"n_lead_changes": n, "lead_changed": s.flag(n > 0)})


def with_race_relative(cand: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Leads, shares, gaps and flags within the race, by weighted means."""
    cand = cand.withColumn("race__", F.struct(*extra, "race_id"))
    w = Window.partitionBy("race__")
    best = lambda p: F.max(F.when(F.col("party") == p, F.col("poll_wavg"))).over(w)
    rows = win.lead(cand, "race__", "poll_wavg").withColumn("gap__", best("DEM") - best("REP"))
    return rows.withColumnsRenamed({"lead": "poll_lead", "share": "poll_share"}).select(
        "*", F.sum("n_polls").over(w).alias("race_total_polls"), F.try_divide(F.col("n_polls_over50").cast("double"), F.col("n_polls")).alias("frac_polls_over50"),
        s.flag(F.col("party") == "DEM").alias("is_dem"), s.flag(F.col("party") == "REP").alias("is_rep"), s.flag(F.col("office") == "Senate").alias("is_senate"),
        s.flag(F.col("office") == "Governor").alias("is_gov"), (F.col("gap__") * F.col("sign")).alias("twoparty_margin_cand"), F.abs("gap__").alias("abs_gap"),
        s.flag(F.abs("gap__") < 3).alias("tossup"), (F.col("poll_lead") * s.recency(F.col("min_days"))).alias("gap_x_recency"),
    ).drop("race__", "gap__", "field_best")


def candidate_table(readings: DataFrame, leans: DataFrame, holders: DataFrame, margins: DataFrame, climate: DataFrame, train: list[int]) -> DataFrame:
    """All of ``FEATURES`` with race, seat, party and outcome; house effects come from the years ``train`` alone."""
    effects = agg.house_effect(readings.filter(F.col("year").isin(train)), "race_id", "poll", "house", "party", "pct")
    cand = with_trajectories(with_dimensions(rollup(readings, effects), leans, holders, margins, climate), readings)
    return with_race_relative(cand).select("race_id", "cand_key", *SEAT, "party", "won", *FEATURES)


def adjusted_by_fold(readings: DataFrame, years: list[int]) -> DataFrame:
    """(fold, race_id, cand_key, poll_wavg_adj): the one figure that depends on a fold, which leaves out its own year.

    Each reading is looked up in every fold's effects (a fixed few); the rest of the candidate table is the same in all.
    """
    effects = ev.house_effects_by_fold(readings, "year", years, "race_id", "poll", "house", "party", "pct")
    each = readings.withColumn("fold", F.explode(F.array(*[F.lit(y) for y in years])))
    return rollup(each, effects, ("fold",)).select("fold", "race_id", "cand_key", "year", "party", "poll_wavg_adj")


def macro_table(monthly: DataFrame, cycles: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """A row for each cycle with sixteen figures of each metric (name: whether its change over twelve rows counts).

    ``monthly`` (month, metric, v); changes are taken over the whole series, then cut to each cycle's window.
    """
    yearly = F.col("metric").isin(*[m for m, change in metrics.items() if change] or [""])
    values = F.when(yearly, ser.change_over("month", ["metric"], "v")).otherwise(F.col("v"))
    rows = ser.cycle_rows(monthly.select("month", "metric", values.alias("v")), cycles, "month", "metric", "v")
    whole, recent = ser.cycle_stats(rows, "metric", "v"), ser.recency_stats(rows, "metric", "v")
    names = [c for c in (*whole.columns, *recent.columns) if c not in ("cycle", "metric")]
    wide = ser.widened(whole.join(recent, ["cycle", "metric"]), "metric", list(metrics), names)
    # A cycle without any value still has a row.
    return cycles.select("cycle").join(wide, "cycle", "left")


def with_macro(cand: DataFrame, macro: DataFrame) -> DataFrame:
    """The cycle's macro figures beside each candidate; a year without a row there is an error, not a null."""
    figures = [c for c in macro.columns if c != "cycle"]
    joined = cand.join(F.broadcast(macro.withColumnRenamed("cycle", "year").withColumn("known__", F.lit(True))), "year", "left")
    known = F.when(F.col("known__").isNull(), F.raise_error(F.concat(F.lit("no macro figures for "), F.col("year").cast("string"))).cast("int")).otherwise(F.col("year"))
    return joined.withColumn("year", known).select(*cand.columns, *figures)
