"""Queries: contestants, races, trajectories, house effects, series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from psephon.functions import scalars as s
from psephon.operators import aggregates as agg
from psephon.operators import evaluation as ev
from psephon.operators import relations as rel
from psephon.operators import series as ser
from psephon.operators import windows as win
from psephon.plans.base import BALLOTS, READINGS, ballots, load, query, readings, rounded
from psephon.sources import files

WEIGHT = "1.0::DOUBLE / (1 + greatest(days, 0) / 30.0::DOUBLE) * sqrt(greatest(size, 1)) * (1 + coalesce(grade, 0) / 3.0::DOUBLE)"
#: A contestant's weighted mean; values of every seventh reading are missing, weights of every eleventh.
WAVG = f"""{READINGS}, rw AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE pct END AS v, CASE WHEN event_id % 11 = 0 THEN 0 ELSE {WEIGHT} END AS w FROM readings),
vb AS (SELECT *, avg(v) OVER (PARTITION BY race, cand) AS vbar FROM rw),
wavg AS (SELECT race, cand, count(*) AS n_polls, CASE WHEN sum(w) > 0 AND count(v) > 0 THEN sum(coalesce(v, vbar) * w) / sum(w) ELSE avg(v) END AS wavg FROM vb GROUP BY race, cand)"""


def weighted(spark, sf_dir):
    r = readings(spark, sf_dir)
    v = F.when(F.col("event_id") % 7 != 0, F.col("pct"))
    w = F.when(F.col("event_id") % 11 != 0, s.reading_weight(F.col("days"), F.col("size"), F.col("grade")))
    return r.groupBy("race", "cand").agg(F.count("*").alias("n_polls"), agg.weighted_mean(v, w).alias("wavg"))


SECOND = "coalesce(max(CASE WHEN rn = 2 THEN wavg END) OVER (PARTITION BY race), max(wavg) OVER (PARTITION BY race))"


@query(f"""
WITH {WAVG}, k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY wavg DESC NULLS LAST) AS rn FROM wavg)
SELECT race, cand, n_polls, round(wavg, 6) AS wavg, round(wavg - {SECOND}, 6) + 0.0::DOUBLE AS lead FROM k""")
def weighted_avg_lead(spark, sf_dir):
    """Weighted mean of each contestant and the lead over the runner-up."""
    return rounded(win.lead(weighted(spark, sf_dir), "race", "wavg").select("race", "cand", "n_polls", "wavg", "lead"))


@query(f"""
WITH {WAVG}, k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY wavg DESC NULLS LAST) AS rn FROM wavg),
m AS (SELECT *, {SECOND} AS second, max(CASE WHEN cand = 'click' THEN wavg END) OVER (PARTITION BY race) - max(CASE WHEN cand = 'view' THEN wavg END) OVER (PARTITION BY race) AS margin,
  sum(wavg) OVER (PARTITION BY race) AS total, sum(n_polls) OVER (PARTITION BY race)::BIGINT AS race_total_polls, count(*) OVER (PARTITION BY race) AS n_cands FROM k)
SELECT race, cand, round(wavg - second, 6) + 0.0::DOUBLE AS lead, round(wavg / total, 6) AS share, round(100 - total, 6) AS undecided, n_cands, race_total_polls,
  round(margin * CASE cand WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END, 6) + 0.0::DOUBLE AS twoparty, round(abs(margin), 6) AS abs_gap, CASE WHEN abs(margin) < 3 THEN 1 ELSE 0 END AS tossup FROM m""")
def race_relative(spark, sf_dir):
    """Leads, shares, two-party margins and flags within the race."""
    whole = Window.partitionBy("race")
    best = lambda c: F.max(F.when(F.col("cand") == c, F.col("wavg"))).over(whole)
    rows = win.lead(weighted(spark, sf_dir), "race", "wavg").withColumn("margin", best("click") - best("view")).withColumn("race_total_polls", F.sum("n_polls").over(whole))
    signed = F.col("margin") * s.sign(F.col("cand"), "click", "view")
    return rounded(rows.select("race", "cand", "lead", "share", "undecided", "n_cands", "race_total_polls", signed.alias("twoparty"), F.abs("margin").alias("abs_gap"), s.flag(F.abs("margin") < 3).alias("tossup")))


@query(f"""
WITH {READINGS} SELECT race, cand, round(avg(pct), 6) AS poll_avg, round(CASE WHEN count(*) > 1 THEN stddev_samp(pct) END, 6) AS poll_std, count(*) AS n_polls, count(*) FILTER (pct > 50) AS n_over50,
  round(count(*) FILTER (pct > 50) / count(*)::DOUBLE, 6) AS frac_over50, round(coalesce(avg(pct) FILTER (days <= 10), avg(pct)), 6) AS poll_last, round(avg(grade), 6) AS avg_grade, round(avg(size), 6) AS avg_sample, min(days) AS min_days
FROM readings GROUP BY race, cand""")
def candidate_rollup(spark, sf_dir):
    """A contestant's readings in one row."""
    pct = F.col("pct")
    out = readings(spark, sf_dir).groupBy("race", "cand").agg(
        F.avg(pct).alias("poll_avg"), F.stddev_samp(pct).alias("poll_std"), F.count("*").alias("n_polls"), F.count_if(pct > 50).alias("n_over50"),
        F.try_divide(F.count_if(pct > 50).cast("double"), F.count("*")).alias("frac_over50"), agg.recent_mean(pct, F.col("days"), 10).alias("poll_last"),
        F.avg("grade").alias("avg_grade"), F.avg("size").alias("avg_sample"), F.min("days").alias("min_days"),
    )
    return rounded(out)


@query(f"""
WITH {READINGS} SELECT race, cand, CASE WHEN count(*) FILTER (days <= 20) >= 3 AND min(days) FILTER (days <= 20) < max(days) FILTER (days <= 20) THEN round(regr_slope(pct, -days) FILTER (days <= 20), 6) + 0.0::DOUBLE END AS momentum FROM readings GROUP BY race, cand""")
def momentum_slope(spark, sf_dir):
    """Slope of late readings over time, from three points on."""
    days = F.col("days").cast("double")
    return rounded(readings(spark, sf_dir).groupBy("race", "cand").agg(agg.slope(F.col("pct"), -days, days <= 20, least=3).alias("momentum")))


@query(f"""
WITH {BALLOTS}, p AS (SELECT race, year, poll, max(CASE WHEN party = 'DEM' THEN pct END) AS "DEM", max(CASE WHEN party = 'REP' THEN pct END) AS "REP" FROM ballots WHERE party IN ('DEM', 'REP') GROUP BY 1, 2, 3)
SELECT *, "DEM" - "REP" AS margin, coalesce("DEM", 0) - coalesce("REP", 0) AS margin0 FROM p""")
def pivot_margin(spark, sf_dir):
    """Greatest value of either party side by side, and margins with and without nulls."""
    p = agg.two_parties(ballots(spark, sf_dir), ["race", "year", "poll"], "party", "pct")
    return p.withColumns({"margin": F.col("DEM") - F.col("REP"), "margin0": F.coalesce("DEM", F.lit(0.0)) - F.coalesce("REP", F.lit(0.0))})


HOUSE = """pm AS (SELECT {x}race, poll, house, max(CASE WHEN party = 'DEM' THEN pct END) - max(CASE WHEN party = 'REP' THEN pct END) AS m FROM {t} WHERE party IN ('DEM', 'REP') GROUP BY {x}race, poll, house),
hd AS (SELECT *, m - avg(m) OVER (PARTITION BY {x}race) AS dev FROM pm), he AS (SELECT {x}house, avg(dev) AS house_effect FROM hd GROUP BY {x}house)"""


@query(f"""
WITH {BALLOTS}, tr AS (SELECT * FROM ballots WHERE year <= 1999), {HOUSE.format(x="", t="tr")}
SELECT b.race, b.party, count(*) AS n, round(avg(b.pct - CASE b.party WHEN 'DEM' THEN 1 WHEN 'REP' THEN -1 ELSE 0 END * coalesce(h.house_effect, 0)), 6) AS adjusted FROM ballots b LEFT JOIN he h ON b.house = h.house GROUP BY b.race, b.party""")
def house_effect(spark, sf_dir):
    """Mean deviation of each house over training years, taken off its readings."""
    b = ballots(spark, sf_dir)
    effect = agg.house_effect(b.filter("year <= 1999"), "race", "poll", "house", "party", "pct")
    adjusted = F.col("pct") - s.sign(F.col("party")) * F.col("house_effect")
    rows = b.join(rel.small(effect), "house", "left")
    return rounded(rows.withColumn("house_effect", F.coalesce("house_effect", F.lit(0.0))).groupBy("race", "party").agg(F.count("*").alias("n"), F.avg(adjusted).alias("adjusted")))


YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


@query(f"""
WITH {BALLOTS}, tr AS (SELECT f.fold, b.* FROM ballots b, (SELECT unnest({YEARS})::INTEGER AS fold) f WHERE b.year <> f.fold), {HOUSE.format(x="fold, ", t="tr")} SELECT fold, house, round(house_effect, 6) + 0.0::DOUBLE AS house_effect FROM he""")
def house_effect_folds(spark, sf_dir):
    """House effects of each leave-one-year-out fold, never from the fold's own year."""
    return rounded(ev.house_effects_by_fold(ballots(spark, sf_dir), "year", YEARS, "race", "poll", "house", "party", "pct"))


SPINE = """daily AS (SELECT race, cand, d, sum(pct) AS s, count(pct) AS n FROM readings GROUP BY 1, 2, 3),
sp AS (SELECT a.race, a.d, b.cand FROM (SELECT DISTINCT race, d FROM daily) a JOIN (SELECT DISTINCT race, cand FROM daily) b ON a.race = b.race),
cum AS (SELECT sp.race, sp.d, sp.cand, sum(y.s) AS s, sum(y.n) AS n FROM sp JOIN daily y ON sp.race = y.race AND sp.cand = y.cand AND y.d <= sp.d GROUP BY 1, 2, 3),
means AS (SELECT race, d, cand, round(s / n, 9) AS m FROM cum)"""


@query(f"""
WITH {READINGS}, {SPINE}, led AS (SELECT race, d, cand FROM (SELECT *, row_number() OVER (PARTITION BY race, d ORDER BY m DESC, cand) AS rn FROM means) WHERE rn = 1),
ch AS (SELECT race, CASE WHEN lag(cand) OVER (PARTITION BY race ORDER BY d) <> cand THEN 1 ELSE 0 END AS c FROM led)
SELECT race, sum(c)::BIGINT AS n_lead_changes, CASE WHEN sum(c) > 0 THEN 1 ELSE 0 END AS lead_changed FROM ch GROUP BY race""")
def running_leader_changes(spark, sf_dir):
    """How often the leader by running means changes."""
    means = win.running_means(readings(spark, sf_dir), "race", "cand", "d", "pct")
    return win.lead_changes(means, "race", "cand", "d").withColumn("lead_changed", s.flag(F.col("n_lead_changes") > 0))


@query(f"""
WITH {READINGS}, {SPINE}, mg AS (SELECT a.race, a.d, a.cand, a.m - coalesce((SELECT max(b.m) FROM means b WHERE b.race = a.race AND b.d = a.d AND b.cand <> a.cand), a.m) AS margin, date_diff('day', min(a.d) OVER (PARTITION BY a.race), a.d) AS e FROM means a)
SELECT race, cand, round(avg(margin), 6) + 0.0::DOUBLE AS avg_margin, round(stddev_pop(margin), 6) AS margin_volatility, round(min(margin), 6) + 0.0::DOUBLE AS min_margin,
  round(CASE WHEN count(*) > 1 AND min(e) < max(e) THEN regr_slope(margin, e) ELSE 0 END, 6) + 0.0::DOUBLE AS margin_trend FROM mg GROUP BY race, cand""")
def margin_trajectory(spark, sf_dir):
    """Margins over the best other contestant, day by day, in four figures."""
    return rounded(win.margin_trajectory(readings(spark, sf_dir), "race", "cand", "d", "pct"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1, 2")
def month_resample(spark, sf_dir):
    """Monthly means."""
    o = load(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return rounded(ser.monthly(o, "day", ["o_orderpriority"], "o_totalprice"), 4)


@query("""
WITH dly AS (SELECT o_orderdate::DATE AS day, o_orderpriority, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), sp AS (SELECT p.o_orderpriority, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT o_orderpriority FROM dly) p, (SELECT min(day) AS a, max(day) AS b FROM dly))
SELECT sp.o_orderpriority, sp.day, last_value(dly.v IGNORE NULLS) OVER (PARTITION BY sp.o_orderpriority ORDER BY sp.day) AS v, dly.v IS NULL AS filled FROM sp LEFT JOIN dly ON sp.o_orderpriority = dly.o_orderpriority AND sp.day = dly.day""")
def calendar_fill_ffill(spark, sf_dir):
    """Daily sums on a full calendar, gaps carried forward."""
    daily = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return ser.calendar_filled(daily, "day", ["o_orderpriority"], "v")


MONTHLY = "mon AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS metric, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


def month_sums(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), F.col("o_orderpriority").alias("metric")).agg(F.sum("o_totalprice").alias("v"))


@query(f"WITH {MONTHLY} SELECT month, metric, round(100 * (v / lag(v, 12) OVER (PARTITION BY metric ORDER BY month) - 1), 6) AS yoy FROM mon")
def yoy_lag12(spark, sf_dir):
    """Change against twelve rows earlier."""
    return rounded(month_sums(spark, sf_dir).select("month", "metric", ser.change_over("month", ["metric"], "v").alias("yoy")))


CYCLES = [(1997, "1995-11-01", "1997-11-01"), (1999, "1997-11-01", "1999-11-01"), (2001, "1999-11-01", "2001-11-01")]
WINDOWED = f"""{MONTHLY}, cyc(cycle, s, e) AS (VALUES (1997, DATE '1995-11-01', DATE '1997-11-01'), (1999, DATE '1997-11-01', DATE '1999-11-01'), (2001, DATE '1999-11-01', DATE '2001-11-01')),
rw AS (SELECT c.cycle, m.metric, m.month, m.v, row_number() OVER (PARTITION BY c.cycle, m.metric ORDER BY m.month) - 1 AS i, row_number() OVER (PARTITION BY c.cycle, m.metric ORDER BY m.month DESC) AS back FROM mon m JOIN cyc c ON m.month > c.s AND m.month <= c.e)"""


def cycle_rows(spark, sf_dir):
    cycles = files.literal(spark, CYCLES, "cycle int, start string, eve string").select("cycle", F.col("start").cast("date"), F.col("eve").cast("date"))
    return ser.cycle_rows(month_sums(spark, sf_dir), cycles, "month", "metric", "v")


@query(f"""
WITH {WINDOWED} SELECT cycle, metric, round(max(CASE WHEN back = 1 THEN v END), 4) AS eve, round(avg(v), 4) AS mean, round(max(v), 4) AS max, round(min(v), 4) AS min, round(stddev_pop(v), 4) AS std,
  round(CASE WHEN count(*) > 1 THEN regr_slope(v, i) ELSE 0 END, 4) AS trend, round(coalesce(max(CASE WHEN back = 1 THEN v END) - max(CASE WHEN back = 13 THEN v END), 0), 4) AS last12_delta FROM rw GROUP BY cycle, metric""")
def series_cycle_stats(spark, sf_dir):
    """Seven figures of each series in each cycle's window."""
    return rounded(ser.cycle_stats(cycle_rows(spark, sf_dir), "metric", "v"), 4)


@query(f"WITH {WINDOWED} SELECT cycle, metric, " + ", ".join(f"round(avg(v) FILTER (back <= {n}), 4) AS avg_{n}mo, round(max(v) FILTER (back <= {n}), 4) AS max_{n}mo, round(coalesce(regr_slope(v, i) FILTER (back <= {n}), 0), 4) AS trend_{n}mo" for n in (3, 6, 12)) + " FROM rw GROUP BY cycle, metric")
def series_recency(spark, sf_dir):
    """Mean, maximum and trend of the last three, six and twelve months."""
    return rounded(ser.recency_stats(cycle_rows(spark, sf_dir), "metric", "v"), 4)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"WITH {WINDOWED} SELECT cycle, " + ", ".join(f"""round(max(v) FILTER (metric = '{p}'), 2) AS "{p}_max", round(min(v) FILTER (metric = '{p}'), 2) AS "{p}_min" """ for p in PRIORITIES) + " FROM rw GROUP BY cycle")
def series_wide(spark, sf_dir):
    """Figures of all series side by side, a row for each cycle."""
    return rounded(ser.widened(ser.cycle_stats(cycle_rows(spark, sf_dir), "metric", "v"), "metric", PRIORITIES, ["max", "min"]), 2)


@query(f"""
WITH {READINGS}, a AS (SELECT race, cand, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE avg(pct) END AS v FROM readings GROUP BY 1, 2), f AS (SELECT *, exp((coalesce(v, avg(v) OVER w) - max(v) OVER w) / 3.0::DOUBLE) AS e FROM a WINDOW w AS (PARTITION BY race))
SELECT race, cand, round(e / sum(e) OVER (PARTITION BY race), 6) AS p FROM f""")
def softmax_share(spark, sf_dir):
    """Softmax of mean readings within the race, missing ones at the race's mean."""
    a = readings(spark, sf_dir).groupBy("race", "cand").agg(F.when(F.count("*") % 5 != 0, F.avg("pct")).alias("v"))
    return rounded(a.select("race", "cand", win.softmax("v", "race").alias("p")))


@query("""
WITH r AS (SELECT l_partkey AS p_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1)
SELECT p_partkey, revenue, CAST(row_number() OVER (ORDER BY revenue DESC, p_partkey) AS INTEGER) AS rank FROM r QUALIFY rank <= 15""")
def topk_importance_rank(spark, sf_dir):
    """The fifteen parts of greatest revenue, ranked."""
    revenue = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return win.ranked(revenue, "revenue", "p_partkey", 15)
