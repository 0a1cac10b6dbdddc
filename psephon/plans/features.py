"""Queries: long table, candidate table, macro table, and what is read off them.

``events`` play the polls of four cycles: a user is a seat's state, office and district, an event type a contestant,
a day and a house a poll. Every thirteenth reading has no date, some have no size or grade.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from psephon.functions import catalogs
from psephon.functions import scalars as s
from psephon.operators import aggregates as agg
from psephon.operators import evaluation as ev
from psephon.operators import features as feat
from psephon.operators import relations as rel
from psephon.operators import series as ser
from psephon.operators import windows as win
from psephon.plans.base import load, query, rounded
from psephon.plans.contest import MONTHLY, month_sums
from psephon.plans.evaluation import PICKS, contestants
from psephon.sources import files

YEARS = [2018, 2020, 2022, 2024]


def polls(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k, user, i = F.from_json("props", "k int").getField("k"), F.col("user_id"), F.col("event_id")
    office = F.when(user % 3 == 0, "Senate").when(user % 3 == 1, "House").otherwise("Governor")
    date = F.when(i % 13 != 0, F.col("ts").cast("date"))
    party = F.when(F.col("event_type") == "click", "DEM").when(F.col("event_type") == "view", "REP").otherwise("OTH")
    r = e.select(
        (i % 4 * 2 + 2018).cast("int").alias("year"), F.concat(F.lit("S"), (user % 6).cast("string")).alias("state"), office.alias("office"),
        F.when(office == "House", (user % 2).cast("string")).otherwise("").alias("district"), F.col("event_type").alias("cand_key"), party.alias("party"),
        F.dayofmonth("ts").alias("poll"), (k % 6).alias("house"), F.col("value").alias("pct"), F.when(k % 11 != 0, k).alias("sample"), F.when(k % 7 != 0, k % 4).alias("grade"),
        ((k % 10) / 10.0).alias("score"), date.alias("date"), (F.datediff(F.lit("2024-01-31").cast("date"), date) * 3).alias("days"), (F.col("value") > 60).cast("int").alias("won"), i.alias("seq"),
    )
    return r.withColumn("race_id", s.joined_key(F.col("year").cast("string"), F.col("state"), F.col("office"), district=F.col("district")))


POLLS = """p0 AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE user_id % 3 WHEN 0 THEN 'Senate' WHEN 1 THEN 'House' ELSE 'Governor' END AS office, CASE WHEN event_id % 13 <> 0 THEN ts::DATE END AS date FROM events),
p1 AS (SELECT CAST(event_id % 4 * 2 + 2018 AS INTEGER) AS year, 'S' || (user_id % 6) AS state, office, CASE WHEN office = 'House' THEN (user_id % 2)::VARCHAR ELSE '' END AS district, event_type AS cand_key,
  CASE event_type WHEN 'click' THEN 'DEM' WHEN 'view' THEN 'REP' ELSE 'OTH' END AS party, CAST(day(ts) AS INTEGER) AS poll, k % 6 AS house, value AS pct, CASE WHEN k % 11 <> 0 THEN k END AS sample, CASE WHEN k % 7 <> 0 THEN k % 4 END AS grade,
  (k % 10) / 10.0::DOUBLE AS score, date, CAST(date_diff('day', date, DATE '2024-01-31') * 3 AS INTEGER) AS days, CASE WHEN value > 60 THEN 1 ELSE 0 END AS won, event_id AS seq FROM p0),
polls AS (SELECT *, year || '_' || state || '_' || office || CASE WHEN district = '' THEN '' ELSE '-' || district END AS race_id FROM p1)"""
SIGN = "CASE party WHEN 'DEM' THEN 1 WHEN 'REP' THEN -1 ELSE 0 END"


def outcomes(polls_):
    """A result for each (seat, contestant) that has a reading above 40, several for some."""
    keys = [*feat.SEAT, "cand_key"]
    found = polls_.filter("pct > 40").select(*keys, F.col("pct").alias("vote_pct"), "won", "seq")
    return feat.with_race_best(found)


@query(f"""
WITH {POLLS}, res AS (SELECT *, max(pct) OVER (PARTITION BY year, state, office, district) AS race_winning_pct, row_number() OVER (PARTITION BY year, state, office, district, cand_key ORDER BY seq) AS rn FROM polls WHERE pct > 40)
SELECT p.seq, p.race_id, p.cand_key, p.party, p.pct, r.pct AS vote_pct, r.won::DOUBLE AS won, r.race_winning_pct, CASE WHEN r.seq IS NULL THEN 0 ELSE 1 END AS has_result
FROM polls p LEFT JOIN res r ON r.rn = 1 AND p.year = r.year AND p.state = r.state AND p.office = r.office AND p.district = r.district AND p.cand_key = r.cand_key""")
def long_table(spark, sf_dir):
    """Every reading with its contestant's outcome, whether there is one, and the race's key."""
    p = polls(spark, sf_dir)
    out = feat.long_table(p.drop("won", "race_id"), outcomes(p))
    return out.select("seq", "race_id", "cand_key", "party", "pct", "vote_pct", F.col("won").cast("double").alias("won"), "race_winning_pct", "has_result")


def dimensions(spark, sf_dir, p):
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("S"), (F.col("n_nationkey") % 5).cast("string")).alias("state"), (F.col("n_nationkey") % 2).cast("string").alias("district"), F.col("n_nationkey").cast("double").alias("x"))
    leans = rel.union_all([n.groupBy("state", "district").agg((F.avg("x") * 1.5).alias("lean")), n.groupBy("state").agg(F.avg("x").alias("lean")).withColumn("district", F.lit(""))])
    holders = rel.last_rows(p, feat.SEAT, [F.col("pct"), F.col("seq")]).select((F.col("year") + 2).alias("year"), "state", "office", "district", F.col("party").alias("inc_party"))
    margins = agg.two_parties(p, feat.SEAT, "party", "pct").select(*feat.SEAT, (F.coalesce("DEM", F.lit(0.0)) - F.coalesce("REP", F.lit(0.0))).alias("margin"))
    climate = files.literal(spark, [c[:3] for c in catalogs.CYCLES], "year int, pres_party string, natl_env double")
    return leans, holders, margins, climate


def effects_sql(polls_: str, fold: str = "") -> str:
    return f"""pm AS (SELECT {fold}race_id, poll, house, max(pct) FILTER (party = 'DEM') - max(pct) FILTER (party = 'REP') AS m FROM {polls_} WHERE party <> 'OTH' GROUP BY {fold}race_id, poll, house),
pd AS (SELECT *, m - avg(m) OVER (PARTITION BY {fold}race_id) AS dev FROM pm), he AS (SELECT {fold}house, avg(dev) AS eff FROM pd GROUP BY {fold}house)"""


WEIGHT = "1.0::DOUBLE / (1 + greatest(days, 0) / 30.0::DOUBLE) * sqrt(greatest(sample, 1)) * (1 + coalesce(grade, 0) / 3.0::DOUBLE)"
#: Weights (0 without days or size), the contestant's sign by the earliest reading, and the house-adjusted value.
WEIGHED = f"""wt AS (SELECT *, CASE WHEN days IS NULL OR sample IS NULL THEN 0 ELSE {WEIGHT} END AS w, row_number() OVER (PARTITION BY {{fold}}race_id, cand_key ORDER BY date NULLS LAST, seq) AS k, count(*) OVER (PARTITION BY {{fold}}race_id, cand_key) AS n_polls FROM {{polls}}),
sg AS (SELECT {{fold}}race_id, cand_key, {SIGN} AS sign FROM wt WHERE k = 1),
ad AS (SELECT wt.*, sg.sign, wt.pct - sg.sign * CASE WHEN he.house IS NULL THEN 0 ELSE he.eff END AS adj FROM wt JOIN sg ON {{on_sg}} LEFT JOIN he ON {{on_he}}),
av AS (SELECT *, avg(adj) OVER (PARTITION BY {{fold}}race_id, cand_key) AS adj_mean FROM ad)"""
WMEAN = "CASE WHEN sum(w) > 0 AND count({0}) > 0 THEN sum({1} * w) / sum(w) ELSE avg({0}) END"
CANDIDATES = f"""WITH {POLLS}, tr AS (SELECT * FROM polls WHERE year <= 2022), {effects_sql("tr")},
{WEIGHED.format(fold="", polls="polls", on_sg="wt.race_id = sg.race_id AND wt.cand_key = sg.cand_key", on_he="wt.house = he.house")},
ru AS (SELECT race_id, cand_key, any_value(sign) AS sign, arg_min(year, k) AS year, arg_min(state, k) AS state, arg_min(office, k) AS office, arg_min(district, k) AS district, arg_min(party, k) AS party, arg_min(won, k) AS won, avg(pct) AS poll_avg, {WMEAN.format("pct", "pct")} AS poll_wavg,
  arg_max(pct, k) AS poll_last, coalesce(avg(pct) FILTER (days <= 30), avg(pct)) AS poll_last30, CASE WHEN count(*) > 1 THEN stddev_samp(pct) END AS poll_std, count(*) AS n_polls, count(*) FILTER (pct > 50) AS n_polls_over50, avg(grade) AS avg_grade, avg(score) AS avg_pollscore, avg(sample) AS avg_sample, min(days) AS min_days,
  CASE WHEN count(*) FILTER (days <= 60) >= 3 AND min(days) FILTER (days <= 60) < max(days) FILTER (days <= 60) THEN regr_slope(pct, -days) FILTER (days <= 60) END AS poll_momentum, {WMEAN.format("adj", "coalesce(adj, adj_mean)")} AS poll_wavg_adj FROM av GROUP BY race_id, cand_key),
na AS (SELECT 'S' || (n_nationkey % 5) AS state, (n_nationkey % 2)::VARCHAR AS district, n_nationkey::DOUBLE AS x FROM nation),
le AS (SELECT state, district, avg(x) * 1.5 AS lean FROM na GROUP BY 1, 2 UNION ALL SELECT state, '' AS district, avg(x) AS lean FROM na GROUP BY 1),
ho AS (SELECT year + 2 AS year, state, office, district, party AS inc_party FROM (SELECT *, row_number() OVER (PARTITION BY year, state, office, district ORDER BY pct DESC, seq DESC) AS rn FROM polls) WHERE rn = 1),
ma AS (SELECT year, state, office, district, coalesce(max(pct) FILTER (party = 'DEM'), 0) - coalesce(max(pct) FILTER (party = 'REP'), 0) AS margin FROM polls WHERE party <> 'OTH' GROUP BY ALL),
cl(year, pres, natl) AS (VALUES {", ".join(f"({y}, '{p}', {n}::DOUBLE)" for y, p, n, _ in catalogs.CYCLES)}),
dm AS (SELECT ru.*, sign * le.lean AS lean_cand, sign * (SELECT m.margin FROM ma m WHERE m.state = ru.state AND m.office = ru.office AND m.district = ru.district AND m.year IN (ru.year - 2, ru.year - 4, ru.year - 6, ru.year - 8) ORDER BY m.year DESC LIMIT 1) AS prior_margin_cand,
  CASE WHEN ho.inc_party = ru.party THEN 1 ELSE 0 END AS is_incumbent, CASE WHEN ho.inc_party IN ('DEM', 'REP') THEN 1 ELSE 0 END AS is_inc_party_race, sign * cl.natl AS natl_env_cand, CASE WHEN ru.party = cl.pres THEN 1 ELSE 0 END AS is_president_party
  FROM ru LEFT JOIN le ON ru.state = le.state AND le.district = CASE WHEN ru.office = 'House' THEN ru.district ELSE '' END LEFT JOIN ho ON ru.year = ho.year AND ru.state = ho.state AND ru.office = ho.office AND ru.district = ho.district LEFT JOIN cl ON ru.year = cl.year),
dy AS (SELECT race_id, cand_key, date AS d, sum(pct) AS s, count(pct) AS n FROM polls WHERE date IS NOT NULL GROUP BY ALL),
sp AS (SELECT a.race_id, a.d, b.cand_key FROM (SELECT DISTINCT race_id, d FROM dy) a JOIN (SELECT DISTINCT race_id, cand_key FROM dy) b ON a.race_id = b.race_id),
me AS (SELECT sp.race_id, sp.d, sp.cand_key, round(sum(y.s) / sum(y.n), 9) AS m FROM sp JOIN dy y ON sp.race_id = y.race_id AND sp.cand_key = y.cand_key AND y.d <= sp.d GROUP BY ALL),
ld AS (SELECT race_id, d, cand_key FROM (SELECT *, row_number() OVER (PARTITION BY race_id, d ORDER BY m DESC, cand_key) AS rn FROM me) WHERE rn = 1),
lc AS (SELECT race_id, sum(c)::BIGINT AS n_lead_changes FROM (SELECT race_id, CASE WHEN lag(cand_key) OVER (PARTITION BY race_id ORDER BY d) <> cand_key THEN 1 ELSE 0 END AS c FROM ld) GROUP BY race_id),
mg AS (SELECT a.race_id, a.cand_key, a.m - coalesce((SELECT max(b.m) FROM me b WHERE b.race_id = a.race_id AND b.d = a.d AND b.cand_key <> a.cand_key), a.m) AS margin, date_diff('day', min(a.d) OVER (PARTITION BY a.race_id), a.d) AS e FROM me a),
td AS (SELECT race_id, cand_key, avg(margin) AS avg_margin_over_time, stddev_pop(margin) AS margin_volatility, min(margin) AS min_margin, CASE WHEN count(*) > 1 AND min(e) < max(e) THEN regr_slope(margin, e) ELSE 0 END AS margin_trend FROM mg GROUP BY ALL),
al AS (SELECT dm.*, coalesce(lc.n_lead_changes, 0) AS n_lead_changes, CASE WHEN lc.n_lead_changes > 0 THEN 1 ELSE 0 END AS lead_changed, td.* EXCLUDE (race_id, cand_key), row_number() OVER (PARTITION BY dm.race_id ORDER BY poll_wavg DESC NULLS LAST) AS rn
  FROM dm LEFT JOIN lc ON dm.race_id = lc.race_id LEFT JOIN td ON dm.race_id = td.race_id AND dm.cand_key = td.cand_key),
rr AS (SELECT *, poll_wavg - coalesce(max(CASE WHEN rn = 2 THEN poll_wavg END) OVER r, max(poll_wavg) OVER r) AS poll_lead, poll_wavg / sum(poll_wavg) OVER r AS poll_share, count(*) OVER r AS n_cands, sum(n_polls) OVER r::BIGINT AS race_total_polls, 100 - sum(poll_wavg) OVER r AS undecided,
  max(CASE WHEN party = 'DEM' THEN poll_wavg END) OVER r - max(CASE WHEN party = 'REP' THEN poll_wavg END) OVER r AS gap FROM al WINDOW r AS (PARTITION BY race_id)),
cand AS (SELECT *, n_polls_over50 / n_polls::DOUBLE AS frac_polls_over50, CASE WHEN party = 'DEM' THEN 1 ELSE 0 END AS is_dem, CASE WHEN party = 'REP' THEN 1 ELSE 0 END AS is_rep, CASE WHEN office = 'Senate' THEN 1 ELSE 0 END AS is_senate, CASE WHEN office = 'Governor' THEN 1 ELSE 0 END AS is_gov,
  gap * sign AS twoparty_margin_cand, abs(gap) AS abs_gap, CASE WHEN abs(gap) < 3 THEN 1 ELSE 0 END AS tossup, CASE WHEN min_days IS NOT NULL THEN poll_lead / (1 + greatest(min_days, 0) / 30.0::DOUBLE) END AS gap_x_recency FROM rr)"""
DOUBLES = {"poll_avg", "poll_wavg", "poll_last", "poll_last30", "poll_std", "frac_polls_over50", "avg_grade", "avg_pollscore", "avg_sample", "poll_lead", "poll_share", "lean_cand", "prior_margin_cand", "twoparty_margin_cand", "abs_gap", "undecided", "gap_x_recency", "natl_env_cand", "poll_momentum", "poll_wavg_adj", "avg_margin_over_time", "margin_volatility", "min_margin", "margin_trend"}
SHOWN = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" if c in DOUBLES else c for c in ["race_id", "cand_key", *feat.SEAT, "party", "won", *feat.FEATURES])


def candidates(spark, sf_dir):
    p = polls(spark, sf_dir)
    return feat.candidate_table(p, *dimensions(spark, sf_dir, p), train=[2018, 2020, 2022])


@query(f"{CANDIDATES} SELECT {SHOWN} FROM cand")
def candidate_table(spark, sf_dir):
    """A row for each contestant of each race, with all 39 figures; house effects from the years up to 2022."""
    return rounded(candidates(spark, sf_dir))


@query(f"""
{CANDIDATES} SELECT CASE WHEN year <= 2022 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT race_id) AS n_races, round(avg(won), 6) AS win_rate FROM cand GROUP BY 1""")
def temporal_split(spark, sf_dir):
    """Candidates up to a year, and after it."""
    part = F.when(F.col("year") <= 2022, "train").otherwise("test").alias("part")
    return rounded(candidates(spark, sf_dir).groupBy(part).agg(F.count("*").alias("n"), F.countDistinct("race_id").alias("n_races"), F.avg("won").alias("win_rate")))


@query(f"""
WITH {POLLS}, fp AS (SELECT f.fold, p.* FROM polls p, (SELECT unnest({YEARS}) AS fold) f), tr AS (SELECT * FROM fp WHERE year <> fold), {effects_sql("tr", "fold, ")},
{WEIGHED.format(fold="fold, ", polls="fp", on_sg="wt.fold = sg.fold AND wt.race_id = sg.race_id AND wt.cand_key = sg.cand_key", on_he="wt.fold = he.fold AND wt.house = he.house")}
SELECT CAST(fold AS INTEGER) AS fold, race_id, cand_key, any_value(year) AS year, arg_min(party, k) AS party, round({WMEAN.format("adj", "coalesce(adj, adj_mean)")}, 6) AS poll_wavg_adj FROM av GROUP BY fold, race_id, cand_key""")
def fold_features(spark, sf_dir):
    """The house-adjusted mean of every candidate in every leave-one-cycle-out fold."""
    return rounded(feat.adjusted_by_fold(polls(spark, sf_dir), YEARS))


#: Metrics of the macro table; the change of the first over twelve months counts.
METRICS = {"1-URGENT": True, "2-HIGH": False, "3-MEDIUM": False, "4-NOT SPECIFIED": False, "5-LOW": False, "F": False, "O": False}
MACRO_CYCLES = [(2018, "1994-11-01", "1996-11-01"), (2020, "1996-11-01", "1998-11-01"), (2022, "1998-11-01", "2000-11-01"), (2024, "2000-11-01", "2002-11-01")]
FIGURES = {
    "eve": "max(v) FILTER (back = 1)", "mean": "avg(v)", "max": "max(v)", "min": "min(v)", "std": "stddev_pop(v)", "trend": "CASE WHEN count(v) > 1 THEN regr_slope(v, i) WHEN count(v) = 1 THEN 0 END",
    "last12_delta": "CASE WHEN count(v) > 0 THEN coalesce(max(v) FILTER (back = 1) - max(v) FILTER (back = 13), 0) END",
} | {f"{name}_{n}mo": f"{sql.format(f'FILTER (back <= {n})')}" for n in (3, 6, 12) for name, sql in (("avg", "avg(v) {0}"), ("max", "max(v) {0}"), ("trend", "CASE WHEN count(v) > 0 THEN coalesce(regr_slope(v, i) {0}, 0) END"))}
MACRO = f"""{MONTHLY}, mo AS (SELECT * FROM mon UNION ALL SELECT date_trunc('month', l_shipdate)::DATE AS month, l_linestatus AS metric, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
yo AS (SELECT month, metric, CASE WHEN metric = '1-URGENT' THEN 100 * (v / lag(v, 12) OVER (PARTITION BY metric ORDER BY month) - 1) ELSE v END AS v FROM mo),
cy(cycle, s, e) AS (VALUES {", ".join(f"({c}, DATE '{a}', DATE '{b}')" for c, a, b in MACRO_CYCLES)}),
mr AS (SELECT c.cycle, y.metric, y.v, row_number() OVER (PARTITION BY c.cycle, y.metric ORDER BY y.month) - 1 AS i, row_number() OVER (PARTITION BY c.cycle, y.metric ORDER BY y.month DESC) AS back FROM yo y JOIN cy c ON y.month > c.s AND y.month <= c.e WHERE y.v IS NOT NULL),
ms AS (SELECT cycle, metric, {", ".join(f'round({sql}, 4) + 0.0::DOUBLE AS "{name}"' for name, sql in FIGURES.items())} FROM mr GROUP BY cycle, metric),
macro AS (SELECT cy.cycle, {", ".join(f"""max(ms."{n}") FILTER (ms.metric = '{m}') AS "{m}_{n}" """ for m in METRICS for n in FIGURES)} FROM cy LEFT JOIN ms ON cy.cycle = ms.cycle GROUP BY cy.cycle)"""


def macro(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"), F.col("l_linestatus").alias("metric")).agg(F.sum("l_extendedprice").alias("v"))
    cycles = files.literal(spark, MACRO_CYCLES, "cycle int, start string, eve string").select("cycle", F.col("start").cast("date"), F.col("eve").cast("date"))
    return rounded(feat.macro_table(month_sums(spark, sf_dir).unionByName(lines), cycles, METRICS), 4)


@query(f"WITH {MACRO} SELECT * FROM macro")
def macro_features(spark, sf_dir):
    """Sixteen figures of seven series for each cycle, side by side; the first series as change over a year."""
    return macro(spark, sf_dir)


@query(f"{CANDIDATES}, {MACRO} SELECT {SHOWN.replace('year', 'cand.year')}, macro.* EXCLUDE (cycle) FROM cand LEFT JOIN macro ON cand.year = macro.cycle")
def feature_table(spark, sf_dir):
    """The whole model matrix: 39 figures of the candidate and 112 of the cycle."""
    return feat.with_macro(rounded(candidates(spark, sf_dir)), macro(spark, sf_dir))


@query(f"WITH {PICKS} SELECT race, cand, round(score, 6) AS score, votes FROM w WHERE r1 = 1 AND won = 0")
def wrong_picks(spark, sf_dir):
    """Races whose pick did not win, with the pick."""
    return rounded(win.winners(contestants(spark, sf_dir), ["race"], "score", "cand").filter("won = 0").select("race", "cand", "score", "votes"))


@query(f"""
WITH {PICKS}, bl AS (SELECT a.alpha, race, cand, won, round(a.alpha * score + (1 - a.alpha) * other, 9) AS b FROM w, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha) a),
pk AS (SELECT *, row_number() OVER (PARTITION BY alpha, race ORDER BY b DESC, cand) AS r FROM bl) SELECT alpha, count(*) AS n_races, round(avg(won), 6) AS race_acc FROM pk WHERE r = 1 GROUP BY alpha""")
def blend_race_accuracy(spark, sf_dir):
    """Share of races whose pick by a blend of two scores won, for each blend."""
    each = ev.blends(contestants(spark, sf_dir), "score", "other", "b").withColumn("b", F.round("b", 9))
    return rounded(win.winners(each, ["alpha", "race"], "b", "cand").groupBy("alpha").agg(F.count("*").alias("n_races"), F.avg("won").alias("race_acc")))


@query(f"WITH {MONTHLY} SELECT metric, month, round(v, 2) AS v FROM mon ORDER BY metric, month")
def sorted_series(spark, sf_dir):
    """Series by metric and date."""
    return rounded(month_sums(spark, sf_dir), 2).orderBy("metric", "month")


@query("SELECT DISTINCT l_suppkey FROM lineitem ORDER BY l_suppkey LIMIT 15")
def distinct_preview(spark, sf_dir):
    """The fifteen least distinct values."""
    return load(spark, sf_dir, "lineitem").select("l_suppkey").distinct().orderBy("l_suppkey").limit(15)


@query("""
WITH m AS (SELECT o_custkey % 40 AS k, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), ends AS (SELECT k, min(month) AS a, max(month) AS b FROM m GROUP BY k),
s AS (SELECT k, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month FROM ends) SELECT s.k, s.month, round(m.v, 4) AS v FROM s LEFT JOIN m ON s.k = m.k AND s.month = m.month""")
def month_gaps(spark, sf_dir):
    """Monthly means on a full calendar of each series; months without values have null."""
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("k"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("v"))
    return rounded(ser.monthly(o, "day", ["k"], "v", gaps=True).select("k", "month", "v"), 4)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 7)::VARCHAR WHEN c_custkey % 3 = 1 THEN '3' END AS district FROM customer""")
def seat_fallback(spark, sf_dir):
    """District by seat number, where there is one, else by seat name, else null."""
    k = F.col("c_custkey") % 3
    c = load(spark, sf_dir, "customer").withColumns({"seat_number": F.when(k == 0, (F.col("c_custkey") % 7).cast("double")), "seat_name": F.when(k == 1, "Third Congressional District").when(k == 2, "Class I")})
    return c.select("c_custkey", feat.seat_of("seat_number", "seat_name", c.columns).alias("district"))


@query(f"""
SELECT strftime(d, '%Y-%m-%d') AS date, value, metric FROM (SELECT unnest(generate_series(DATE '2016-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS d, unnest([{", ".join(str(v) for values in catalogs.APPROVAL.values() for v in values)}])::DOUBLE AS value, 'approval' AS metric)""")
def approval_series(spark, sf_dir):
    """The literal approval series."""
    return files.literal(spark, catalogs.approval_rows(), "date string, value double, metric string")
