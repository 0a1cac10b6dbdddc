"""Queries: scores against outcomes, folds, picks, blends, a tree model."""

from __future__ import annotations

from pyspark.sql import functions as F

from psephon.operators import evaluation as ev
from psephon.operators import windows as win
from psephon.plans.base import BALLOTS, READINGS, SCORED, ballots, load, query, readings, rounded, scored

#: Area by ranks: the sum of the positives' mid-ranks.
AUC = """CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN mr END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE END"""
LOSS = "avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) AS logloss, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy"


def mid(groups: str = "") -> str:
    over = f"PARTITION BY {groups} " if groups else ""
    tied = ", ".join(x for x in (groups, "p") if x)
    return f"rank() OVER ({over}ORDER BY p) + (count(*) OVER (PARTITION BY {tied}) - 1) / 2.0::DOUBLE AS mr"


@query(f"WITH {SCORED}, k AS (SELECT *, {mid()} FROM scored) SELECT n, round(auc, 6) AS auc, round(brier, 6) AS brier, round(logloss, 6) AS logloss, round(accuracy, 6) AS accuracy FROM (SELECT count(*) AS n, {AUC} AS auc, {LOSS} FROM k)")
def auc_brier_logloss(spark, sf_dir):
    """Exact area under the curve, Brier score, log-loss and accuracy."""
    return rounded(ev.metrics(scored(spark, sf_dir), [], "y", "p"))


@query(f"""
WITH {SCORED}, ed AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS es FROM scored), b AS (SELECT s.*, CAST(len(list_filter(ed.es, lambda e: e < s.p)) AS INTEGER) AS bin FROM scored s, ed)
SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS rate FROM b GROUP BY bin""")
def calibration_bins(spark, sf_dir):
    """Mean score and observed rate in eight quantile bins."""
    return rounded(ev.calibration(scored(spark, sf_dir), "y", "p"))


@query(f"WITH {SCORED} SELECT count(*) FILTER (y = 0 AND p <= 0.5) AS tn, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn, count(*) FILTER (y = 1 AND p > 0.5) AS tp FROM scored")
def confusion(spark, sf_dir):
    return ev.confusion(scored(spark, sf_dir).withColumn("predicted", (F.col("p") > 0.5).cast("int")), "y", "predicted")


@query(f"""
WITH {SCORED}, bl AS (SELECT y, a.alpha, round(a.alpha * p + (1 - a.alpha) * (doc_id % 101) / 101.0::DOUBLE, 9) AS p FROM scored, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha) a), k AS (SELECT *, {mid("alpha")} FROM bl)
SELECT alpha, n, round(auc, 6) AS auc, round(brier, 6) AS brier, round(logloss, 6) AS logloss, round(accuracy, 6) AS accuracy FROM (SELECT alpha, count(*) AS n, {AUC} AS auc, {LOSS} FROM k GROUP BY alpha)""")
def blend_sweep(spark, sf_dir):
    """Metrics of blends of two scores."""
    other = scored(spark, sf_dir).withColumn("q", F.col("doc_id") % 101 / 101.0)
    return rounded(ev.metrics(ev.blends(other, "p", "q", "b").withColumn("b", F.round("b", 9)), ["alpha"], "y", "b"))


PICKS = f"""{READINGS}, c AS (SELECT race, cand, round(avg(pct), 9) AS score, round(max(pct), 9) AS other, CAST(sum(CASE WHEN pct > 60 THEN 1 ELSE 0 END) AS BIGINT) AS votes FROM readings GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY race ORDER BY votes DESC, cand) = 1 THEN 1 ELSE 0 END AS won, row_number() OVER (PARTITION BY race ORDER BY score DESC, cand) AS r1, row_number() OVER (PARTITION BY race ORDER BY other DESC, cand) AS r2 FROM c)"""


def contestants(spark, sf_dir):
    """Contestants with two scores and an outcome."""
    c = readings(spark, sf_dir).groupBy("race", "cand").agg(F.round(F.avg("pct"), 9).alias("score"), F.round(F.max("pct"), 9).alias("other"), F.count_if(F.col("pct") > 60).alias("votes"))
    top = win.winners(c, ["race"], "votes", "cand").select("race", F.col("cand").alias("winner"))
    return c.join(top, "race").withColumn("won", (F.col("cand") == F.col("winner")).cast("int"))


@query(f"""
WITH {PICKS} SELECT CAST(race % 3 AS INTEGER) AS office, count(*) FILTER (r1 = 1) AS n_races, round(avg(won) FILTER (r1 = 1), 6) AS accuracy, round(avg(won) FILTER (r2 = 1), 6) AS baseline, count(*) FILTER (r1 = 1 AND won = 0) AS wrong FROM w GROUP BY 1""")
def winner_pick_accuracy(spark, sf_dir):
    """Share of races whose pick won, by office, against a baseline's picks."""
    c = contestants(spark, sf_dir)
    office = (F.col("race") % 3).cast("int").alias("office")
    picked = win.winners(c, ["race"], "score", "cand").groupBy(office).agg(F.count("*").alias("n_races"), F.avg("won").alias("accuracy"), F.count_if(F.col("won") == 0).alias("wrong"))
    base = win.winners(c, ["race"], "other", "cand").groupBy(office).agg(F.avg("won").alias("baseline"))
    return rounded(picked.join(base, "office").select("office", "n_races", "accuracy", "baseline", "wrong"))


@query(f"""
WITH {PICKS}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY race)) / 3.0::DOUBLE) AS e FROM w), q AS (SELECT race, cand, won AS y, round(e / sum(e) OVER (PARTITION BY race), 9) AS p FROM e), k AS (SELECT *, {mid()} FROM q)
SELECT n, round(auc, 6) AS auc, round(brier, 6) AS brier, round(logloss, 6) AS logloss, round(accuracy, 6) AS accuracy FROM (SELECT count(*) AS n, {AUC} AS auc, {LOSS} FROM k)""")
def poll_only_baseline(spark, sf_dir):
    """Metrics of the softmax of mean readings."""
    c = contestants(spark, sf_dir).withColumn("p", F.round(win.softmax("score", "race"), 9))
    return rounded(ev.metrics(c, [], "won", "p"))


@query(f"""
WITH {BALLOTS}, c AS (SELECT year AS fold, race, party, round(avg(pct), 9) AS score, max(pct) AS best, count(*) AS n FROM ballots GROUP BY 1, 2, 3),
w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY fold, race ORDER BY n DESC, party) = 1 THEN 1 ELSE 0 END AS y, exp((score - max(score) OVER (PARTITION BY fold, race)) / 3.0::DOUBLE) AS e, row_number() OVER (PARTITION BY fold, race ORDER BY score DESC, party) AS r1, row_number() OVER (PARTITION BY fold, race ORDER BY best DESC, party) AS r2 FROM c),
q AS (SELECT *, round(e / sum(e) OVER (PARTITION BY fold, race), 9) AS p FROM w), k AS (SELECT *, {mid("fold")} FROM q),
f AS (SELECT fold, count(*) AS n, count(DISTINCT race) AS n_races, {AUC} AS auc, {LOSS}, avg(y) FILTER (r1 = 1) AS race_acc, avg(y) FILTER (r2 = 1) AS baseline_acc FROM k GROUP BY fold)
SELECT fold::VARCHAR AS fold, CAST(n AS DOUBLE) AS n, CAST(n_races AS DOUBLE) AS n_races, round(auc, 6) AS auc, round(brier, 6) AS brier, round(logloss, 6) AS logloss, round(accuracy, 6) AS accuracy, round(race_acc, 6) AS race_acc, round(baseline_acc, 6) AS baseline_acc FROM f
UNION ALL SELECT 'mean' AS fold, round(avg(n), 6) AS n, round(avg(n_races), 6) AS n_races, round(avg(auc), 6) AS auc, round(avg(brier), 6) AS brier, round(avg(logloss), 6) AS logloss, round(avg(accuracy), 6) AS accuracy, round(avg(race_acc), 6) AS race_acc, round(avg(baseline_acc), 6) AS baseline_acc FROM f""")
def loco_report(spark, sf_dir):
    """Baseline report: metrics of each year's softmax of its own mean readings, and their means. Nothing is fitted or held out."""
    c = ballots(spark, sf_dir).groupBy(F.col("year").alias("fold"), "race", "party").agg(F.round(F.avg("pct"), 9).alias("score"), F.max("pct").alias("best"), F.count("*").alias("votes"))
    c = c.withColumn("key", F.struct("fold", "race"))
    top = win.winners(c, ["fold", "race"], "votes", "party").select("fold", "race", F.col("party").alias("winner"))
    c = c.join(top, ["fold", "race"]).withColumn("y", (F.col("party") == F.col("winner")).cast("int")).withColumn("p", F.round(win.softmax("score", "key"), 9))
    picks = [win.winners(c, ["fold", "race"], by, "party").groupBy("fold").agg(F.avg("y").alias(name)) for by, name in (("score", "race_acc"), ("best", "baseline_acc"))]
    races = c.groupBy("fold").agg(F.countDistinct("race").alias("n_races"))
    by_fold = ev.metrics(c, ["fold"], "y", "p").join(races, "fold").join(picks[0], "fold").join(picks[1], "fold")
    names = ["n", "n_races", "auc", "brier", "logloss", "accuracy", "race_acc", "baseline_acc"]
    by_fold = by_fold.select(F.col("fold").cast("string"), *[F.col(n).cast("double") for n in names])
    return rounded(by_fold.unionByName(by_fold.agg(*[F.avg(n).alias(n) for n in names]).withColumn("fold", F.lit("mean"))))


def labelled(spark, sf_dir):
    """Every document with its features, fold by id and label (null without one)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("upper"), F.length(F.regexp_replace("text", "[^|!#$%&*]", "")).alias("marks"), F.size(F.split("text", "\n")).alias("lines"))
    fold = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int")
    return d.join(load(spark, sf_dir, "labels"), "doc_id", "left").withColumn("y", F.col("quality").cast("double")).withColumn("fold", fold)


FEATURES, GRID = ["n_chars", "upper", "marks", "lines"], {"maxDepth": [2, 3], "maxIter": [5], "stepSize": [0.3]}


@query()
def gbt_fit_predict(spark, sf_dir):
    """Boosted trees, folds by id, a grid of two points: for every document its score by the model of the other folds."""
    from psephon.plans.model import grid_search, out_of_fold

    rows = labelled(spark, sf_dir)
    best = grid_search(rows.filter("y IS NOT NULL"), FEATURES, "y", "fold", [0, 1, 2], GRID, n=2)
    return out_of_fold(rows, FEATURES, "y", "fold", [0, 1, 2], best).select("doc_id", "fold", "y", F.round("p", 9).alias("p"))


@query()
def gbt_importances(spark, sf_dir):
    """Ranked importances of boosted trees over all labelled documents, at the best of a grid of two points."""
    from psephon.plans.model import grid_search, importances

    rows = labelled(spark, sf_dir).filter("y IS NOT NULL")
    return importances(rows, FEATURES, "y", grid_search(rows, FEATURES, "y", "fold", [0, 1, 2], GRID, n=2))
