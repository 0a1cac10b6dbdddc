"""Hand-computed cases of the relational operators."""

import math

import pytest
from pyspark.sql import functions as F

from psephon.functions import catalogs
from psephon.functions import scalars as s
from psephon.operators import aggregates as agg
from psephon.operators import evaluation as ev
from psephon.operators import features as feat
from psephon.operators import relations as rel
from psephon.operators import series as ser
from psephon.operators import windows as win
from psephon.sources import fetching, files


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_person_key(spark):
    names = ["Robert P. Casey Jr.", "William Pounds IV", "Rayshawn D'Anthony Merrill", "Mikaela Shonnie Lutes-Burton", "JD Vance", "Cher", "  ", None, "José Peña", "Bjørn Ødegård", "Ĳsbrand", "Ｊane Ｄoe", "ﬁnn \U0001d400bel", "™"]
    assert column(spark, names, s.person_key) == ["casey r", "pounds w", "merrill r", "burton m", "vance j", "cher", None, None, "pena j", "degard b", "ijsbrand", "doe j", "abel f", "tm"]


def test_seats(spark):
    seats = ["6.0", "District 07", "Third Congressional District", "At-Large", "Class I", None, "Twenty-first District"]
    assert column(spark, seats, s.seat_number) == ["6", "7", "3", "1", None, None, "21"]
    assert column(spark, ["Twenty-first District", "Second"], lambda c: s.seat_number(c, longest=False)) == ["1", "2"]
    assert column(spark, ["6.0", "x", None, "007"], s.seat_digits) == ["6", "", "", "7"]


def test_words(spark):
    assert column(spark, [" dem ", "Republican", "LIB", None], s.party_group) == ["DEM", "REP", "OTH", "OTH"]
    assert column(spark, ["True", "False", "", "1", "yes", None, " true", "Y"], s.truthy) == [1, 0, 0, 1, 1, 0, 0, 1]
    assert [str(d) if d else None for d in column(spark, ["10/3/22", "10/3/2022", "2022-10-03", "junk", None], s.day)] == ["2022-10-03"] * 3 + [None] * 2
    assert column(spark, ["1.5", " 2 ", "x", None, ""], s.number) == [1.5, 2.0, None, None, None]
    df = spark.createDataFrame([(2022, "GA", "Senate", ""), (2022, "CA", "House", "7")], "y int, s string, o string, d string")
    assert [r[0] for r in df.select(s.joined_key(F.col("y").cast("string"), F.col("s"), F.col("o"), district=F.col("d"))).collect()] == ["2022_GA_Senate", "2022_CA_House-7"]
    a, b = s.code_parts(F.col("v"))
    df = spark.createDataFrame([("CA-07",), ("AK-AL",), ("X",)], "v string")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("CA", "7"), ("AK", "AL"), ("X", None)]
    assert column(spark, [-3, 0, 30, None], s.recency, "int") == [1.0, 1.0, 0.5, None]


@pytest.mark.parametrize(("rows", "want"), [([(50.0, 1.0), (None, 2.0), (44.0, None)], 48.0), ([(50.0, None), (44.0, None)], 47.0), ([(None, 1.0)], None), ([(3.0, 1.0), (5.0, 3.0)], 4.5)])
def test_weighted_mean(spark, rows, want):
    df = spark.createDataFrame(rows, "v double, w double")
    assert df.agg(agg.weighted_mean(F.col("v"), F.col("w"))).first()[0] == want


def test_slopes(spark):
    df = spark.createDataFrame([(1, 10.0, 50.0), (1, 20.0, 48.0), (1, 40.0, 44.0), (2, 10.0, 50.0), (2, 20.0, 48.0), (3, 5.0, 1.0), (3, 5.0, 2.0), (3, 5.0, 3.0)], "g int, d double, p double")
    got = {r.g: r.m for r in df.groupBy("g").agg(agg.slope(F.col("p"), -F.col("d"), least=3).alias("m")).collect()}
    assert got[1] == pytest.approx(0.2) and got[2] is None and got[3] is None


READINGS = [("r", "A", "2024-01-01", 50.0), ("r", "B", "2024-01-01", 45.0), ("r", "B", "2024-01-02", 51.0), ("r", "A", "2024-01-03", 44.0), ("r", "C", "2024-01-03", 10.0)]


def test_trajectory(spark):
    df = spark.createDataFrame(READINGS, "race string, cand string, d string, pct double").withColumn("d", F.to_date("d"))
    means = win.running_means(df, "race", "cand", "d", "pct")
    assert win.lead_changes(means, "race", "cand", "d").collect()[0].n_lead_changes == 1
    got = {r.cand: r for r in win.margin_trajectory(df, "race", "cand", "d", "pct").collect()}
    want = {"A": (2, -1, math.sqrt(6), -3), "B": (-2, -5, math.sqrt(6), 3), "C": (-38, -38, 0, 0)}
    for c, (mean, low, std, trend) in want.items():
        assert (got[c].avg_margin, got[c].min_margin, got[c].margin_volatility, got[c].margin_trend) == pytest.approx((mean, low, std, trend))


def test_lead_and_softmax(spark):
    df = spark.createDataFrame([("r", "a", 52.0), ("r", "b", 44.0), ("r", "c", 2.0), ("q", "a", 9.0), ("s", "a", 48.0), ("s", "b", 45.0)], "race string, cand string, w double")
    got = {(r.race, r.cand): r.lead for r in win.lead(df, "race", "w").collect()}
    assert got == {("r", "a"): 8, ("r", "b"): 0, ("r", "c"): -42, ("q", "a"): 0, ("s", "a"): 3, ("s", "b"): 0}
    p = {(r.race, r.cand): r.p for r in df.withColumn("p", win.softmax("w", "race")).collect()}
    assert p["s", "a"] == pytest.approx(0.731059, abs=1e-6) and p["q", "a"] == 1


def test_house_effect(spark):
    rows = [("r", 1, "X", "DEM", 50.0), ("r", 1, "X", "REP", 44.0), ("r", 2, "Y", "DEM", 46.0), ("r", 2, "Y", "REP", 46.0), ("q", 3, "Z", "DEM", 40.0)]
    df = spark.createDataFrame(rows, "race string, poll int, house string, party string, pct double")
    assert {r.house: r.house_effect for r in agg.house_effect(df, "race", "poll", "house", "party", "pct").collect()} == {"X": 3.0, "Y": -3.0, "Z": None}


def test_folds_do_not_leak(spark):
    rows = [(y, "r", y * 10 + k, h, p, 40.0 + k + i) for y in (1, 2, 3) for k, h in enumerate("XY") for i, p in enumerate(("DEM", "REP"))]
    schema = "year int, race string, poll int, house string, party string, pct double"
    effect = lambda rs: {(r.fold, r.house): r.house_effect for r in agg.house_effect(ev.folds(spark.createDataFrame(rs, schema), "year", [1, 2, 3]), "race", "poll", "house", "party", "pct", ("fold",)).collect()}
    changed = [(*r[:5], r[5] + (90 if r[0] == 2 and r[3] == "X" and r[4] == "DEM" else 0)) for r in rows]
    before, after = effect(rows), effect(changed)
    summed = {(r.fold, r.house): r.house_effect for r in ev.house_effects_by_fold(spark.createDataFrame(changed, schema), "year", [1, 2, 3], "race", "poll", "house", "party", "pct").collect()}
    assert summed == pytest.approx(after)
    assert all(before[k] == after[k] for k in before if k[0] == 2) and any(before[k] != after[k] for k in before)


def test_latest_before(spark):
    past = spark.createDataFrame([("s", 2014, 5.0), ("s", 2016, -2.0), ("s", 2017, 9.0), ("s", 2018, None)], "seat string, year int, m double")
    probe = spark.createDataFrame([("s", 2020), ("s", 2024), ("s", 2026)], "seat string, year int")
    assert {r.year: r.m for r in rel.latest_before(probe, past, ["seat"], "year", "m").collect()} == {2020: -2.0, 2024: -2.0, 2026: None}


def test_auc_and_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, p double")
    assert ev.auc(df, [], "y", "p").first()[0] == 0.875
    assert ev.auc(df.filter("y = 1"), [], "y", "p").first()[0] is None
    assert [tuple(r) for r in ev.confusion(df.withColumn("c", (F.col("p") > 0.5).cast("int")), "y", "c").collect()] == [(1, 1, 0, 2)]
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 2, 9, 9, 4]], "p double")
    assert [r.edge for r in ev.quantiles(values, "p", [0.0, 0.25, 0.5, 0.9, 1.0]).orderBy("k").collect()] == pytest.approx([1, 1.5, 4, 9, 9])


def test_series(spark):
    months = [(f"{2015 + k // 12}-{k % 12 + 1:02d}-01", "m", 100.0 + k) for k in range(48)]
    df = spark.createDataFrame(months, "d string, metric string, v double").withColumn("d", F.to_date("d"))
    cycles = spark.createDataFrame([(2018, "2016-11-01", "2018-11-01"), (2030, "2028-11-01", "2030-11-01")], "cycle int, a string, b string").select("cycle", F.to_date("a").alias("start"), F.to_date("b").alias("eve"))
    rows = ser.cycle_rows(df, cycles, "d", "metric", "v")
    assert rows.agg(F.min("d"), F.max("d"), F.count("*")).first()[2] == 24
    r = ser.cycle_stats(rows, "metric", "v").collect()[0]
    assert (r.eve, r.trend, r.last12_delta) == (146.0, pytest.approx(1.0), 12.0)
    short = ser.cycle_stats(rows.filter("back = 1"), "metric", "v").collect()[0]
    assert (short.trend, short.last12_delta, short["std"]) == (0.0, 0.0, 0.0)
    yoy = df.withColumn("y", ser.change_over("d", ["metric"], "v")).orderBy("d").collect()
    assert yoy[11].y is None and yoy[12].y == pytest.approx(12.0)
    recent = ser.recency_stats(rows, "metric", "v").collect()[0]
    assert recent.avg_3mo == 145.0 and recent.trend_6mo == pytest.approx(1.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Poll_ID,Pct,extra\n07,NA,1\n8,45.5,\n")
    df = files.read_text_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("07", None, "1"), ("8", "45.5", None)]
    aliases = {"poll": ("poll", "poll_id"), "pct": ("pct",), "state": ("state",)}
    assert [tuple(r) for r in rel.resolved(df, aliases, ("poll",)).collect()] == [("07", None, None), ("8", "45.5", None)]
    assert rel.resolved(df, aliases, ("state",)) is None
    assert files.looks_like_markup("  <!DOCTYPE html>") and not files.looks_like_markup("a,b")
    body = '{"series":{"docs":[{"period":["2020-01","2020-02-05","x"],"value":[3.5,"NA","7"]}]}}'
    got = files.payload_rows(spark.createDataFrame([(body,), ("{}",)], "j string"), "j").withColumn("d", files.period_start(F.col("period"))).collect()
    assert [(str(r.d), r.value) for r in got] == [("2020-01-01", 3.5), ("None", 7.0)]


def test_first_rows_and_lookup(spark):
    df = spark.createDataFrame([("k", None, 1, 5), ("k", None, 0, 6), ("k", "x", 0, 7)], "a string, b string, src int, v int")
    assert {r.v for r in rel.first_rows(df, ["a", "b", "gone"], [F.col("src"), F.col("v")]).collect()} == {6, 7}
    dim = spark.createDataFrame([("X", 3.0), ("Z", None)], "h string, dev double")
    got = {r.h: r.dev for r in rel.lookup(spark.createDataFrame([("X",), ("Y",), ("Z",)], "h string"), dim, ["h"], "dev", F.lit(0.0)).collect()}
    assert got == {"X": 3.0, "Y": 0.0, "Z": None}


def test_streaming(spark, tmp_path):
    from psephon.streaming.running import windowed_means

    spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 3.0), ("2024-01-09 00:00:00", "a", 9.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = windowed_means(stream, "t", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start)[:10], r["mean"], r.n) for r in spark.table("means").collect()) == [("2024-01-01", 2.0, 2), ("2024-01-09", 9.0, 1)]


def test_skewed_scores_are_placed_exactly(spark):
    values = [1.0 - 2.0 ** -(k % 40) for k in range(400)] + [0.5] * 50
    df = spark.createDataFrame([(v, k % 2) for k, v in enumerate(values)], "p double, y int")
    got = {r.p: r.below_n for r in ev.placed(df, [], "p", {"n": F.lit(1)}).collect()}
    assert got == {v: sum(w < v for w in values) for v in set(values)}


def test_local_copies(spark, tmp_path):
    pages = {"a": b"<!DOCTYPE html>" + b"x" * 3000, "b": b"short", "c": b"date,value\n" * 300}

    def get(url):
        if url not in pages:
            raise OSError("unreachable")
        return pages[url]

    folder = str(tmp_path / "data")
    assert fetching.local_copy("f.csv", ["gone", "a", "b"], folder, least_kb=1, get=get) is None
    path = fetching.local_copy("f.csv", ["gone", "a", "b", "c"], folder, least_kb=1, get=get)
    assert open(path, "rb").read() == pages["c"]
    assert fetching.local_copy("f.csv", [], folder) == path and fetching.local_copy("f.csv", [], folder, force=True) is None
    assert fetching.local_catalog({"House": {"f.csv": [], "g.csv": ["a"]}, "Senate": {"h.csv": ["c"]}}, folder, least_kb=1, get=get) == {"House": [path], "Senate": [f"{folder}/h.csv"]}
    assert fetching.by_template("https://archive.example/{path}", "x/y.csv") == "https://archive.example/x/y.csv"
    with pytest.raises(FileNotFoundError, match="write the monthly series first"):
        fetching.series_table(spark, str(tmp_path / "none.csv"))
    one = spark.createDataFrame([(1,)], "v int")
    read = {"x": lambda: one, "y": lambda: one.limit(0), "z": lambda: 1 / 0}
    both, skipped = fetching.each_series(["x", "y", "z"], lambda n: read[n]())
    assert both.count() == 1 and skipped == {"y": "no data", "z": "division by zero"}


def test_stage_and_columns(spark):
    df = spark.createDataFrame([("General", 1), ("primary", 2), (None, 3)], "Stage string, v int")
    assert [r.v for r in rel.containing(df, "stage", "general").collect()] == [1]
    assert rel.containing(df.drop("Stage"), "stage", "general").count() == 3
    assert rel.peek(df, 2)[0] == ["Stage", "v"] and rel.peek(df, 2)[1].count() == 2
    # A raw column under a logical name that another column fills is dropped.
    twice = spark.createDataFrame([("x", "y")], "candidate_name string, candidate string")
    assert [tuple(r) for r in rel.resolved(twice, {"candidate": ("candidate_name", "candidate")}).collect()] == [("x",)]


def test_macro_years_must_be_known(spark):
    cand, macro = spark.createDataFrame([(2018, "a"), (2020, "b")], "year int, c string"), spark.createDataFrame([(2018, 1.5)], "cycle int, m double")
    assert [tuple(r) for r in feat.with_macro(cand.filter("year = 2018"), macro).collect()] == [(2018, "a", 1.5)]
    with pytest.raises(Exception, match="no macro figures for 2020"):
        feat.with_macro(cand, macro).collect()


def test_catalogs():
    assert len(catalogs.STATES) == 51 and len(catalogs.approval_rows()) == 108 and len(feat.FEATURES) == 39
