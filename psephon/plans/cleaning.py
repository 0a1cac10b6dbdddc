"""Queries: scans, cleaning, keys, unions, joins and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psephon.functions import scalars as s
from psephon.operators import aggregates as agg
from psephon.operators import relations as rel
from psephon.plans.base import BALLOTS, READINGS, ballots, load, query, readings, rounded
from psephon.sources import files


@query("""
SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS num, TRY_CAST(c_name AS DOUBLE) AS bad, o.o_orderkey,
  o.o_orderdate::DATE AS d1, CASE WHEN year(o.o_orderdate) < 2000 THEN NULL ELSE o.o_orderdate::DATE END AS d2, CAST(date_diff('day', o.o_orderdate::DATE, DATE '2001-11-01') AS INTEGER) AS days
FROM customer JOIN orders o ON c_custkey = o.o_custkey""")
def coerce_dates_numbers(spark, sf_dir):
    """Numbers and dates out of text; what is none becomes null."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    text1 = F.date_format(day, "M/d/yyyy")
    text2 = F.when(F.year(day) < 2000, F.lit("junk")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    joined = c.select("c_custkey", "c_name").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", s.number(F.substring("c_name", 10, 30)).alias("num"), s.number(F.col("c_name")).alias("bad"), "o_orderkey", s.day(text1).alias("d1"), s.day(text2).alias("d2"), F.datediff(F.lit("2001-11-01").cast("date"), s.day(text1)).alias("days"))


FLAGS = "CASE l_linestatus WHEN 'O' THEN 'Yes' WHEN 'F' THEN 'False' END"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lower({FLAGS}) IN ('true','1','t','yes','y') THEN 1 ELSE 0 END AS won,
  CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END AS close
FROM lineitem""")
def truthy_parse(spark, sf_dir):
    """Spellings of true, and a threshold flag that null does not pass."""
    spelled = F.when(F.col("l_linestatus") == "O", "Yes").when(F.col("l_linestatus") == "F", "False")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.truthy(spelled).alias("won"), s.flag(F.col("l_quantity") < 10).alias("close"))


@query(f"""
WITH {BALLOTS} SELECT race, year, party, CASE party WHEN 'DEM' THEN 1 WHEN 'REP' THEN -1 ELSE 0 END AS sign, CASE WHEN party = 'DEM' THEN 1 ELSE 0 END AS is_dem,
  CASE WHEN party = 'REP' THEN 1 ELSE 0 END AS is_rep, CASE WHEN year % 2 = 0 THEN 1 ELSE 0 END AS is_even, count(*) AS n,
  round(sum(pct * CASE party WHEN 'DEM' THEN 1 WHEN 'REP' THEN -1 ELSE 0 END), 6) + 0.0::DOUBLE AS signed FROM ballots GROUP BY race, year, party""")
def sign_onehot(spark, sf_dir):
    """Signs and one-hot flags of parties."""
    b = ballots(spark, sf_dir).withColumn("sign", s.sign(F.col("party")))
    out = b.groupBy("race", "year", "party", "sign").agg(F.count("*").alias("n"), F.sum(F.col("pct") * F.col("sign")).alias("signed"))
    return rounded(out.select("race", "year", "party", "sign", s.flag(F.col("party") == "DEM").alias("is_dem"), s.flag(F.col("party") == "REP").alias("is_rep"), s.flag(F.col("year") % 2 == 0).alias("is_even"), "n", "signed"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, year(l_shipdate)::VARCHAR || '_' || l_returnflag || '_' || l_linestatus || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '-' || (l_suppkey % 3)::VARCHAR END AS race_id
FROM lineitem""")
def composite_key(spark, sf_dir):
    """Key of year, state and office, with a district where there is one."""
    district = F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 3).cast("string"))
    key = s.joined_key(F.year("l_shipdate").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), district=district)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("race_id"))


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_counts(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, count(l_quantity) AS known_l_quantity, min(l_shipdate::DATE) AS min_day, max(l_shipdate::DATE) AS max_day, count(l_shipdate) AS known_day FROM lineitem GROUP BY 1")
def group_profile(spark, sf_dir):
    """Counts and ranges by group."""
    return agg.profile(load(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date")), "l_returnflag", ["l_quantity", "day"])


NAME = "array_to_string(list_filter(string_split_regex(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z]+'), lambda w: w <> '' AND w NOT IN ('jr','sr','ii','iii','iv')), ' ')"


@query(f"""
WITH w AS (SELECT doc_id, string_split(nullif({NAME}, ''), ' ') AS ws FROM documents)
SELECT doc_id, CASE WHEN ws IS NULL THEN NULL WHEN ws[1] = ws[-1] THEN ws[1] ELSE ws[-1] || ' ' || substr(ws[1], 1, 1) END AS cand_key FROM w""")
def name_key(spark, sf_dir):
    """Last name and first initial of whole texts, however long."""
    return load(spark, sf_dir, "documents").select("doc_id", s.person_key(F.col("text")).alias("cand_key"))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'At-Large' WHEN 2 THEN 'Twenty-first District' WHEN 3 THEN 'Class I' END AS v FROM customer)
SELECT c_custkey, v AS seat, CASE WHEN regexp_matches(v, '\\d') THEN CAST(CAST(regexp_extract(v, '(\\d+)', 1) AS BIGINT) AS VARCHAR) WHEN v = 'At-Large' THEN '1' WHEN v LIKE 'Twenty%' THEN '21' END AS district,
  coalesce(CASE WHEN regexp_matches(v, '\\d') THEN CAST(CAST(regexp_extract(v, '(\\d+)', 1) AS BIGINT) AS VARCHAR) END, '') AS digits FROM t""")
def district_parse(spark, sf_dir):
    """District numbers out of seat names."""
    k = F.col("c_custkey") % 5
    seat = F.when(k == 0, F.col("c_name")).when(k == 1, "At-Large").when(k == 2, "Twenty-first District").when(k == 3, "Class I")
    return load(spark, sf_dir, "customer").select("c_custkey", seat.alias("seat")).withColumn("district", s.seat_number(F.col("seat"))).withColumn("digits", s.seat_digits(F.col("seat")))


@query("""
SELECT c_custkey, CASE WHEN starts_with(upper(trim(c_mktsegment)), 'BUI') THEN 'BUI' WHEN starts_with(upper(trim(c_mktsegment)), 'MAC') THEN 'MAC' ELSE 'OTH' END AS party,
  CASE WHEN contains(lower(c_mktsegment), 'house') THEN 'House' WHEN contains(lower(c_mktsegment), 'auto') THEN 'Senate' END AS office FROM customer""")
def party_office_map(spark, sf_dir):
    """Groups by prefix and offices by the first name that is contained."""
    seg = F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select("c_custkey", s.party_group(seg, groups=("BUI", "MAC")).alias("party"), s.first_contained(seg, {"house": "House", "auto": "Senate"}).alias("office"))


@query("""
WITH p AS (SELECT event_id, ts::DATE AS d, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, k, strftime(d, '%Y-%m') AS period, CAST(k AS DOUBLE) AS value FROM p UNION ALL SELECT event_id, k, '2024-02' AS period, k + 0.5 AS value FROM p WHERE k % 2 = 0""")
def json_expand(spark, sf_dir):
    """Nested arrays of periods and values to rows; values that are no numbers go."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(F.lit('{"series":{"docs":[{"period":["'), F.date_format("ts", "yyyy-MM"), F.lit('","2024-02"],"value":['), k.cast("string"), F.lit(","), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise('"NA"'), F.lit("]}]}}"))
    return files.payload_rows(load(spark, sf_dir, "events").select("event_id", k.alias("k"), body.alias("body")), "body", "event_id", "k")


@query("""
WITH u AS (SELECT user_id, event_type, value, NULL::VARCHAR AS note, 0 AS src, event_id FROM events UNION ALL SELECT user_id, event_type, value, 'old' AS note, 1 AS src, event_id FROM events)
SELECT user_id, event_type, value, note, src, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY src, event_id) AS rn FROM u) WHERE rn = 1""")
def union_dedupe_first(spark, sf_dir):
    """Two sources, each the whole table, united by name; per key the first row of the first source stays."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    both = rel.union_all([e.withColumn("src", F.lit(0)), e.withColumns({"src": F.lit(1), "note": F.lit("old")})])
    return rel.first_rows(both, ["user_id", "event_type", "absent"], [F.col("src"), F.col("event_id")])


@query("""
SELECT d.source, d.lang, count(*) AS n, sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS matched, round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS match_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def left_join_indicator(spark, sf_dir):
    """Left join with a match flag, and match rates."""
    joined = rel.with_match(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), load(spark, sf_dir, "labels"), ["doc_id"], "has_result")
    return rounded(joined.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("has_result").alias("matched"), F.avg("has_result").alias("match_rate")))


@query("""
SELECT c.c_custkey, CASE WHEN c.c_mktsegment = 'BUILDING' THEN n.n_nationkey * 1.5::DOUBLE ELSE r.r_regionkey * 10.0::DOUBLE END AS lean
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def conditional_lookup(spark, sf_dir):
    """One lookup in a dimension that holds district and state rows: district rows for some, state rows for the rest."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    dim = rel.union_all([
        n.select(F.col("n_regionkey").alias("state"), F.col("n_nationkey").cast("string").alias("district"), (F.col("n_nationkey") * F.lit(1.5)).alias("lean")),
        r.select(F.col("r_regionkey").alias("state"), F.lit("").alias("district"), (F.col("r_regionkey") * F.lit(10.0)).alias("lean")),
    ])
    c = rel.lookup(load(spark, sf_dir, "customer").withColumn("n_nationkey", F.col("c_nationkey")), n, ["n_nationkey"], "n_regionkey")
    c = c.select("c_custkey", F.col("n_regionkey").alias("state"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("n_nationkey").cast("string")).otherwise("").alias("district"))
    return rel.lookup(c, dim, ["state", "district"], "lean").select("c_custkey", "lean")


@query(f"""
WITH {BALLOTS}, p AS (SELECT race, year, max(CASE WHEN party = 'DEM' THEN pct END) AS a, max(CASE WHEN party = 'REP' THEN pct END) AS b FROM ballots WHERE party IN ('DEM', 'REP') AND (race + year) % 3 <> 0 GROUP BY 1, 2),
h AS (SELECT race, year, coalesce(a, 0) - coalesce(b, 0) AS m FROM p), probe AS (SELECT DISTINCT race, year FROM ballots)
SELECT q.race, q.year, (SELECT h.m FROM h WHERE h.race = q.race AND h.year IN (q.year - 2, q.year - 4, q.year - 6, q.year - 8) ORDER BY h.year DESC LIMIT 1) AS prior FROM probe q""")
def asof_bounded(spark, sf_dir):
    """Margin of the nearest of four earlier cycles."""
    b = ballots(spark, sf_dir)
    past = agg.two_parties(b.filter((F.col("race") + F.col("year")) % 3 != 0), ["race", "year"], "party", "pct")
    past = past.select("race", "year", (F.coalesce("DEM", F.lit(0.0)) - F.coalesce("REP", F.lit(0.0))).alias("prior"))
    return rel.latest_before(b.select("race", "year").distinct(), past, ["race"], "year", "prior")


@query(f"""
WITH {BALLOTS}, d AS (SELECT house, CASE WHEN house % 4 = 0 THEN NULL ELSE round(avg(pct), 6) END AS dev FROM ballots WHERE house <= 9 GROUP BY house)
SELECT b.race, b.house, count(*) AS n, CASE WHEN b.house > 9 THEN 0.0 ELSE max(d.dev) END AS dev FROM ballots b LEFT JOIN d ON b.house = d.house GROUP BY b.race, b.house""")
def lookup_defaults(spark, sf_dir):
    """Unknown houses get 0, known houses without a figure null."""
    b = ballots(spark, sf_dir)
    dim = rounded(b.filter("house <= 9").groupBy("house").agg(F.avg("pct").alias("dev"))).withColumn("dev", F.when(F.col("house") % 4 != 0, F.col("dev")))
    return rel.lookup(b.groupBy("race", "house").agg(F.count("*").alias("n")), dim, ["house"], "dev", F.lit(0.0))


@query("""
SELECT p_partkey, split_part(p_brand, '#', 1) AS brand, CAST(TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS VARCHAR) AS code FROM part""")
def code_split(spark, sf_dir):
    """Codes cut in two, numbers normalised."""
    head, tail = s.code_parts(F.col("p_brand"), "#")
    return load(spark, sf_dir, "part").select("p_partkey", head.alias("brand"), tail.alias("code"))


@query("""
SELECT n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'N0' WHEN 'NATION_1' THEN 'N1' WHEN 'NATION_2' THEN 'N2' ELSE n_name END AS code,
  CASE n_nationkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'CA' ELSE 'Guam' END AS state FROM nation""")
def state_lookup(spark, sf_dir):
    """Names to codes; two letters are codes already, the unknown passes through."""
    k = F.col("n_nationkey") % 3
    spelled = F.when(k == 0, " ca ").when(k == 1, "California").otherwise("Guam")
    return load(spark, sf_dir, "nation").select("n_nationkey", s.translated(F.col("n_name"), {"NATION_0": "N0", "NATION_1": "N1", "NATION_2": "N2"}).alias("code"), s.state_code(spelled, {"California": "CA"}).alias("state"))


@query(f"""
WITH {READINGS}, n AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE d END AS nd FROM readings)
SELECT race, cand, arg_min(pct, k) AS first_pct, arg_max(pct, k) AS last_pct, count(nd) AS dated FROM (SELECT *, row_number() OVER (PARTITION BY race, cand ORDER BY nd NULLS LAST, event_id) AS k FROM n) GROUP BY race, cand""")
def first_last_by_date(spark, sf_dir):
    """First and last reading by date; undated ones come last."""
    r = readings(spark, sf_dir).withColumn("nd", F.when(F.col("event_id") % 7 != 0, F.col("d")))
    pick = lambda last: agg.by_date(F.col("pct"), F.col("nd"), F.col("event_id"), last=last)
    return r.groupBy("race", "cand").agg(pick(False).alias("first_pct"), pick(True).alias("last_pct"), F.count("nd").alias("dated"))


@query(f"""
WITH {BALLOTS}, dim(year, pres, natl) AS (VALUES (1995, 'DEM', 2.5), (1996, 'DEM', NULL), (1997, 'REP', -1.0), (1998, 'REP', 0.5))
SELECT b.race, b.party, b.year, count(*) AS n, max(CASE WHEN b.party = d.pres THEN 1 ELSE 0 END) AS is_pres, max(CASE b.party WHEN 'DEM' THEN 1 WHEN 'REP' THEN -1 ELSE 0 END * d.natl::DOUBLE) + 0.0::DOUBLE AS natl
FROM ballots b LEFT JOIN dim d ON b.year = d.year GROUP BY 1, 2, 3""")
def broadcast_dims(spark, sf_dir):
    """Figures of a cycle from a literal relation."""
    dim = files.literal(spark, [(1995, "DEM", 2.5), (1996, "DEM", None), (1997, "REP", -1.0), (1998, "REP", 0.5)], "year int, pres string, natl double")
    rows = ballots(spark, sf_dir).groupBy("race", "party", "year").agg(F.count("*").alias("n")).join(F.broadcast(dim), "year", "left")
    return rows.select("race", "party", "year", "n", s.flag(F.col("party") == F.col("pres")).alias("is_pres"), (s.sign(F.col("party")) * F.col("natl") + F.lit(0.0)).alias("natl"))


@query("""
SELECT source, count(*) AS n, 'without' AS kind FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source UNION ALL
SELECT source, count(*) AS n, 'with' AS kind FROM documents SEMI JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') GROUP BY source""")
def semi_unmatched(spark, sf_dir):
    """Rows without a partner, and rows of a short list of languages with one."""
    d, labels = load(spark, sf_dir, "documents").select("doc_id", "source", "lang"), load(spark, sf_dir, "labels")
    parts = [(rel.matching(d, labels, ["doc_id"], False), "without"), (rel.matching(d.filter(F.col("lang").isin("en", "fr")), labels, ["doc_id"]), "with")]
    return rel.union_all([p.groupBy("source").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for p, k in parts])


ORDERED = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax"


@query(f"""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {ORDERED}) AS rn FROM lineitem)
SELECT l_suppkey, l_returnflag, l_quantity, max(l_quantity) OVER (PARTITION BY l_suppkey) AS race_best FROM u WHERE rn = 1""")
def results_dedupe_max(spark, sf_dir):
    """First row for each key under a total order, with the race's greatest value."""
    order = [F.col(c) for c in ORDERED.split(", ")]
    first = rel.first_rows(load(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], order)
    return first.select("l_suppkey", "l_returnflag", "l_quantity", F.max("l_quantity").over(Window.partitionBy("l_suppkey")).alias("race_best"))


@query("""
SELECT p_partkey, upper(p_type) AS kind, p_size, round(sqrt(p_retailprice), 6) AS root, 'part' AS office FROM part
WHERE p_size BETWEEN 5 AND 40 AND contains(lower(p_type), 's') AND lower(trim(p_brand)) NOT IN ('brand#1', 'brand#2') AND regexp_matches(p_name, '^(large|small) ') AND p_retailprice IS NOT NULL""")
def predicate_chain(spark, sf_dir):
    """Range, containment, junk list, pattern and null filters, pushed down where the file format can."""
    p = load(spark, sf_dir, "part")
    kept = p.filter(F.col("p_size").between(5, 40) & F.coalesce(F.lower("p_type"), F.lit("")).contains("s") & ~s.is_junk(F.col("p_brand"), ("brand#1", "brand#2")) & F.col("p_name").rlike("^(large|small) ")).dropna(subset=["p_retailprice"])
    return rounded(kept.select("p_partkey", F.upper("p_type").alias("kind"), "p_size", F.sqrt("p_retailprice").alias("root"), F.lit("part").alias("office")))


@query(f"""
WITH {READINGS} SELECT race, cand, min(days) AS min_days, round(1 / (1 + greatest(min(days), 0) / 30.0::DOUBLE), 6) AS recency, round(greatest(min(pct), 20.0), 6) AS floor_pct, make_date(2024, 11, 1) AS eve,
  CAST(round_even(avg(days), 0) AS DOUBLE) AS mean_days FROM readings GROUP BY race, cand""")
def recency_gap(spark, sf_dir):
    """Recency factor, lower clip, election eve, half-even rounding."""
    g = readings(spark, sf_dir).groupBy("race", "cand").agg(F.min("days").alias("min_days"), F.min("pct").alias("low"), F.avg("days").alias("mean"))
    return rounded(g.select("race", "cand", "min_days", s.recency(F.col("min_days")).alias("recency"), s.at_least(F.col("low"), 20.0).alias("floor_pct"), s.eve(F.lit(2024)).alias("eve"), F.bround("mean", 0).alias("mean_days")))


@query(f"""
WITH {BALLOTS}, inc AS (SELECT race, year, house, party AS inc_party FROM (SELECT *, row_number() OVER (PARTITION BY race, year, house ORDER BY poll DESC, pct DESC, party DESC) AS rn FROM ballots) WHERE rn = 1)
SELECT b.race, b.year, b.house, b.party, count(*) AS n, max(CASE WHEN b.party = i.inc_party THEN 1 ELSE 0 END) AS is_incumbent, max(CASE WHEN i.inc_party IN ('DEM', 'REP') THEN 1 ELSE 0 END) AS is_inc_party_race
FROM ballots b LEFT JOIN inc i ON b.race = i.race AND b.year + 1 = i.year AND b.house = i.house GROUP BY 1, 2, 3, 4""")
def incumbent_flag(spark, sf_dir):
    """Last row for each seat as its holder, looked up by several keys."""
    b = ballots(spark, sf_dir)
    holders = rel.last_rows(b, ["race", "year", "house"], [F.col("poll"), F.col("pct"), F.col("party")]).select("race", (F.col("year") - 1).alias("year"), "house", F.col("party").alias("inc_party"))
    rows = rel.lookup(b.groupBy("race", "year", "house", "party").agg(F.count("*").alias("n")), holders, ["race", "year", "house"], "inc_party")
    return rows.withColumns({"is_incumbent": s.flag(F.col("party") == F.col("inc_party")), "is_inc_party_race": s.flag(F.col("inc_party").isin("DEM", "REP"))}).drop("inc_party")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment, NULL::VARCHAR AS absent FROM customer")
def csv_roundtrip(spark, sf_dir):
    """Written as delimited text, read as text, columns resolved by alias, cast to a fixed schema."""
    c = load(spark, sf_dir, "customer")
    path = f"{files.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_text_table(c.withColumnRenamed("c_name", "Candidate_Name"), path)
    back = rel.resolved(files.read_text_table(spark, path), {"c_custkey": ("id", "c_custkey"), "c_name": ("candidate_name", "name"), "c_acctbal": ("c_acctbal",), "c_mktsegment": ("segment", "c_mktsegment"), "absent": ("nowhere",)}, ("c_custkey", "c_name"))
    return rel.typed(back, T.StructType().add("c_custkey", "long").add("c_name", "string").add("c_acctbal", "double").add("c_mktsegment", "string").add("absent", "string"))


@query("""
WITH dim(year, metric, note) AS (VALUES (1995, 'approval', 'a'), (1996, 'cpi', 'b'), (1997, 'gas', 'c')) SELECT d.year, d.metric, d.note, count(*) AS n FROM orders o JOIN dim d ON year(o.o_orderdate) = d.year GROUP BY 1, 2, 3""")
def literal_dims(spark, sf_dir):
    """Constant catalogs as relations."""
    dim = files.literal(spark, [(1995, "approval", "a"), (1996, "cpi", "b"), (1997, "gas", "c")], "year int, metric string, note string")
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).join(F.broadcast(dim), "year").select("year", "metric", "note", "n")


@query("""
WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), t AS (SELECT count(*) AS n, count(doc_id) AS a, count(lang) AS b, count(quality) AS c, count(toxic) AS d FROM j),
u AS (SELECT n, unnest(['doc_id', 'lang', 'quality', 'toxic']) AS column_name, n - unnest([a, b, c, d]) AS n_missing FROM t) SELECT column_name, n_missing, round(n_missing * 100.0::DOUBLE / n, 6) AS pct_missing FROM u""")
def missingness_profile(spark, sf_dir):
    """Nulls of every column after a left join."""
    joined = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(agg.missingness(joined))
