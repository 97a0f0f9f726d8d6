from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from caseweave.functions import fixed_values as fx, geo, keys, rounding, temporal, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_python_round_matches_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.5, 1.5, 2.5, -0.5, 0.0, 1e15 + 0.3, 123456.785]
    values += [rng.uniform(-1000, 1000) for _ in range(500)] + [rng.randrange(-10**6, 10**6) / 1000 for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 6):
        got = [r[0] for r in df.select(rounding.python_round("v", digits)).collect()]
        assert got == [float(round(v, digits)) for v in values]
    assert one(spark, rounding.python_round(F.lit(None).cast("double"), 2)) is None


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_haversine(spark):
    assert abs(one(spark, geo.haversine_km(F.lit(12.97), F.lit(77.59), F.lit(13.08), F.lit(80.27))) - _km(12.97, 77.59, 13.08, 80.27)) < 1e-9


def test_point_lies_in_nearest_cell(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(12, 18), rng.uniform(74, 78)) for _ in range(400)]
    df = spark.createDataFrame(pts, "lat double, lon double").withColumn("cell", geo.hex_cell("lat", "lon", 6))
    rows = df.withColumn("c", geo.hex_centre("cell")).select("lat", "lon", "cell", "c.lat", "c.lon").collect()
    k = math.cos(math.radians(geo.REFERENCE_LATITUDE))
    centres = {r[2]: (r[3], r[4]) for r in rows}

    def flat(a, b):
        return math.hypot(a[0] - b[0], (a[1] - b[1]) * k)

    for lat, lon, cell, *_ in rows:
        own = flat((lat, lon), centres[cell])
        assert all(own <= flat((lat, lon), c) + 1e-9 for c in centres.values())


def test_missing_or_wild_coordinates_have_no_cell(spark):
    assert one(spark, geo.hex_cell(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert one(spark, geo.hex_cell(F.lit(95.0), F.lit(1.0))) is None


def test_tod_buckets(spark):
    got = [r[0] for r in spark.range(24).select(temporal.tod_bucket("id")).collect()]
    assert got == ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 5 + ["evening"] * 4 + ["late_evening"] * 3
    assert one(spark, temporal.tod_bucket(temporal.hour_or_zero(F.lit(None).cast("timestamp")))) == "night"


def test_weekday_monday_is_zero(spark):
    assert one(spark, temporal.weekday_or_zero(F.lit("2024-01-01").cast("date"))) == 0


def test_cues_match_as_substrings_in_order(spark):
    label = lambda t: one(spark, text.cue_label(F.lit(t), fx.VEHICLE_CUES))
    assert label("He CARRIED a bag") == "car"
    assert label("a bike and a car") == "motorcycle"
    assert label("ದ್ವಿಚಕ್ರ ವಾಹನ") == "motorcycle"
    assert label("on foot") is None
    assert one(spark, text.cue_label(F.lit(None).cast("string"), fx.VEHICLE_CUES)) is None


def test_shared_phrases(spark):
    got = one(spark, text.shared_phrases(F.lit("Near the old temple, gold chain snatched"), F.lit("gold chain snatched near the bus stand")))
    assert got == ["chain snatched", "gold chain"]
    assert one(spark, text.shared_phrases(F.lit("word"), F.lit(None).cast("string"))) == []


def test_grounding(spark):
    check = lambda a, v, q: one(spark, text.grounded(F.lit(a), F.lit(v), F.lit(q)))
    assert check("There were 1,204 cases in 2026.", "1204", "How many in 2026?")
    assert not check("There were 1,204 cases, up 7%.", "1204", "How many in 2026?")


def test_extract_sql(spark):
    take = lambda t: one(spark, text.extract_sql(F.lit(t)))
    assert take("Here:\n```sql\nSELECT 1;\n```\nDone") == "SELECT 1"
    assert take("Sure! with a as (select 1) select * from a;") == "with a as (select 1) select * from a"
    assert take("no query") == "no query"


def test_longest_contained(spark):
    assert one(spark, text.longest_contained(F.lit("in Bengaluru City today"), ["Bengaluru", "Bengaluru City"])) == "Bengaluru City"


def test_case_key(spark):
    key = one(spark, keys.case_key(F.lit(1), F.lit(7), F.lit(42), F.lit(2026), F.lit(15)))
    assert key == "100070042202600015"
    assert one(spark, keys.case_number(F.lit(2026), F.lit(15))) == key[9:]
    parsed = one(spark, keys.parse_case_key(F.lit(key)))
    assert parsed.asDict() == {"category": 1, "district": 7, "unit": 42, "year": 2026, "serial": 15}
    assert one(spark, keys.valid_case_key(F.lit(key)))
    for bad in ("2" + key[1:], key[:-1], key[:-1] + "x"):
        assert not one(spark, keys.valid_case_key(F.lit(bad)))


def test_unit_vector_and_cosine(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert abs(one(spark, vectors.norm(v)) - 5) < 1e-12
    assert abs(one(spark, vectors.cosine(v, v)) - 1) < 1e-8
    assert [round(x, 6) for x in one(spark, vectors.unit(v))] == [0.6, 0.8]
