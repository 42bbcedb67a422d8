"""Rules whose cost or meaning must hold beyond the small tables."""

from pyspark.sql import functions as F

from witnessframe.functions import values as V
from witnessframe.operators import ledger as L
from witnessframe.operators import runs as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sample_step_is_searched_not_listed(spark):
    # One step per bit; a list of all candidates would have a hundred million entries.
    assert value(spark, V.sample_step(F.lit(10**8), F.lit(10**8), 1)) == 5 * 10**7 + 1
    for w, h, most in ((1366, 5477, 1_500_000), (23, 22, 500), (1_200_000, 60_000, 500), (19_999, 3, 7), (1, 501, 500), (501, 1, 500)):
        step = value(spark, V.sample_step(F.lit(w), F.lit(h), most))
        assert (w // step) * (h // step) <= most and (step == 1 or (w // (step - 1)) * (h // (step - 1)) > most)


def uses(spark, column, name):
    return spark.range(1).select(column.alias("v"))._jdf.queryExecution().analyzed().toString().count(name)


def test_js_string_takes_a_number_apart_once(spark):
    x = F.rand(1) * 100
    assert uses(spark, V.js_string(x), "regexp_extract(") <= 5
    expected = {0.1: "0.1", -2.5: "-2.5", 1e-3: "0.001", 9.99e-4: "0.000999", 1234567.5: "1234567.5", 12345678.25: "12345678.25", -0.0: "0", 3.0: "3", 1e15: "1000000000000000", -1e20: "-100000000000000000000"}
    rows = spark.createDataFrame([(k,) for k in expected], "x double").select("x", V.js_string(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == expected


def test_a_pass_is_looked_up_once_per_member(spark):
    v = F.try_parse_json(F.col("id").cast("string"))
    # Its own kind and that of five members.
    assert uses(spark, R.pass_error(v, "p"), "schema_of_variant(") <= 6
    docs = {None: "p must be an object", "[1]": "p must be an object", "{}": None, '{"lang":1,"psm":-1}': "p.lang must be a string", '{"psm":"3"}': "p.psm must be a non-negative number",
            '{"dpi":1.5}': "p.dpi must be an integer", '{"upscale":1.5}': "p.upscale: scale 1.5 must be in (0, 1] or a whole factor 2..4", '{"upscale":null,"pixel_budget":true}': "p.pixel_budget must be a non-negative number"}
    rows = spark.createDataFrame([(k,) for k in docs], "d string").select("d", R.pass_error(F.try_parse_json("d"), "p").alias("e")).collect()
    assert {r.d: r.e for r in rows} == docs


def test_cookie_rejects_parse_a_text_once(spark):
    texts = {None: False, "": False, " \n": False, "null": False, "false": False, '""': False, "[]": False, "{}": False, "true": True, "12": True, '"x"': True, "{broken": True, '\t[{"name":"a","value":1}]\n': False}
    df = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("home", F.lit("u"))
    rejects = L.cookie_rows(df, ["raw"], "raw", "home")[1]
    assert {r.raw for r in rejects.collect()} == {t for t, bad in texts.items() if bad}
    assert rejects._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + rejects._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
