from pyspark.sql import functions as F

from planline.functions import evidence as E


def test_totals_are_withheld_unless_complete(spark):
    rows = [("a", 1.0, "m"), ("a", 2.0, "m"), ("b", 1.0, "m"), ("b", None, "m"), ("c", 1.0, "m"), ("c", 2.0, "ft"), ("d", 0.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, u string")
    r = {x.g: x.t for x in df.groupBy("g").agg(E.total(F.col("v"), F.col("u")).alias("t")).collect()}
    assert (r["a"].value, r["a"].unit, r["a"].withheld_reason) == (3.0, "m", None)
    assert r["b"].value is None and r["b"].withheld_reason == "1 of 2 not measured"
    assert r["c"].value == 3.0 and r["c"].unit is None and r["c"].unit_reason == "mixed units"
    assert r["d"].value == 0.0 and r["d"].unit_reason == "no unit declared"
    empty = df.limit(0).agg(E.total(F.col("v"), F.col("u")).alias("t")).first().t
    assert empty.value is None and empty.withheld_reason == "nothing to add"


def test_quantity_and_units(spark):
    df = spark.createDataFrame([(None, "model", "m"), (2.0, "paper", "m"), (2.0, "model", None), (0.0, "model", "m")], "v double, s string, d string")
    u = df.withColumn("u", E.unit_of(F.col("s"), F.col("d")))
    q = [r.q for r in u.select(E.quantity(F.col("v"), F.col("u.unit"), F.col("u.reason"), "ring", "shoelace").alias("q")).collect()]
    assert q[0].value is None and q[0].withheld_reason == "not measured"
    assert q[1].unit is None and q[1].unit_reason == "units hold in model space only"
    assert q[2].unit_reason == "the file declares none" and q[3].value == 0.0 and q[3].withheld_reason is None


def test_grades(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (1, 1), (2, 5)], "c int, p int").withColumn("g", E.grade(F.col("c"), F.col("p")))
    assert [r.g for r in df.collect()] == list(E.GRADES)
    assert df.where("c > 0").agg(E.weakest(F.col("g")).alias("w")).first().w == "stated"
