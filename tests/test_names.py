"""The schema test against its sequential statement."""

import random

import sequential
from pyspark.sql import functions as F

from lineweave.functions import names as nm


def test_known_table(spark):
    rnd = random.Random(9)
    parts = ["SWG", "DB_", "_", ".", "X", "IP_PLF", "가", "TAST", "ABA", "BA", "TB", "A", "STG_CATV", "ICT", "ANLY"]
    names = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(4000)})
    for schemas in (["SWG", "ABA", "ICT", "ICTANLY", "IP_PLF", "STG_CATV", "TAST"], ["SWG", "A"], ["IP_PLFX"]):
        df = spark.createDataFrame([(n,) for n in names], "n string")
        got = {r.n: r.ok for r in df.select("n", nm.known_table(F.col("n"), schemas).alias("ok")).collect()}
        assert got == {n: sequential.passes(n, "", schemas) for n in names}
        assert len(set(got.values())) == (1 if schemas == ["IP_PLFX"] else 2)


def test_normal_names(spark):
    names = ["a_b.c.d", "{DB}.\"t\"", "x", "SWG.", ".y", "ip_plf_1.t.u", "a.IP_PLF.c", "f(a.b)", "_x._y", "a\nb_c.d\ne.f", "'"]
    row = spark.createDataFrame([(names,)], "n array<string>").select(nm.normal_names(F.col("n")).alias("m")).first()
    assert row.m == [sequential.normal(n) for n in names]


def test_starts_and_ends_is_looser_than_equality(spark):
    df = spark.createDataFrame([("SWGSWG.TAB",), ("ABABA.TAB",), ("SWGX.TAB",)], "n string")
    assert [r.ok for r in df.select(nm.known_table(F.col("n"), ["SWG", "ABA"]).alias("ok")).collect()] == [True, True, False]
