import math

from pyspark.sql import functions as F

from cohortspark.functions import tails
from cohortspark.operators import models as M, stats as ST

# Published two-proportion results (treatment x, control x, rate difference, se, z, p); n = 315888 and 316404.
GOLDEN = [
    (1239, 575, 0.002104979376192785, 0.0001345263068198314, 15.647343824074092, 3.463777600734985e-55),
    (6173, 5354, 0.002620332031000837, 0.0003364924836205947, 7.787193350670321, 6.8514065251601156e-15),
    (2152, 2060, 0.0003018775738219171, 0.00020459983221682767, 1.4754536626598886, 0.14009061728416558),
    (1164, 1115, 0.00016087465003152956, 0.00015073028762894496, 1.067301420054058, 0.2858357470683849),
    (373, 354, 6.197548672244005e-05, 8.523733100181355e-05, 0.7270932347837291, 0.46716884278196763),
    (373, 355, 5.881497042049691e-05, 8.529586597766275e-05, 0.6895406916426566, 0.49048307528939916),
    (1434, 1407, 9.273721306730931e-05, 0.00016821711895996473, 0.5512947412289265, 0.5814316428456088),
    (1099, 1090, 3.4119358421638346e-05, 0.00014773461484134543, 0.2309440089786932, 0.8173583005079549),
    (288, 283, 1.7289431300144772e-05, 7.554997431225707e-05, 0.22884761321937036, 0.8189873586112173),
]


def test_published_z_tests(spark):
    df = spark.createDataFrame([(i, a, 315888, b, 316404) for i, (a, b, *_) in enumerate(GOLDEN)], "i int, xt long, nt long, xc long, nc long")
    for r in ST.ztest_prop(df, "xt", "nt", "xc", "nc").collect():
        _, _, diff, se, z, p = GOLDEN[r.i]
        for got, want in ((r.se, se), (r.z, z), (r.p_value, p)):
            assert abs(got / want - 1) < 1e-9, (r.i, got, want)
        assert abs(r.rate_diff - diff) < 2e-9


def test_tails():
    for z in (0.0, 0.3, 0.46875 * math.sqrt(2), 1.96, 4 * math.sqrt(2), 9.0):
        assert abs(ST.norm_ppf(0.975) - 1.959963984540054) < 1e-12
    assert abs(tails.t_sf2_value(2.0, 10) - 0.07338803477074039) < 1e-10
    assert abs(tails.t_sf2_value(1.0, 1) - 0.5) < 1e-12
    assert abs(tails.chi2_sf_value(9.0, 4) - math.exp(-4.5) * 5.5) < 1e-12
    assert abs(tails.chi2_sf_value(1.5, 2) - math.exp(-0.75)) < 1e-12


def test_normal_tail_column(spark):
    zs = [0.01, 0.5, 0.66, 1.0, 2.5, 5.6, 5.7, 12.0, 20.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", tails.norm_sf2("z"))
    for r in df.collect():
        assert abs(r.p / math.erfc(r.z / math.sqrt(2)) - 1) < 1e-12


def test_mann_whitney_when_cut(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("arm"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
    a, b = ST.mann_whitney(df, "arm", "a", "b", "v").first(), ST.mann_whitney(df, "arm", "a", "b", "v", hot_rows=10).first()
    assert a == b


def test_logit_recovers_coefficients(spark):
    df = spark.range(20000).select(((F.pmod(F.xxhash64("id"), F.lit(2000)) - 1000) / 500.0).alias("x"), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10000)) / 10000.0).alias("u"))
    df = df.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-(0.5 + 1.2 * F.col("x"))))).cast("int"))
    got = {r.term: r for r in M.logit_inference(df, ["x"], "y").collect()}
    assert abs(got["x"].coef - 1.2) < 0.08 and abs(got["intercept"].coef - 0.5) < 0.08
    assert got["x"].ci_low < 1.2 < got["x"].ci_high and got["x"].p_value < 1e-50
    terms, models = M.fit_logit(df, ["x"], "y")
    assert abs(terms.first().coef - got["x"].coef) < 1e-3
    assert 0.75 < terms.first().auc < 0.9
