"""Text and nearest joins against brute force on small frames."""

import random

from pyspark.sql import functions as F

from cohortspark.operators import joins as J


def words(seed, n, alphabet="abcde ", low=3, high=12):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high))).strip() or "a" for _ in range(n)]


def jaro_winkler_value(s, t):
    """Jaro-Winkler similarity in 0..1 (prefix weight 0.1, up to 4 characters, for Jaro above 0.7)."""
    if not s and not t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    used, seq = [False] * len(t), []
    for i, ch in enumerate(s):
        j = t.find(ch, max(0, i - reach), i + reach + 1)
        while j != -1 and used[j]:
            j = t.find(ch, j + 1, i + reach + 1)
        if j != -1:
            used[j] = True
            seq.append(ch)
    m = len(seq)
    if m == 0:
        return 0.0
    other = [ch for ch, u in zip(t, used) if u]
    swaps = sum(x != y for x, y in zip(seq, other)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3.0
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(s), len(t)) and s[same] == t[same]:
        same += 1
    return jaro + same * 0.1 * (1.0 - jaro)


def test_jaro_winkler_column(spark):
    rnd = random.Random(8)
    pairs = [(x, y) for x, y in zip(words(9, 400, "abcd 日é", 1, 14), words(10, 400, "abcd 日é", 1, 14))]
    pairs += [(x, "".join(rnd.sample(x, len(x)))) for x, _ in pairs[:200]] + [("", ""), ("", "a"), ("b", ""), ("martha", "marhta"), ("dixon", "dicksonx")]
    df = spark.createDataFrame(pairs + [(None, "a"), ("a", None)], "x string, y string")
    for x, y, v in df.select("x", "y", J.jaro_winkler("x", "y")).collect():
        assert v == (None if x is None or y is None else int(jaro_winkler_value(x, y) * 100 + 0.5)), (x, y)


def test_fuzzy_candidates_are_few(spark):
    rnd = random.Random(4)
    letters = "etaoinshrdlcumwfgypbvkjxqz"
    weights = [1 / (i + 3) for i in range(26)]
    text = sorted({"".join(rnd.choices(letters, weights, k=rnd.randint(4, 12))) for _ in range(3000)})
    typo = [w[:k] + rnd.choice(letters) + w[k + 1:] for w in text for k in [rnd.randrange(len(w))]]
    a, b = spark.createDataFrame([(w,) for w in text], "x string"), spark.createDataFrame([(w,) for w in typo], "y string")
    pairs = J.fuzzy_candidates(a, b, "x", "y", 90).count()
    assert pairs < 0.01 * len(text) * len(set(typo))
    few = text[:40]
    want = sorted((x, y) for x in few for y in set(typo) if int(jaro_winkler_value(x, y) * 100 + 0.5) >= 90)
    got = sorted({(r.x, r.y) for r in J.fuzzy_join(spark.createDataFrame([(w,) for w in few], "x string"), b, "x", "y", 90).collect()})
    assert got == want


def test_fuzzy_join_misses_nothing(spark):
    left, right = sorted(set(words(1, 150))), sorted(set(words(2, 60)))
    a, b = spark.createDataFrame([(w,) for w in left], "x string"), spark.createDataFrame([(w,) for w in right], "y string")
    for threshold in (60, 85, 90, 95):
        want = sorted((x, y) for x in left for y in right if int(jaro_winkler_value(x, y) * 100 + 0.5) >= threshold)
        got = sorted((r.x, r.y) for r in J.fuzzy_join(a, b, "x", "y", threshold).collect())
        assert got == want and want


def test_contains_join_both_ways(spark):
    texts, pats = words(3, 80, "abC\n", 1, 12) + [f"zz{p}yy{p[1:]}" for p in words(5, 30, "abc", 11, 26)[:20]] + words(6, 60, "xyZ", 5, 60), words(4, 40, "aBc", 4, 7) + words(5, 30, "abc", 11, 26)
    a = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "id long, t string")
    for some in (pats, pats[:40], pats[40:], ["a", "nowhere in any of these texts", None]):
        b = spark.createDataFrame([(p,) for p in some], "p string")
        want = sorted(i for i, t in enumerate(texts) if any(p and p.lower() in t.lower() for p in some))
        assert sorted(r.id for r in J.contains_join(a, b, "id", "t", "p").collect()) == want
    b = spark.createDataFrame([("",), ("abc",)], "p string")
    assert J.contains_join(a, b, "id", "t", "p").count() == len(texts) + 1


def test_nearest_value_when_cut(spark):
    a = spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    b = spark.range(200).select(F.col("id").alias("c"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).cast("double").alias("w"))
    rows = b.collect()
    for hot in (None, 40):
        for r in J.nearest_value_join(a, b, "v", "w", "c", hot_rows=hot).collect():
            best = min(rows, key=lambda x: (abs(x.w - r.v), x.w, x.c))
            assert (r.match_id, r.match_gap) == (best.c, abs(best.w - r.v))


def test_hot_key_window_join_needs_no_product(spark):
    # one key holds every row: 2000 x 2000 rows, but only neighbours in time meet
    base = spark.range(2000).select(F.lit(1).alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("t0"))
    ev = base.select("k", F.col("t0").alias("et"))
    out = J.window_join(base, ev, "k", "t0", "et", 0, 120)
    assert out.count() == 2 * 2000 - 3
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_hot_keys_are_spread_without_changing_the_result(spark):
    base = spark.range(60).select((F.col("id") % 5).alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("t0"))
    ev = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).cast("int").alias("k"), "id",
                                 F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id / 10 as int))").alias("et"))
    for hi in (None, 1800):
        for how in ("inner", "left"):
            plain = J.window_join(base, ev, "k", "t0", "et", 0, hi, how=how)
            spread = J.window_join(base, ev, "k", "t0", "et", 0, hi, how=how, hot_rows=200)
            assert sorted(map(str, plain.select("k", "t0", "id").collect())) == sorted(map(str, spread.select("k", "t0", "id").collect()))
    small = base.groupBy("k").agg(F.min("t0").alias("m"))
    for how in ("inner", "left"):
        a, b = J.spread_join(ev, small, ["k"], how), J.spread_join(ev, small, ["k"], how, hot_rows=200)
        assert sorted(map(str, a.select("k", "id", "m").collect())) == sorted(map(str, b.select("k", "id", "m").collect()))
