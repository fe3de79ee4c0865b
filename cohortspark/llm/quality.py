"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

``signals`` measures each text. ``calibrate`` chooses one cutoff per stratum and rule: candidate cutoffs are tested from
the most lenient to the strictest on a labelled holdout; a cutoff passes while the exact binomial bound shows that good
documents are rejected at a rate of at most ``risk``/rules. Each stratum and rule tests at level ``delta``/(strata x
rules) (Bonferroni) and stops at its first failure (fixed sequence), so with probability 1 - ``delta`` no stratum rejects
more than ``risk`` of its good documents. Among the cutoffs that passed, the other labelled half (tuning) picks the one
that rejects most bad documents, the most lenient on ties; where none helps, the rule is off in that stratum.

Defined cases: null or empty text has no words and fails the base rules (n_words < 10); a null stratum is its own
stratum; rows without labels do not take part in the calibration; contradictory labels of one id count as bad only if
every label is bad; without labels every rule is off and only base rules reject. Rows with equal id and text get equal
verdicts. Other columns are ignored, whatever their names.
"""

from pyspark.sql import functions as F

from cohortspark.llm.common import TEXT_KEY, stored

WS = "[\\x20\\x09-\\x0D]+"
#: Rules reject values above the cutoff. Candidates from the most lenient to the strictest.
RULES = {
    "symbol_rate": [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "stutter_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
RISK, DELTA, TUNING_SHARE = 0.05, 0.05, 0.3
#: Cutoff tables up to this many rows are broadcast; larger ones are joined by shuffle.
SMALL_TABLE = 10_000


def signals(docs):
    """Base measures and rule signals of every row of ``docs`` (doc_id, text, and any other columns, which stay)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn("_words", F.filter(F.split(text, WS), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # a 5-word window is known by its 64-bit hash within its text
    windows = split.withColumn("n_words", F.size("_words").cast("long")).withColumn(
        "_win", F.expr("CASE WHEN n_words < 6 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, CAST(n_words AS INT) - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) END"))
    sorted_ = windows.withColumn(
        "_sorted", F.expr("CASE WHEN size(array_distinct(_win)) = size(_win) THEN CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>) ELSE array_sort(transform(_win, (h, i) -> struct(h AS h, i AS i))) END"))
    places = sorted_.withColumn(
        "_at", F.expr("array_sort(transform(filter(_sorted, (x, i) -> (i > 0 AND _sorted[i - 1].h = x.h) OR (i + 1 < size(_sorted) AND _sorted[i + 1].h = x.h)), x -> x.i))"))
    measured = places.withColumns({
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]++", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr("CAST(CASE WHEN size(_at) = 0 THEN 0 ELSE aggregate(_at, struct(0 AS n, -5 AS last), (a, x) -> struct(a.n + least(5, x - a.last) AS n, x AS last)).n END AS BIGINT)"),
        "_n_lines": F.size("_lines"),
        "_stutters": F.expr("CASE WHEN n_words < 2 THEN 0 ELSE size(filter(_words, (w, i) -> i > 0 AND w = _words[i - 1])) END"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1))
    return measured.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "stutter_rate": F.col("_stutters") / words,
    }).drop("_words", "_lines", "_win", "_sorted", "_at", "_n_lines", "_stutters")


def log_gamma(x):
    """Natural logarithm of the gamma function for x >= 1 (Stirling's series at x + 8, shifted down)."""
    y = x + 8
    shift = x * (x + 1) * (x + 2) * (x + 3)
    shift2 = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(shift) - F.log(shift2)


def log_binomial_cdf(k, n, p):
    """log P(X <= k) for X ~ Binomial(n, p) and k < n p, an upper bound exact to about 1e-12.

    Terms are summed downwards from k, relative to the term at k; the sum stops 60 + 12 sd below k and a geometric
    bound stands for what is left, so the result errs on the safe side only."""
    k, n, p = k.cast("double"), n.cast("double"), F.lit(float(p))
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p)
    steps = F.least(k, F.floor(60 + 12 * F.sqrt(n * p * (1 - p))))
    parts = F.aggregate(
        F.sequence(F.lit(0), steps.cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * (1 - p) / p).alias("term"), (a["sum"] + a["term"]).alias("sum")))
    ratio = k / (n - k + 1) * (1 - p) / p
    rest = F.when(steps < k, parts["term"] / (1 - ratio)).otherwise(0.0)
    return first + F.log(parts["sum"] + rest)


def calibrate(measured, labels, risk=RISK, delta=DELTA, rules=RULES, stratum="stratum", seed="holdout"):
    """One row per stratum and rule with a certified cutoff: stratum, rule, cutoff, n_good, n_rejected, bound.

    ``measured``: doc_id, stratum, base_failed and the rules' signals; ``labels``: doc_id, quality (1 good, 0 bad).
    Documents that fail the base rules are no part of it: the verdict is not asked for them."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_good"))
    half = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1000)) < int(1000 * TUNING_SHARE)
    rows = measured.where(~F.col("base_failed")).join(known, measured["doc_id"] == known["_id"]).select(F.col(stratum).alias("stratum"), "_good", half.alias("_tune"), *rules)
    counts = []
    for rule, cutoffs in rules.items():
        for step, c in enumerate(cutoffs):
            above = F.col(rule) > float(c)
            counts.append(F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(float(c)).alias("cutoff"),
                                   F.count_if(~F.col("_tune") & (F.col("_good") == 1)).alias("n_good"),
                                   F.count_if(~F.col("_tune") & (F.col("_good") == 1) & above).alias("n_rejected"),
                                   F.count_if(F.col("_tune") & (F.col("_good") == 0) & above).alias("n_hits"),
                                   F.count_if(F.col("_tune") & (F.col("_good") == 1) & above).alias("n_lost")))
    grid = rows.groupBy("stratum").agg(F.array(*counts).alias("_c"))
    cells = stored(grid.select("stratum", F.inline("_c")), "quality-grid")
    n_strata = max(1, cells.select("stratum").distinct().count())
    share = risk / len(rules)
    tested = cells.withColumn("log_level", F.log(F.lit(delta / (n_strata * len(rules)))))
    k, n = F.col("n_rejected"), F.col("n_good")
    log_bound = F.when((n > 0) & (k < n * share), log_binomial_cdf(F.when(k < n * share, k).otherwise(0), F.greatest(n, F.lit(1)), share)).otherwise(0.0)
    judged = tested.withColumn("bound", log_bound).withColumn("passed", F.col("bound") <= F.col("log_level"))
    per_rule = judged.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("step", "passed", "cutoff", "n_good", "n_rejected", "n_hits", "n_lost", "bound"))).alias("_s"))
    # the candidates before the first failure; of these the best on the tuning half
    ahead = F.expr("filter(_s, (x, i) -> forall(slice(_s, 1, i + 1), y -> y.passed))")
    gain = lambda x: x["n_hits"] - 2 * x["n_lost"]
    best = F.array_max(F.transform(F.col("_a"), lambda x: F.struct(gain(x).alias("gain"), (-x["step"]).alias("lenient"), x["cutoff"].alias("cutoff"), x["n_good"].alias("n_good"), x["n_rejected"].alias("n_rejected"), x["bound"].alias("bound"))))
    return per_rule.withColumn("_a", ahead).where(F.size("_a") > 0).withColumn("_b", best).where("_b.gain > 0").select("stratum", "rule", "_b.cutoff", "_b.n_good", "_b.n_rejected", "_b.bound")


def judge(measured, cutoffs, rules=RULES, stratum="stratum"):
    """Adds ``kept`` and ``rejected_by`` (the first rule that rejects, or base, or null)."""
    table = cutoffs.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in rules])
    if table.count() <= SMALL_TABLE:
        table = F.broadcast(table)
    joined = measured.join(table, measured[stratum].eqNullSafe(table["_s"]), "left")
    why = F.when(F.col("base_failed"), "base")
    for r in rules:
        why = why.when(F.col(r) > F.col(f"_cut_{r}"), r)
    return joined.withColumn("rejected_by", why).withColumn("kept", F.col("rejected_by").isNull()).drop("_s", *[f"_cut_{r}" for r in rules])


def measured_rows(docs, stratum_col="lang"):
    """Signals of every document as a stored narrow table (no texts): doc_id, text key, stratum, measures."""
    stratum = F.col(stratum_col).cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias(TEXT_KEY), stratum.alias("stratum"))
    return stored(signals(base).drop("text"), "quality-signals")


def quality_verdicts(docs, labels, risk=RISK, delta=DELTA):
    """One row per document: measures, base_failed, kept, rejected_by."""
    measured = measured_rows(docs)
    cutoffs = stored(calibrate(measured, labels, risk, delta), "quality-cutoffs")
    return judge(measured, cutoffs)


def keep_good(docs, labels, risk=RISK, delta=DELTA):
    """The documents the rules keep, with their columns as they are."""
    rejected = quality_verdicts(docs, labels, risk, delta).where(~F.col("kept")).select("doc_id", TEXT_KEY).distinct()
    key = F.xxhash64(F.col("text").cast("string"))
    rejected = rejected.withColumnsRenamed({"doc_id": "_rejected_id", TEXT_KEY: "_rejected_key"})
    return docs.join(rejected, docs["doc_id"].cast("long").eqNullSafe(F.col("_rejected_id")) & (key == F.col("_rejected_key")), "left_anti")
