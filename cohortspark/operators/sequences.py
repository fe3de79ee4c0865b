"""Session sequences, text profiles and similarity between sessions."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.functions.exprs import col, micros
from cohortspark.operators.joins import spread_join
from cohortspark.operators.ordered import OrderedScan, key_sum, lag, row_number
from cohortspark.operators.windows import first_per, top_n


def dot(a, b):
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b):
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def profile_text(cols):
    """Joined, whitespace-collapsed, lower-case text of several columns; NULL when nothing is left."""
    text = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", *[F.col(c) for c in cols]), r"\s+", " ")))
    return F.nullif(text, F.lit(""))


def text_vectors(df, text, name="vec", features=512):
    """TF-IDF vectors (hashed) of a text column as an array of doubles."""
    model = Pipeline(stages=[RegexTokenizer(inputCol="_txt", outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features),
                             IDF(inputCol="_tf", outputCol="_v")]).fit(df.withColumn("_txt", F.coalesce(F.col(text), F.lit(""))))
    out = model.transform(df.withColumn("_txt", F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn(name, vector_to_array("_v")).drop("_txt", "_w", "_tf", "_v")


def session_similarity(df, unit, order, vec, mode="prev", name="similarity", hot_rows=None):
    """Cosine of each session's vector with the previous session's (``prev``) or the first one's (``anchor``)."""
    if mode == "prev":
        out = OrderedScan(df, [unit], order, hot_rows=hot_rows).add(_ref=lag(vec)).result()
    else:
        anchor = first_per(df, [unit], order).select(unit, F.col(vec).alias("_ref"))
        out = spread_join(df, anchor, [unit], "inner", hot_rows)
    return out.withColumn(name, cosine(vec, "_ref")).drop("_ref")


def session_sequences(events, session, ts, tiebreak, event, max_len=20, min_freq=3, min_events=2, hot_rows=None):
    """Per session the first ``max_len`` events in time order, as names, seconds since the previous event and token ids.

    Ids: 0 = PAD, 1 = UNK, then 2.. by falling frequency for events seen at least ``min_freq`` times.
    """
    counts = events.groupBy(event).agg(F.count(F.lit(1)).alias("_f")).filter(F.col("_f") >= min_freq)
    vocab = OrderedScan(counts, [], ["-_f", event], hot_rows=hot_rows).add(_id=row_number()).result().select(event, (F.col("_id") + 1).cast("int").alias("_id"))
    scan = OrderedScan(events.select(*session, ts, tiebreak, event), session, [ts, tiebreak], hot_rows=hot_rows)
    rows = scan.add(_rn=row_number(), _prev=lag(ts)).result()
    rows = spread_join(rows, vocab, [event], "left", hot_rows)
    item = F.struct("_rn", F.col(event).alias("e"), F.coalesce((micros(ts) - micros("_prev")) / 1000000.0, F.lit(0.0)).alias("s"), F.coalesce("_id", F.lit(1)).alias("i"))
    # truncation to max_len happens before the rows of a session meet
    out = rows.groupBy(*session).agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= max_len, item))).alias("_q"))
    out = out.filter(F.col("n_events") >= min_events)
    ids = F.concat(F.transform("_q", lambda q: q["i"]), F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_q")))
    return out.select(*session, "n_events", F.transform("_q", lambda q: q["e"]).alias("events"), F.transform("_q", lambda q: q["s"]).alias("seconds_since_prev"), ids.alias("token_ids"))


def attribution_summary(scored, label, event, score, position, n_positions=5):
    """Mean attribution score by event for label 1 and 0 with their lift, and by position bin.

    Returns (event table, position table).
    """
    y = F.col(label).cast("int")
    table = scored.groupBy(event).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(y == 1, F.col(score))).alias("score_1"), F.avg(F.when(y == 0, F.col(score))).alias("score_0"))
    table = table.withColumn("lift", F.col("score_1") / F.nullif(F.col("score_0"), F.lit(0.0)))
    pos = F.least(F.col(position), F.lit(n_positions)).alias("position_bin")
    return table, scored.groupBy(pos).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def top_entities(scored, entity, score, n=10, min_n=10):
    """Entities with at least ``min_n`` scored events by mean score."""
    per = scored.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score")).filter(F.col("n") >= min_n)
    return top_n(per, ["-mean_score", entity], n)


def touch_weights(events, session, ts, tiebreak, hot_rows=None):
    """Linear touch weight per event: 1 / events of its session, with its position."""
    scan = OrderedScan(events, session, [ts, tiebreak], hot_rows=hot_rows).add(position=row_number(), _n=key_sum(F.lit(1)))
    return scan.derive(score=1.0 / F.col("_n")).result().drop("_n")


