"""Toxicity by a factorization machine over hashed terms.

Terms (digits, letters and characters beyond ASCII, lower-cased) are hashed to ``BUCKETS``. Spark counts, over all
training documents, how many toxic and other documents hold each bucket; a bucket's value in a document that holds it is
its smoothed log odds. On these values a factorization machine learns a bias, a weight per bucket and ``FACTORS``
factors per bucket, so pairs of terms (an insult with a group's name) add what neither term has alone:

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2])

The machine is fitted by Adam in one task, on at most ``SAMPLE`` training documents (those with the smallest hash of
their id: a documented bound, the same at every size; the counts above have none). The model has a fixed size and is
broadcast. Rows with crc32(doc_id as text) mod 5 = 0 are held out from counts and fit alike. Only the text is scored.

Defined cases: null and empty texts score by the bias; a missing doc_id counts as the empty text in the held-out rule
and never has a label; contradictory labels of one id count as toxic; without labels, or with one class only, the score
is the share of toxic labels (0.5 without any) for every text; rows are scored each for itself; texts are read whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, keyed, row_chunks, stored
from cohortspark.llm.tokens import word_table

BUCKETS = 2**18
FACTORS = 4
SAMPLE = 20_000
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.02, 1e-4
#: Log odds: strength of the smoothing, documents a bucket needs, and the margin taken off towards 0.
SMOOTH, LEAST, MARGIN = 10.0, 3, 1.0


def is_held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def buckets_of(column):
    """(distinct buckets, sorted within each row, first place of each row)."""
    words, off, *_ = word_table(column, "alnum")
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = np.unique(rows * BUCKETS + (words >> np.uint64(44)).astype(np.int64) % BUCKETS)
    return key % BUCKETS, np.searchsorted(key, np.arange(len(off)) * BUCKETS)


def training_rows(docs, labels):
    """(doc_id, toxic, packed buckets) of the labelled documents that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~is_held_out(F.col("_id")))

    def run(batch):
        for part in row_chunks(batch, 2_000_000):
            b, first = buckets_of(part.column("text"))
            b = b.astype("<u4")
            yield {"doc_id": part.column("doc_id"), "buckets": [b[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist())]}

    rows = keyed(docs).where("doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id"))).select("doc_id", "text")
    found = arrow_map(rows, run, "doc_id long, buckets binary")
    return found.join(known.hint("merge"), found["doc_id"] == known["_id"]).select("doc_id", "toxic", "buckets")


def bucket_counts(rows):
    """Arrays of toxic and other documents per bucket, over all training rows: BUCKETS rows at most reach the driver."""

    def run(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            blobs = batch.column("buckets").to_pylist()
            size = [len(b) // 4 for b in blobs]
            flat = np.frombuffer(b"".join(blobs), "<u4")
            label = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), size)
            for k in (0, 1):
                totals[k] += np.bincount(flat[label == k], minlength=BUCKETS)
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[0][at]), pa.array(totals[1][at])], names=["bucket", "n0", "n1"])

    counted = rows.select("toxic", "buckets").mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0"), F.sum("n1")).toPandas().to_numpy(np.int64)
    out = np.zeros((2, BUCKETS))
    out[:, counted[:, 0]] = counted[:, 1:].T
    return out


def odds(counts, n0, n1, own=None):
    """Value of each bucket: log of how much likelier toxic documents hold it, smoothed, less a margin. ``own`` takes
    one document of that class away, so that a training document is not told its own label."""
    share = n1 / (n0 + n1)
    c0, c1 = (np.maximum(counts[k] - (own == k), 0) for k in (0, 1))
    rate = (c1 + SMOOTH * share) / (c0 + c1 + SMOOTH)
    value = np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    value = np.where(c0 + c1 >= LEAST, value, 0.0)
    return (np.sign(value) * np.maximum(np.abs(value) - MARGIN, 0)).astype(np.float32)


def forward(x, buckets, row, n, model):
    """Raw scores of n rows from their buckets' values, with what the gradient needs."""
    b, w, v = model
    linear = np.bincount(row, weights=w[buckets] * x, minlength=n)
    vx = v[buckets] * x[:, None]
    sums = np.column_stack([np.bincount(row, weights=vx[:, f], minlength=n) for f in range(v.shape[1])])
    squares = np.bincount(row, weights=(vx**2).sum(axis=1), minlength=n)
    return b[0] + linear + 0.5 * ((sums**2).sum(axis=1) - squares), vx, sums


def fit(sample, values, share):
    """(bias, weights, factors) fitted to a list of (label, buckets). values: of each label's documents, see ``odds``."""
    rng = np.random.default_rng(1)
    rows = []
    for label, buckets in sample:
        x = values[label][buckets]
        rows.append((label, buckets[x != 0].astype(np.int64), x[x != 0]))
    model = [np.array([np.log(share / (1 - share))]), np.ones(BUCKETS), rng.normal(0, 0.1, (BUCKETS, FACTORS))]
    first, second = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    step = 0
    for _ in range(EPOCHS):
        for cut in np.split(rng.permutation(len(rows)), np.arange(BATCH, len(rows), BATCH)):
            y, buckets, x = np.array([rows[i][0] for i in cut]), np.concatenate([rows[i][1] for i in cut]), np.concatenate([rows[i][2] for i in cut])
            row = np.repeat(np.arange(len(cut)), [len(rows[i][1]) for i in cut])
            raw, vx, sums = forward(x, buckets, row, len(cut), model)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(cut)
            used, at = np.unique(buckets, return_inverse=True)
            e = err[row] * x
            wide = e[:, None] * (sums[row] - vx)
            # weights are drawn to 1 (the plain sum of log odds), factors to 0
            grads = [np.array([err.sum()]), np.bincount(at, weights=e, minlength=len(used)) + DECAY * (model[1][used] - 1),
                     np.column_stack([np.bincount(at, weights=wide[:, f], minlength=len(used)) for f in range(FACTORS)]) + DECAY * model[2][used]]
            step += 1
            for p, m, s, g, sel in zip(model, first, second, grads, (slice(None), used, used)):
                m[sel] = 0.9 * m[sel] + 0.1 * g
                s[sel] = 0.999 * s[sel] + 0.001 * g * g
                p[sel] -= RATE * (m[sel] / (1 - 0.9**step)) / (np.sqrt(s[sel] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs, labels, sample=SAMPLE):
    """The model as one dict of arrays, of fixed size."""
    rows = stored(training_rows(docs, labels), "toxicity-rows")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return {"constant": share}
    counts, share = bucket_counts(rows), n1 / (n0 + n1)
    values = {label: odds(counts, n0, n1, own=label) for label in (0, 1)}
    # one task orders the sample: counts by the hash's upper 16 bits tell which rows can be in it
    hashed = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("cell", F.shiftright("h", 48))
    cells = sorted((r["cell"], r["count"]) for r in hashed.groupBy("cell").count().collect())
    full = np.searchsorted(np.cumsum([c for _, c in cells]), sample)
    last = cells[min(int(full), len(cells) - 1)][0]
    chosen = hashed.where(F.col("cell") <= last).orderBy("h", "doc_id").limit(sample).select("toxic", "buckets")

    def run(batches):
        got = []
        for batch in batches:
            got += [(t, np.frombuffer(b, "<u4")) for t, b in zip(batch.column("toxic").to_pylist(), batch.column("buckets").to_pylist())]
        got.sort(key=lambda r: (r[0], r[1].tobytes()))  # the same fit, whatever order the rows arrive in
        if got:
            b, w, v = fit(got, values, share)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (b, w, v)], names=["b", "w", "v"])

    r = chosen.coalesce(1).mapInArrow(run, "b binary, w binary, v binary").first()
    read = lambda x: np.frombuffer(bytes(x), "<f4")
    return {"values": odds(counts, n0, n1), "b": read(r["b"]), "w": read(r["w"]), "v": read(r["v"]).reshape(BUCKETS, FACTORS)}


def score(docs, model):
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = sent.value
        for part in row_chunks(batch, 2_000_000):
            n = part.num_rows
            if "constant" in m:
                p = np.full(n, float(m["constant"]))
            else:
                b, first = buckets_of(part.column("text"))
                x, row = m["values"][b], np.repeat(np.arange(n), np.diff(first))
                told = x != 0
                raw = forward(x[told], b[told], row[told], n, (m["b"], m["w"], m["v"]))[0]
                p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    rows = keyed(docs).select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")
