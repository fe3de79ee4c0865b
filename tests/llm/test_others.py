"""Quality rules, pages, archives, toxicity and the pipeline."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from test_documents import WORD, brute_components, same_rows, sha
from conftest import prose


# -- quality rules ---------------------------------------------------------------------------------------------------


def brute_signals(t):
    words = WORD.findall(t or "")
    n = len(words)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(n - 4))
    again = set()
    for i in range(n - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = n < 10 or 100 * len(again) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), failed


def test_base_measures(spark, docs, texts):
    from cohortspark.llm.quality import quality_verdicts

    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_verdicts(docs, labels)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    same_rows(got, [(d, *brute_signals(t), not brute_signals(t)[-1]) for d, t in texts])  # without labels every rule is off


def test_binomial_bound(spark):
    from cohortspark.llm.quality import log_binomial_cdf

    cases = [(0, 50), (1, 400), (3, 900), (17, 2000), (300, 40000), (99000, 10000000)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("b", log_binomial_cdf(F.col("k"), F.col("n"), 0.01))
    for k, n, b in df.collect():
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99) for i in range(max(0, k - 20000), k + 1)]
        top = max(terms)
        want = top + math.log(math.fsum(math.exp(t - top) for t in terms))
        assert abs(b - want) < 1e-6 * max(1, abs(want)), (k, n, b, want)


def test_cutoffs_hold_on_the_holdout(spark):
    from cohortspark.llm.quality import RISK, RULES, keep_good, quality_verdicts

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        good = rng.random() < 0.8
        words = prose(rng, 14).split()
        if not good:
            words = [w + "###" for w in words]
        lang = rng.choice(["en", None, "tiny" if i < 200 else "en"])
        rows.append((i, " ".join(words), lang))
        if i % 4:
            labels.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels + labels[:50] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_verdicts(docs, labels).collect()}
    bad = [d for d, t, lang in rows if "###" in t and lang != "tiny"]
    good = [d for d, t, _ in rows if "###" not in t]
    assert all(not out[d]["kept"] and out[d]["rejected_by"] == "symbol_rate" for d in bad)
    assert sum(not out[d]["kept"] for d in good) <= RISK * len(good)
    tiny = [d for d, _, lang in rows if lang == "tiny"]
    assert all(out[d]["kept"] for d in tiny)  # too few labels to certify anything
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out.values())
    assert len(RULES) == 3


def test_quality_runs_no_python(spark, docs):
    from cohortspark.llm.quality import signals

    plan = signals(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- pages -----------------------------------------------------------------------------------------------------------


def extracted(spark, rows, **how):
    from cohortspark.llm.template import main_text

    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {r["page_id"]: r for r in main_text(df, **how).collect()}


def test_article_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Home</a></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1><span>by me</span></header><p>First <b>bold</b>text&nbsp;here<br>next
line<p>Second &lt;tag&gt; &#233;&#x1F600; &unknown; a &am<ul><li>one<li>two</ul><table><tr><td>cell<td>other</table><form>no</form><aside>no</aside><div class="comments"><p>first!</p></div><script>x</script>
<blockquote>quoted</blockquote></article><section id="comments"><article><p>Reader comment</p></article></section><footer>&copy;</footer>"""
    out = extracted(spark, [(1, "http://a.b/c", page), (2, None, None), (3, "u", ""), (4, "u", "plain  text"), (5, "u", "<p>cut <b"), (6, "u", "<article><p>x" + "<div>" * 3000 + "deep"), (None, "u", "<main><p>m</p></main><p>not</p>")])
    assert out[1]["text"] == "Title & more First boldtext here next line Second <tag> é\U0001f600 &unknown; a &am one two cell other quoted"
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert [out[i]["text"] for i in (2, 3, 4, 5, 6, None)] == ["", "", "plain text", "cut", "x deep", "m"]


def test_templates_of_a_host(spark):
    rng = random.Random(3)
    box = "<div><p>About this site</p><p>Contact us any time</p></div>"
    rows = [(i, f"https://WWW.a.com/{i}", f"<body>{box}<div><p>{prose(rng, 60)}</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body>{box}<div><p>{prose(rng, 60)}</p></div></body>") for i in range(3)]
    rows += [(200 + i, "http://c.net/x", "<body><div><p>the same long text on every page of this host</p></div></body>") for i in range(9)]
    rows += [(300 + i, "http://d.net/x", f"<article><p>the same paragraph</p><p>{prose(rng, 60)}</p></article>") for i in range(9)]
    out = extracted(spark, rows)
    assert all("Contact" not in out[i]["text"] and out[i]["n_removed"] == 2 for i in range(30))
    assert all(out[i]["text"] == re.sub("<[^>]*>", "", rows[i][2].replace(box, "")) for i in range(30))
    assert all("Contact" in out[100 + i]["text"] for i in range(3))  # too few pages
    assert all(out[200 + i]["text"].startswith("the same long") for i in range(9))  # the page's own text
    assert all(out[300 + i]["text"].startswith("the same paragraph") for i in range(9))  # prose of the article


# -- archives --------------------------------------------------------------------------------------------------------


PAGES = [(i, f"http://h/{i} \n", f"<p>{i % 7}</p>é") for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "x" * 300_000), (None, "u", "<p>3</p>é"), (60, "u", "solo"), (60, "u", "solo"), (9, "u", "later")]


@pytest.mark.parametrize("roll", [64_000_000, 400])
def test_archives(spark, roll, monkeypatch):
    from cohortspark.llm import warc

    monkeypatch.setattr(warc, "ROLL", roll)
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, digest int").repartition(4)
    got, final = warc.archive_pages(pages)
    first = {}
    for p, _, h in PAGES:
        k = (p is None, p)
        first[h or ""] = min(first.get(h or "", k), k)
    left = collections.Counter()
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        original = (p is None, p) == first[h or ""] and not left[h or ""]
        left[h or ""] += original
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, len(raw), digest, "response" if original else "revisit", None if original else first[h or ""][1]))
    same_rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)
    records = [r for f in final.collect() for r in warc.read_records(f["path"])]
    assert len(records) == len(PAGES)
    payloads = collections.Counter(warc.payload_of(b) for _, h, b in records if h["WARC-Type"] == "response")
    assert payloads == collections.Counter({(h or "").encode(): 1 for _, _, h in PAGES})
    ids = {h["WARC-Record-ID"] for _, h, _ in records if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in ids for _, h, _ in records if h["WARC-Type"] == "revisit")


def test_archives_of_one_name_and_earlier_revisits(spark):
    """Three folders whose archives share their names; the third holds revisits of an earlier run. Deduplicated twice."""
    from cohortspark.llm import warc
    from cohortspark.llm.common import shared_path

    schema = "page_id long, url string, html string"
    first = warc.write_archives(spark.createDataFrame([(1, "u", "aaaa"), (5, "v", "bb")], schema).coalesce(1), shared_path(spark, "warc"))
    second = warc.write_archives(spark.createDataFrame([(6, "w", "aaaa"), (7, "x", "cc"), (1, "u", "aaaa")], schema).coalesce(1), shared_path(spark, "warc"))
    _, third = warc.archive_pages(spark.createDataFrame([(8, "y", "aaaa"), (9, "z", "aaaa"), (10, "z", None)], schema).coalesce(1))
    names = lambda m: [r["path"].rsplit("/", 1)[1][:10] for r in m.collect()]
    assert names(first) == names(second) == names(third)
    final = first.unionByName(second).unionByName(third)
    for _ in range(2):
        final = warc.deduplicate_archives(final, shared_path(spark, "warc-again"))
        assert final.agg(F.sum("records")).first()[0] == 8
        rows = warc.resolved_pages(final).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
        same_rows(rows, [(1, 4, "response", None), (5, 2, "response", None), (6, 4, "revisit", 1), (7, 2, "response", None), (1, 4, "revisit", 1),
                         (8, 4, "revisit", 1), (9, 4, "revisit", 1), (10, 0, "response", None)])
    records = [r for f in final.collect() for r in warc.read_records(f["path"])]
    ids = {h["WARC-Record-ID"] for _, h, _ in records if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in ids and b"Content-Length: 4\r\n" in block for _, h, block in records if h["WARC-Type"] == "revisit")


def test_small_payloads_stay_responses(spark):
    from cohortspark.llm.warc import archive_pages

    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in archive_pages(pages, min_bytes=5)[0].collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert archive_pages(pages.where("false"))[0].count() == 0


# -- toxicity --------------------------------------------------------------------------------------------------------


def toxic_rows(n):
    """Insults are toxic, and so are two harmless words when they meet."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 40)).split()
        kind = rng.random()
        toxic = 0
        if kind < 0.1:
            words.insert(rng.randrange(len(words)), "Idiot")
            toxic = 1
        elif kind < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice(["groupx", "leave"]))
        elif kind < 0.4:
            words += ["groupx", "leave"]
            toxic = 1
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_is_learned_and_held_out(spark):
    from cohortspark.llm.toxicity import score, train

    rows, labels = toxic_rows(4000)
    docs = spark.createDataFrame(rows + [(None, None), (9999, ""), (9998, None)], "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    table = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = train(docs, table)
    out = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert len(out) == 4003
    truth = dict(labels)
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d]["held_out"] == (d in set(held)) for d in truth)
    wrong = [d for d in held if out[d]["predicted"] != truth[d]]
    assert len(wrong) <= 0.03 * len(held)
    assert out[9999]["score"] == out[9998]["score"] == out[None]["score"] < 0.5
    text = dict(rows)
    pair = sum(out[d]["score"] for d in held if "groupx" in text[d] and "leave" in text[d]) / sum("groupx" in text[d] and "leave" in text[d] for d in held)
    alone = [out[d]["score"] for d in held if ("groupx" in text[d]) != ("leave" in text[d]) and "Idiot" not in text[d]]
    assert pair > 0.8 and sum(alone) / len(alone) < 0.3
    # labels of held-out rows change nothing
    flipped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = train(docs, flipped)
    assert all((again[k] == model[k]).all() for k in model)


def test_toxicity_without_labels(spark):
    from cohortspark.llm.toxicity import score, train

    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in score(docs, train(docs, none)).collect()] == [0.5, 0.5]
    assert score(docs.where("false"), train(docs.where("false"), none)).count() == 0


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, texts, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from cohortspark.llm.linedup import line_key
    from cohortspark.llm.pieces import default_model

    item = [t for d, t in texts if d == 3][0]
    docs.select("doc_id", "text", "lang", "source", F.col("n").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    low = -(2**63)
    rows = [(d, t) for d, t in texts if not brute_signals(t)[-1]]
    held = collections.defaultdict(list)
    for d, t in rows:
        for k in {line_key(x, 20) for x in t.encode().split(b"\n")} - {None}:
            held[k].append(low if d is None else d)
    last = {k: max(v) for k, v in held.items() if len(v) >= 3}
    rows = [(d, b"\n".join(x for x in t.encode().split(b"\n") if not (line_key(x, 20) in last and (low if d is None else d) < last[line_key(x, 20)])).decode()) for d, t in rows]
    rows = [r for r, c in zip(rows, brute_components(rows)) if c[2] is None or c[2] == r[0]]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = word.findall(item.lower())
    windows = {tuple(bench[i:i + 10]) for i in range(len(bench) - 9)}
    rows = [(d, t) for d, t in rows if not any(tuple(w[i:i + 10]) in windows for w in [word.findall(t.lower())] for i in range(len(w) - 9))]
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    same_rows([(r["doc_id"], r["text"], r["n_chars"], r["n_tokens"], r["decoded_sha256"]) for r in got], [(d, t, len(t), len(sp.encode(t)), sha(sp.decode(sp.encode(t)))) for d, t in rows])
    assert 40 < len(got) < len(texts) and not any(d == 3 for d, _ in rows)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "benchmark decontamination", "sentencepiece encoding"]
