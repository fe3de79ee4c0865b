"""The registered queries of this subpackage, and the SQL that checks those SQL can express."""

QUERIES, ORACLES = {}, {}


def read(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_piece_encoding(spark, folder):
    from cohortspark.llm.pieces import encode_decode

    return encode_decode(read(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query
def op8_quality_rules(spark, folder):
    from cohortspark.llm.quality import quality_verdicts

    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return quality_verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


@query
def op1_line_dedup(spark, folder):
    from cohortspark.llm.linedup import drop_common_lines

    return drop_common_lines(read(spark, folder, "documents").select("doc_id", "text")).drop("text")


ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keys AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_id FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.k IS NOT NULL AND doc_id <> last_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL OR doc_id = last_id), '')) AS kept_sha256
FROM keys LEFT JOIN common USING (k) GROUP BY doc_id"""


@query
def op6_decontamination(spark, folder):
    from pyspark.sql import functions as F

    from cohortspark.llm.winnow import contamination

    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op10_jaccard_join(spark, folder):
    from cohortspark.llm.jaccard import near_classes

    return near_classes(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op3_substring_dedup(spark, folder):
    from cohortspark.llm.substrings import drop_repeats

    return drop_repeats(read(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query
def op9_suffix_dedup(spark, folder):
    from cohortspark.llm.suffixes import drop_repeated_bytes

    return drop_repeated_bytes(read(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query
def op4_warc(spark, folder):
    from cohortspark.llm.warc import archive_pages

    return archive_pages(read(spark, folder, "pages"))[0].drop("record_id", "path")


@query
def op7_toxicity(spark, folder):
    from cohortspark.llm.toxicity import score, train

    docs = read(spark, folder, "documents")
    return score(docs, train(docs, read(spark, folder, "labels")))


@query
def op2_html_extraction(spark, folder):
    from cohortspark.llm.template import main_text

    return main_text(read(spark, folder, "pages"))


@query
def op11_vector_codes(spark, folder):
    from pyspark.sql import functions as F

    from cohortspark.llm.codes import compress, digest

    coded, books = compress(read(spark, folder, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books or [])).alias("codebooks_sha256"))


def _codes_sql():
    """Two rounds over parts as rows: (vec_id, part, place, component) against (part, entry, place, component)."""
    assign = """a{r} AS (
  SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d
    FROM x JOIN b{r} AS b ON x.part = b.part AND x.place = b.place GROUP BY ALL) GROUP BY ALL)"""
    refine = """b{n} AS (
  SELECT b.part, b.entry, b.place, coalesce(s.v, b.v) AS v FROM b{r} AS b LEFT JOIN (
    SELECT x.part, a.entry, x.place, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v
    FROM x JOIN a{r} AS a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL) AS s
  ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)"""
    steps = [assign.format(r=0), refine.format(r=0, n=1), assign.format(r=1), refine.format(r=1, n=2), assign.format(r=2)]
    return """
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS (
  SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS place, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), b0 AS (
  SELECT x.part, s.entry, x.place, x.v FROM x JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) AS s USING (vec_id)
), """ + ", ".join(steps) + """, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


ORACLES["op11_vector_codes"] = _codes_sql()


@query
def op12_token_alignment(spark, folder):
    from cohortspark.llm.align import align

    return align(read(spark, folder, "documents").select("doc_id", "text"))


@query
def op13_lm_scoring(spark, folder):
    from pyspark.sql import functions as F

    from cohortspark.llm.lm import score, train

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    docs = read(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return score(docs, train(docs.filter(~F.col("held_out"))))
