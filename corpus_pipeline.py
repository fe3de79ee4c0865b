"""A corpus pipeline of five stages, each over all that the stage before it kept.

``run(spark, sf_dir)`` applies them to ``documents``; each stage's result is written as Parquet to the folder all
executors share and read again as the next one's input. All stages but the last return the columns of ``documents``.
"""

from pyspark.sql import functions as F

from cohortspark.llm.common import stored
from cohortspark.llm.jaccard import one_of_each
from cohortspark.llm.linedup import drop_common_lines
from cohortspark.llm.pieces import encode_decode
from cohortspark.llm.quality import keep_good
from cohortspark.llm.winnow import drop_contaminated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _as_documents(docs):
    """The columns of ``documents``; n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules or the certified cutoffs go."""
    return _as_documents(keep_good(docs, _read(spark, sf_dir, "labels")))


def line_dedup(spark, docs, sf_dir):
    """Lines of at least 20 characters that at least 3 documents hold stay only in the last of them."""
    return _as_documents(drop_common_lines(docs))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates the smallest doc_id stays."""
    return _as_documents(one_of_each(docs))


def decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return _as_documents(drop_contaminated(docs, _read(spark, sf_dir, "benchmark")))


def encoding(spark, docs, sf_dir):
    """Token counts and digests of ids and decoded text for every document left, beside its columns."""
    return encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: Piece encoding cannot be expressed in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}-{name.replace(' ', '-')}")
    return docs
