"""A corpus pipeline: languages, near copies, repeats, secrets, then packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import Scratch
from ledgerloom.llm.langid import known_language
from ledgerloom.llm.packing import packed
from ledgerloom.llm.secrets_scan import redacted
from ledgerloom.llm.simhash import keep_one
from ledgerloom.llm.suffix import without_repeats

#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents:
#: documents of no clear language go; of each group of near copies one document stays;
#: texts lose strings that an earlier document has; secrets are blanked; the rest is packed.
STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", keep_one),
    ("suffix_array_dedup", without_repeats),
    ("secret_scan", redacted),
    ("best_fit_packing", packed),
]

#: No SQL: classifiers, suffix buckets and tokenizers aren't expressed in it. tests/llm
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again by the next.

    The five columns of documents are read, so other columns never clash. Null and empty
    texts go with the first stage, as they have no language; texts are worked on whole,
    however long; rows that share a doc_id are documents of their own unless their texts
    are near copies; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
