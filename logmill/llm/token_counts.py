"""Operator 5: token counts through a digest cache.

Stored counts are keyed by the SHA-256 of the normalised content and the digest of the tokenizer file.  Contents
are joined to the store; the distinct ones that miss are encoded once each and appended to it as a new Parquet
part, which a lost executor leaves whole or absent.

Null text counts as empty: no bytes, no tokens.  Repeated rows share one stored count and are all returned.
A store that does not exist yet, or an empty one, has no counts; an empty table adds none and gives no rows.
Very long texts are encoded alone.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common, tokens

STORE = "digest binary, tokenizer string, n_tokens long"
LIMIT = 512
#: Missing digests that are broadcast, of 32 bytes each.
FEW_MISSES = 100_000


def stored(spark: SparkSession, store: str, version: str) -> DataFrame:
    try:
        known = spark.read.schema(STORE).parquet(store)
    except AnalysisException:
        known = spark.createDataFrame([], STORE)
    return known.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def _encode(batches):
    encoder = tokens.byte_bpe()
    for part in tokens.slices(batches, "t"):
        yield pa.RecordBatch.from_arrays([part["digest"], pa.array(encoder.counts(part["t"]), pa.int64())], names=["digest", "n_tokens"])


def _texts_of_misses(rows: DataFrame, known: DataFrame) -> DataFrame | None:
    """One text for each digest that the store lacks; None: it lacks none.

    Digests alone are held against the store.  While few are missing, they go to the tasks and no other text is moved;
    else texts meet the missing digests by digest.
    """
    spark = rows.sparkSession
    if known.isEmpty():
        wanted = rows
    else:
        missing, path = common.materialise(rows.select("digest").distinct().join(known, "digest", "left_anti"), "token-misses")
        n = missing.count()
        if not n:
            common.remove(spark, path)
            return None
        missing = F.broadcast(missing) if n <= FEW_MISSES else missing.hint("shuffle_hash")
        wanted = rows.join(missing, "digest", "left_semi")
    # copies within a task go before the texts are shuffled; one text of each digest arrives
    return wanted.select("digest", "t").groupBy("digest").agg(F.first("t").alias("t"))


def count_tokens(docs: DataFrame, store: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row; what the store lacked is in it afterwards."""
    spark = docs.sparkSession
    version = tokens.version_of(tokens.path_of("byte_bpe_50k.json"))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), content.alias("t"), F.unhex(F.sha2(content, 256)).alias("digest"))
    misses = _texts_of_misses(rows, stored(spark, store, version))
    if misses is not None:
        new = misses.mapInArrow(_encode, "digest binary, n_tokens long")
        new.withColumn("tokenizer", F.lit(version)).select("digest", "tokenizer", "n_tokens").write.mode("append").parquet(store)
    # two jobs that missed the same digest at once both append it: one count is taken
    counts = stored(spark, store, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts, _ = common.materialise(counts, "token-counts")
    sized = rows.select("k", "digest", F.octet_length("t").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.scratch(spark, "token-store"))
