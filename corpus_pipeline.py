"""A training corpus from raw documents, in five stages over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to the shared scratch folder and reads
it again as the next one's docs, and deletes it when that is written. All but the last return the columns of docs.

Empty tables stay empty in every stage. Other columns may have any name but those that the last stage adds (ids, n_tokens, round_trip),
which it replaces; repeated rows are near-duplicates of each other, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontaminate, pieces, pii, simhash, toxicity
from plenum.llm.common import forget, fresh, passing, settle, table
from plenum.llm.queries import TOKENIZERS

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """Python workers get and give at most 8 MB of rows at a time: stages share their executors, and long texts would fill these.
    The setting must hold until a stage's result is written, so run() resets it, not the stage."""
    spark.conf.set(BYTES, "8m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among docs, doesn't reject. Null texts stay."""
    lean(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.probabilities(F.col("text"), chain)[chain.categories[-1]] < 0.5)


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a settled key of each row, and the key's name: ids may be null or shared by different texts."""
    row = fresh(docs, "row")
    return settle(docs.withColumn(row, F.monotonically_increasing_id())), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id (null ids last) of each group of linked fingerprints; each row is judged by its own text."""
    lean(spark)
    rows, row = with_rows(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = simhash.near_duplicates(rows.select(key.alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias(row))
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark's windows don't contaminate; each row is judged by its own text."""
    rows, row = with_rows(docs)
    found = decontaminate.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data, and n_chars of the new text."""
    lean(spark)
    done = pii.pseudonymise(docs).drop("n_entities")
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, the number of ids, and whether decoding gives the text back."""
    lean(spark)
    blob = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    out = fresh(docs, "pieces_of_text")
    coded = pieces.encode_checked(docs, blob, out=out, likely=False, remembered=24 << 20)
    n = F.coalesce(F.size(f"{out}.ids"), F.lit(0)).cast("long")
    return coded.withColumns({"ids": F.col(f"{out}.ids"), "n_tokens": n, "round_trip": F.col(f"{out}.round_trip")}).drop(out)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("tokenise", tokenise),
]

#: SQL has neither the chain's training, nor XXH64 with a seed, nor surrogates, nor piece ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the whole documents. Settings are as before afterwards, and only the last result is left in the scratch folder."""
    before = spark.conf.get(BYTES)
    docs = table(spark, sf_dir, "documents")
    try:
        for _, stage in STAGES:
            with passing() as keep:
                done = keep(settle(stage(spark, docs, sf_dir)))
            forget(docs)
            docs = done
    finally:
        spark.conf.set(BYTES, before)
    return docs
