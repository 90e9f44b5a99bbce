"""Corpus cleaning in stages, each one of the training-data operators applied to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import bpe, decontaminate, near_copies, secrets, toxicity
from symgraph.session import ship
from symgraph.storage import materialize
from symgraph.tables import table

#: A document is rejected from this probability of toxicity on.
TOXIC = 0.7


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and how to name them back."""
    taken, back = set(docs.columns), {}
    for name in names:
        if name in taken:
            other = next(f"{name}_{i}" for i in range(len(taken) + 1) if f"{name}_{i}" not in taken)
            docs, back[other] = docs.withColumnRenamed(name, other), name
            taken.add(other)
    return docs, back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labels of this stage's own input.

    Whole texts count. A null or empty text scores like one without words and stays; rows
    that repeat an id or a text are each scored alike; without labels nothing goes; an empty
    table stays empty; more columns pass through.
    """
    ship(spark)
    docs, back = _aside(docs, "__score")
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    kept = toxicity.score(docs, model, out_col="__score").where(F.col("__score") < TOXIC).drop("__score")
    return kept.withColumnsRenamed(back)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    Texts without words, null ones too, are copies of each other. Rows that repeat an id are
    one document and stay or go together, as do all rows without an id; a group with an id keeps the
    smallest. An empty table stays empty; more columns pass through.
    """
    ship(spark)
    docs, back = _aside(docs, "__kept")
    groups = near_copies.near_copies(docs.select("doc_id", "text"))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").withColumnsRenamed(back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, edits up to a tenth of its characters allowed.

    Whole texts are searched. Null and empty texts hold nothing and stay; rows that repeat an
    id are each searched; an empty benchmark lets all stay; more columns pass through.
    """
    ship(spark)
    docs, back = _aside(docs, "leaks")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).drop("leaks").withColumnsRenamed(back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text.

    A text without secrets, null and empty ones too, stays as it is with its n_chars; overlapping
    spans become one mark; rows that repeat an id are each searched on their own text; an
    empty table stays empty; more columns pass through.
    """
    ship(spark)
    docs, back = _aside(docs, "secret_spans", "__secrets_id", "__secrets_mask")
    found = secrets.find_secrets(docs)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans")))
    clean = clean.withColumn("n_chars", F.when(F.size("secret_spans") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns).withColumnsRenamed(back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, packed as little-endian unsigned 32-bit integers, and their number.

    A null or empty text has no ids; every row gives one, repeated or not; an empty table gives none. Of other columns lang and source stay.
    """
    ship(spark)
    encoded = bpe.encode(docs)
    return encoded.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: SQL cannot express the first stages; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
