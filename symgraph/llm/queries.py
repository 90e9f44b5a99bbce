"""Registered queries of the ten operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import backoff, blocknames, bpe, decontaminate, extract, periodic, secrets, sharding, simhash, toxicity, trie, vectors, warc
from symgraph.llm.sql import ORACLES  # noqa: F401
from symgraph.storage import materialize
from symgraph.tables import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score_corpus(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.describe(base), 256).alias("base_sha256"), secrets.describe(F.col("secret_spans")).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage that a document holds; clean documents have none."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks")).select("doc_id", F.col("item").alias("item_id"), "edits")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model).select("doc_id", F.col("toxicity").alias("score"))
    return scored.select("doc_id", (~toxicity.in_training_fold(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write_archives(pages))
    return warc.read_captures(pages, index)


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "token_ids")
    return bpe.decode(encoded).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Of some documents, by a checksum of the id, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def rebuilt(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    chosen = docs.withColumn("h", h).withColumn("words", F.when((F.col("h") % 10 == 0) & (F.size(words) > 0), words))
    return chosen.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(rebuilt(F.col("words"))).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"))


def _forked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c begins with the first h turns of c - c % 5, its own follow after its first h."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = materialize(convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "forks")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "bytes")
    heads = turns.where("pos <= 8").withColumnRenamed("conv_id", "base")
    taken = heads.join(convs, "base").where("pos <= h").select("conv_id", "pos", "turn_id", "bytes")
    return own.union(taken), convs.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(trie.numbered(trie.named_turns(table(spark, sf_dir, "conversations"))), "numbered")
    return trie.prefix_nodes(*_forked(turns))


QUERIES = {"op1_lm_score": op1_lm_score, "op2_secret_scan": op2_secret_scan, "op3_decontaminate": op3_decontaminate, "op4_embeddings": op4_embeddings, "op5_simhash": op5_simhash, "op6_toxicity": op6_toxicity, "op7_warc": op7_warc, "op8_extract": op8_extract, "op9_bpe": op9_bpe, "op10_sharding": op10_sharding, "op11_periodic_runs": op11_periodic_runs, "op12_exact_dedup": op12_exact_dedup, "op13_prefix_trie": op13_prefix_trie}
