"""The operators as named queries over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailscope.llm import chat, decontam, langid, line_dedup, minhash, mixing, periodic, quality, sharding, sql, suffix_dedup, toxicity, warc, whitening
from trailscope.llm.common import WORD, in_fold, step_path, store

#: Fixed by the contract: the text that both turns of the added conversation say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs).select("doc_id", "dedup.*")
    return found.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write_bundles(pages, warc.archive_folder(pages))
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records are written to shards; everything returned is read back from these."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded, path = sharding.shard_documents(docs), step_path(spark, "shards")
    sharding.write_shards(sharded, path)
    records = spark.read.schema(sharded.schema).parquet(path)
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return records.select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"), digest.alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = langid.fit_language_model(docs.where(~held_out))
    found = langid.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per occurrence of a benchmark item; documents without a row are clean."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_contamination(docs, _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = toxicity.fit_toxicity(docs, labels.where(~held_out))
    scored = toxicity.score_toxicity(docs, model, out="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    turns = turns.unionByName(added.select("conv_id", "t.turn", "t.role", F.lit(CONTROL_TEXT).alias("text")))
    return chat.conversation_digests(store(chat.format_conversations(turns), "chat-windows"))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.apply_cascade(docs, out="verdict", base_stats=True).select("doc_id", "verdict.*")
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *numbers, "base_failed", F.col("name").isNull().alias("kept"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", whitening.lattice(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    rows = store(vectors, "whiten-rows")
    model = whitening.fit_whitening(rows)
    found = whitening.whiten(rows, model).select("vec_id", "whitened.deviation", F.posexplode("whitened.whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts (doc_id, text): from word ``a`` on, a tenth of the documents repeat ``p`` words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))})
    placed = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    taken = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(taken, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs).select("doc_id", "repeats.*")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs).select("doc_id", "lines.*")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_warc, op3_sharding, op4_source_mix, op5_language_id, op6_decontamination, op7_toxicity, op8_minhash, op9_chat_format, op10_quality_cascade, op11_whitening, op12_periodic_runs, op13_line_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Only where SQL states the whole result; the others are tested against brute force, a round trip or held-out accuracy."""
    return {
        "op1_suffix_dedup": sql.OP1, "op2_warc": sql.OP2, "op8_minhash": sql.OP8,
        "op9_chat_format": sql.OP9, "op10_quality_cascade": sql.OP10, "op13_line_dedup": sql.OP13,
    }
