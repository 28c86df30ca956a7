"""One query per operator, over its whole table; ``ORACLES`` where SQL can
express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..sources.tables import table
from . import chat, conv_trie, fim, line_dedup, mix, ngram_join, packing, pii, quality, shard, token_files, url_model, vector_dedup
from . import sql as oracle


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_model.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score_bin")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard.shard_documents(docs).select(
        "doc_id", shard.row_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    rows = token_files.digests(token_files.read_tokens(spark, path))
    return rows.join(token_files.starts(spark, path), "file").select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", mix.word_count(F.col("text")).alias("size"))
    return mix.mix(rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_pack_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", F.col("length").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", F.col("offset").cast("bigint").alias("offset"))


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    c = chat.format_conversations(turns.unionByName(extra))
    lost = F.raise_error(F.concat(F.lit("does not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    c = c.withColumn("formatted", F.when(F.col("round_trip"), F.col("formatted")).otherwise(lost))
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    turn_text = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return c.select(
        "conv_id", F.size("parsed").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turn_text, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, counts=COUNTS, keep_columns=["doc_id"])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS, base.alias("base_failed"), "kept")


def op8_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


#: The key is the operator's parameter; in production it comes from a secret store.
PII_KEY = "pseudonym-key-1"


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, found_col="n_replaced")


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Turns a conversation may take over from the first one of its hundred.
HEAD = 5


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations whose first turns are those of the
    first one of their hundred, and all conversations."""
    turns = materialize(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base, h = (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), F.coalesce(F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1), F.lit(0)).alias("h")
    there = sizes.select(F.col("conv_id").alias("b"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", base, h).join(there, F.col("base") == F.col("b"), "left")
    convs = materialize(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "rebuilt")
    own = convs.select(F.col("conv_id").alias("c"), "h", "taken")
    tails = turns.join(own, F.col("conv_id").eqNullSafe(F.col("c"))).where("ord > h").select("conv_id", (F.col("ord") - F.col("h") + F.col("taken")).alias("ord"), "id", "chars")
    first = turns.where((F.col("ord") <= HEAD) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("b"), "ord", "id", "chars")
    heads = convs.join(first, (F.col("base") == F.col("b")) & (F.col("ord") <= F.col("taken"))).select("conv_id", "ord", "id", "chars")
    return heads.unionByName(tails), convs.select("conv_id")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.prefix_trie(*rebuilt(conv_trie.number_turns(table(spark, sf_dir, "conversations"))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = fim.restore(F.col("output"), F.col("form"))
    return fim.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_ratio, op2_histogram_shards, op3_token_files, op4_mix_sources, op5_pack_online,
                                   op6_chat_round_trip, op7_quality_cascade, op8_hnsw_dedup, op9_ngram_jaccard, op10_feistel_pseudonyms,
                                   op11_line_bitmaps, op12_conversation_trie, op13_fill_in_middle)}

ORACLES = {"op1_url_ratio": oracle.URLS, "op4_mix_sources": oracle.MIX, "op6_chat_round_trip": oracle.CHAT, "op7_quality_cascade": oracle.QUALITY,
           "op11_line_bitmaps": oracle.LINES, "op12_conversation_trie": oracle.TRIE, "op13_fill_in_middle": oracle.MIDDLE}
