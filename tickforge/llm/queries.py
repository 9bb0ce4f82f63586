"""The registered queries of this package: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tickforge.llm import alignment, chat_trees, chunks, decontaminate, exact, filter_audit, langid, nn_descent, packing, quality, rans, resharding, simhash, sql
from tickforge.llm.common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.fingerprint_text("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


OLD_SHARDS, NEW_SHARDS = 12, 16


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From twelve shards by source, of which one holds a third, to sixteen of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old, new, schema = fresh_path(spark, "shards"), fresh_path(spark, "resharded"), docs.schema
    resharding.write_shards(docs, F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS)), old)
    manifest = resharding.reshard(spark, old, new, schema, NEW_SHARDS)
    text = F.col("row.text")
    columns = [
        F.col("row.doc_id").alias("doc_id"),
        resharding.row_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]
    found = resharding.read_resharded(spark, old, new, schema, manifest, columns)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a tree in which every turn answers the one before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') v(t, r)")
    node = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.unionByName(extra).withColumn("node", node)
    messages = numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score")
    )
    found = chat_trees.formatted(chat_trees.branches(messages))
    read = found.select(F.col("tree").alias("conv_id"), "formatted", chat_trees.turns_of(F.col("formatted")).alias("turns"), chat_trees.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("items").alias("item_ids"), "words")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host of a document, its language there the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.judged(docs, classifier, F.col("source"), F.col("lang"), keep_text=False)
    return found.select("row.doc_id", "evidence", "host_mean", "path_mean", "wanted", (F.col("wanted") >= quality.THRESHOLD).alias("kept"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    found = langid.identify(docs, model)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recall = nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall")
    )


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "rans")
    rans.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return rans.read_ids(spark, path, digest=True).withColumnsRenamed({"n": "n_tokens", "ids": "ids_crc32"})


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunks.drop_repeated_chunks(docs)
    return found.select("row.doc_id", "lines", "removed_lines", F.length("row.text").cast("long").alias("kept_chars"), F.md5("row.text").alias("kept_md5"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.windows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return cut.select("sequence_id", F.inline("pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    counts = alignment.PairCounts(alignment.bundles(table(spark, sf_dir, "documents"), a, b), a, b)
    return alignment.aligned(counts, digest=True).withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.labelled(failed, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_reshard": op2_reshard,
        "op3_chat_trees": op3_chat_trees,
        "op4_spaced_seeds": op4_spaced_seeds,
        "op5_quality": op5_quality,
        "op6_language": op6_language,
        "op7_nn_descent": op7_nn_descent,
        "op8_rans": op8_rans,
        "op9_line_chunks": op9_line_chunks,
        "op10_packing": op10_packing,
        "op11_exact": op11_exact,
        "op12_alignment": op12_alignment,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_chunks": sql.OP9, "op11_exact": sql.OP11, "op13_filter_audit": sql.OP13}
