"""The registered queries: each applies one operator to its whole table and derives a digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetrics.llm import (
    angular_negatives, decontaminate, embedding_whitening, lattice_lm, mix_sources, pack_harmonic, perplexity_rules, quality_rff, reshard_flow,
    secret_ledger, simhash_pivots, suffix_dedup, superkmer_dedup,
)
from playmetrics.llm.common import new_path, read_table, text_of


def op1_secret_ledger(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    ledger = secret_ledger.update_ledger(docs, "doc_id", "text")
    found = secret_ledger.findings(docs, "doc_id", "text", ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_ledger.BASE_RULES]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_ledger.span_text(base), 256).alias("base_sha256"),
        secret_ledger.span_text(F.col("spans")).alias("spans"))


def op4_superkmer_dedup(spark, sf_dir):
    left = superkmer_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_benchmark_windows(spark, sf_dir):
    found = decontaminate.verdict(decontaminate.find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated")


def op2_perplexity_bands(spark, sf_dir):
    judged = perplexity_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op3_harmonic_packing(spark, sf_dir):
    pieces = pack_harmonic.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


#: The layout before: so many shards, dealt by a hash of the id.
OLD_SHARDS, NEW_SHARDS = 12, 16


def op6_flow_resharding(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")

    def old_shard(doc_id):
        return F.pmod(F.xxhash64(doc_id), F.lit(OLD_SHARDS)).cast("int")

    before = reshard_flow.write_layout(docs, old_shard("doc_id"))
    after = reshard_flow.rewrite_affected(spark, before, "text", new_path(spark, "resharded"),
                                          shards=NEW_SHARDS, schema=docs.schema)
    rows = reshard_flow.read_layout(spark, after.layout, docs.schema)
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), reshard_flow.size_of("doc.text").alias("size"),
        F.crc32(text_of("doc.text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), old_shard("doc.doc_id").alias("old_shard"))


def op7_rff_quality(spark, sf_dir):
    scored = quality_rff.score_documents(read_table(spark, sf_dir, "documents"),
                                         read_table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_lattice_likelihood(spark, sf_dir):
    return lattice_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op9_simhash_pivots(spark, sf_dir):
    found = simhash_pivots.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op10_suffix_dedup(spark, sf_dir):
    left = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))


def op11_angular_negatives(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angular_negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def op12_whitening(spark, sf_dir):
    return embedding_whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_exponential_mix(spark, sf_dir):
    return mix_sources.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "epochs")


QUERIES = {f.__name__: f for f in (
    op1_secret_ledger, op2_perplexity_bands, op3_harmonic_packing, op4_superkmer_dedup,
    op5_benchmark_windows, op6_flow_resharding, op7_rff_quality,
    op8_lattice_likelihood, op9_simhash_pivots, op10_suffix_dedup,
    op11_angular_negatives, op12_whitening, op13_exponential_mix,
)}
