"""Registered queries of the training-data operators: ``fn(spark, sf_dir) -> DataFrame``.

The operators keep general interfaces; the queries apply them with production
parameters to whole tables and derive the asked-for columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tipflow.llm import (
    decontaminate, infill, langid, minhash, mixing, ngram_join, pii, quality, repair, rules, stats, substrings, urls, warc)
from tipflow.llm.common import crc_fold, table


def op1_ngram_jaccard_join(spark, sf_dir):
    """(doc_id, n_shingles, component_id) of every document."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    """(doc_id, held_out, lang_pred, score) of every document, with cross_entropy and rejected."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


# Fixed rules of the URL filter.
URL_RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"),
             urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op3_url_filter(spark, sf_dir):
    """(page_id, host, path, rule, verdict) of every page, with the trees' score."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_pii(spark, sf_dir):
    """Base counts and digest, and all spans, of every document; n_added counts the contextual spans."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(kind).alias(f"n_{name}") for kind, name in enumerate(pii.KINDS)]
    added = F.coalesce("added", F.array().cast(pii._SPANS))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.sort_array(F.concat("base", added))).alias("spans"),
                        F.size(added).cast("long").alias("n_added"))


def op5_warc(spark, sf_dir):
    """Every page written to archives and read back: size, digest, type and reference of its record."""
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark, sf_dir):
    """(doc_id, item_id, shared, item_shingles, containment) of every benchmark item in every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    """(doc_id, start, end, words, kept_doc_id, kept_start) of every repeated line, sentence or run
    of sentences but the earliest."""
    return substrings.removals(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    """(doc_id, size, source_size, target, taken) of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    """(doc_id, held_out, score, predicted) of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_fold("doc_id", 5) == 0)


def op10_quality_rules(spark, sf_dir):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *stats.COUNTS, "base_failed", "kept")


def damaged(conversations):
    """The conversations with seeded damage: rows dropped, emptied, cut short, repeated or given another role."""
    space = F.lit(" ")
    seed = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(seed.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))


def op11_conversation_repair(spark, sf_dir):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every damaged conversation."""
    return repair.digests(*repair.parts(damaged(table(spark, sf_dir, "conversations")), F.col("dropped")))


def op12_minhash_dedup(spark, sf_dir):
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    out = infill.restore(infill.transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_language_id, op3_url_filter, op4_pii, op5_warc, op6_decontamination,
    op7_substring_dedup, op8_source_mixing, op9_quality_classifier, op10_quality_rules, op11_conversation_repair,
    op12_minhash_dedup, op13_fill_in_middle)}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": warc.oracle_sql(),
    "op6_decontamination": decontaminate.oracle_sql(),
    "op7_substring_dedup": substrings.oracle_sql(),
    "op8_source_mixing": mixing.oracle_sql(),
    "op12_minhash_dedup": minhash.oracle_sql(),
    "op13_fill_in_middle": infill.oracle_sql(),
}
