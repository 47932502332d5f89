"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm import chat, interactions, jaccard, latent, minhash, mixing, periodic, quality, secrets, substring, tokens, warc, wordpiece
from docforge.llm.oracles import ORACLES as PLAIN
from docforge.llm.oracles import mixing_sql

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Weights of the example tree: domains are groups of sources, below them languages, below them sources.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


#: Half of all tokens, at most two epochs of a leaf.
MIX = {"share": 0.5, "epochs": 2, "seed": 7}


def domain() -> F.Column:
    number = F.regexp_extract("source", r"(\d+)", 1)  # of any length; its last two digits say what is left of it by 4
    return F.concat(F.lit("d"), F.when(number == "", "x").otherwise(F.substring(number, -2, 2).cast("long") % 4))


def tree_levels() -> list[F.Column]:
    return [domain(), F.col("lang"), F.col("source")]


def tree_weights(spark: SparkSession) -> DataFrame:
    node = lambda level, path, weight: F.struct(F.lit(level).alias("level"), F.array(*map(F.lit, path)).alias("path"), F.lit(weight).alias("weight"))
    nodes = [node(0, [d], w) for d, w in DOMAIN_WEIGHTS.items()]
    nodes += [node(1, [d, lang], w) for d in DOMAIN_WEIGHTS for lang, w in LANG_WEIGHTS.items()]
    return spark.range(1).select(F.inline(F.array(*nodes)))


def op1_substring_dedup(spark, folder):
    cut = substring.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op2_jaccard_join(spark, folder):
    found = jaccard.similar_components(_table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_mixing(spark, folder):
    """Half of all tokens by the example tree, at most two epochs of a leaf."""
    taken = mixing.mix(_table(spark, folder, "documents"), tree_levels(), tree_weights(spark), **MIX)
    return taken.select("row.doc_id", "row.lang", "row.source", "tokens", "copies")


def op4_quality_rules(spark, folder):
    marked = quality.ledger(_table(spark, folder, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE)) != 0
    return marked.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        quality.kept().alias("kept"),
        "fail_bits",
    )


def op5_token_output(spark, folder):
    return tokens.tokenize_to_files(_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op6_secret_scans(spark, folder):
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    return found.select(
        "row.doc_id",
        *[secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        secrets.base_sha256().alias("base_sha256"),
        secrets.digest().alias("spans"),
    )


def op7_warc(spark, folder):
    read = warc.read_archives(warc.archive(_table(spark, folder, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark, folder):
    """One row for each document and benchmark item that it holds."""
    found = latent.scan(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("row.doc_id", F.inline("matches"))


def op9_token_counts(spark, folder):
    counted = wordpiece.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.select("row.doc_id", "n_words", "n_pieces")


def _conversations(spark, folder):
    """The table, and a conversation whose texts hold control strings."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.unionByName(planted)


def op10_chat_formatting(spark, folder):
    formatted = chat.format_conversations(_conversations(spark, folder))
    read = formatted.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_mask")), "")
    )
    spoken = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted_periods(key: F.Column, text: F.Column) -> F.Column:
    """The text, of which a tenth of the documents repeat a stretch of their own words up to the end."""
    name = F.crc32(key.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")

    def repeat(words):
        n, g = F.size(words).cast("long"), F.floor(name / 10)
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        tail = F.transform(F.sequence(start, n - 1), lambda i: F.get(words, (start + (i - start) % period).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, start.cast("int")), tail), " ")

    # the array is bound once, by a one-element transform
    planted = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(text))[0]
    return F.when((name % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def op11_periodic_runs(spark, folder):
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    planted = documents.withColumn("text", planted_periods(F.col("doc_id"), F.col("text")))
    found = periodic.find_runs(planted)
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        periodic.digest().alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_filter_interactions(spark, folder):
    return interactions.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_minhash_dedup(spark, folder):
    found = minhash.similar_components(_table(spark, folder, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_substring_dedup,
        op2_jaccard_join,
        op3_mixing,
        op4_quality_rules,
        op5_token_output,
        op6_secret_scans,
        op7_warc,
        op8_decontamination,
        op9_token_counts,
        op10_chat_formatting,
        op11_periodic_runs,
        op12_filter_interactions,
        op13_minhash_dedup,
    )
}

ORACLES = {**PLAIN, "op3_mixing": mixing_sql(DOMAIN_WEIGHTS, LANG_WEIGHTS, **MIX)}

__all__ = ["ORACLES", "QUERIES"]
