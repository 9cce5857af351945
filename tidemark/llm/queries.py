"""The registered queries of the corpus operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (op1_spots, op2_paths, op3_suffix, op4_bins, op5_lists, op6_pu, op7_lattice, op8_cascade, op9_viterbi,
                          op10_packing, op11_toxic, op12_runs, op13_whitening)
from tidemark.llm.text import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_spots_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return op1_spots.edit_report(table(spark, folder, "documents"))


def op2_paths_links(spark: SparkSession, folder: str) -> DataFrame:
    """Class and links of every document."""
    return op2_paths.class_report(table(spark, folder, "documents"))


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What repeats of 100 bytes leave of every document."""
    report = op3_suffix.repeat_report(table(spark, folder, "documents"))
    return report.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_bins_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into id matrices."""
    return op4_bins.pack_matrices(table(spark, folder, "documents"))


def op5_lists_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, fetched on a day that follows from its id, against list changes that follow from all pages."""
    pages = table(spark, folder, "pages")
    host, path, page = op5_lists.host_of(F.col("url")), op5_lists.path_of(F.col("url")), F.col("page_id")
    captures = pages.select("page_id", "url", (19700 + page * 37 % 360).alias("day"))
    key = F.when(page % 3 == 0, host).when(page % 3 == 1, F.regexp_replace(host, r"^[^.]+\.", "")).otherwise(F.concat(host, path))
    changes = pages.select(key.alias("key"), (19700 + page * 53 % 360).alias("day"),
                           F.when(page % 4 < 2, "add").otherwise("remove").alias("action"))
    return op5_lists.judge(captures, changes)


def op6_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    model, _ = op6_pu.fit(docs, table(spark, folder, "labels"), ~held_out(5))
    return op6_pu.score_rows(docs, model).select(
        "doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every document."""
    scores = op7_lattice.score_texts(table(spark, folder, "documents"), ~held_out(10), kind="lang")
    return scores.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_cascade_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    report = op8_cascade.cascade_report(table(spark, folder, "documents"), measures=base)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return report.select("doc_id", *base, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op9_viterbi_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and whether decoding gives the text back."""
    docs = table(spark, folder, "documents")
    return op9_viterbi.round_trip(docs)


def op10_packing_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document."""
    return op10_packing.pack_documents(table(spark, folder, "documents"))


def op11_toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    model, _ = op11_toxic.fit(docs, table(spark, folder, "labels"), ~held_out(5))
    return op11_toxic.score_rows(docs, model).select(
        "doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_runs_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, one in ten of them with a looped tail."""
    report = op12_runs.run_report(table(spark, folder, "documents"), edit=op12_runs.looped_tail)
    return report.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_whitening_components(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of every embedding."""
    return op13_whitening.whiten_report(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spots_edits": op1_spots_edits,
    "op2_paths_links": op2_paths_links,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_bins_matrices": op4_bins_matrices,
    "op5_lists_blocked": op5_lists_blocked,
    "op6_pu_quality": op6_pu_quality,
    "op7_lattice_scores": op7_lattice_scores,
    "op8_cascade_rules": op8_cascade_rules,
    "op9_viterbi_ids": op9_viterbi_ids,
    "op10_packing_sequences": op10_packing_sequences,
    "op11_toxic_scores": op11_toxic_scores,
    "op12_runs_collapsed": op12_runs_collapsed,
    "op13_whitening_components": op13_whitening_components,
}

SQL: dict[str, str] = {
    "op5_lists_blocked": r"""
        WITH own AS (
          SELECT page_id, 19700 + page_id * 37 % 360 AS day,
                 regexp_replace(regexp_extract(lower(coalesce(url, '')),
                   '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS host,
                 regexp_replace(regexp_extract(coalesce(url, ''),
                   '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
          FROM pages),
        changes AS (
          SELECT CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]+\.', '') ELSE host || path END AS key,
                 19700 + page_id * 53 % 360 AS day, min(CASE WHEN page_id % 4 < 2 THEN 1 ELSE 0 END) AS listed
          FROM own GROUP BY 1, 2),
        spans AS (
          SELECT key, day AS valid_from, listed,
                 coalesce(lead(day) OVER (PARTITION BY key ORDER BY day), 2147483647) AS valid_to
          FROM changes),
        keys AS (
          SELECT page_id, day, unnest(list_distinct(list_concat(
            [array_to_string(string_split(host, '.')[i + 1:], '.') FOR i IN range(0, greatest(len(string_split(host, '.')) - 1, 1))],
            CASE WHEN path = '' THEN [] ELSE
            [host || array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(2, len(string_split(path, '/')) + 1)]
            END))) AS key
          FROM own WHERE host <> ''),
        met AS (
          SELECT k.page_id, count(*) AS n_active, min(k.key) AS first_key
          FROM keys k JOIN spans s ON s.key = k.key AND s.listed = 1 AND k.day >= s.valid_from AND k.day < s.valid_to
          GROUP BY 1)
        SELECT o.page_id, o.host, o.day, coalesce(m.n_active, 0) AS n_active, m.first_key, m.n_active IS NOT NULL AS blocked
        FROM own o LEFT JOIN met m ON m.page_id = o.page_id""",
}
