"""The operators bound to the test tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chunking, clusters, crf, decontam, density, langid, licenses, packing, pfor, pii, ppm, simhash
from corpusloom.llm import sql, whitening
from corpusloom.session import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_harmonic_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"))


def op2_offset_pii(spark, folder):
    return pii.personal_data(_table(spark, folder, "documents"))


def op3_content_chunks(spark, folder):
    return chunking.shift_fingerprints(_table(spark, folder, "documents"))


def op4_containment_search(spark, folder):
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_ppm_score(spark, folder):
    return ppm.score(_table(spark, folder, "documents"))


def op6_text_density(spark, folder):
    return density.main_text(_table(spark, folder, "pages"))


def op7_word_backoff(spark, folder):
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs)
    return langid.predict(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])


def op8_license_scan(spark, folder):
    return licenses.license_scan(_table(spark, folder, "documents"))


def op9_line_field(spark, folder):
    docs = _table(spark, folder, "documents")
    return crf.score(docs, crf.fit(docs, _table(spark, folder, "labels")))


def op10_gray_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_hadamard_clusters(spark, folder):
    return clusters.cluster(_table(spark, folder, "embeddings"))


def op12_feast_whitening(spark, folder):
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_patched_blocks(spark, folder):
    files = scratch_path(spark, "token-ids")
    pfor.write_ids(_table(spark, folder, "documents"), files)
    return pfor.read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (
    op1_harmonic_packing, op2_offset_pii, op3_content_chunks, op4_containment_search, op5_ppm_score, op6_text_density,
    op7_word_backoff, op8_license_scan, op9_line_field, op10_gray_simhash,
    op11_hadamard_clusters, op12_feast_whitening, op13_patched_blocks,
)}

SQL: dict[str, str] = {"op4_containment_search": sql.CONTAINMENT, "op11_hadamard_clusters": sql.CLUSTERS}
