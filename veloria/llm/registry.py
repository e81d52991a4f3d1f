"""The training-data queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, centroids, exact, html, langid, linededup, merkle, mixing, packing, phrases, simhash, tokens, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": tokens.op1_token_files,
        "op2_simhash": simhash.op2_simhash,
        "op3_language_id": langid.op3_language_id,
        "op4_main_text": html.op4_main_text,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_nearest": ann.op7_nearest,
        "op8_pack_sequences": packing.op8_pack_sequences,
        "op9_warc": warc.op9_warc,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_phrase_fingerprint": phrases.op11_phrase_fingerprint,
        "op12_centroid_clusters": centroids.op12_centroid_clusters,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact.SQL, "op7_nearest": ann.SQL, "op9_warc": warc.SQL, "op10_mix_sources": mixing.SQL, "op12_centroid_clusters": centroids.SQL, "op13_merkle_manifest": merkle.SQL}
