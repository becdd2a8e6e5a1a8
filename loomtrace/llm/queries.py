"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, lm, media, mixing, negatives, packing, pii, rlz, sharding, simhash, topk, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (sharding.op1_extendible_hash_shards, lm.op2_log_bloom_lm, toxicity.op3_string_kernel_svm, pii.op4_pii, rlz.op5_rlz_substrings, mixing.op6_poisson_mix, packing.op7_best_fit_packing, simhash.op8_simhash_mih, media.op9_matroska, topk.op10_hamming_topk, negatives.op11_hard_negatives, licenses.op12_diagonal_licenses, whitening.op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_hash_shards": sharding.ORACLE, "op5_rlz_substrings": rlz.ORACLE, "op6_poisson_mix": mixing.ORACLE, "op10_hamming_topk": topk.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_diagonal_licenses": licenses.ORACLE}
