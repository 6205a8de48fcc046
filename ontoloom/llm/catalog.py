"""The queries and SQL that this subpackage contributes to __spark_entry__."""

from __future__ import annotations

from . import bpe, chat, matroska, ngrams, nndescent, packing, quality, recompression, simhash, toxicity

QUERIES = {
    "op1_gam": quality.op1_gam,
    "op2_simhash_vptree": simhash.op2_simhash_vptree,
    "op3_stupid_backoff": ngrams.op3_stupid_backoff,
    "op4_bpe_automaton": bpe.op4_bpe_automaton,
    "op5_recompression": recompression.op5_recompression,
    "op6_vector_best_fit": packing.op6_vector_best_fit,
    "op7_prefix_targets": chat.op7_prefix_targets,
    "op8_boosted_toxicity": toxicity.op8_boosted_toxicity,
    "op9_nn_descent": nndescent.op9_nn_descent,
    "op10_matroska": matroska.op10_matroska,
}
SQL = {
    "op3_stupid_backoff": ngrams.SQL,
    "op5_recompression": recompression.SQL,
    "op7_prefix_targets": chat.SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
