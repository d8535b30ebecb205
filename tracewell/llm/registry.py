"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from . import bpe, fixity, lm, minhash, mixing, negatives, neighbours, parsing, perplexity, quality_rules, toxicity, whitening, winnowing


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_ppm": lm.op2_ppm,
        "op3_collision_counting": neighbours.op3_collision_counting,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_near_duplicates": minhash.op6_near_duplicates,
        "op7_repeated_spans": parsing.op7_repeated_spans,
        "op8_warc_fixity": fixity.op8_warc_fixity,
        "op9_poisson_mix": mixing.op9_poisson_mix,
        "op10_quality_classifier": perplexity.op10_quality_classifier,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_winnowing": winnowing.op12_winnowing,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_fixity": fixity.OP8_SQL, "op9_poisson_mix": mixing.OP9_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_winnowing": winnowing.OP12_SQL}
