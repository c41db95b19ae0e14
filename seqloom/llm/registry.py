"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import attention, bpe, decontaminate, divergence, iblt, kneser_ney, manifest, pii, simhash, suffix_dedup, toxicity, warc, wavelet


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_fingerprint": iblt.op2_fingerprint,
        "op3_wavelet": wavelet.op3_wavelet,
        "op4_bpe": bpe.op4_bpe,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_pii": pii.op6_pii,
        "op7_simhash": simhash.op7_simhash,
        "op8_lm": attention.op8_lm,
        "op9_quality": kneser_ney.op9_quality,
        "op10_warc_fixity": warc.op10_warc_fixity,
        "op11_manifest": manifest.op11_manifest,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op5_suffix_dedup": suffix_dedup.OP5_SQL,
        "op10_warc_fixity": warc.OP10_SQL,
        "op11_manifest": manifest.OP11_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
