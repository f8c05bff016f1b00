"""The queries of this subpackage, one a operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, jaccard, jpeg, lm, oracles, packing, quality, substring, urls, warc


def queries() -> dict:
    return {
        "op1_lm_scoring": lm.op1,
        "op2_url_filter": urls.op2,
        "op3_substring_dedup": substring.op3,
        "op4_packing": packing.op4,
        "op5_bpe": bpe.op5,
        "op6_warc": warc.op6,
        "op7_jaccard_join": jaccard.op7,
        "op8_ann": ann.op8,
        "op9_progressive_jpeg": jpeg.op9,
        "op10_quality": quality.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": oracles.OP2, "op3_substring_dedup": oracles.OP3, "op6_warc": oracles.OP6, "op7_jaccard_join": oracles.OP7}
