"""Registry of the corpus queries and of the SQL that some of them can be held against."""

from __future__ import annotations

from . import align, bpe, chat, langid, media, mixing, neardup, pii, spelling, topk, toxicity, warc, wordbpe


def queries() -> dict:
    return {
        "op1_media_columns": media.op1, "op2_exact_topk": topk.op2, "op3_source_mixing": mixing.op3, "op4_chat_format": chat.op4, "op5_toxicity": toxicity.op5, "op6_bpe_round_trip": bpe.op6,
        "op7_warc": warc.op7, "op8_surrogates": pii.op8, "op9_language_id": langid.op9, "op10_near_duplicates": neardup.op10,
        "op11_token_alignment": align.op11, "op12_spelling_variants": spelling.op12, "op13_word_bpe": wordbpe.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": topk.SQL, "op12_spelling_variants": spelling.SQL}
