"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from . import align, bpe, chat, decontaminate, hmm, langid, negatives, packing, simhash, substrings, token_counts, topk, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_hmm": hmm.op4_hmm,
    "op5_langid": langid.op5_langid,
    "op6_chat": chat.op6_chat,
    "op7_warc": warc.op7_warc,
    "op8_topk": topk.op8_topk,
    "op9_substrings": substrings.op9_substrings,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_alignment": align.op12_alignment,
    "op13_packing": packing.op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat": chat.SQL,
    "op7_warc": warc.SQL,
    "op8_topk": topk.SQL,
    "op11_hard_negatives": negatives.SQL,
}
