"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, hard_negatives, jaccard_join, lexical_search, license_scan, mixing, quality, secret_scan, sentence_pieces, token_count, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_count": token_count.op7_token_count,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_ann": ann.op9_ann,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_sentencepiece": sentence_pieces.op12_sentencepiece,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_secret_scan": secret_scan.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
