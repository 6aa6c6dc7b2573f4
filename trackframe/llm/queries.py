"""The registered queries of this package and their SQL."""

from __future__ import annotations

from trackframe.llm import exact_dedup, html_text, langid, lm_scoring, merkle, mixing, order_minhash, pieces, pii, sharding, simhash, token_counts, whitening
from trackframe.llm.common import shipped

QUERIES = {name: shipped(fn) for name, fn in {
    "op1_mixing": mixing.query,
    "op2_sharding": sharding.query,
    "op3_language_id": langid.query,
    "op4_order_minhash": order_minhash.query,
    "op5_pii": pii.query,
    "op7_html_text": html_text.query,
    "op6_simhash": simhash.query,
    "op10_lm_scoring": lm_scoring.query,
    "op9_sentencepiece": pieces.query,
    "op8_exact_dedup": exact_dedup.query,
    "op11_token_counts": token_counts.query,
    "op12_whitening": whitening.query,
    "op13_merkle": merkle.query,
}.items()}
ORACLE = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op13_merkle": merkle.SQL,
}
