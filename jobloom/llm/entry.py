"""The queries of this subpackage, by the names under which the driver calls them."""

from __future__ import annotations

from . import bpe, embed_join, htmltext, langid, media, merkle, mixing, ngram_join, oracles, phrases, secrets, sharding, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_language_id": langid.op1,
        "op2_source_mix": mixing.op2,
        "op3_html_text": htmltext.op3,
        "op4_substring_dedup": substring_dedup.op4,
        "op5_media_columns": media.op5,
        "op6_embedding_join": embed_join.op6,
        "op7_secret_scan": secrets.op7,
        "op8_shards": sharding.op8,
        "op9_ngram_join": ngram_join.op9,
        "op10_byte_bpe": bpe.op10,
        "op11_toxicity": toxicity.op11,
        "op12_phrases": phrases.op12,
        "op13_merkle_manifest": merkle.op13,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; ``tests/llm`` holds the others against brute force, round trips or held-out rows."""
    return {"op3_html_text": oracles.OP3, "op4_substring_dedup": oracles.OP4, "op6_embedding_join": oracles.OP6, "op9_ngram_join": oracles.OP9, "op12_phrases": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
