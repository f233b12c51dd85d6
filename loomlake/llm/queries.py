"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, embed_dedup, exact_dedup, merkle, mixing, passage_dedup, quality, sharding, simhash, token_files, toxicity, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_dedup": passage_dedup.op8_suffix_dedup,
    "op9_embed_dedup": embed_dedup.op9_embed_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_merkle": merkle.op11_merkle,
    "op12_token_files": token_files.op12_token_files,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op8_suffix_dedup": passage_dedup.OP8_SQL,
    "op9_embed_dedup": embed_dedup.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
