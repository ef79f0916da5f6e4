"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, media, minhash_dedup, mixing, quality, secrets, substring_dedup, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_chat_snapshots": chat.op5_chat_snapshots,
    "op6_poisson_mix": mixing.op6_poisson_mix,
    "op7_quality_trees": quality.op7_quality_trees,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_media_columns": media.op9_media_columns,
    "op10_warc_revisits": warc.op10_warc_revisits,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_snapshots": chat.OP5_SQL,
    "op6_poisson_mix": mixing.OP6_SQL,
    "op10_warc_revisits": warc.OP10_SQL,
}
