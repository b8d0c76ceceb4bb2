"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import archives, contamination, contextmix, lines, mixing, nearcopies, passages, secrets, suffixes, tokens

QUERIES = {
    "op1_warc": archives.op1_warc,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_context_mixing": contextmix.op3_context_mixing,
    "op4_quality": lines.op4_quality,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_mix": mixing.op6_mix,
    "op7_secrets": secrets.op7_secrets,
    "op8_passages": passages.op8_passages,
    "op9_near_copies": nearcopies.op9_near_copies,
    "op10_decontaminate": contamination.op10_decontaminate,
}

ORACLES = {
    "op1_warc": archives.OP1_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op8_passages": passages.OP8_SQL,
    "op9_near_copies": nearcopies.OP9_SQL,
    "op10_decontaminate": contamination.OP10_SQL,
}
