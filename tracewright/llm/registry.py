"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, lines, packing, passages, pii, quality, sharding, simhash, vectors

QUERIES = {f.__name__: f for f in (
    sharding.op1_sharding,
    lines.op2_line_dedup,
    decontaminate.op3_benchmark_decontamination,
    simhash.op4_simhash_near_dedup,
    quality.op5_quality_classifier,
    pii.op6_pii,
    passages.op7_substring_dedup,
    vectors.op8_embedding_near_dedup,
    packing.op9_packing,
    language.op10_language_id,
)}
ORACLES: dict[str, str] = {"op2_line_dedup": lines.OP2_SQL, "op3_benchmark_decontamination": decontaminate.OP3_SQL, "op8_embedding_near_dedup": vectors.OP8_SQL}
