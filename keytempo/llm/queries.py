"""The registered text queries and, where SQL can say them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from keytempo.llm import (
    block_dedup,
    bpe,
    chat,
    decontamination,
    embedding_dedup,
    language_id,
    merkle,
    ngram_join,
    oracles,
    packing,
    pii,
    resampling,
    sharding,
    suffix_dedup,
)

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_perspective_rotation": chat.op2_perspective_rotation,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_surrogates": pii.op7_surrogates,
    "op8_language_id": language_id.op8_language_id,
    "op10_fixed_block_anchors": block_dedup.op10_fixed_block_anchors,
    "op9_feistel_shards": sharding.op9_feistel_shards,
    "op11_forced_boundary_bpe": bpe.op11_forced_boundary_bpe,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES = {
    "op3_suffix_dedup": oracles.BYTE_RUNS,
    "op5_ngram_jaccard": oracles.JACCARD,
    "op9_feistel_shards": oracles.SHARDS,
    "op10_fixed_block_anchors": oracles.WORD_RUNS,
    "op2_perspective_rotation": oracles.PERSPECTIVES,
    "op12_merkle_manifest": oracles.MANIFEST,
    "op13_importance_resampling": oracles.RESAMPLED,
}
