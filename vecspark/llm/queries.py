"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import bpe, gif, jaccard, lines, masked_lm, mixing, pii, sharding, simhash, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_shards": sharding.op5_shards,
    "op6_masked_lm": masked_lm.op6_masked_lm,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_gif": gif.op9_gif,
    "op10_mix_sources": mixing.op10_mix_sources,
}

SQL = {
    "op2_line_dedup": lines.OP2_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
}
