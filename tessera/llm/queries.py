"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from . import align_tokens, chat_format, decontaminate, html_extract, language_id, mixing, near_embeddings, personal_data, resample, sharding, simhash_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_near_embeddings": near_embeddings.op1,
    "op2_chat_format": chat_format.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_mix_sources": mixing.op4,
    "op5_simhash_dedup": simhash_dedup.op5,
    "op6_language_id": language_id.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_toxicity": toxicity.op8,
    "op9_html_text": html_extract.op9,
    "op10_shard": sharding.op10,
    "op11_resample": resample.op11,
    "op12_align_tokens": align_tokens.op12,
    "op13_personal_data": personal_data.op13,
}
ORACLES = {"op2_chat_format": chat_format.OP2_SQL, "op3_decontaminate": decontaminate.OP3_SQL, "op11_resample": resample.OP11_SQL}
