"""Registry of the corpus operators' queries and of their SQL twins."""

from __future__ import annotations

from . import decontaminate, licences, lm_scoring, mixing, sharding, simhash, spelling, token_counts, tool_calls, top_k, toxicity, vector_codes, warc

QUERIES = {
    "op1_lm_score": lm_scoring.op1_lm_score,
    "op2_top_k": top_k.op2_top_k,
    "op3_warc": warc.op3_warc,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mix": mixing.op5_mix,
    "op6_tool_calls": tool_calls.op6_tool_calls,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_shard": sharding.op10_shard,
    "op11_spelling": spelling.op11_spelling,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_licences": licences.op13_licences,
}

ORACLE_SQL = {
    "op2_top_k": top_k.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op6_tool_calls": tool_calls.OP6_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
