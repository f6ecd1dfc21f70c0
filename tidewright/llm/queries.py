"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidewright.llm import bpe, chat, licences, minhash, mixing, packing, periodic, quality_cnn, quality_rules, records, subspace, suffix_tree, vector_codes

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_mixing": mixing.op2,
    "op3_quality_cnn": quality_cnn.op3,
    "op4_suffix_tree": suffix_tree.op4,
    "op5_subspace_join": subspace.op5,
    "op6_token_records": records.op6,
    "op7_licences": licences.op7,
    "op8_minhash": minhash.op8,
    "op9_chat": chat.op9,
    "op10_quality_rules": quality_rules.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_bpe": bpe.op12,
    "op13_periodic_runs": periodic.op13,
}
SQL = {
    "op5_subspace_join": subspace.OP5_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_periodic_runs": periodic.OP13_SQL,
}
