"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from riskloom.llm import (
    decontamination, fill_in_middle, hash_index, licences, mixing, quality_rules, quality_trees, runs, sharding, simhash,
    token_store, toxicity, url_filter,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_token_store": token_store.op4_token_store,
    "op5_licences": licences.op5_licences,
    "op6_mixing": mixing.op6_mixing,
    "op7_hash_tree": sharding.op7_hash_tree,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_trees": quality_trees.op9_quality_trees,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_hash_index": hash_index.op13_hash_index,
}
ORACLES = {"op7_hash_tree": sharding.OP7_SQL, "op1_quality_rules": quality_rules.OP1_SQL, "op2_decontamination": decontamination.OP2_SQL, "op12_fill_in_middle": fill_in_middle.OP12_SQL}
