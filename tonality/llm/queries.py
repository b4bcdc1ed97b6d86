"""The registered queries of this subpackage: name -> (builder, DuckDB SQL or None)."""
from __future__ import annotations

import corpus_pipeline
from tonality.llm import collocations, decontaminate, grammar_output, jaccard_join, license_scan, line_dedup, pfair, pii_crf, prefix_trie, suffix_tree, token_counts, topk, toxicity


def registered() -> dict:
    return {
        "op1_suffix_tree": (suffix_tree.op1_suffix_tree, None),
        "op2_toxicity": (toxicity.op2_toxicity, None),
        "op3_line_dedup": (line_dedup.op3_line_dedup, line_dedup.SQL),
        "op4_grammar_output": (grammar_output.op4_grammar_output, None),
        "op5_pii_crf": (pii_crf.op5_pii_crf, None),
        "op6_pfair_mix": (pfair.op6_pfair_mix, pfair.SQL),
        "op7_topk_search": (topk.op7_topk_search, topk.SQL),
        "op8_license_scan": (license_scan.op8_license_scan, license_scan.SQL),
        "op9_jaccard_join": (jaccard_join.op9_jaccard_join, None),
        "op10_decontaminate": (decontaminate.op10_decontaminate, None),
        "op11_prefix_trie": (prefix_trie.op11_prefix_trie, prefix_trie.SQL),
        "op12_collocations": (collocations.op12_collocations, collocations.SQL),
        "op13_token_counts": (token_counts.op13_token_counts, None),
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
