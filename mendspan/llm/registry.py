"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from mendspan.llm import chosen_path, language, licenses, lines, mixing, passages, perplexity, private, templates, topk

QUERIES = {
    "op1_private": private.op1_private,
    "op2_topk": topk.op2_topk,
    "op3_lines": lines.op3_lines,
    "op4_mixing": mixing.op4_mixing,
    "op5_language": language.op5_language,
    "op6_passages": passages.op6_passages,
    "op7_quality": perplexity.op7_quality,
    "op8_jaccard_join": chosen_path.op8_jaccard_join,
    "op9_decontaminate": templates.op9_decontaminate,
    "op10_licenses": licenses.op10_licenses,
}

ORACLE_SQL = {
    "op2_topk": topk.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_passages": passages.OP6_SQL,
    "op8_jaccard_join": chosen_path.OP8_SQL,
}
