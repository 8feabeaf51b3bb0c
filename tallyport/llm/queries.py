"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tallyport.llm import (
    op1_licenses,
    op2_quality,
    op3_html,
    op4_chat,
    op5_packing,
    op6_decontamination,
    op7_near_dedup,
    op8_toxicity,
    op9_warc,
    op10_quality_rules,
    op11_spelling,
    op12_topk,
    op13_collocations,
)

MODULES = (op1_licenses, op2_quality, op3_html, op4_chat, op5_packing, op6_decontamination, op7_near_dedup, op8_toxicity, op9_warc, op10_quality_rules, op11_spelling, op12_topk, op13_collocations)
QUERIES: dict = {m.NAME: m.query for m in MODULES}


def oracles() -> dict[str, str]:
    """The DuckDB SQL of those that have it; the licence model is trained for it when it is first asked for."""
    return {op1_licenses.NAME: op1_licenses.oracle()} | {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
