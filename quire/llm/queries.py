"""Registry of the subpackage: query name -> callable, and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm import exact_dedup, fill_middle, html_text, licenses, manifest, mixing, packing, quality, repeats, simhash, topk, toxicity, warc

MODULES = {
    "op1_exact_dedup": exact_dedup,
    "op2_toxicity": toxicity,
    "op3_source_mix": mixing,
    "op4_exact_topk": topk,
    "op5_packing": packing,
    "op6_warc": warc,
    "op7_license_scan": licenses,
    "op8_html_text": html_text,
    "op9_simhash_near_dedup": simhash,
    "op10_quality": quality,
    "op11_merkle_manifest": manifest,
    "op12_fill_in_middle": fill_middle,
    "op13_suffix_dedup": repeats,
}
QUERIES = {name: module.query for name, module in MODULES.items()}
ORACLES = {name: module.SQL for name, module in MODULES.items() if module.SQL}
