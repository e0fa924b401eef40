"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, html, language, mixing, packing, quality, simhash, sketch, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_language": language.op2_language,
    "op3_html": html.op3_html,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_ann": ann.op7_ann,
    "op8_sketch": sketch.op8_sketch,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {"op1_url_filter": url_filter.SQL, "op9_mixing": mixing.SQL}
