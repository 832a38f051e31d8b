"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from groundsearch.llm import html, language, licenses, media, mixing, packing, quality, simhash, substring, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_media": media.op3_media,
    "op4_html": html.op4_html,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring": substring.op6_substring,
    "op7_mix": mixing.op7_mix,
    "op8_quality": quality.op8_quality,
    "op9_language": language.op9_language,
    "op10_licenses": licenses.op10_licenses,
}

ORACLES: dict[str, str] = {
    "op8_quality": quality.OP8_SQL,
    "op10_licenses": licenses.op10_sql(),
}
