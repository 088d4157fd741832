"""The registered queries of this folder and their SQL for DuckDB, where SQL can say it."""

from shelfwise.llm import (
    decontaminate, exact_dedup, html_text, language_id, packing, quality, sharding, simhash, spelling, token_counts, url_filter,
    warc, whitening,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_html_text": html_text.op8_html_text,
    "op9_language_id": language_id.op9_language_id,
    "op10_packing": packing.op10_packing,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_whitening": whitening.op12_whitening,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
}
