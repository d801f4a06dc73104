"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, language, licenses, lines, pieces, quality, simhash, surrogates, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scan, decontaminate.op2_decontamination, url_filter.op3_url_filter, quality.op4_quality_rules, language.op5_language_id,
        toxicity.op6_toxicity, surrogates.op7_surrogates, simhash.op8_simhash, lines.op9_line_dedup, pieces.op10_pieces,
    )
}
SQL = {"op3_url_filter": url_filter.SQL, "op9_line_dedup": lines.SQL}
