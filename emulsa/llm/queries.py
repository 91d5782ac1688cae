"""The queries of this subpackage, by name, with the SQL that DuckDB can run on the same tables."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, forest, licenses, lines, mixing, periods, pii, quality, search, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_warc": warc.op2_warc,
    "op3_token_output": tokens.op3_token_output,
    "op4_simhash": simhash.op4_simhash,
    "op5_personal_data": pii.op5_personal_data,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_minhash_forest": forest.op13_minhash_forest,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": mixing.OP1_SQL, "op2_warc": warc.OP2_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op8_license_scan": licenses.OP8_SQL, "op9_line_dedup": lines.OP9_SQL, "op10_quality_rules": quality.OP10_SQL, "op11_ranked_search": search.OP11_SQL}
