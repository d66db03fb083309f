"""The queries of this package and their DuckDB equivalents, for __spark_entry__.py."""

from loam.llm import collocations, decontaminate, exact_dedup, licenses, line_dedup, maxent, near_dedup, negatives, packing, sanitise, simhash, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_packing": packing.op3_packing,
    "op4_sanitise": sanitise.op4_sanitise,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_lm_scoring": maxent.op7_lm_scoring,
    "op8_warc": warc.op8_warc,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_simhash": simhash.op12_simhash,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLES = {"op8_warc": warc.OP8_SQL, "op9_decontamination": decontaminate.OP9_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op11_collocations": collocations.OP11_SQL, "op13_hard_negatives": negatives.OP13_SQL}
