"""The corpus queries and their SQL."""

from . import decontaminate, itq, language, lattice, mixing, secret_scan, sentence_spans, simhash, token_counts, warc

QUERIES = {
    "op1_subword_lattice": lattice.op1_subword_lattice,
    "op2_derivatives": warc.op2_derivatives,
    "op3_iterative_quantisation": itq.op3_iterative_quantisation,
    "op4_vantage_point": simhash.op4_vantage_point,
    "op5_aho_corasick": decontaminate.op5_aho_corasick,
    "op6_randomness_battery": secret_scan.op6_randomness_battery,
    "op7_sentence_spans": sentence_spans.op7_sentence_spans,
    "op8_string_kernel": language.op8_string_kernel,
    "op9_entropy_balancing": mixing.op9_entropy_balancing,
    "op10_offset_attribution": token_counts.op10_offset_attribution,
}
SQL = {"op3_iterative_quantisation": itq.SQL_3, "op5_aho_corasick": decontaminate.SQL_5}
