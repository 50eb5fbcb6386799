"""The registered queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, golden_record, html_extract, line_dedup, ngram_join, quality_classifier, quality_rules, token_files, toxicity, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_byte_bpe": bpe.query,
    "op3_ngram_join": ngram_join.query,
    "op4_toxicity": toxicity.query,
    "op5_token_files": token_files.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_warc": warc.query,
    "op8_chat_format": chat_format.query,
    "op9_quality_rules": quality_rules.query,
    "op10_decontaminate": decontaminate.query,
    "op11_golden_record": golden_record.query,
    "op12_vector_codes": vector_codes.query,
    "op13_html_extract": html_extract.query,
}
ORACLES = {
    "op7_warc": warc.oracle(),
    "op8_chat_format": chat_format.oracle(),
    "op9_quality_rules": quality_rules.oracle(),
    "op10_decontaminate": decontaminate.oracle(),
    "op11_golden_record": golden_record.oracle(),
    "op12_vector_codes": vector_codes.oracle(),
}
