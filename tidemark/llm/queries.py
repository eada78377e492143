"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, fim, fingerprints, jaccard_join, licenses, mixture, quality_classifier, quality_rules, sentencepiece, spelling, toxicity, url_filter, warc

QUERIES = {
    "op1_mixture": mixture.op1_mixture,
    "op2_licenses": licenses.op2_licenses,
    "op3_warc": warc.op3_warc,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_sentencepiece": sentencepiece.op8_sentencepiece,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_spelling": spelling.op12_spelling,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op1_mixture": mixture.ORACLE,
    "op2_licenses": licenses.ORACLE,
    "op3_warc": warc.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
