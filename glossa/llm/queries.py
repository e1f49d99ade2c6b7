"""The queries of the operators and their SQL."""

from glossa.llm import op1_mixing, op2_jaccard, op3_secrets, op4_media, op5_decontamination, op6_quality, op7_html, op8_pii, op9_sharding, op10_warc, op11_exact, op12_merkle, op13_lexical

QUERIES = {
    "op1_mixing": op1_mixing.op1_mixing,
    "op2_jaccard": op2_jaccard.op2_jaccard,
    "op3_secrets": op3_secrets.op3_secrets,
    "op4_media": op4_media.op4_media,
    "op5_decontamination": op5_decontamination.op5_decontamination,
    "op6_quality": op6_quality.op6_quality,
    "op7_html": op7_html.op7_html,
    "op8_pii": op8_pii.op8_pii,
    "op9_sharding": op9_sharding.op9_sharding,
    "op10_warc": op10_warc.op10_warc,
    "op11_exact": op11_exact.op11_exact,
    "op12_merkle": op12_merkle.op12_merkle,
    "op13_lexical": op13_lexical.op13_lexical,
}

SQL = {"op1_mixing": op1_mixing.SQL, "op10_warc": op10_warc.SQL, "op11_exact": op11_exact.SQL, "op12_merkle": op12_merkle.SQL, "op13_lexical": op13_lexical.SQL}
