"""The queries of the corpus operators, one for each, and the SQL of those that SQL can express."""

from palisade.llm import bpe, decontaminate, exact_dedup, html_extract, language, licenses, near_dedup, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_licenses": licenses.op2_licenses,
    "op3_html": html_extract.op3_html,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_language": language.op9_language,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
}
