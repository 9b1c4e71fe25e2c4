"""Registry of the training-data queries and of the SQL that checks them."""

from trafficwarden.llm import ann, chat, decontaminate, fim, html_text, kmeans, language, licenses, neardup, packing, pii, sentences, tokens

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_nearest": ann.op2_nearest,
    "op3_tokens": tokens.op3_tokens,
    "op4_html": html_text.op4_html,
    "op5_packing": packing.op5_packing,
    "op6_language": language.op6_language,
    "op7_preferences": chat.op7_preferences,
    "op8_pii": pii.op8_pii,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_neardup": neardup.op10_neardup,
    "op11_sentencepiece": sentences.op11_sentencepiece,
    "op12_fim": fim.op12_fim,
    "op13_clusters": kmeans.op13_clusters,
}

ORACLE_SQL = {
    "op1_licenses": licenses.OP1_SQL,
    "op7_preferences": chat.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op12_fim": fim.OP12_SQL,
    "op13_clusters": kmeans.OP13_SQL,
}
