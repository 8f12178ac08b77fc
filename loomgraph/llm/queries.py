"""The corpus queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from loomgraph.llm import chat, decontaminate, html, langid, licenses, mixing, quality, secrets, simhash, substrings

QUERIES = {
    "op1_substring_dedup": substrings.op1,
    "op2_secret_scan": secrets.op2,
    "op3_license_scan": licenses.op3,
    "op4_mix_sources": mixing.op4,
    "op5_quality_rules": quality.op5,
    "op6_simhash_dedup": simhash.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_chat_format": chat.op8,
    "op9_html_extract": html.op9,
    "op10_language_id": langid.op10,
}
SQL = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_chat_format": chat.OP8_SQL,
}
