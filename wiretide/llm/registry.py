"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from wiretide.llm import boilerplate, bpe, chat, convrepair, decontam, langid, linededup, personal, phrases, quality, secrets, simhash, substring

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_html_extraction": boilerplate.op9_html_extraction,
    "op10_language_id": langid.op10_language_id,
    "op11_personal_data": personal.op11_personal_data,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_conversation_repair": convrepair.op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_substring_dedup": substring.ORACLE_OP2,
    "op3_quality_rules": quality.ORACLE_OP3,
    "op4_chat_formatting": chat.ORACLE_OP4,
    "op7_benchmark_decontamination": decontam.ORACLE_OP7,
    "op8_line_dedup": linededup.ORACLE_OP8,
    "op12_phrase_collocations": phrases.ORACLE_OP12,
    "op13_conversation_repair": convrepair.ORACLE_OP13,
}
