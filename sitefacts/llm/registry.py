"""Queries of this subpackage and their SQL."""

from . import chat, decontaminate, html_text, importance, language, licenses, media, packing, pii, quality, repair, simhash, toxicity


def queries():
    return {f.__name__: f for f in (media.op1_media_columns, chat.op2_chat_formatting, decontaminate.op3_benchmark_decontamination, licenses.op4_license_scan, simhash.op5_simhash_near_dedup, quality.op6_quality_classifier, html_text.op7_html_extraction, pii.op8_pii, language.op9_language_id, packing.op10_packing, toxicity.op11_toxicity, repair.op12_structure_repair, importance.op13_importance_resampling)}


def oracle_sql():
    return {"op2_chat_formatting": chat.ORACLE, "op13_importance_resampling": importance.ORACLE}
