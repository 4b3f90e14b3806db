"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, fill_middle, fingerprint, html, katz, language, minhash, packing, pii, ranked_search, token_count, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_katz": katz.op3_katz,
    "op4_packing": packing.op4_packing,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_language": language.op7_language,
    "op8_minhash": minhash.op8_minhash,
    "op9_pii": pii.op9_pii,
    "op10_html": html.op10_html,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_token_count": token_count.op12_token_count,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_packing": packing.OP4_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
