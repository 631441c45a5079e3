"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, disclosure, infill, langid, media, mixing, negatives, quality, secrets, simhash, suffixes, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secrets": secrets.op3_secrets,
    "op4_language_id": langid.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_simhash": simhash.op8_simhash,
    "op9_chat": chat.op9_chat,
    "op10_suffixes": suffixes.op10_suffixes,
    "op11_infill": infill.op11_infill,
    "op12_negatives": negatives.op12_negatives,
    "op13_disclosure": disclosure.op13_disclosure,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_chat": chat.OP9_SQL,
    "op11_infill": infill.OP11_SQL,
    "op12_negatives": negatives.OP12_SQL,
    "op13_disclosure": disclosure.OP13_SQL,
}
