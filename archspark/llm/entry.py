"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import audio, decontaminate, langid, licenses, lines, mixing, neardup, secrets, substrings, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_line_dedup": lines.op2,
    "op3_audio_features": audio.op3,
    "op4_license_scan": licenses.op4,
    "op5_mix_sources": mixing.op5,
    "op6_url_filter": urls.op6,
    "op7_secret_scan": secrets.op7,
    "op8_suffix_dedup": substrings.op8,
    "op9_near_dedup": neardup.op9,
    "op10_language_id": langid.op10,
    "op10_language_id_pages": langid.op10_pages,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_line_dedup": lines.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op6_url_filter": urls.ORACLE,
    "op9_near_dedup": neardup.oracle(),
}
