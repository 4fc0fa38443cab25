"""The queries of this subpackage for the driver's contract."""

from __future__ import annotations

from . import bpe, distinct, importance, jaccard, language, linededup, media, mixing, quality, rules, search, secrets, sharding

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_secrets": secrets.op2_secrets,
    "op3_bpe": bpe.op3_bpe,
    "op4_language": language.op4_language,
    "op5_sharding": sharding.op5_sharding,
    "op6_search": search.op6_search,
    "op7_media": media.op7_media,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_quality": quality.op10_quality,
    "op11_rules": rules.op11_rules,
    "op12_importance": importance.op12_importance,
    "op13_distinct": distinct.op13_distinct,
}

ORACLE_SQL = {"op6_search": search.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op11_rules": rules.ORACLE_SQL, "op12_importance": importance.ORACLE_SQL}
