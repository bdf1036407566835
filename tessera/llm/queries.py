"""The thin queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.chat import op6_chat
from tessera.llm.cover_dedup import op8_cover_dedup
from tessera.llm.decontaminate import ORACLE_SQL as DECONTAMINATE
from tessera.llm.decontaminate import op13_decontaminate
from tessera.llm.embedding_join import op4_embedding_join
from tessera.llm.filter_audit import ORACLE_SQL as AUDIT
from tessera.llm.filter_audit import op12_filter_audit
from tessera.llm.manifest import ORACLE_SQL as MANIFEST
from tessera.llm.manifest import op11_manifest
from tessera.llm.merge_dropout import op10_merge_dropout
from tessera.llm.near_pairs import connected_groups, near_duplicate_pairs
from tessera.llm.ngram_join import op5_ngram_join
from tessera.llm.oracles import ORACLE_SQL as PLAIN
from tessera.llm.outliers import op7_outliers
from tessera.llm.packing import op3_packing
from tessera.llm.pii import op9_pii
from tessera.llm.quality import op1_quality
from tessera.llm.suffix_dedup import op2_suffix_dedup

QUERIES = {
    # in place of the plain joins of tessera.plans.corpus, whose SQL they have
    "near_duplicate_pairs": near_duplicate_pairs,
    "connected_groups": connected_groups,
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_packing": op3_packing,
    "op4_embedding_join": op4_embedding_join,
    "op5_ngram_join": op5_ngram_join,
    "op6_chat": op6_chat,
    "op7_outliers": op7_outliers,
    "op8_cover_dedup": op8_cover_dedup,
    "op9_pii": op9_pii,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_manifest": op11_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontaminate": op13_decontaminate,
}
ORACLE_SQL = PLAIN | {"op11_manifest": MANIFEST, "op12_filter_audit": AUDIT, "op13_decontaminate": DECONTAMINATE}
__all__ = ["ORACLE_SQL", "QUERIES"]
