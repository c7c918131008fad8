"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .bpe import op5_byte_bpe
from .chat import OP2_SQL, op2_chat_perspectives
from .linededup import OP10_SQL, op10_line_dedup
from .media import op1_media_columns
from .minhash import op4_minhash_near_dedup
from .mixing import op8_source_mixing
from .outliers import op9_quality_rules
from .periodic import op12_periodic_runs
from .pieces import op13_sentencepiece
from .secrets import op3_secret_scans
from .token_counts import op6_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_chat_perspectives,
        op3_secret_scans,
        op4_minhash_near_dedup,
        op5_byte_bpe,
        op6_token_counts,
        op7_toxicity,
        op8_source_mixing,
        op9_quality_rules,
        op10_line_dedup,
        op11_token_alignment,
        op12_periodic_runs,
        op13_sentencepiece,
    )
}
ORACLE_SQL = {"op2_chat_perspectives": OP2_SQL, "op10_line_dedup": OP10_SQL}
