"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op9_chat_format
from .langid import op1_language_id
from .neardup import op7_near_duplicates
from .packing import op6_packing
from .pieces import op5_sampled_pieces
from .ppm import op10_ppm_score
from .quality import op3_quality_rules
from .secret_scan import op2_secret_scan
from .sharding import op8_sharding
from .topk import OP4_SQL, op4_exact_top_k

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_secret_scan,
        op3_quality_rules,
        op4_exact_top_k,
        op5_sampled_pieces,
        op6_packing,
        op7_near_duplicates,
        op8_sharding,
        op9_chat_format,
        op10_ppm_score,
    )
}
ORACLES = {"op4_exact_top_k": OP4_SQL}
