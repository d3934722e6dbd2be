"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat import op3_chat_format
from .decontaminate import op7_decontamination
from .html_extract import op2_html_extract
from .line_dedup import OP8_SQL, op8_line_dedup
from .near_dedup import op5_near_dedup
from .quality import OP9_SQL, op9_quality_rules
from .secrets import op1_secrets
from .sharding import op10_sharding
from .token_store import op4_token_ids


def queries() -> dict:
    return {
        "op1_secrets": op1_secrets,
        "op2_html_extract": op2_html_extract,
        "op3_chat_format": op3_chat_format,
        "op4_token_ids": op4_token_ids,
        "op5_near_dedup": op5_near_dedup,
        "op6_bpe": op6_bpe,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict:
    return {"op8_line_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL}
