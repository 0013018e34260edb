"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .alignment import op11_event_sweep
from .decontaminate import op7_decontaminate
from .interpolated_lm import op9_interpolated_lm
from .mixing import op5_mixing
from .pii import op2_pii
from .quality_mcd import op1_quality_mcd
from .setsketch import OP6_SQL, op6_setsketch
from .sharding import op10_sharding, op10_sql
from .structure_repair import OP13_SQL, op13_structure_repair
from .substring_cover import OP4_SQL, op4_substring_cover
from .suffix_dedup import OP8_SQL, op8_suffix_dedup
from .token_coder import op3_token_coder
from .toxicity import op12_factor_toxicity


def queries() -> dict:
    return {
        "op1_quality_mcd": op1_quality_mcd,
        "op2_pii": op2_pii,
        "op3_token_coder": op3_token_coder,
        "op4_substring_cover": op4_substring_cover,
        "op5_mixing": op5_mixing,
        "op6_setsketch": op6_setsketch,
        "op7_decontaminate": op7_decontaminate,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_interpolated_lm": op9_interpolated_lm,
        "op10_sharding": op10_sharding,
        "op11_event_sweep": op11_event_sweep,
        "op12_factor_toxicity": op12_factor_toxicity,
        "op13_structure_repair": op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_cover": OP4_SQL, "op6_setsketch": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op10_sharding": op10_sql(), "op13_structure_repair": OP13_SQL}
