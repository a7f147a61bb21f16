"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .packing import op5_packing
from .token_file import op6_token_file

from .decontaminate import op3_decontaminate
from .quality import op4_quality_ranking
from .toxicity import op7_toxic_segments
from .html_extract import op10_wrapper_text
from .url_filter import op2_path_templates
from .line_dedup import op1_line_dedup
from .near_dedup import op9_jaccard_join
from .periodic_runs import op11_periodic_runs
from .clustering import OP12_SQL, op12_dual_tree_lloyd
from .neighbours import OP13_SQL, op13_rotated_codes

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_path_templates": op2_path_templates,
    "op10_wrapper_text": op10_wrapper_text,
    "op4_quality_ranking": op4_quality_ranking,
    "op7_toxic_segments": op7_toxic_segments,
    "op3_decontaminate": op3_decontaminate,
    "op9_jaccard_join": op9_jaccard_join,
    "op5_packing": op5_packing,
    "op6_token_file": op6_token_file,
    "op8_exact_dedup": op8_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_rotated_codes": op13_rotated_codes,
}
SQL = {"op8_exact_dedup": OP8_SQL, "op12_dual_tree_lloyd": OP12_SQL, "op13_rotated_codes": OP13_SQL}
