"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from ..functions.messages import MESSAGE
from ..functions.numbers import BREAKDOWN

EVAL = "developer string, user string, expected_km double, expected_value double, expected_unit string, fmt string, alat double, alon double, blat double, blon double"
TRAIN = f"developer string, user string, analysis string, final string, messages array<{MESSAGE}>"
OUTPUTS = "idx bigint, model_output_raw string"
_BREAKDOWN = "struct<" + ",".join(f"{n}:int" for n in BREAKDOWN) + ">"
RESULTS = f"""idx bigint, developer string, user string, model_input_rendered string, final_seen_in_pass1 boolean, forced_final_inserted boolean, model_output_raw string, model_output_final string, model_output_analysis string, expected_km double,
 parsed_value double, parsed_unit_raw string, parsed_unit_norm string, assumed_unit_for_match string, parsed_km double, rel_error double, bucket string, points int,
 score_breakdown {_BREAKDOWN}, span_start int, span_end int, used_analysis_fallback boolean"""
