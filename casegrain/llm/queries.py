"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from .decontaminate import op3_decontamination
from .html_text import op10_html_extraction
from .packing import op1_packing
from .quality import op5_quality_rules
from .simhash import op6_simhash_near_dedup
from .suffix_dedup import op4_suffix_array_dedup
from .token_counts import op8_token_counts
from .token_files import op2_token_files
from .toxicity import op9_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
}

ORACLES: dict[str, str] = {
    "op7_warc": OP7_SQL,
}
