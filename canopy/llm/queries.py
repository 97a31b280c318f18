"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from .bpe import op10_bpe
from .decontaminate import OP6_SQL, op6_decontaminate
from .language import op2_language
from .quality import op9_quality_rules
from .sharding import op7_sharding
from .simhash import op4_simhash
from .substrings import op5_substrings
from .token_planes import op8_token_planes
from .url_filter import op3_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_language, op3_url_filter, op4_simhash, op5_substrings, op6_decontaminate, op7_sharding, op8_token_planes, op9_quality_rules, op10_bpe)}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op6_decontaminate": OP6_SQL}
