"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op10_embeddings
from .fingerprints import op9_fingerprints
from .html import op3_html
from .jaccard import OP4_SQL, op4_jaccard
from .lines import OP2_SQL, op2_lines
from .mixing import op7_mixing
from .packing import op5_packing
from .periods import op12_periods
from .phrases import OP13_SQL, op13_phrases
from .quality import op1_quality
from .sharding import op6_sharding
from .substrings import OP8_SQL, op8_substrings
from .warc import OP11_SQL, op11_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_lines": op2_lines,
    "op3_html": op3_html,
    "op4_jaccard": op4_jaccard,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_substrings": op8_substrings,
    "op9_fingerprints": op9_fingerprints,
    "op10_embeddings": op10_embeddings,
    "op11_warc": op11_warc,
    "op12_periods": op12_periods,
    "op13_phrases": op13_phrases,
}

#: The others need a model, a tokenizer, bit votes, a curve, a seeded permutation or every period: tests hold those.
ORACLE: dict[str, str] = {"op2_lines": OP2_SQL, "op4_jaccard": OP4_SQL, "op8_substrings": OP8_SQL, "op11_warc": OP11_SQL, "op13_phrases": OP13_SQL}
