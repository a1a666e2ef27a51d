"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op1_decontamination
from .packing import op8_packing
from .quality import op2_quality
from .search import op7_search
from .secret_scan import op10_secret_scan
from .sharding import op4_ring_shards
from .simhash import op3_simhash
from .suffix_tree import op6_suffix_tree
from .toxicity import op9_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_ring_shards": op4_ring_shards,
    "op5_warc": op5_warc,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_search": op7_search,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES: dict[str, str] = {
    "op5_warc": OP5_SQL,
}
