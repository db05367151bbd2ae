"""The corpus queries and their SQL, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.bpe import op4_merge_rounds
from tracewell.llm.kd_shards import op8_kd_tree
from tracewell.llm.language_id import op3_compression_language
from tracewell.llm.line_quality import op1_line_frequency
from tracewell.llm.media_fingerprint import op2_wav_fingerprint
from tracewell.llm.packing import op6_best_two_fit
from tracewell.llm.periodic_runs import op13_lyndon_runs
from tracewell.llm.repeats import op10_radix_repeats
from tracewell.llm.simhash import op9_gray_simhash
from tracewell.llm.spelling import ORACLE_SQL as SPELLING_SQL
from tracewell.llm.spelling import op12_partenum_variants
from tracewell.llm.syncmers import op11_closed_syncmers
from tracewell.llm.toxicity import op5_crf_toxicity
from tracewell.llm.url_rules import ORACLE_SQL as URL_SQL
from tracewell.llm.url_rules import op7_url_range_join


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_line_frequency, op2_wav_fingerprint, op3_compression_language, op4_merge_rounds, op5_crf_toxicity, op6_best_two_fit, op7_url_range_join, op8_kd_tree, op9_gray_simhash, op10_radix_repeats, op11_closed_syncmers, op12_partenum_variants, op13_lyndon_runs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_range_join": URL_SQL, "op12_partenum_variants": SPELLING_SQL}
