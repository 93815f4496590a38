"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import sql
from sluice.llm.op1_quality import op1_quality
from sluice.llm.op2_sentencepiece import op2_sentencepiece
from sluice.llm.op3_lines import op3_lines
from sluice.llm.op4_simhash import op4_simhash
from sluice.llm.op5_sharding import op5_sharding
from sluice.llm.op6_decontamination import op6_decontamination
from sluice.llm.op7_passages import op7_passages
from sluice.llm.op8_language import op8_language
from sluice.llm.op9_pitman_yor import op9_pitman_yor
from sluice.llm.op10_html import op10_html
from sluice.llm.op11_prefix_trie import op11_prefix_trie
from sluice.llm.op12_jaccard import op12_jaccard
from sluice.llm.op13_spelling import op13_spelling


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality, op2_sentencepiece, op3_lines, op4_simhash, op5_sharding, op6_decontamination, op7_passages, op8_language, op9_pitman_yor, op10_html, op11_prefix_trie, op12_jaccard, op13_spelling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": sql.quality(), "op11_prefix_trie": sql.prefix_trie(), "op12_jaccard": sql.jaccard(), "op13_spelling": sql.spelling()}
