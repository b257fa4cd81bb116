"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genoframe.llm.decontamination import op2_decontamination
from genoframe.llm.html_extraction import op7_html_extraction
from genoframe.llm.maxent import op4_maxent
from genoframe.llm.minhash import op9_minhash
from genoframe.llm.nbest import op10_nbest
from genoframe.llm.paragraphs import op6_paragraphs
from genoframe.llm.quality import op8_quality
from genoframe.llm.token_counts import op1_token_counts
from genoframe.llm.token_planes import op3_token_planes
from genoframe.llm.transport_stream import op5_transport_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op3_token_planes, op5_transport_stream, op7_html_extraction, op9_minhash, op6_paragraphs, op2_decontamination, op8_quality, op10_nbest, op4_maxent)
}
ORACLES: dict[str, str] = {}
