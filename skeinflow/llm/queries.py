"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinflow.llm.bytepairs import op11_byte_bpe
from skeinflow.llm.exact import OP10_SQL, op10_exact_dedup
from skeinflow.llm.mixing import OP7_SQL, op7_mixing
from skeinflow.llm.negatives import OP13_SQL, op13_hard_negatives
from skeinflow.llm.pii import op5_pii
from skeinflow.llm.quality import op9_quality
from skeinflow.llm.ranked import OP12_SQL, op12_ranked_search
from skeinflow.llm.sentencepieces import op1_sentencepiece
from skeinflow.llm.simhash import op6_simhash
from skeinflow.llm.tokens import op4_token_store
from skeinflow.llm.urls import OP8_SQL, op8_url_filter
from skeinflow.llm.vectors import OP2_SQL, op2_embedding_dedup
from skeinflow.llm.warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_warc": op3_warc,
    "op4_token_store": op4_token_store,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": OP2_SQL,
    "op7_mixing": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
