"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusmill.llm.alignment import op11_alignment
from corpusmill.llm.bpe import op1_byte_bpe
from corpusmill.llm.chat import OP10_SQL, op10_chat_formatting
from corpusmill.llm.langid import op2_language_id
from corpusmill.llm.merkle import OP12_SQL, op12_merkle
from corpusmill.llm.mixing import OP6_SQL, op6_mixing
from corpusmill.llm.quality import op9_quality_classifier
from corpusmill.llm.secrets import op5_secret_scans
from corpusmill.llm.sharding import op7_sharding
from corpusmill.llm.text_dedup import op4_minhash_dedup
from corpusmill.llm.topk import OP3_SQL, op3_exact_topk
from corpusmill.llm.url_filter import OP13_SQL, op13_url_filters
from corpusmill.llm.vector_dedup import op8_embedding_dedup

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_exact_topk": op3_exact_topk,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_alignment": op11_alignment,
    "op12_merkle": op12_merkle,
    "op13_url_filters": op13_url_filters,
}

ORACLES = {
    "op3_exact_topk": OP3_SQL,
    "op6_mixing": OP6_SQL,
    "op10_chat_formatting": OP10_SQL,
    "op12_merkle": OP12_SQL,
    "op13_url_filters": OP13_SQL,
}
