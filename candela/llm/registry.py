"""The corpus operators' queries, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from candela.llm.alignment import op12_cross_tokenizer
from candela.llm.chat import OP9_SQL, op9_chat_format
from candela.llm.credentials import op11_secret_scan
from candela.llm.decontam import OP8_SQL, op8_decontamination
from candela.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from candela.llm.licenses import OP4_SQL, op4_license_scan
from candela.llm.packing import op1_packing
from candela.llm.quality import op10_quality
from candela.llm.ranking import OP13_SQL, op13_ranked_search
from candela.llm.sharding import op2_feistel_shards
from candela.llm.simhash import op7_simhash
from candela.llm.substring import op5_shared_passages
from candela.llm.toxicity import op6_toxicity

QUERIES: dict = {
    "op1_packing": op1_packing,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_shared_passages": op5_shared_passages,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_secret_scan": op11_secret_scan,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_license_scan": OP4_SQL, "op8_decontamination": OP8_SQL, "op9_chat_format": OP9_SQL, "op13_ranked_search": OP13_SQL}
