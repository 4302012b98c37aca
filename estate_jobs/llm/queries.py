"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from estate_jobs.llm.chat_format import OP2_SQL, op2_chat_format
from estate_jobs.llm.decontaminate import OP10_SQL, op10_decontamination
from estate_jobs.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from estate_jobs.llm.language_id import op1_language_id
from estate_jobs.llm.lm_scoring import op8_lm_scoring
from estate_jobs.llm.minhash_dedup import OP12_SQL, op12_minhash_dedup
from estate_jobs.llm.mixing import OP5_SQL, op5_mixing
from estate_jobs.llm.near_duplicates import op7_near_duplicates
from estate_jobs.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from estate_jobs.llm.quality import op4_quality_classifier
from estate_jobs.llm.secrets import OP6_SQL, op6_secret_scan
from estate_jobs.llm.spot_signatures import op3_spot_signatures
from estate_jobs.llm.url_filter import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_chat_format, op3_spot_signatures, op4_quality_classifier, op5_mixing, op6_secret_scan, op7_near_duplicates, op8_lm_scoring, op9_url_filter, op10_decontamination, op11_fill_in_middle, op12_minhash_dedup, op13_prefix_trie)
}

#: The other operators have no form in SQL; tests/llm holds them against brute force, round trips or held-out rows.
ORACLES = {"op2_chat_format": OP2_SQL, "op5_mixing": OP5_SQL, "op6_secret_scan": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_minhash_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
