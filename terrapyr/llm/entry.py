"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, embedding_dedup, mixing, quality, simhash, token_counts, toxicity, url_filter, warc

QUERIES = {"op1_mix_sources": mixing.op1_mix_sources, "op2_token_counts": token_counts.op2_token_counts, "op3_warc_bundles": warc.op3_warc_bundles, "op4_decontaminate": decontaminate.op4_decontaminate, "op5_simhash_dedup": simhash.op5_simhash_dedup, "op6_chat_masks": chat.op6_chat_masks, "op7_toxicity_chain": toxicity.op7_toxicity_chain, "op8_url_filter": url_filter.op8_url_filter, "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup, "op10_quality_mil": quality.op10_quality_mil}
SQL = {"op6_chat_masks": chat.SQL, "op3_warc_bundles": warc.SQL, "op8_url_filter": url_filter.SQL}
