"""Queries of this package and their SQL, by name."""

from revlens.llm import chat, decontaminate, mixing, near_dup, pii, prefix_trie, quality, repair, secrets, substring_dedup, token_files, toxicity, url_filter

_MODULES = (secrets, decontaminate, quality, chat, mixing, substring_dedup, url_filter, near_dup, toxicity, token_files, repair, pii, prefix_trie)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
