"""Preparing text corpora: quality rules, archives, dedup, extraction, mixing, joins, decontamination, chats, toxicity, secrets.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames and is free of query details;
`queries` derives the columns of the registered queries from them.
"""
