"""The registered queries of this folder and their DuckDB counterparts."""

from querycorpus.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    fill_in_middle,
    importance_resampling,
    licenses,
    line_dedup,
    minhash_dedup,
    packing,
    quality,
    repeated_strings,
    sharding,
    toxicity,
)

MODULES = [
    packing, embedding_dedup, line_dedup, toxicity, exact_dedup, minhash_dedup, licenses, bpe, quality, sharding, fill_in_middle,
    repeated_strings, importance_resampling,
]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
