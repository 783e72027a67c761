"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pagewright.llm import op2_lattice as lattice
from pagewright.llm import op8_exact_dedup as exact
from pagewright.llm import op11_neighbours as neighbours
from pagewright.llm import op12_prefix_trie as trie
from pagewright.llm import op13_merkle as manifest
from pagewright.llm.op1_lm_score import op1_lm_score
from pagewright.llm.op2_lattice import op2_lattice
from pagewright.llm.op3_toxicity import op3_toxicity
from pagewright.llm.op4_simhash import op4_simhash
from pagewright.llm.op5_token_counts import op5_token_counts
from pagewright.llm.op6_packing import op6_packing
from pagewright.llm.op7_sharding import op7_sharding
from pagewright.llm.op8_exact_dedup import op8_exact_dedup
from pagewright.llm.op9_quality import op9_quality
from pagewright.llm.op10_bpe_codec import op10_bpe_codec
from pagewright.llm.op11_neighbours import op11_neighbours
from pagewright.llm.op12_prefix_trie import op12_prefix_trie
from pagewright.llm.op13_merkle import op13_merkle

QUERIES = {f.__name__: f for f in (op1_lm_score, op2_lattice, op3_toxicity, op4_simhash, op5_token_counts, op6_packing, op7_sharding, op8_exact_dedup, op9_quality, op10_bpe_codec, op11_neighbours, op12_prefix_trie, op13_merkle)}
ORACLES = {"op2_lattice": lattice.ORACLE, "op8_exact_dedup": exact.ORACLE, "op11_neighbours": neighbours.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_merkle": manifest.ORACLE}
