"""All queries of this package; importing the operators fills the registry."""

from sitewise.llm import (alignment, brown, fingerprints, language, lines, mixing, ngram_join, packing,  # noqa: F401
                          repetition, search, secrets, suffix_dedup, turn_trie)
from sitewise.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
