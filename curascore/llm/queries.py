"""All registered queries of the subpackage."""

from curascore.llm import (  # noqa: F401  (modules register on import)
    ann, decontaminate, interpolation, jaccard_join, language_id, line_dedup, mixing, pii, prefix_trie, secrets, token_counts, toxicity, whitening,
)
from curascore.llm.base import REGISTRY

__all__ = ["REGISTRY"]
