"""All queries of the subpackage: importing this module registers them."""
from pulsegrid.llm import (byte_repeats, conversation_trie, decontamination, fingerprints, licenses, line_dedup, near, seeds,  # noqa: F401
                           sentencepiece_codec, source_mixing, token_alignment, token_fertility, toxicity)
from pulsegrid.llm.registry import ORACLES, QUERIES  # noqa: F401
