"""All queries of the subpackage."""

from kerbside.llm import q_dedup, q_lexical, q_lines, q_native, q_search, q_text, q_tokens  # noqa: F401
from kerbside.llm.registry import ORACLES, QUERIES  # noqa: F401
