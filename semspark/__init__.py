"""semspark: semantic data processing over Spark DataFrames."""

from .agent import Agent
from .operators.base import Op
from .operators.dedup import SemanticDeduplicator
from .operators.groups import discover_labels, sem_agg, sem_group_by
from .operators.pairs import sem_join, sem_top_k
from .operators.reduce import get_action, reduce, register_action
from .operators.semantic import filter, finalize, map  # noqa: A004
from .runtime.clients import LLM, Azure, CallableLLM, Gemini, Huggingface, Mistral, Ollama, OpenAI

__all__ = ["Agent", "Azure", "CallableLLM", "Gemini", "Huggingface", "LLM", "Mistral", "Ollama", "Op", "OpenAI", "SemanticDeduplicator", "filter", "finalize", "discover_labels", "get_action", "map", "reduce", "register_action", "sem_agg", "sem_group_by", "sem_join", "sem_top_k"]
