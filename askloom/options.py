"""Validated option sets. Every operator takes one of these instead of loose keyword values."""

from __future__ import annotations

from dataclasses import dataclass

# Keywords and defaults of the query surface.
CHUNKING_STRATEGIES = ("basic", "by_title")
METRICS = ("cosine", "l2", "ip")
DEFAULT_CONTEXT_TEMPLATE = """Ответь на вопрос при условии контекста.

Контекст:
{context}

Вопрос:
{user_message}"""


def _at_least(name: str, value: float, low: float) -> None:
    if isinstance(value, bool) or not value >= low:
        raise ValueError(f"{name} must be at least {low}, got {value!r}")


def _one_of(name: str, value: object, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {value!r}")


@dataclass(frozen=True)
class CleanOptions:
    """Switches of the cleaning step; ``clean=False`` turns the whole step off."""

    clean: bool = True
    bullets: bool = True
    extra_whitespace: bool = True
    dashes: bool = False
    trailing_punctuation: bool = True
    lowercase: bool = False


@dataclass(frozen=True)
class ChunkOptions:
    """Chunk sizes in characters: soft limit ``new_after_n_chars``, hard limit ``max_characters``."""

    chunking_strategy: str = "basic"
    max_characters: int = 800
    new_after_n_chars: int = 500
    overlap: int = 0

    def __post_init__(self) -> None:
        _one_of("chunking_strategy", self.chunking_strategy, CHUNKING_STRATEGIES)
        _at_least("max_characters", self.max_characters, 2)
        _at_least("new_after_n_chars", self.new_after_n_chars, 0)
        _at_least("overlap", self.overlap, 0)
        if self.overlap >= self.max_characters - 1:
            raise ValueError("overlap must leave room for new characters below max_characters")

    @property
    def soft(self) -> int:
        return min(self.new_after_n_chars, self.max_characters)

    @property
    def by_title(self) -> bool:
        return self.chunking_strategy == "by_title"


@dataclass(frozen=True)
class EmbedOptions:
    """Batch size per model call and optional unit-length scaling."""

    batch_size: int = 300
    normalize_embeddings: bool | None = None

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")


@dataclass(frozen=True)
class SearchOptions:
    """``n_results`` is a positive number, ``'max'`` (all within the limit) or ``'all'`` (every chunk, no limit).

    ``approximate``, for a collection with an index: look only in that many cells per question.
    """

    n_results: int | str = 2
    max_distance: float = 0.5
    space: str = "cosine"
    approximate: int | None = None

    def __post_init__(self) -> None:
        if isinstance(self.n_results, str):
            _one_of("n_results", self.n_results, ("max", "all"))
        else:
            _at_least("n_results", self.n_results, 1)
        _at_least("max_distance", self.max_distance, float("-inf"))
        _one_of("space", self.space, METRICS)
        if self.approximate is not None:
            _at_least("approximate", self.approximate, 1)

    @property
    def k(self) -> int | None:
        return self.n_results if isinstance(self.n_results, int) else None


@dataclass(frozen=True)
class SamplingOptions:
    """Settings sent along with each model request."""

    do_sample: bool = False
    temperature: float = 0.2
    top_p: float = 0.9
    top_k: int = 40
    repeat_penalty: float = 1.0
    max_tokens: int = -1
    enable_thinking: bool = False
    reasoning_format: str = "none"

    def __post_init__(self) -> None:
        _at_least("temperature", self.temperature, 0)
        _at_least("top_p", self.top_p, 0)
        _at_least("top_k", self.top_k, 0)
        _at_least("repeat_penalty", self.repeat_penalty, 0)


@dataclass(frozen=True)
class ChatOptions:
    """History length in message pairs, system prompt, RAG switch and prompt template."""

    history_len: int = 0
    system_prompt: str | None = None
    support_system_role: bool = True
    rag_mode: bool = False
    context_template: str = DEFAULT_CONTEXT_TEMPLATE

    def __post_init__(self) -> None:
        _at_least("history_len", self.history_len, 0)


@dataclass(frozen=True)
class PreviewOptions:
    """Number of preview lines; a negative number shows all of them."""

    max_lines: int = 200

    def __post_init__(self) -> None:
        _at_least("max_lines", self.max_lines, -1)


def check_subtitle_lang(lang: str) -> str:
    """Any language code will do; which ones a video has shows when it is looked up."""
    if not isinstance(lang, str) or not lang.strip():
        raise ValueError(f"subtitle_lang must be a language code, got {lang!r}")
    return lang
