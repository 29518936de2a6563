"""Messages, requests and the offline generator."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class Message:
    role: str
    content: str

    def __post_init__(self):
        if self.role not in ROLES or not self.content.strip():
            raise ValueError("a message needs a known role and a text")


@dataclass(frozen=True)
class Request:
    """What is asked of a generator: at least one message, a temperature from 0 to 2."""

    messages: list[Message]
    temperature: float = 0.2
    response_format: str = "text"

    def __post_init__(self):
        if not self.messages or not 0 <= self.temperature <= 2 or self.response_format not in ("text", "json"):
            raise ValueError("messages, temperature or response format")


@dataclass
class OfflineGenerator:
    """Answers without a model: a fixed object or text that repeats the question's length; for tests of what comes after."""

    name: str = "offline"
    width: int = 32
    fields: dict = field(default_factory=lambda: {"candidates": [], "limitations": []})

    def generate(self, request: Request) -> str:
        asked = request.messages[-1].content
        return json.dumps({**self.fields, "asked": len(asked)}, ensure_ascii=False) if request.response_format == "json" else f"No model is attached; {len(asked)} characters were asked."

    def stream(self, request: Request) -> Iterator[tuple[str, str | None]]:
        """(delta, finish reason) parts; the last has the reason ``stop``."""
        text = self.generate(request)
        for start in range(0, len(text), self.width):
            yield text[start : start + self.width], None
        yield "", "stop"


GENERATORS: dict[str, Callable[[], OfflineGenerator]] = {"offline": OfflineGenerator}


def accumulate(parts: Iterator[tuple[str, str | None]]) -> tuple[str, str | None]:
    """The whole text and the last finish reason of a stream."""
    text, reason = "", None
    for delta, last in parts:
        text, reason = text + delta, last or reason
    return text, reason
