"""Chat providers as generators: three request formats over an injected transport.

A transport is a function of (request) -> reply, both dictionaries as the provider's public HTTP
interface has them; it owns keys, addresses and timeouts. Nothing here opens a network connection.
A prompt is a text or a list of {"role", "content"} messages with the roles system, user and assistant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from curatrix.sources.generators import register

Messages = list[dict[str, str]]

#: The request format of each provider.
FORMATS = {"openai": "chat", "deepseek": "chat", "xai": "chat", "moonshot": "chat", "anthropic": "messages", "google": "contents"}


def as_messages(prompt: str | Messages, system: str | None = None) -> Messages:
    """The prompt as messages; a system text comes first unless the prompt has one."""
    found = [{"role": "user", "content": prompt}] if isinstance(prompt, str) else [dict(m) for m in prompt]
    if wrong := {m["role"] for m in found} - {"system", "user", "assistant"}:
        raise ValueError(f"roles: {sorted(wrong)}")
    return found if not system or any(m["role"] == "system" for m in found) else [{"role": "system", "content": system}, *found]


def _split(messages: Messages) -> tuple[str, Messages]:
    """The system texts, joined, and the other messages."""
    return "\n".join(m["content"] for m in messages if m["role"] == "system"), [m for m in messages if m["role"] != "system"]


@dataclass
class ChatProvider:
    """thinking: a budget of tokens to reason with (messages format) or an effort's name (chat format); with either no temperature is sent."""

    provider: str
    model: str
    transport: Callable[[dict], dict]
    system: str | None = None
    top_p: float = 0.9
    max_tokens: int = 4000
    thinking: int | str | None = None

    def __post_init__(self) -> None:
        if self.provider not in FORMATS:
            raise ValueError(f"no provider {self.provider!r}; known: {sorted(FORMATS)}")

    @property
    def name(self) -> str:
        """The model's name, with how it reasons."""
        return self.model + (f"_thinking_{self.thinking}" if isinstance(self.thinking, str) else "_thinking" if self.thinking else "")

    def request(self, prompt: str | Messages, temperature: float = 0.5) -> dict:
        messages = as_messages(prompt, self.system)
        sampling = {} if self.thinking else {"temperature": temperature}
        kind = FORMATS[self.provider]
        if kind == "chat":
            effort = {"reasoning_effort": self.thinking} if self.thinking else {"top_p": self.top_p}
            return {"model": self.model, "messages": messages, "max_tokens": self.max_tokens} | sampling | effort
        system, rest = _split(messages)
        if kind == "messages":
            budget = {"thinking": {"type": "enabled", "budget_tokens": self.thinking}} if self.thinking else {}
            return {"model": self.model, "messages": rest, "max_tokens": self.max_tokens} | ({"system": system} if system else {}) | sampling | budget
        contents = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in rest]
        settings = {"generationConfig": sampling | {"topP": self.top_p, "maxOutputTokens": self.max_tokens}}
        return {"model": self.model, "contents": contents} | settings | ({"systemInstruction": {"parts": [{"text": system}]}} if system else {})

    def reply(self, got: dict) -> tuple[str, dict]:
        """Text and usage of a reply; a reply without text is an error, so that it is asked for again."""
        kind = FORMATS[self.provider]
        if kind == "chat":
            text, usage = (got.get("choices") or [{}])[0].get("message", {}).get("content"), got.get("usage", {})
            counts = usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)
        elif kind == "messages":
            text, usage = "".join(b.get("text", "") for b in got.get("content", []) if b.get("type") == "text"), got.get("usage", {})
            counts = usage.get("input_tokens", 0), usage.get("output_tokens", 0)
        else:
            parts = (got.get("candidates") or [{}])[0].get("content", {}).get("parts", [])
            text, usage = "".join(p.get("text", "") for p in parts), got.get("usageMetadata", {})
            counts = usage.get("promptTokenCount", 0), usage.get("candidatesTokenCount", 0)
        if not text:
            raise ValueError(f"{self.provider} gave no text: {str(got)[:200]}")
        return text, {"prompt_tokens": counts[0], "completion_tokens": counts[1], "provider": self.provider, "model": self.name}

    def generate(self, prompt: str | Messages, temperature: float = 0.5) -> tuple[str, dict]:
        return self.reply(self.transport(self.request(prompt, temperature)))


def _factory(provider: str) -> Callable[..., ChatProvider]:
    return lambda **options: ChatProvider(provider, **options)


for _name in FORMATS:
    register(_name, _factory(_name))
