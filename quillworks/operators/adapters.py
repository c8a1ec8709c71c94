"""Models behind chat services, one call shape each, with shared manners: a timeout, four tries, keys out of messages.

An adapter is called as adapter(slug, prompt, text) inside a panel run.  post(url, body, headers, timeout) is injected
in tests.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from typing import Any

from .bench import ReplyError
from .judge import BACKOFF_MS, ATTEMPTS, Judge, http_post
from .scrub import scrub

TIMEOUT_S = 60
BODY_CHARS = 200


class AdapterError(RuntimeError):
    pass


def may_pass(status: int) -> bool:
    """Unlike the judgment service, any server error is worth another try here."""
    return status == 429 or status >= 500


def request_json(post: Any, url: str, body: str, headers: dict[str, str], secrets: tuple[str, ...], sleep: Any = time.sleep) -> tuple[dict, int]:
    """(reply, tries)."""
    why = ""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            status, _, text = post(url, body, headers, TIMEOUT_S)
            if status == 200:
                value = json.loads(text)
                if isinstance(value, dict):
                    return value, attempt
                why = "the reply is no object"
            else:
                why = f"HTTP {status}: {text.strip()[:BODY_CHARS]}"
                if not may_pass(status):
                    break
        except (OSError, ValueError) as e:
            why = str(e)
        if attempt < ATTEMPTS:
            sleep(BACKOFF_MS * 2 ** (attempt - 1) / 1000)
    raise AdapterError(scrub(f"{url}: {why}", secrets))


def whole(x: Any) -> int:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 else 0


def section(value: Any, name: str) -> dict:
    found = value.get(name) if isinstance(value, dict) else None
    return found if isinstance(found, dict) else {}


@dataclass
class Chat:
    """Chat completions.  What differs between services is the name of the budget, and which settings they take."""

    url: str
    key: str
    budget: int = 2000
    budget_field: str = "max_tokens"
    fixed: dict = field(default_factory=dict)
    json_mode: bool = False
    post: Any = http_post

    def __call__(self, slug: str, prompt: str, text: str) -> dict:
        body = {"model": slug, self.budget_field: self.budget, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}], **self.fixed}
        if self.json_mode:
            body["response_format"] = {"type": "json_object"}
        reply, tries = request_json(self.post, self.url, json.dumps(body), {"content-type": "application/json", "authorization": f"Bearer {self.key}"}, (self.key,))
        choices = reply.get("choices")
        first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
        content = section(first, "message").get("content")
        if isinstance(content, list):
            content = "".join(p.get("text", "") for p in content if isinstance(p, dict) and isinstance(p.get("text"), str))
        usage = section(reply, "usage")
        return {
            "text": content if isinstance(content, str) else "", "truncated": first.get("finish_reason") == "length", "attempts": tries,
            "input_tokens": whole(usage.get("prompt_tokens")), "output_tokens": whole(usage.get("completion_tokens")),
            "reasoning_tokens": whole(section(usage, "completion_tokens_details").get("reasoning_tokens")),
        }


def openrouter(key: str, budget: int = 2000, json_mode: bool = False, reasoning: dict | None = None, post: Any = http_post) -> Chat:
    return Chat("https://openrouter.ai/api/v1/chat/completions", key, budget, "max_tokens", {"temperature": 0} | ({"reasoning": reasoning} if reasoning else {}), json_mode, post)


def openai(key: str, budget: int = 4000, json_mode: bool = False, effort: str | None = None, post: Any = http_post) -> Chat:
    """No temperature: its reasoning models take only their default."""
    return Chat("https://api.openai.com/v1/chat/completions", key, budget, "max_completion_tokens", {"reasoning_effort": effort} if effort else {}, json_mode, post)


@dataclass
class Messages:
    """The messages API: system beside the messages, content in blocks, and its own word for a reply cut short."""

    key: str
    budget: int = 2000
    url: str = "https://api.anthropic.com/v1/messages"
    version: str = "2023-06-01"
    post: Any = http_post

    def __call__(self, slug: str, prompt: str, text: str) -> dict:
        body = {"model": slug, "max_tokens": self.budget, "system": prompt, "messages": [{"role": "user", "content": text}]}
        reply, tries = request_json(self.post, self.url, json.dumps(body), {"content-type": "application/json", "x-api-key": self.key, "anthropic-version": self.version}, (self.key,))
        blocks = reply.get("content")
        texts = [b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)] if isinstance(blocks, list) else []
        usage = section(reply, "usage")
        return {"text": texts[0] if texts else "", "truncated": reply.get("stop_reason") == "max_tokens", "attempts": tries, "input_tokens": whole(usage.get("input_tokens")), "output_tokens": whole(usage.get("output_tokens"))}


@dataclass
class AsPanelRow:
    """The judgment service as a row of a panel: undecided rules are left out, a flag is a probability at the bar."""

    judge: Judge
    questions: str
    bar: float = 0.7

    def __call__(self, slug: str, prompt: str, text: str) -> dict:
        answer = self.judge.ask(text, self.questions)
        decided = {k: {"flag": p >= self.bar, "p": p} for k, p in answer["nouls"].items() if not 0.4 <= p <= 0.6}
        if not answer["nouls"]:
            raise ReplyError("the judge answered nothing")
        return {"text": json.dumps(decided), "truncated": False, "attempts": answer.get("attempts", 1), "input_tokens": answer["input_tokens"], "output_tokens": answer["output_tokens"]}
