"""Models that answer prompts: the reply, the errors, clients of a local server and of a hosted service, with attempts and backoff.

``ask`` of the triage operator runs a client on the executors, so a client must be picklable; it opens connections there.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from siftline.functions import fixed


class SiftlineError(Exception):
    """What this package raises when it can't do what it is asked for."""


class ModelError(SiftlineError):
    """The model couldn't be reached, or refused."""


class ReportError(SiftlineError, ValueError):
    """A report, or a row of it, can't be read."""


class BudgetExceeded(SiftlineError):
    """The token budget doesn't allow another prompt."""


@dataclass(frozen=True)
class ModelReply:
    text: str
    input_tokens: int
    output_tokens: int


def with_attempts(send: Callable[[str], ModelReply], attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> Callable[[str], ModelReply]:
    """``send`` repeated on lost connections and on errors worth it, after min(2**n + a random part, 30) seconds."""

    def ask(prompt: str) -> ModelReply:
        last: Exception | None = None
        for attempt in range(attempts):
            try:
                return send(prompt)
            except urllib.error.HTTPError as error:
                if error.code not in fixed.RETRYABLE:
                    raise ModelError(f"the model refused: {error}") from error
                last = error
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                last = error
            wait(min(2**attempt + random.random(), 30))
        raise ModelError(f"the model wasn't reached in {attempts} attempts: {last}")

    return ask


def local_model(model_id: str, base_url: str = "http://localhost:11434", timeout: float = 120.0, max_tokens: int = 1024, attempts: int = 4) -> Callable[[str], ModelReply]:
    """A client of a server with ``/api/generate``; temperature 0, whole answers."""
    url = f"{base_url.rstrip('/')}/api/generate"

    def send(prompt: str) -> ModelReply:
        body = json.dumps({"model": model_id, "prompt": prompt, "stream": False, "options": {"temperature": 0, "num_predict": max_tokens}}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"}), timeout=timeout) as answer:
            found = json.loads(answer.read())
        return ModelReply(found.get("response", ""), found.get("prompt_eval_count", 0), found.get("eval_count", 0))

    return with_attempts(send, attempts)


#: The hosted service's path and the version of its wire format.
MESSAGES_PATH, MESSAGES_VERSION = "/v1/messages", "2023-06-01"


def hosted_model(model_id: str, key: str | None, base_url: str = "https://api.anthropic.com", timeout: float = 120.0, max_tokens: int = 1024, attempts: int = 4) -> Callable[[str], ModelReply]:
    """A client of a hosted service with a key: one message, temperature 0, the text blocks of the answer."""
    if not key:
        raise ModelError("the hosted model needs a key")
    url = f"{base_url.rstrip('/')}{MESSAGES_PATH}"

    def send(prompt: str) -> ModelReply:
        body = json.dumps({"model": model_id, "max_tokens": max_tokens, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json", "x-api-key": key, "anthropic-version": MESSAGES_VERSION}
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=timeout) as answer:
            found = json.loads(answer.read())
        text = "".join(x.get("text", "") for x in found.get("content", []) if x.get("type") == "text")
        return ModelReply(text, found.get("usage", {}).get("input_tokens", 0), found.get("usage", {}).get("output_tokens", 0))

    return with_attempts(send, attempts)
