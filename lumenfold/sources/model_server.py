"""A client of model servers that speak the usual chat and completion requests over HTTP, with the standard library alone.

ModelServer holds plain settings and goes to executors; calling it there makes the client of a task, which keeps a
connection open for each of the task's threads.
"""

from __future__ import annotations

import http.client
import json
import math
import os
import threading
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from lumenfold.functions.predicates import TOO_LONG
from lumenfold.operators.inference import ContextOverflow, FatalRequest, Overloaded, retryable

#: Alternatives of a next token that are asked for.
ALTERNATIVES = 20


class MalformedAnswer(Overloaded):
    """An answer that is not what was asked for: the server may do better next time."""


@dataclass(frozen=True)
class ModelServer:
    base_url: str
    model: str
    max_tokens: int = 4096
    temperature: float = 0.0
    top_p: float = 1.0
    #: Seconds that a request may take.
    timeout: float = 600.0
    #: The environment variable of the executors that holds the key; without it requests carry the word EMPTY.
    key_variable: str = "OPENAI_API_KEY"
    #: Further fields of every request.
    extra: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        parts = urlsplit(self.base_url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"base_url must be an http or https URL: {self.base_url!r}")
        if not self.model:
            raise ValueError("a server needs the name of its model")
        if not self.timeout > 0 or self.max_tokens < 1:
            raise ValueError("timeout and max_tokens must be positive")

    def __call__(self) -> ServerClient:
        return ServerClient(self)


class ServerClient:
    """Requests of a task. Threads may share it."""

    def __init__(self, server: ModelServer):
        self.server = server
        self.own = threading.local()

    def _connection(self) -> http.client.HTTPConnection:
        if getattr(self.own, "open", None) is None:
            parts = urlsplit(self.server.base_url)
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            self.own.open = kind(parts.hostname, parts.port, timeout=self.server.timeout)
        return self.own.open

    def _close(self) -> None:
        if getattr(self.own, "open", None) is not None:
            self.own.open.close()
            self.own.open = None

    def _post(self, path: str, fields: dict) -> dict:
        """The answer to a request, as an object. Raises ContextOverflow, FatalRequest, or Overloaded where a retry may help."""
        body = json.dumps({"model": self.server.model, **fields, **self.server.extra}, ensure_ascii=False, allow_nan=False).encode("utf-8")
        key = os.environ.get(self.server.key_variable) or "EMPTY"
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        try:
            connection = self._connection()
            connection.request("POST", urlsplit(self.server.base_url).path.rstrip("/") + path, body, headers)
            answer = connection.getresponse()
            status, text = answer.status, answer.read().decode("utf-8", "replace")
        except (OSError, http.client.HTTPException) as e:
            self._close()
            raise Overloaded(f"{type(e).__name__}: {e}") from e
        if answer.will_close:
            self._close()
        try:
            found = json.loads(text)
        except ValueError:
            found = None
        if status >= 400:
            told = found.get("error", found.get("message")) if isinstance(found, dict) else None
            told = told.get("message") if isinstance(told, dict) else told
            message = f"status {status}: {(told if isinstance(told, str) else text)[:500]}"
            if any(phrase in message.lower() for phrase in TOO_LONG):  # under any status: some servers say it with a 429
                raise ContextOverflow(message)
            raise (Overloaded if retryable(status) else FatalRequest)(message)
        if not isinstance(found, dict):
            raise MalformedAnswer(f"no JSON object: {text[:200]}")
        return found

    def _messages(self, prompt: str, system: str | None) -> list[dict]:
        if not isinstance(prompt, str) or not prompt.strip():
            raise FatalRequest("a prompt must not be blank")
        said = [{"role": "system", "content": system}] if system else []
        return [*said, {"role": "user", "content": prompt}]

    @staticmethod
    def _first(found: dict) -> dict:
        choices = found.get("choices")
        if not isinstance(choices, list) or not choices or not isinstance(choices[0], dict):
            raise MalformedAnswer("no choices")
        return choices[0]

    def generate(self, prompt: str, system: str | None, seed: int) -> str:
        """What the model says to a prompt. An empty text is an answer, a blank one is asked for again."""
        s = self.server
        fields = {"messages": self._messages(prompt, system), "max_completion_tokens": s.max_tokens, "temperature": s.temperature, "top_p": s.top_p, "seed": int(seed)}
        message = self._first(self._post("/chat/completions", fields)).get("message")
        content = message.get("content") if isinstance(message, dict) else None
        if not isinstance(content, str):
            raise MalformedAnswer("no content")
        if content and not content.strip():
            raise MalformedAnswer("blank content")
        return content

    def alternatives(self, prompt: str, system: str | None = None, seed: int = 0) -> dict[str, float]:
        """The log-probabilities of the likeliest next tokens; of a token that stands twice, the greater."""
        fields = {"messages": self._messages(prompt, system), "max_completion_tokens": 1, "temperature": 0, "logprobs": True, "top_logprobs": ALTERNATIVES, "seed": seed}
        told = self._first(self._post("/chat/completions", fields)).get("logprobs")
        content = told.get("content") if isinstance(told, dict) else None
        entries = content[0].get("top_logprobs") if isinstance(content, list) and content and isinstance(content[0], dict) else None
        if not isinstance(entries, list) or not entries:
            raise MalformedAnswer("no alternatives")
        found: dict[str, float] = {}
        for entry in entries:
            token, score = (entry.get("token"), entry.get("logprob")) if isinstance(entry, dict) else (None, None)
            if not isinstance(token, str) or not _number(score):
                raise MalformedAnswer("an alternative without a token and a finite log-probability")
            found[token] = max(float(score), found.get(token, -math.inf))
        return found

    def echo(self, text: str, seed: int = 0) -> tuple[list[int | None], list[str], list[float | None]]:
        """(offsets, tokens, log-probabilities) of a text's own tokens."""
        fields = {"prompt": text, "max_tokens": 1, "temperature": 0, "logprobs": ALTERNATIVES, "echo": True, "seed": seed}
        told = self._first(self._post("/completions", fields)).get("logprobs")
        columns = [told.get(k) if isinstance(told, dict) else None for k in ("text_offset", "tokens", "token_logprobs")]
        if not all(isinstance(c, list) for c in columns) or len({len(c) for c in columns}) != 1:
            raise MalformedAnswer("no offset and log-probability for each token")
        offsets, tokens, scores = columns
        if any(o is not None and type(o) is not int for o in offsets) or not all(isinstance(t, str) for t in tokens) or any(x is not None and not _number(x) for x in scores):
            raise MalformedAnswer("malformed tokens, offsets or log-probabilities")
        return offsets, tokens, scores


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
