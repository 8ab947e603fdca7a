"""Model clients: what is asked of each kind of service and where its answer stands, waits on refusals, and listeners.

A client is a callable (fqcn, prompt) -> answer that tasks can run; its transport is a parameter, so tests need no network.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from ..functions.text import retry_after

#: (status, headers, body) of a POST of a body with headers to an address, within a number of seconds.
Transport = Callable[[str, Mapping[str, str], str, float], tuple[int, Mapping[str, str], str]]
SYSTEM = "You classify software tests by their security relevance. Answer with one JSON object and nothing else."
TIMEOUT, RETRIES, MOST_TOKENS = 90.0, 1, 2000


class ModelError(RuntimeError):
    """No answer: the service can't be used, refused, or said nothing."""


@dataclass(frozen=True)
class Service:
    """base: the address without a given one (None: one must be given); path; kind of request; whether a key is needed."""

    base: str | None
    path: str
    kind: str = "openai"
    keyed: bool = True


# Addresses and paths of the services.
SERVICES = {
    "ollama": Service("http://localhost:11434", "/api/chat", "ollama", False),
    "openai": Service("https://api.openai.com", "/v1/chat/completions"),
    "openrouter": Service("https://openrouter.ai/api", "/v1/chat/completions"),
    "anthropic": Service("https://api.anthropic.com", "/v1/messages", "anthropic"),
    "azure_openai": Service(None, "/openai/deployments/{model}/chat/completions?api-version={version}", "azure"),
    "groq": Service("https://api.groq.com/openai", "/v1/chat/completions"),
    "xai": Service("https://api.x.ai/v1", "/chat/completions"),
    "github_models": Service("https://models.inference.ai.azure.com", "/chat/completions"),
    "mistral": Service("https://api.mistral.ai/v1", "/chat/completions"),
}


def over_http(url: str, headers: Mapping[str, str], body: str, timeout: float) -> tuple[int, Mapping[str, str], str]:
    """The plain transport; statuses that aren't successes are returned and not raised."""
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, body.encode(), dict(headers), method="POST"), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode()
    except error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode(errors="replace")


def request_of(kind: str, model: str, prompt: str) -> dict:
    """The body of a request."""
    turns = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
    if kind == "anthropic":
        return {"model": model, "system": SYSTEM, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}]}], "temperature": 0.0, "max_tokens": MOST_TOKENS}
    if kind == "ollama":
        return {"model": model, "messages": turns, "stream": False, "options": {"temperature": 0.0}}
    return {"model": model, "messages": turns, "temperature": 0.0}


def answer_of(kind: str, body: str) -> str:
    """The text of an answer; ModelError if it has none."""
    try:
        doc = json.loads(body)
        if kind == "anthropic":
            found = [b.get("text") for b in doc["content"] if b.get("type") == "text"]
        elif kind == "ollama":
            found = [doc["message"]["content"]]
        else:
            found = [c["message"]["content"] for c in doc["choices"][:1]]
    except (ValueError, KeyError, TypeError) as e:
        raise ModelError(f"the answer can't be read: {e}") from e
    if not found or not (found[0] or "").strip():
        raise ModelError("the model returned no text")
    return found[0]


@dataclass
class Client:
    """Asks one service. on_wait(seconds, attempt, retries) hears of pauses; on_answer(fqcn, prompt, answer) of answers."""

    service: str
    model: str
    key: str | None = None
    base: str | None = None
    version: str = "2024-02-01"
    timeout: float = TIMEOUT
    retries: int = RETRIES
    transport: Transport = over_http
    sleep: Callable[[float], None] = time.sleep
    on_wait: Callable[[int, int, int], None] | None = None
    on_answer: Callable[[str, str, str], None] | None = None
    about: Service = field(init=False)

    def __post_init__(self):
        self.about = SERVICES[self.service]
        if not (self.base or self.about.base):
            raise ModelError(f"{self.service} needs an address")
        if self.about.keyed and not (self.key or "").strip():
            raise ModelError(f"{self.service} needs a key")

    def headers(self) -> dict[str, str]:
        own = {"anthropic": {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, "azure": {"api-key": self.key}, "ollama": {}}
        return {"Content-Type": "application/json"} | own.get(self.about.kind, {"Authorization": f"Bearer {self.key}"})

    def post(self, body: str) -> str:
        """The answer's body. A refusal for too many requests is tried again after the wait that the service asks for, up to the number of retries."""
        url = (self.base or self.about.base).rstrip("/") + self.about.path.format(model=self.model, version=self.version)
        for attempt in range(1, self.retries + 2):
            status, headers, text = self.transport(url, self.headers(), body, self.timeout)
            if status != 429 or attempt > self.retries:
                break
            wait = retry_after(next((v for k, v in headers.items() if k.lower() == "retry-after"), None), text)
            if self.on_wait:
                self.on_wait(wait, attempt, self.retries)
            self.sleep(wait)
        if not 200 <= status < 300:
            raise ModelError(f"HTTP {status}: {text}")
        return text

    def __call__(self, fqcn: str, prompt: str) -> str:
        answer = answer_of(self.about.kind, self.post(json.dumps(request_of(self.about.kind, self.model, prompt), ensure_ascii=False)))
        if self.on_answer:
            self.on_answer(fqcn, prompt, answer)
        return answer


def reachable(base: str, timeout: float = 2.0) -> bool:
    """Whether a local service answers."""
    from urllib import request

    try:
        with request.urlopen(base.rstrip("/") + "/api/tags", timeout=timeout):
            return True
    except OSError:
        return False


def client(service: str, model: str, key: str | None = None, key_env: str | None = None, is_up: Callable[[str], bool] = reachable, **options) -> Client:
    """A client of a service. auto: the local one if it answers, else, with a key, the one of the common kind."""
    key = key or (os.environ.get(key_env) if key_env else None)
    if service != "auto":
        return Client(service, model, key, **options)
    base = options.get("base") or SERVICES["ollama"].base
    if is_up(base):
        return Client("ollama", model, key, **options)
    if not (key or "").strip():
        raise ModelError("the local service doesn't answer and there is no key for another")
    return Client("openai", model, key, **options)
