"""Language-model clients: picklable settings here, the connection in the process that sends."""

from __future__ import annotations

import copy
import json
import logging
import os
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from .leases import Lease, lease
from .protocol import END, estimate_tokens, framed_rows
from .runner import BatchRunner, Clock, RateWindow

log = logging.getLogger(__name__)

# Request and token limits a minute, by model.
RATE_LIMITS: dict[str, dict[str, int]] = {
    "gpt-3.5-turbo": {"tpm": 200_000, "rpm": 500},
    "gpt-3.5-turbo-0125": {"tpm": 200_000, "rpm": 500},
    "gpt-3.5-turbo-1106": {"tpm": 200_000, "rpm": 500},
    "gpt-3.5-turbo-16k": {"tpm": 200_000, "rpm": 500},
    "gpt-3.5-turbo-instruct": {"tpm": 90_000, "rpm": 3_500},
    "gpt-3.5-turbo-instruct-0914": {"tpm": 90_000, "rpm": 3_500},
    "gpt-4": {"tpm": 10_000, "rpm": 500},
    "gpt-4-0613": {"tpm": 10_000, "rpm": 500},
    "gpt-4-turbo": {"tpm": 30_000, "rpm": 500},
    "gpt-4-turbo-2024-04-09": {"tpm": 30_000, "rpm": 500},
    "gpt-4-turbo-preview": {"tpm": 30_000, "rpm": 500},
    "gpt-4-0125-preview": {"tpm": 30_000, "rpm": 500},
    "gpt-4-1106-preview": {"tpm": 30_000, "rpm": 500},
    "gpt-4.1": {"tpm": 30_000, "rpm": 500},
    "gpt-4.1-2025-04-14": {"tpm": 30_000, "rpm": 500},
    "gpt-4.1-mini": {"tpm": 200_000, "rpm": 500},
    "gpt-4.1-mini-2025-04-14": {"tpm": 200_000, "rpm": 500},
    "gpt-4.1-nano": {"tpm": 200_000, "rpm": 500},
    "gpt-4.1-nano-2025-04-14": {"tpm": 200_000, "rpm": 500},
    "gpt-4.5-preview": {"tpm": 125_000, "rpm": 1_000},
    "gpt-4.5-preview-2025-02-27": {"tpm": 125_000, "rpm": 1_000},
    "gpt-4o": {"tpm": 30_000, "rpm": 500},
    "gpt-4o-2024-05-13": {"tpm": 30_000, "rpm": 500},
    "gpt-4o-2024-08-06": {"tpm": 30_000, "rpm": 500},
    "gpt-4o-2024-11-20": {"tpm": 30_000, "rpm": 500},
}
DEFAULT_MODEL = "gpt-3.5-turbo"
MAX_TOKENS = {"gpt-3.5-turbo": 4_096, "gpt-4": 4_096}
DEFAULT_MAX_TOKENS = 4_096
#: Requests a minute that a task has at least.
LEAST_SHARE = 4


def limits_of(model: str) -> dict[str, int] | None:
    """Limits of a model by its exact name."""
    return RATE_LIMITS.get(model)


class LLM:
    """A model named ``provider/model`` behind an HTTP chat endpoint.

    Keyword arguments: api_key, api_base, api_version, temperature (0.0), rpm, tpm, max_tokens, parallelism (tasks
    that call the model at a time; without it as many as the session runs and the limits serve), threads (requests in flight in a task),
    metrics (a RunMetrics), timeout, leases; others are sent with each request. All tasks of an application borrow from
    one budget of the model's limits, which the driver holds; ``leases=False``, where executors cannot reach a port of
    the driver, gives each task a fixed share instead.
    """

    url = "https://api.openai.com/v1"

    def __init__(self, model_name: str, **kwargs):
        provider, slash, model = model_name.partition("/")
        self.provider, self.model = (provider, model) if slash else ("", model_name)
        self.model_name = model_name
        options = {k: v for k, v in kwargs.items() if v is not None}
        limits = limits_of(self.model)
        if limits is None:
            missing = [k for k in ("rpm", "tpm") if k not in options]
            if missing:
                log.warning("no %s known for %s: that of %s is used; give %s to set it", " and ".join(missing), model_name, DEFAULT_MODEL, ", ".join(missing))
            limits = RATE_LIMITS[DEFAULT_MODEL]
        self.rpm, self.tpm = options.pop("rpm", limits["rpm"]), options.pop("tpm", limits["tpm"])
        self.temperature = options.pop("temperature", 0.0)
        self.max_tokens = options.pop("max_tokens", MAX_TOKENS.get(self.model, DEFAULT_MAX_TOKENS))
        self.parallelism, self.threads, self.metrics = options.pop("parallelism", None), options.pop("threads", 8), options.pop("metrics", None)
        self._share, self._lease, self.leases = 1, None, options.pop("leases", True)
        self._budget = f"{model_name}-{uuid.uuid4().hex}"
        self.timeout = options.pop("timeout", 120)
        self.api_key, self.api_base, self.api_version = (options.pop(k, None) for k in ("api_key", "api_base", "api_version"))
        self.options = options

    def get_max_tokens(self) -> int:
        return self.max_tokens

    def request(self, prompt: str) -> urllib.request.Request:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}], **self.options}
        headers = {"Content-Type": "application/json"}
        key = self.api_key or os.environ.get(f"{self.provider.upper() or 'OPENAI'}_API_KEY")
        if key:
            headers["Authorization"] = f"Bearer {key}"
        return urllib.request.Request(f"{(self.api_base or self.url).rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)

    def complete(self, prompt: str) -> str:
        with urllib.request.urlopen(self.request(prompt), timeout=self.timeout) as reply:  # noqa: S310  the address is the user's
            return json.load(reply)["choices"][0]["message"]["content"]

    def _tried(self, prompt: str) -> str | Exception:
        try:
            return self.complete(prompt)
        except Exception as error:  # noqa: BLE001  a provider may raise anything; it becomes the prompt's answer
            return error

    def complete_all(self, prompts: list[str], max_retries: int = 0) -> list[str | Exception]:
        """One prompt, one answer or last error, in order; ``threads`` at a time, within the limits."""
        window = self.window()
        out: list[str | Exception] = [RuntimeError("not sent")] * len(prompts)
        open_ = list(range(len(prompts)))
        with ThreadPoolExecutor(self.threads) as pool:
            for _ in range(max_retries + 1):
                waiting = []
                for k in open_:
                    window.admit(estimate_tokens(prompts[k]))
                    waiting.append((k, pool.submit(self._tried, prompts[k])))
                for k, reply in waiting:
                    out[k] = reply.result()
                open_ = [k for k in open_ if isinstance(out[k], Exception)]
                if not open_:
                    break
        return out

    def tasks(self, slots: int) -> int:
        """Tasks that may call the model at a time on a session that runs ``slots``: more than the limits have a few
        requests a minute for would wait, or without leases have no share."""
        return self.parallelism or max(1, min(slots, int(self.rpm // LEAST_SHARE)))

    def shared_by(self, tasks: int) -> LLM:
        """A copy whose limits are a share of these, for each of so many tasks."""
        own = copy.copy(self)
        own._share = max(1, tasks)
        return own

    def borrowing(self, spark) -> LLM:
        """A copy whose requests are all counted against one budget, which this driver holds for this model."""
        own = copy.copy(self)
        own._lease = lease(spark, self._budget, self.rpm, self.tpm)
        return own

    def window(self, clock: Clock | None = None) -> RateWindow | Lease:
        if self._lease is not None:
            return self._lease
        return RateWindow(self.rpm / self._share, self.tpm / self._share, clock)

    def runner(self) -> BatchRunner:
        return BatchRunner(self.complete, self.max_tokens, self.window(), threads=self.threads, metrics=self.metrics)

    def __call__(self, rows, prefix: str = "", criteria: str = "", suffix: str = "", optimized: bool = True, max_retries: int = 5):
        """A string is completed; a list is answered row by row, packed (``optimized``) or one prompt each."""
        if isinstance(rows, str):
            return self.complete(rows)
        if optimized:
            return self.runner().run(list(rows), prefix, criteria, suffix, max_retries)
        return self.complete_all([f"{prefix}{criteria}\n{r}{suffix}" for r in rows], max_retries)


class OpenAI(LLM):
    def __init__(self, model_name: str = "gpt-3.5-turbo", api_key: str | None = None, **kwargs):
        super().__init__(model_name if "/" in model_name else f"openai/{model_name}", api_key=api_key, **kwargs)


class Ollama(LLM):
    def __init__(self, model_name: str = "gemma3:4b", api_base: str = "http://localhost:11434", **kwargs):
        super().__init__(f"ollama/{model_name}", api_base=f"{api_base.rstrip('/')}/v1", **kwargs)


class Azure(LLM):
    def __init__(self, model_name: str, api_key: str | None = None, api_base: str | None = None, api_version: str | None = None, **kwargs):
        super().__init__(f"azure/{model_name.removeprefix('azure/')}", api_key=api_key, api_base=api_base, api_version=api_version, **kwargs)

    def request(self, prompt: str) -> urllib.request.Request:
        made = super().request(prompt)
        version = f"?api-version={self.api_version}" if self.api_version else ""
        made.full_url = f"{(self.api_base or '').rstrip('/')}/openai/deployments/{self.model}/chat/completions{version}"
        if self.api_key:
            made.add_header("api-key", self.api_key)
        return made


class _Prefixed(LLM):
    provider_name = ""

    def __init__(self, model_name: str, api_key: str | None = None, **kwargs):
        super().__init__(model_name if model_name.startswith(f"{self.provider_name}/") else f"{self.provider_name}/{model_name}", api_key=api_key, **kwargs)


class Gemini(_Prefixed):
    provider_name, url = "gemini", "https://generativelanguage.googleapis.com/v1beta/openai"

    def __init__(self, model_name: str = "gemini/gemma-3-1b-it", api_key: str | None = None, **kwargs):
        super().__init__(model_name, api_key, **kwargs)


class Mistral(_Prefixed):
    provider_name, url = "mistral", "https://api.mistral.ai/v1"

    def __init__(self, model_name: str = "mistral/mistral-tiny", api_key: str | None = None, **kwargs):
        super().__init__(model_name, api_key, **kwargs)


class Huggingface(_Prefixed):
    provider_name, url = "huggingface", "https://router.huggingface.co/v1"


class CallableLLM(LLM):
    """An in-process model: ``rule`` maps a row's text to the value it answers with, or raises.

    The prompts go through the real protocol: rows are taken out of the prompt and answers are framed again.
    """

    def __init__(self, rule: Callable[[str], object], **kwargs):
        super().__init__("local/callable", rpm=kwargs.pop("rpm", 10**9), tpm=kwargs.pop("tpm", 10**12), max_tokens=kwargs.pop("max_tokens", 100_000), leases=kwargs.pop("leases", False), **kwargs)
        self.rule = rule

    def complete(self, prompt: str) -> str:
        out = []
        for index, row in framed_rows(prompt):
            try:
                out.append(f"index={index}|{self.rule(row)!r}{END}")
            except Exception as error:  # noqa: BLE001  such a row gets an answer that cannot be read
                out.append(f"index={index}|error: {error}{END}")
        return "".join(out)


class ScriptedLLM(LLM):
    """Answers whole prompts from a list, in turn; for the planner and for tests."""

    def __init__(self, replies: list[str]):
        super().__init__("local/scripted", rpm=10**9, tpm=10**12)
        self.replies, self.prompts = list(replies), []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.replies.pop(0)
