"""Sends packed requests within rate limits and retries the rows that got no usable answer."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from .protocol import estimate_tokens, pack, read_answers

FAILED = "FAILED_AFTER_MAX_RETRIES"
WINDOW_SECONDS = 61.0


class RowError(Exception):
    """Why a row has no answer."""


@dataclass
class Clock:
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


class RateWindow:
    """Lets requests through while both budgets of the current window last, else waits for the next window."""

    def __init__(self, rpm: float, tpm: float, clock: Clock | None = None):
        self.rpm, self.tpm, self.clock = max(2.0, rpm), max(1.0, tpm), clock or Clock()
        self._began, self._count, self._tokens = self.clock.now(), 0, 0

    def admit(self, tokens: int) -> None:
        now = self.clock.now()
        if now - self._began >= WINDOW_SECONDS:
            self._began, self._count, self._tokens = now, 0, 0
        if self._count and (self._count + 1 >= self.rpm or self._tokens + tokens >= self.tpm):
            self.clock.sleep(max(0.0, WINDOW_SECONDS - (now - self._began)))
            self._began, self._count, self._tokens = self.clock.now(), 0, 0
        self._count += 1
        self._tokens += tokens


class BatchRunner:
    """Answers lists of rows: packs them, sends the requests, reads the answers, and retries what is missing.

    A request that raises is retried like a malformed answer, as its error may pass; a row's last error is kept.
    """

    def __init__(self, send: Callable[[str], str], budget: int, window: RateWindow | None = None, count: Callable[[str], int] = estimate_tokens, threads: int = 8, metrics=None):
        self.send, self.budget, self.window, self.count, self.threads, self.metrics = send, budget, window, count, threads, metrics

    def _one(self, prompt: str) -> str | Exception:
        try:
            return self.send(prompt)
        except Exception as error:  # noqa: BLE001  a provider may raise anything; it becomes the rows' error
            return error

    def run(self, rows: list[str], prefix: str = "", criteria: str = "", suffix: str = "", max_retries: int = 5) -> list[str | Exception]:
        """An answer or an error for each row. No rows make no request."""
        answers: dict[int, str] = {}
        errors: dict[int, Exception] = {}
        open_ = list(range(len(rows)))
        seen = dict.fromkeys(("requests", "failed_requests", "retried_rows", "tokens_sent"), 0)
        with ThreadPoolExecutor(self.threads) as pool:
            for turn in range(max_retries + 1):
                if not open_:
                    break
                seen["retried_rows"] += len(open_) if turn else 0
                requests = pack([(i, rows[i]) for i in open_], prefix, criteria, suffix, self.budget, self.count)
                waiting = []
                for request in requests:
                    if self.window:
                        self.window.admit(request.tokens)
                    seen["requests"] += 1
                    seen["tokens_sent"] += request.tokens
                    waiting.append((request, pool.submit(self._one, request.prompt)))
                for request, reply in waiting:
                    got = reply.result()
                    if isinstance(got, Exception):
                        seen["failed_requests"] += 1
                        errors.update(dict.fromkeys(request.rows, got))
                    else:
                        found = read_answers(got, request.rows)
                        answers.update(found)
                        for i in request.rows:
                            errors.pop(i, None)
                open_ = [i for i in open_ if i not in answers]
        if self.metrics:
            self.metrics.add(rows=len(rows), unanswered_rows=len(open_), **seen)
        return [answers[i] if i in answers else errors.get(i, RowError(FAILED)) for i in range(len(rows))]
