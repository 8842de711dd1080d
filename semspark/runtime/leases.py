"""One budget of requests and tokens for all tasks of an application, held by the driver.

A task asks the driver before each request and is told to go or how long to wait; nothing is dealt out ahead of time, so
the budget of idle tasks is there for the busy ones, and what a dead task was granted counts as used. The driver listens
on a port that executors can reach, and answers only callers that know the budget's secret.
"""

from __future__ import annotations

import json
import os
import secrets
import socket
import socketserver
import threading

from .runner import WINDOW_SECONDS, Clock


class Budget:
    """Grants requests while both limits of the current window last. For many callers at once."""

    def __init__(self, rpm: float, tpm: float, clock: Clock | None = None):
        self.rpm, self.tpm, self.clock = max(2.0, rpm), max(1.0, tpm), clock or Clock()
        self._lock = threading.Lock()
        self._began, self._count, self._tokens = None, 0, 0

    def borrow(self, tokens: int) -> float:
        """0 for a request that is granted, else the seconds until the next window. A request of more tokens than a
        window has is granted as a window's first."""
        with self._lock:
            now = self.clock.now()
            if self._began is None or now - self._began >= WINDOW_SECONDS:
                self._began, self._count, self._tokens = now, 0, 0
            if self._count and (self._count + 1 >= self.rpm or self._tokens + tokens >= self.tpm):
                return max(0.001, WINDOW_SECONDS - (now - self._began))
            self._count += 1
            self._tokens += tokens
            return 0.0


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        for line in self.rfile:
            try:
                asked = json.loads(line)
                known = self.server.budgets.get(asked["budget"]) if secrets.compare_digest(str(asked["secret"]), self.server.secret) else None
            except (ValueError, KeyError, TypeError):
                known = None
            if known is None:
                return  # not one of ours
            self.wfile.write(json.dumps({"wait": known.borrow(int(asked["tokens"]))}).encode() + b"\n")


class LeaseServer(socketserver.ThreadingTCPServer):
    """The driver's side: budgets by name. One for a process serves all models."""

    daemon_threads = allow_reuse_address = True
    request_queue_size = 4096

    def __init__(self, host: str = ""):
        super().__init__((host, 0), _Handler)
        self.budgets: dict[str, Budget] = {}
        self.secret = secrets.token_hex(16)
        threading.Thread(target=self.serve_forever, daemon=True).start()


_server: LeaseServer | None = None
_starting = threading.Lock()


class Lease:
    """A task's side of a budget: small, and can be sent to tasks. ``admit`` returns once a request may be sent."""

    def __init__(self, host: str, port: int, secret: str, budget: str, clock: Clock | None = None):
        self.host, self.port, self.secret, self.budget, self.clock = host, port, secret, budget, clock
        self._file = None
        self._lock = threading.Lock()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_file", "_lock")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._file, self._lock = None, threading.Lock()

    def _ask(self, tokens: int) -> float:
        if self._file is None:
            # The connection stays open for the task's requests; it closes with the process.
            self._file = socket.create_connection((self.host, self.port), timeout=60).makefile("rwb")
        self._file.write(json.dumps({"secret": self.secret, "budget": self.budget, "tokens": tokens}).encode() + b"\n")
        self._file.flush()
        line = self._file.readline()
        if not line:
            raise ConnectionError("the driver's budget does not answer")
        return json.loads(line)["wait"]

    def admit(self, tokens: int) -> None:
        clock = self.clock or Clock()
        while True:
            with self._lock:
                try:
                    wait = self._ask(tokens)
                except OSError:  # a connection that broke is made anew, once
                    self._file = None
                    wait = self._ask(tokens)
            if not wait:
                return
            clock.sleep(wait)


def lease(spark, name: str, rpm: float, tpm: float) -> Lease:
    """A lease on the budget ``name`` of this driver, which is made at its first use."""
    global _server
    with _starting:
        if _server is None:
            _server = LeaseServer()
        _server.budgets.setdefault(name, Budget(rpm, tpm))
    host = spark.conf.get("spark.driver.host", None) or os.environ.get("SPARK_LOCAL_IP") or socket.gethostname()
    return Lease(host, _server.server_address[1], _server.secret, name)
