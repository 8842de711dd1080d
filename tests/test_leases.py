"""One budget for all tasks: never exceeded, and not left idle."""

import json
import pickle
import socket
import threading

from semspark.runtime import leases
from semspark.runtime.clients import CallableLLM
from semspark.runtime.leases import Budget, Lease, LeaseServer
from semspark.runtime.runner import WINDOW_SECONDS, Clock


class SharedClock:
    """Time that passes only while all callers sleep: the first of them to wake moves it on."""

    def __init__(self, callers):
        self.time, self.callers, self.asleep = 0.0, callers, {}
        self.changed = threading.Condition()

    def now(self):
        return self.time

    def sleep(self, seconds):
        with self.changed:
            me = threading.get_ident()
            self.asleep[me] = self.time + seconds
            while self.time < self.asleep[me]:
                if len(self.asleep) >= self.callers:
                    self.time = max(self.time, min(self.asleep.values()))
                    self.changed.notify_all()
                else:
                    self.changed.wait(5)
            del self.asleep[me]

    def leave(self):
        with self.changed:
            self.callers -= 1
            if self.asleep and len(self.asleep) >= self.callers:
                self.time = max(self.time, min(self.asleep.values()))
            self.changed.notify_all()


def run(shares, rpm, tpm, tokens=1):
    """(times of all requests, time at the end) of callers with so many requests each."""
    clock = SharedClock(len(shares))
    server = LeaseServer("127.0.0.1")
    server.budgets["b"] = Budget(rpm, tpm, Clock(clock.now, clock.sleep))
    sent = []

    def task(n):
        own = pickle.loads(pickle.dumps(Lease("127.0.0.1", server.server_address[1], server.secret, "b")))
        own.clock = Clock(clock.now, clock.sleep)
        for _ in range(n):
            own.admit(tokens)
            sent.append(clock.now())
        clock.leave()

    threads = [threading.Thread(target=task, args=(n,)) for n in shares]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    server.shutdown()
    return sorted(sent), clock.now()


def test_skewed_tasks_use_the_whole_budget_and_no_more():
    shares = [95, 3, 1, 1]
    sent, end = run(shares, rpm=11, tpm=10**6)
    assert len(sent) == 100
    windows = {t: sent.count(t) for t in set(sent)}
    assert max(windows.values()) <= 10 and end <= 9 * WINDOW_SECONDS + 1
    # Fixed shares of a quarter each would have let the large task send two or three a window.
    assert end < WINDOW_SECONDS * 95 / 3


def test_tokens_are_one_budget_too():
    sent, _ = run([20, 20], rpm=10**6, tpm=101, tokens=10)
    assert max(sent.count(t) for t in set(sent)) == 10 and len(sent) == 40
    sent, _ = run([3, 2], rpm=10**6, tpm=5, tokens=10)  # each is more than a window has
    assert [sent.count(t) for t in sorted(set(sent))] == [1] * 5


def test_what_a_dead_task_was_granted_stays_used():
    now = [0.0]
    server = LeaseServer("127.0.0.1")
    server.budgets["b"] = Budget(11, 10**6, Clock(lambda: now[0], lambda s: None))
    ask = lambda own: own._ask(1)
    dying = Lease("127.0.0.1", server.server_address[1], server.secret, "b")
    assert [ask(dying) for _ in range(7)] == [0.0] * 7
    dying._file.close()  # the task dies with its requests in flight, and is run again
    again = Lease("127.0.0.1", server.server_address[1], server.secret, "b")
    assert [ask(again) > 0 for _ in range(5)] == [False] * 3 + [True] * 2
    now[0] = WINDOW_SECONDS
    assert ask(again) == 0.0
    with socket.create_connection(server.server_address, timeout=5) as stranger:
        stranger.sendall(json.dumps({"secret": "no", "budget": "b", "tokens": 1}).encode() + b"\n")
        assert stranger.recv(100) == b""
    server.shutdown()


def test_tasks_of_a_job_borrow_from_the_driver(spark):
    """Three models' tasks in worker processes count against their own budgets."""
    import semspark as ss

    df = spark.range(60).repartition(4)
    llm = CallableLLM(lambda t: {"m": json.loads(t)["id"]}, rpm=10**6, tpm=10**9, max_tokens=200, leases=True)
    for _ in range(2):
        got = ss.finalize(ss.map(prompt="p", output_fields={"m": "long"})(llm, df)).collect()
        assert all(r.id == r.m for r in got)
    budget = leases._server.budgets[llm._budget]
    assert budget._count >= 2 * 4 and llm.tasks(4) == 4
