import json
import random
import threading
import time

import pytest

from semspark.runtime.clients import LLM, RATE_LIMITS, Azure, CallableLLM, Gemini, Huggingface, Mistral, Ollama, OpenAI, limits_of
from semspark.runtime.protocol import END, escape, estimate_tokens, find_dict, framed_rows, pack, read_answers
from semspark.runtime.runner import FAILED, BatchRunner, Clock, RateWindow


def runner(replies):
    calls = []

    def send(prompt):
        calls.append(prompt)
        reply = replies[min(len(calls), len(replies)) - 1]
        if isinstance(reply, Exception):
            raise reply
        return reply

    return BatchRunner(send, 10_000, threads=1), calls


def test_answers_are_read_in_row_order():
    r, calls = runner([f"index=1|'world'{END}\n index=0|'hello'{END}"])
    assert r.run(["a", "b"]) == ["hello", "world"] and len(calls) == 1


def test_no_rows_make_no_call():
    r, calls = runner(["x"])
    assert r.run([]) == [] and not calls


def test_only_missing_rows_are_sent_again_with_their_own_index():
    r, calls = runner([f"index=0|'a'{END}index=1|oops({END}index=7|'z'{END}", f"index=1|'b'{END}index=1|'c'{END}"])
    assert r.run(["x", "y"]) == ["a", "b"]
    assert [i for i, _ in framed_rows(calls[1])] == [1]


def test_rows_without_an_answer_end_in_an_error():
    r, calls = runner(["nothing"])
    out = r.run(["x", "y"], max_retries=2)
    assert [str(e) for e in out] == [FAILED, FAILED] and len(calls) == 3


def test_a_request_that_raises_is_tried_again():
    r, _ = runner([OSError("down"), f"index=0|1{END}"])
    assert r.run(["x"]) == ["1"]
    r, _ = runner([OSError("down")])
    assert str(r.run(["x"], max_retries=1)[0]) == "down"


def test_packing_keeps_order_and_sends_large_rows_alone():
    rows = [(i, "x" * n) for i, n in enumerate([10, 10, 5000, 10])]
    made = pack(rows, "p", "c", "s", 400)
    assert [r.rows for r in made] == [[0, 1], [2], [3]]
    assert all(estimate_tokens(r.prompt) < 400 for r in made if 2 not in r.rows)


def test_rate_window_waits():
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    w = RateWindow(3, 10**9, Clock(lambda: now[0], sleep))
    for _ in range(5):
        w.admit(1)
    assert slept == [61.0, 61.0]
    w = RateWindow(10**9, 100, Clock(lambda: now[0], sleep))
    w.admit(500)
    w.admit(1)
    assert len(slept) == 3


@pytest.mark.parametrize("text,value", [("{'a': {'b': '}'}}", {"a": {"b": "}"}}), ('say {"a": null} end', {"a": None}), ("{x} {'k': [1, '{']}", {"k": [1, "{"]})])
def test_find_dict(text, value):
    assert find_dict(text) == value


def test_find_dict_refuses_others():
    for bad in ("[1]", "none", "{"):
        with pytest.raises(ValueError):
            find_dict(bad)


def test_hostile_rows_survive_the_round_trip():
    rng = random.Random(1)
    rows = ["".join(rng.choice(["|", "}", "{", "'", '"', "\n", END, "index=3|", "a", "é"]) for _ in range(8)) for _ in range(40)]
    llm = CallableLLM(lambda row: row)
    got = llm([escape(r) + "." for r in rows])
    assert [g.split() for g in got] == [(escape(r) + ".").strip().split() for r in rows]


def test_read_answers_ignores_noise():
    assert read_answers(f"hm index=0|{{'a': 1}}{END} index=x|1{END}|{END}", [0]) == {0: "{'a': 1}"}


def test_limits_are_those_of_the_exact_name(caplog):
    assert len(RATE_LIMITS) == 25
    assert limits_of("gpt-4-0125-preview") == limits_of("gpt-4-1106-preview") == {"tpm": 30_000, "rpm": 500}
    assert limits_of("gpt-4-0613")["tpm"] == 10_000 and limits_of("gpt-4o-mini") is None
    llm = LLM("openai/gpt-4o-mini")
    assert (llm.rpm, llm.tpm) == (500, 200_000) and "rpm and tpm" in caplog.text
    assert LLM("openai/gpt-4o-mini", rpm=7, tpm=9).rpm == 7


def test_tasks_share_the_limits():
    llm = LLM("openai/gpt-4", rpm=100, tpm=1000)
    assert llm.tasks(8) == 8 and llm.tasks(500) == 25 and LLM("openai/gpt-4", parallelism=3).tasks(8) == 3
    own = llm.shared_by(llm.tasks(500))
    assert own.window().rpm * 25 == 100 and own.window().tpm * 25 == 1000 and llm.window().rpm == 100


def test_plain_batches_run_side_by_side_and_are_tried_again():
    here, most, lock = [0], [0], threading.Lock()
    failed = set()

    class Slow(LLM):
        def complete(self, prompt):
            with lock:
                here[0] += 1
                most[0] = max(most[0], here[0])
            time.sleep(0.05)
            with lock:
                here[0] -= 1
            if prompt.endswith("3") and prompt not in failed or prompt.endswith("9"):
                failed.add(prompt)
                raise ValueError(prompt)
            return prompt.upper()

    llm = Slow("x/y", rpm=1000, tpm=10**9)
    out = llm(["row1", "row3", "row9", "row4"], "p ", "c", "", optimized=False, max_retries=1)
    assert most[0] > 1 and out[0] == "P C\nROW1" and out[1].endswith("ROW3") and isinstance(out[2], ValueError) and out[3].endswith("ROW4")
    assert isinstance(llm.complete_all(["a9"])[0], ValueError) and llm.complete_all([]) == []


def test_requests_of_the_clients():
    body = lambda llm: json.loads(llm.request("hi").data)
    assert OpenAI("gpt-4o").request("hi").full_url == "https://api.openai.com/v1/chat/completions" and body(OpenAI("gpt-4o", top_p=1))["top_p"] == 1
    assert Ollama("m").request("x").full_url == "http://localhost:11434/v1/chat/completions" and body(Ollama("m"))["model"] == "m"
    azure = Azure("gpt-4", api_key="k", api_base="https://h", api_version="v").request("x")
    assert azure.full_url == "https://h/openai/deployments/gpt-4/chat/completions?api-version=v" and azure.get_header("Api-key") == "k"
    for made, model in ((Gemini(api_key="k"), "gemma-3-1b-it"), (Mistral(api_key="k"), "mistral-tiny"), (Huggingface("a/b", api_key="k"), "a/b")):
        assert body(made)["model"] == model and made.request("x").get_header("Authorization") == "Bearer k"
