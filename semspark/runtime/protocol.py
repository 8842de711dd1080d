"""The wire protocol between rows and a language model: framing, packing under a token budget, reading answers.

Rows go out as ``index=<i>|<row> <endofrow>`` and come back in the same frame, each with a Python or JSON literal.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

END = "<endofrow>"

PREAMBLE = (
    "Each record below is one line of the form index=<number>|<record> and ends with " + END + ". Answer every record, "
    "in any order, as index=<number>|<answer>" + END + " with the same number. An answer is one literal: a string in "
    "quotes, a number, a list or a dictionary, without any words around it.\n"
)


def estimate_tokens(text: str) -> int:
    """About four characters make a token; nothing is free."""
    return -(-len(text) // 4)


def escape(row: str) -> str:
    """A row that cannot be taken for the frame: angle brackets become JSON escapes."""
    return row.replace("<", "\\u003c")


def frame(index: int, row: str) -> str:
    return f"index={index}|{row}"


def parse_literal(text: str) -> object:
    """A Python literal, or else a JSON value. Raises ValueError."""
    text = text.strip()
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return json.loads(text)


class Answer(str):
    """An answer's text, with the value that it was read as."""

    value: object = None


def read_answers(reply: str, wanted: Iterable[int]) -> dict[int, str]:
    """Answers by index. Pieces that are malformed, unknown or come twice are passed over; the first one counts."""
    open_ = set(wanted)
    out: dict[int, str] = {}
    for piece in reply.split(END):
        head, bar, value = piece.strip().partition("|")
        m = re.search(r"index\s*=\s*(-?\d+)\s*$", head)
        if not bar or not m or int(m[1]) not in open_:
            continue
        try:
            read = parse_literal(value)
            answer = Answer(read)
            answer.value = read
            out[int(m[1])] = answer
        except (ValueError, RecursionError):
            continue
        open_.discard(int(m[1]))
    return out


def find_dict(answer: str) -> dict:
    """The first dictionary in an answer, nested or not. Raises ValueError if there is none."""
    if isinstance(answer, Answer) and isinstance(answer.value, dict):
        return answer.value
    start = answer.find("{")
    while start >= 0:
        depth, quote, k = 0, "", start
        while k < len(answer):
            c = answer[k]
            if quote:
                if c == "\\":
                    k += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    break
            k += 1
        try:
            value = parse_literal(answer[start : k + 1])
            if isinstance(value, dict):
                return value
        except (ValueError, RecursionError):
            pass
        start = answer.find("{", start + 1)
    value = json.loads(answer)
    if not isinstance(value, dict):
        raise ValueError("the answer is not a dictionary")
    return value


@dataclass
class Request:
    """A prompt and the indices of the rows in it."""

    prompt: str
    rows: list[int] = field(default_factory=list)
    tokens: int = 0


def pack(rows: list[tuple[int, str]], prefix: str, criteria: str, suffix: str, budget: int, count: Callable[[str], int] = estimate_tokens) -> list[Request]:
    """Requests in row order, each as full as the budget allows. A row that is too large for any goes alone.

    The criteria are said once for each row, so that a long request does not lose them.
    """
    fixed = count(PREAMBLE + prefix + suffix)
    out: list[Request] = []
    body: list[str] = []
    own: list[int] = []
    total = fixed

    def close():
        if own:
            prompt = PREAMBLE + prefix + "".join(body) + suffix
            out.append(Request(prompt, own.copy(), total))
            body.clear()
            own.clear()

    for index, row in rows:
        text = f"{criteria}\n {frame(index, row)} {END}\n"
        cost = count(text)
        if own and total + cost >= budget:
            close()
            total = fixed
        body.append(text)
        own.append(index)
        total += cost
    close()
    return out


def framed_rows(prompt: str) -> list[tuple[int, str]]:
    """The rows of a prompt made by ``pack``."""
    out = []
    for piece in prompt[len(PREAMBLE) :].split(END)[:-1] if prompt.startswith(PREAMBLE) else prompt.split(END)[:-1]:
        found = list(re.finditer(r"index=(\d+)\|", piece))
        if found:
            m = next((x for x in found if x.start() == 0 or piece[x.start() - 2 : x.start()] == "\n "), found[0])
            out.append((int(m[1]), piece[m.end() :].strip()))
    return out
