"""Deterministic in-process models for the queries: each rule reads a row's JSON and answers as a model would."""

from __future__ import annotations

import json


def _row(text: str) -> dict:
    return json.loads(text)


def wanted_event(text: str) -> dict:
    row = _row(text)
    return {**row, "__filter__": row["event_type"] in ("purchase", "signup")}


def wanted_event_or_error(text: str) -> dict:
    row = _row(text)
    if row["event_id"] % 10 == 3:
        raise ValueError("no answer")
    return wanted_event(text)


def metal_part(text: str) -> dict:
    row = _row(text)
    return {"__filter__": str(len(row["p_type"]) % 2 == 0)}


def machinery_customer(text: str) -> dict:
    return {"__filter__": _row(text)["c_mktsegment"] == "MACHINERY"}


def rich_customer(text: str) -> dict:
    return {"__filter__": _row(text)["c_acctbal"] > 0}


def part_words(text: str) -> dict:
    first, _, rest = _row(text)["p_name"].partition(" ")
    return {"adjective": first, "noun": rest.split(" ")[0]}


def name_length(text: str) -> dict:
    return {"name_length": len(_row(text)["c_name"])}


def mask_name(text: str) -> dict:
    return {"c_name": "XX"}


def event_note(text: str) -> dict:
    row = _row(text)
    if row["event_id"] % 3 == 0:
        return {"note": row["event_type"].upper()}
    if row["event_id"] % 3 == 1:
        return {"note": "other", "event_type": None}
    return {}


def event_note_or_error(text: str) -> dict:
    row = _row(text)
    if row["event_id"] % 7 == 2:
        raise ValueError("no answer")
    return {"note": row["event_type"].upper()}


def event_label(text: str) -> dict:
    return {"label": _row(text)["event_type"].upper()}


def order_rank(text: str) -> dict:
    return {"rank": int(_row(text)["o_orderpriority"][0])}


def text_length(text: str) -> dict:
    return {"text_length": len(_row(text)["text"])}


def long_text(text: str) -> dict:
    return {"__filter__": len(_row(text)["text"]) > 1500}


def same_text(text: str) -> object:
    """Verdict over a cluster: rows with the text of the row of least id."""
    rows = []
    for line in text.split("\n"):
        if line.startswith("ID "):
            head, _, body = line[3:].partition(": ")
            rows.append((int(head), json.loads(body)["text"]))
    rows.sort()
    same = [i for i, t in rows[1:] if t == rows[0][1]]
    return {"canonical_id": rows[0][0], "duplicate_ids": same} if same else "NO_DUPLICATES"


def loud_nation(text: str) -> dict:
    return {"loud": _row(text)["n_name"].upper()}


def answer_name(prompt: str) -> str:
    """Answers a whole prompt, whose last line is a name."""
    name = prompt.rsplit("\n", 1)[-1]
    if name.startswith("A"):
        raise ValueError("refused")
    return f"name: {name}"


def part_is_of_kind(text: str) -> dict:
    """A pair of a part and a kind: the name ends with the kind."""
    pair = _row(text)
    return {"answer": pair["first"]["p_name"].split(" ")[1] == pair["second"]["kind"]}


def same_segment(text: str) -> dict:
    pair = _row(text)
    return {"answer": pair["first"]["c_mktsegment"].lower() == pair["second"]["segment"]}


def dearer_order(text: str) -> dict:
    """A pair of orders: whether the first has the higher price."""
    pair = _row(text)
    return {"answer": pair["first"]["o_totalprice"] > pair["second"]["o_totalprice"]}


def count_and_add(text: str) -> dict:
    """A list of line items, or of such answers: how many, and the sum of their quantities."""
    n, total = 0, 0
    for row in _row(text):
        n += row.get("n", 1)
        total += row["total"] if "n" in row else round(row["l_quantity"])
    return {"answer": {"n": n, "total": total}}


def event_family(text: str) -> dict:
    """Labels an event, in unsteady writing; merges a list of labels."""
    row = _row(text)
    if isinstance(row, list):
        return {"answer": sorted({label.strip("! ").lower() for label in row})}
    family = "money" if row["event_type"] in ("purchase", "signup") else "browsing" if row["event_type"] in ("view", "click") else "fault"
    return {"answer": family.upper() + "!" if row["user_id"] % 2 else family}


def known_family(text: str) -> dict:
    row = _row(text)
    return event_family(text) if isinstance(row, list) else {"answer": event_family(text)["answer"].strip("! ").lower()}
