"""Conversation state on a stream: case files and the window of last messages. The state is typed, bounded for each
conversation, and freed by a timeout after its last change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.operators.turns import CLEAR, KEEP

#: Milliseconds after its last change at which the state of a conversation goes: thirty days.
LIVES = 30 * 24 * 3600 * 1000
CASE = "conv_id long, version string, chip string, topic string, category string, asked boolean, diagnostics long, pending string, tried array<string>"
_EMPTY = {"version": None, "chip": None, "topic": None, "category": None, "asked": False, "diagnostics": 0, "pending": None, "tried": []}


def merged_case(case: dict, update: dict) -> dict:
    """One update put into a case file: the rules of operators.turns.case_files, row by row."""
    out = dict(case)
    if update.get("new_problem"):
        out = {**_EMPTY, "version": out["version"], "chip": out["chip"]}
    for k in ("version", "chip"):
        out[k] = update.get(k) or out[k]
    out["topic"] = out["topic"] or update.get("topic") or None
    if update.get("category") not in (None, "", "general"):
        out["category"] = update["category"]
    low = {t.lower() for t in out["tried"]}
    for t in update.get("tried") if update.get("tried") is not None else []:
        if t.lower() not in low:
            out["tried"] = [*out["tried"], t]
            low.add(t.lower())
    out["asked"] = out["asked"] or bool(update.get("asked"))
    out["diagnostics"] = max(out["diagnostics"], int(update.get("diagnostics") or 0))
    if update.get("pending"):
        out["pending"] = None if update["pending"] == CLEAR else update["pending"]
    return out


def none_for_nan(row: dict) -> dict:
    return {k: None if isinstance(v, float) and pd.isna(v) else v for k, v in row.items()}


def stream_case_files(updates: DataFrame, lives: int = LIVES) -> DataFrame:
    """The case file of a conversation after each micro-batch with updates of it; updates as in operators.turns.case_files, those
    of a batch in the order of their turns. After `lives` milliseconds without an update a conversation is forgotten, and
    starts anew with the next."""
    names = [c.split()[0] for c in CASE.split(", ")]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        case = dict(_EMPTY) | (dict(zip(names[1:], held.get, strict=True)) if held.exists else {})
        case["tried"] = list(case["tried"])
        for row in pd.concat(list(parts)).sort_values("turn").to_dict("records"):
            case = merged_case(case, none_for_nan(row))
        held.update(tuple(case[n] for n in names[1:]))
        held.setTimeoutDuration(lives)
        yield pd.DataFrame([{"conv_id": key[0], **case}])[names]

    return updates.groupBy("conv_id").applyInPandasWithState(fold, CASE, CASE.removeprefix("conv_id long, "), "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_history(messages: DataFrame, keep: int = KEEP, lives: int = LIVES) -> DataFrame:
    """(conv_id, turns): the last `keep` turns of a conversation after each micro-batch with messages of it, forgotten `lives`
    milliseconds after the last."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        before = list(held.get[0]) if held.exists else []
        now = sorted([*before, *(int(t) for p in parts for t in p["turn"])])[-keep:]
        held.update((now,))
        held.setTimeoutDuration(lives)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [",".join(map(str, now))]})

    return messages.select("conv_id", "turn").groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, turns string", "held array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_once(rows: DataFrame, key: str) -> DataFrame:
    """Each key once, however often it comes, also over restarts from the checkpoint: what an ingest embeds."""
    return rows.dropDuplicates([key])
