"""Implicit feedback as a stream: each event is held against the one before it, by session.

A session's state is its last event and the events that the watermark has not
passed yet. Events are looked at in the order of their times once no earlier one can
come, so their order of arrival doesn't matter within the watermark, and what comes
later than that is dropped by Spark. A session that is silent for longer than
``expiry`` is forgotten, its next event has none before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from weftline.operators.analytics import PIN_WEIGHT, REWRITE_SIMILARITY, REWRITE_WEIGHT

SIGNALS = "event_id string, signal string, weight double, similarity double, file_path string, chunk_index int, matched_by string"
_WORD = re.compile("[a-z0-9_]+")


def signals_of(before: dict | None, now: dict) -> list[tuple]:
    """The signals of an event whose predecessor is known, as rows of ``SIGNALS``."""
    if before is None:
        return []
    out = []
    words, earlier = set(_WORD.findall(now["text"].lower())), set(_WORD.findall(before["text"].lower()))
    if before["seed_count"] == 0 and (words or earlier):
        similarity = len(words & earlier) / len(words | earlier)
        if similarity >= REWRITE_SIMILARITY:
            out.append((now["event_id"], "no_hit_rewrite", REWRITE_WEIGHT, similarity, None, None, None))
    text = now["text"].lower()
    for path, index in sorted({tuple(c) for c in before["chunks"]}):
        stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1]).lower()
        bare = stem.replace("_", "").replace("-", "")
        if stem and (stem in words or bare in words):
            out.append((now["event_id"], "path_pin", PIN_WEIGHT, None, path, index, "token"))
        elif stem and (stem in text or bare in text):
            out.append((now["event_id"], "path_pin", PIN_WEIGHT, None, path, index, "text"))
    return out


def feedback_stream(events: DataFrame, session: str = "session", ts: str = "ts", late: str = "10 minutes", expiry: int | None = 30 * 60 * 1000) -> DataFrame:
    """The signals of a stream of (session, ts, event_id, text, seed_count, chunks array<file_path, chunk_index>).

    ``expiry`` is in milliseconds; without one a session is kept for good.
    """
    rows = events.selectExpr(session, f"cast({ts} as timestamp) as _ts", "event_id", "coalesce(text, '') as text", "coalesce(seed_count, 0) as seed_count", "to_json(transform(chunks, c -> array(c.file_path, cast(c.chunk_index as string)))) as chunks")
    rows = rows.withWatermark("_ts", late)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, waiting = (json.loads(x) for x in state.get) if state.exists else (None, [])
        for part in parts:
            for at, event_id, text, seeds, chunks in zip(part["_ts"], part["event_id"], part["text"], part["seed_count"], part["chunks"], strict=True):
                own = [[p, int(k)] for p, k in json.loads(chunks or "[]")]
                waiting.append({"at": int(at.value // 1_000_000), "event_id": event_id, "text": text, "seed_count": int(seeds), "chunks": own})
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda e: (e["at"], e["event_id"]))
        found = []
        while waiting and waiting[0]["at"] <= passed:
            now = waiting.pop(0)
            if before is not None and expiry is not None and now["at"] - before["at"] > expiry:
                before = None
            found += signals_of(before, now)
            before = now
        if before is not None and not waiting and expiry is not None and passed - before["at"] > expiry:
            state.remove()
        else:
            state.update((json.dumps(before), json.dumps(waiting)))
            due = waiting[0]["at"] if waiting else (before["at"] + expiry if expiry is not None else None)
            if due is not None:
                state.setTimeoutTimestamp(max(due, passed + 1))
        if found:
            yield pd.DataFrame(found, columns=[c.split(" ")[0] for c in SIGNALS.split(", ")]).astype({"chunk_index": "Int32"})

    return rows.groupBy(session).applyInPandasWithState(fold, SIGNALS, "before string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
