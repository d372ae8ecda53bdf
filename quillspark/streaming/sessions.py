"""Stream sessions: endpoint segmentation per key, as a stateful streaming operator and as batch kernels.

Two clocks are kept apart: segments are timed by a session's own samples, idleness by arrival.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import by_key, in_order

RATE = 16000
FRAME = RATE // 100


@dataclass
class Rules:
    """Seconds after which a segment ends: of silence without speech, of silence after speech, and in all.

    Each end begins a new segment; one without text gives no final.
    """

    still: float = 2.0
    silence: float = 0.8
    longest: float = 20.0
    char_seconds: float = 0.5
    char: str = "字"


@dataclass
class Segmenter:
    """State of one session; text is one character per half second of speech."""

    total: int = 0
    start: int = 0
    speech: int = 0
    trailing: int = 0
    chunks: int = 0
    finals: int = 0

    def ms(self, samples: int) -> int:
        return round(samples * 1000 / RATE)

    def text(self, rules: Rules) -> str:
        return rules.char * int(self.speech // (RATE * rules.char_seconds))

    def _close(self, rules: Rules) -> list[tuple[str, int, int]]:
        text = self.text(rules)
        out = [(text, self.ms(self.start), self.ms(self.total))] if text else []
        self.finals += len(out)
        self.speech = self.trailing = 0
        self.start = self.total
        return out

    def feed(self, data: bytes, rules: Rules) -> tuple[str, list[tuple[str, int, int]]]:
        """Partial text and finished segments after a chunk of PCM16."""
        return self.hear(*measure(data), rules)

    def hear(self, total: int, speech: int, tail: int, rules: Rules) -> tuple[str, list[tuple[str, int, int]]]:
        """As ``feed``, of a chunk's samples, those with speech, and those of the silence it ends with."""
        self.chunks += 1
        self.total += total
        self.speech += speech
        self.trailing = tail if speech else self.trailing + tail
        quiet = self.trailing >= (rules.silence if self.speech else rules.still) * RATE
        if quiet or self.total - self.start >= rules.longest * RATE:
            return "", self._close(rules)
        return self.text(rules), []

    def finish(self, rules: Rules) -> list[tuple[str, int, int]]:
        return self._close(rules)


def measure(data: bytes) -> tuple[int, int, int]:
    """A chunk of PCM16 by frames: samples, samples of frames with speech, samples after the last of these."""
    samples = np.frombuffer(data, "<i2")
    n = len(samples)
    loud = np.flatnonzero(samples) // FRAME
    if not len(loud):
        return n, 0, n
    frames = np.unique(loud)
    end = min(n, (int(frames[-1]) + 1) * FRAME)
    return n, (len(frames) - 1) * FRAME + end - int(frames[-1]) * FRAME, n - end


def measured(pcm16):
    """Column of ``measure`` of a column; nulls for what is no PCM16."""

    @F.pandas_udf("total int, speech int, tail int")
    def run(chunks: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 3 if x is None or len(x) % 2 else measure(x) for x in chunks]
        return pd.DataFrame(rows, columns=["total", "speech", "tail"]).astype("Int32")

    return run(pcm16)


OUT = "session_id string, seq long, status string, partial string, finals array<struct<text:string,startMs:long,endMs:long>>"
STATE = T.StructType([*(T.StructField(n, T.LongType()) for n in ("total", "start", "speech", "trailing", "chunks", "finals")), T.StructField("open", T.BooleanType())])


def _step(state: Segmenter | None, control: str, chunk: tuple[int, int, int] | None, rules: Rules) -> tuple[Segmenter | None, str, str, list]:
    """The next state, status, partial text and finals of a row: open, audio, finish or delete."""
    if control == "open":
        return (state, "exists", "", []) if state else (Segmenter(), "open", "", [])
    if state is None:
        return None, "unknown_session", "", []
    if control == "audio":
        if chunk is None:
            return state, "bad_audio", "", []
        partial, finals = state.hear(*chunk, rules)
        return state, "ok", partial, finals
    if control == "finish":
        return None, "finished", "", state.finish(rules)
    return None, "closed", "", []


def _row(key: str, seq: int, status: str, partial: str, finals: list) -> tuple:
    return key, seq, status, partial, [{"text": t, "startMs": a, "endMs": b} for t, a, b in finals]


NAMES = ["session_id", "seq", "status", "partial", "finals"]


def segment_batch(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Replays rows (session_id, seq, control, pcm16) of each session in order of seq.

    Chunks are measured where they lie, so that three numbers of each move and are sorted instead of its audio.  Rows
    are streamed in their order and only the segmenter's six numbers are kept from one to the next.
    """
    own = rules or Rules()

    def step(state: Segmenter | None, r) -> tuple[Segmenter | None, tuple]:
        state, *rest = _step(state, r.control, (int(r.total), int(r.speech), int(r.tail)) if r.total == r.total and r.total is not None else None, own)
        return state, _row(r.session_id, r.seq, *rest)

    heard = rows.select("session_id", "seq", "control", measured("pcm16").alias("heard")).select("session_id", "seq", "control", "heard.*")
    return in_order(heard, ["session_id"], ["seq"], by_key(lambda: None, step, NAMES, "session_id"), OUT)


class SessionProcessor(StatefulProcessor):
    """Segments each session's rows as they arrive; rows of a micro-batch are taken in order of seq.

    A session that gets no audio for longer than ``idle_ms`` of processing time is dropped.
    """

    def __init__(self, rules: Rules | None = None, idle_ms: int = 30_000):
        self.rules, self.idle_ms = rules or Rules(), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("segment", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state = Segmenter(*map(int, held[:6])) if held and held[6] else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            good = r.pcm16 is not None and len(r.pcm16) % 2 == 0
            state, *rest = _step(state, r.control, measure(bytes(r.pcm16)) if good else None, self.rules)
            out.append(_row(key[0], r.seq, *rest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
        else:
            self.state.update((state.total, state.start, state.speech, state.trailing, state.chunks, state.finals, True))
            now = timerValues.getCurrentProcessingTimeInMs()
            if now > 0:
                self.handle.registerTimer(now + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([_row(key[0], -1, "idle", "", [])], columns=NAMES)

    def close(self) -> None:
        pass


def segment_stream(rows: DataFrame, rules: Rules | None = None, idle_ms: int = 30_000) -> DataFrame:
    """The streaming form of ``segment_batch``; needs the RocksDB state store."""
    return rows.groupBy("session_id").transformWithStateInPandas(SessionProcessor(rules, idle_ms), OUT, "append", "processingTime")


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str, order: str) -> DataFrame:
    """Sessions of a key: a new one begins when the time since its last event is more than ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    new = (F.col(ts) - F.lag(ts).over(w)) > F.expr(f"INTERVAL {gap}")
    marked = events.withColumn("_n", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(key, "_n").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events")).drop("_n")


def admit(sessions: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """Which sessions (session_id, first_ts, last_ts) get one of ``most`` places, in order of arrival.

    A rejected session never holds a place, so a server's log is worked through in sequence; logs of several
    servers go side by side (the column ``by``).  Only the ends of the ``most`` open sessions are kept.
    """

    def step(busy: list, r) -> tuple[list, tuple]:
        while busy and busy[0] < r.first_ts:
            heapq.heappop(busy)
        if len(busy) == most:
            return busy, (r.session_id, "rejected")
        heapq.heappush(busy, r.last_ts)
        return busy, (r.session_id, "open")

    rows = sessions.select((F.col(by) if by else F.lit(0)).alias("server"), "session_id", "first_ts", "last_ts")
    return in_order(rows, ["server"], ["first_ts", "session_id"], by_key(list, step, ["session_id", "status"], "server"), "session_id string, status string")


def load_counts(log: DataFrame, engine: str, model: str, ts: str, idle: str, order: str) -> DataFrame:
    """Loads and unloads of engines that serve one model at a time: a request loads if it is an engine's
    first, asks for another model, or comes at least ``idle`` after the one before."""
    marked = _kinds(log, engine, model, ts, idle, order)
    return marked.groupBy("kind").agg(F.count("*").alias("requests"))


def _kinds(log: DataFrame, engine: str, model: str, ts: str, idle: str, order: str) -> DataFrame:
    w = Window.partitionBy(engine).orderBy(ts, order)
    before, late = F.lag(model).over(w), (F.col(ts) - F.lag(ts).over(w)) >= F.expr(f"INTERVAL {idle}")
    return log.select(engine, F.when(before.isNull(), "first").when(late, "idle").when(before != F.col(model), "switch").otherwise("warm").alias("kind"))


def lifecycle(log: DataFrame, engine: str, model: str, ts: str, idle: str, order: str) -> DataFrame:
    """Of each engine: loads, unloads after idleness, unloads before another model, requests that found it loaded.

    A switch unloads before it loads, so at no time two models are loaded; the last one is still loaded at the end.
    """
    kinds = _kinds(log, engine, model, ts, idle, order)
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return kinds.groupBy(engine).agg(n("first", "idle", "switch").alias("loads"), n("idle").alias("idle_unloads"), n("switch").alias("switch_unloads"), n("warm").alias("warm"))
