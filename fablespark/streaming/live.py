"""The same operators over streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fablespark.functions import emotion as E
from fablespark.functions.text import normalize_text


def emotion_stream(turns: DataFrame, expressiveness: float = 0.68) -> DataFrame:
    """Row-local scoring: unchanged under readStream."""
    clean = turns.withColumn("text", normalize_text(F.col("text")))
    return clean.withColumn("emotion", E.detect_emotion(F.col("text"), F.lit(expressiveness))).withColumn("auto", E.auto_style(F.col("text")))


def activity(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class _LastTwo(StatefulProcessor):
    """The last two speakers of a key, forgotten when the key was silent for ``ttl_ms``."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("speakers", "last string, older string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last, older = self.state.get() if self.state.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values("turn", na_position="first")
        who = []
        for speaker in batch["speaker"]:
            if pd.isna(speaker):
                speaker = older if last is not None and older is not None and last != older else None
            if speaker is not None:
                last, older = speaker, last
            who.append(speaker)
        self.state.update((last, older))
        yield pd.DataFrame({self.key: batch[self.key], "turn": batch["turn"], "speaker": who})

    def close(self) -> None:
        pass


def attribute_turns(turns: DataFrame, key: str = "conv_id", ttl: dt.timedelta = dt.timedelta(hours=6)) -> DataFrame:
    """Speakers of turns that come piecemeal: unknown ones alternate between the last two of their key.

    turns: key, turn, speaker (null where unknown). State is the last two speakers of each key, dropped
    once the key has had no turn for ``ttl``, after which it starts anew. One micro-batch of a key is
    sorted by turn in one task, so the source should bound its micro-batches. Needs the RocksDB state store;
    as time passes even without rows, such a stream never counts as idle: give it a trigger interval and end it by stop().
    """
    out = f"{key} {turns.schema[key].dataType.simpleString()}, turn long, speaker string"
    processor = _LastTwo(key, int(ttl.total_seconds() * 1000))
    return turns.select(key, "turn", "speaker").groupBy(key).transformWithStateInPandas(processor, out, "append", "ProcessingTime")


def drop_repeats(turns: DataFrame, keys: list[str], ts: str = "ts", late: str = "30 minutes") -> DataFrame:
    """turns without those whose keys came before within ``late``; the keys are forgotten after that."""
    return turns.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def attribute_stream(segs: DataFrame, spans: DataFrame, keys: list[str], late: str = "30 minutes", apart: str = "1 hour") -> DataFrame:
    """Segments with the speaker of the first span that overlaps them, both coming as streams (or tables).

    segs: keys, seg_idx, start, end, ts; spans: keys, start, end, speaker, ts. Ranges are half-open. A span counts
    for a segment when their times differ by at most ``apart``; spans without a speaker do not count, and
    ``speaker`` is null where none overlaps. A segment comes out, once, when no span can join it any more;
    rows later than ``late`` are left out and state is dropped behind the watermark. Rows with a null key have no span.
    """
    s = segs.select(*keys, "seg_idx", "start", "end", "ts").withWatermark("ts", late)
    d = spans.filter(F.col("speaker").isNotNull()).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start").alias("__start"), F.col("end").alias("__end"), "speaker", F.col("ts").alias("__ts"))
    d = d.withWatermark("__ts", late)
    same = reduce(and_, (F.col(k) == F.col(f"__{k}") for k in keys))
    near = F.expr(f"__ts >= ts - interval {apart} and __ts <= ts + interval {apart}")
    joined = s.join(d, same & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end")) & near, "left_outer")
    first = F.min_by("speaker", F.struct("__start", "__end", "speaker"))
    return joined.groupBy(*keys, "seg_idx", "start", "end", "ts").agg(first.alias("speaker"))
