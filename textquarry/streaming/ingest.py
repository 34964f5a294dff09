"""Streams: resumable ingest of chunk files, memory of dialogues, ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textquarry.operators.corpus import latest
from textquarry.sources.files import ensure_collection, upsert_points


def stream_upserts(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files: int = 100):
    """Each micro-batch merges its chunks into the store by ``doc_id, chunk_index``; replays change nothing.

    Chunks of a document that came in earlier batches stay, so a document may be spread over any number of files.
    """
    ensure_collection(spark, target, schema)

    def write(batch: DataFrame, _: int) -> None:
        upsert_points(latest(batch, ["doc_id", "chunk_index"], [F.desc("ingested_at"), F.desc("chunk_id")]), target, schema)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dialogue_memory(messages: DataFrame, turns: int) -> DataFrame:
    """``thread, history`` after each micro-batch: the last ``2 * turns`` messages of every thread that spoke.

    ``messages`` is a stream of ``thread, nth, role, content``; the state of a thread never holds more than that.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = [f"{n:012d}|{r}|{c}" for b in batches for n, r, c in b[["nth", "role", "content"]].itertuples(index=False)]
        kept = sorted(set([*kept, *rows]))[-2 * turns :] if turns else []
        state.update((kept,))
        yield pd.DataFrame({"thread": [key[0]], "history": [[x.split("|", 1)[1] for x in kept]]})

    return messages.groupBy("thread").applyInPandasWithState(step, "thread string, history array<string>", "kept array<string>", "update", GroupStateTimeout.NoTimeout)


#: The order of events in a thread: sources before the first token, the end always last.
ORDER = ("sources", "token", "final", "error", "done")


def ordered_events(events: DataFrame) -> DataFrame:
    """``thread, seq, event, data``: events of each thread in the order that they are sent, ended by ``done``.

    ``events`` has ``thread, nth, event, data``; a thread without ``done`` gets one.
    """
    ended = events.groupBy("thread").agg(F.max((F.col("event") == "done").cast("int")).alias("done"), F.max("nth").alias("last"))
    missing = ended.where("done = 0").select("thread", (F.col("last") + 1).alias("nth"), F.lit("done").alias("event"), F.lit("{}").alias("data"))
    place = F.array_position(F.array(*(F.lit(e) for e in ORDER)), F.col("event"))
    every = events.select("thread", "nth", "event", "data").unionByName(missing)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("thread").orderBy(place, "nth"))).select("thread", "seq", "event", "data")


def parsed_frames(raw: DataFrame) -> DataFrame:
    """``id, nth, event, data`` of server-sent event text: frames parted by blank lines, any line ends, broken JSON as ``{}``."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    frames = raw.select("id", F.posexplode(F.split(text, r"\n\n")).alias("nth", "frame")).where(F.col("frame").rlike(r"(?m)^data:"))
    event = F.regexp_extract("frame", r"(?m)^event: ?(.*)$", 1)
    data = F.array_join(F.regexp_extract_all("frame", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    valid = F.try_parse_json(data).isNotNull()
    return frames.select("id", "nth", F.when(event == "", "message").otherwise(event).alias("event"), F.when(valid, data).otherwise("{}").alias("data"))
