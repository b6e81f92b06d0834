"""The ingest as Structured Streaming jobs.

* T4 ``game_stream``: landing directory of dump files -> one row per game
  (same record split and parse as the batch path), ``maxFilesPerTrigger``
  for back-pressure.
* T5 ``dedup``: the first row of each game id, late files included, with state that expires.
* T6 ``start_upsert``: ``foreachBatch`` into the tables with the batch
  ingest (E1 -> E2 -> K3/K4); a replayed micro-batch inserts nothing.
* T2 ``replay_lines`` / T3 ``assemble``: a line-per-message topic (key =
  source file, offset order) and the keyed state that rebuilds games.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ingest import ingest_tags
from ..sources.pgn import RECORD_SEP, encode_games, parse_tags, split_records, with_position

SEGMENT_LINES = 1 << 19  # lines in a file of the message log

LINE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.StringType()),
])


# --- T4 ---------------------------------------------------------------------
def record_stream(spark: SparkSession, landing: str, max_files: int = 1) -> DataFrame:
    """(file, block, raw, open) per game from dump files arriving in ``landing``."""
    return split_records(spark.readStream.option("lineSep", RECORD_SEP)
                         .option("maxFilesPerTrigger", max_files).text(landing))


def game_stream(spark: SparkSession, landing: str, max_files: int = 1) -> DataFrame:
    """T4: typed game rows (players still as names) as a stream.

    Tags above their game's ``[Event`` line come as a row of their own, which no movetext
    closes; the load (T6), which sees whole micro-batches, puts them together."""
    recs = record_stream(spark, landing, max_files).withColumn("pos", F.lit(0).cast("long"))
    return encode_games(parse_tags(recs))


# --- T5 ---------------------------------------------------------------------
def dedup(games: DataFrame, keep: str = "35 days", without=()) -> DataFrame:
    """T5: the first row of each game id among those that arrive within ``keep`` of it.

    State expires by the time of arrival, not by the games' own time: each micro-batch carries
    its start as event time, so no row is ever late, and a backfilled month comes through
    whole, while the state holds the ids of the last ``keep`` only.  A row that comes back
    later passes; the load (K3) finds its id stored and leaves it out.  Rows
    without an id are told apart by their content, also by the columns ``without``, which are not
    returned and so not shuffled."""
    key = F.coalesce("site", F.sha2(F.to_json(F.struct(*games.columns)), 256))
    arrived = games.withColumns({"_key": key, "_arrived": F.current_timestamp()}).drop(*without)
    return (arrived.withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(["_key"])
            .drop("_key", "_arrived"))


# --- T6 ---------------------------------------------------------------------
def start_upsert(spark: SparkSession, landing: str, root: str, checkpoint: str,
                 max_files: int = 1, available_now: bool = True):
    """Load every micro-batch of records with the batch ingest.

    One writer per table (ids continue from the stored maximum); a batch
    replayed after a failure re-derives the same ids and inserts nothing."""
    recs = record_stream(spark, landing, max_files)

    def sink(batch: DataFrame, epoch: int) -> None:
        ingest_tags(batch.sparkSession, parse_tags(with_position(batch)), root)

    w = recs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# --- T2 ---------------------------------------------------------------------
def replay_lines(spark: SparkSession, dump_paths, out: str) -> str:
    """The non-blank lines of dumps as messages (key = file name,
    offset = line order within the file), written as a message log.

    With a Kafka connector the same frame goes to
    ``write.format("kafka")`` with the key column as the message key."""
    text = spark.read.option("lineSep", RECORD_SEP).text(dump_paths)
    records = text.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("key"),
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")
    # Like a topic partition: one task writes all messages of a key, in offset order (a file
    # stream orders files by modification time only, so a key written by parallel tasks could
    # arrive out of order), ``SEGMENT_LINES`` to a file.  What the shuffle moves and sorts are
    # whole records; they become lines behind it.
    records = records.repartition("key").sortWithinPartitions("key", "file", "pos")
    first = F.row_number().over(Window.partitionBy("key", "file").orderBy("pos")) == 1
    whole = F.when(F.col("first"), F.col("value")).otherwise(F.concat(F.lit(RECORD_SEP[1:]), F.col("value")))
    # one character to split at, for which Java needs no pattern
    whole = F.when(whole.contains("\r"), F.regexp_replace(whole, "\r\n|\r", "\n")).otherwise(whole)
    lines = (records.withColumn("first", first).select("key", F.explode(F.split(whole, "\n")).alias("value"))
             .filter(F.trim("value") != ""))
    (lines.select("key", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), "value")
     .write.mode("append").option("maxRecordsPerFile", SEGMENT_LINES).parquet(out))
    return out


def topic_source(spark: SparkSession, servers: str, topic: str,
                 max_offsets: int | None = 100_000, options: dict | None = None) -> DataFrame:
    """The line topic as a stream (key, partition, offset, value), from the
    earliest offset; progress lives in the query checkpoint, not in consumer
    group offsets.  Needs the Kafka connector on the classpath (absent here)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load().select(F.col("key").cast("string").alias("key"), "partition", "offset",
                           F.col("value").cast("string").alias("value"))


def topic_sink(lines: DataFrame, servers: str, topic: str) -> None:
    """T2 with a broker: write (key, value) messages; key = source file, so
    each file's lines stay in one partition, in order."""
    (lines.select(F.col("key").cast("binary").alias("key"),
                  F.col("value").cast("binary").alias("value"))
     .write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def line_stream(spark: SparkSession, log_dir: str, max_files: int = 1) -> DataFrame:
    """T1 stand-in: the message log as a stream with the topic's columns."""
    return (spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(log_dir))


# --- T3 ---------------------------------------------------------------------
ASSEMBLED = T.StructType([T.StructField("key", T.StringType()),
                          T.StructField("offset", T.LongType()),
                          T.StructField("raw", T.StringType())])
PENDING = T.StructType([T.StructField("lines", T.StringType()),
                        T.StructField("first_offset", T.LongType())])
PACKED = T.StructType([T.StructField("key", T.StringType()),
                       T.StructField("first", T.LongType()),
                       T.StructField("last", T.LongType()),
                       T.StructField("lines", T.BinaryType())])
STEP_LINES = 1 << 17  # lines that are assembled at once, more where messages of several tasks interleave


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages -> a row for each key of a batch: its offsets and lines as one Arrow stream."""
    for batch in batches:
        keys = batch.column("key")
        different = keys.unique()
        for key in different:
            mine = batch.select(["offset", "value"])
            if len(different) > 1:
                mine = mine.filter(pc.equal(keys, key) if key.is_valid else pc.is_null(keys))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, mine.schema) as stream:
                stream.write_batch(mine)
            ends = pc.min_max(mine.column("offset"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key.as_py()], pa.string()), pa.array([ends["min"].as_py()], pa.int64()),
                 pa.array([ends["max"].as_py()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=PACKED.names)


def _steps(packed: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
    """(offset, value) of one key in offset order, some ``STEP_LINES`` at a time."""
    pieces = sorted((p for pdf in packed for p in zip(pdf["first"], pdf["last"], pdf["lines"])), key=lambda p: p[:2])
    step, lines, last = [], 0, None
    for k, (first, end, data) in enumerate(pieces):
        if lines >= STEP_LINES and first > last:
            yield pa.concat_tables(step).sort_by("offset")
            step, lines = [], 0
        step.append(pa.ipc.open_stream(data).read_all())
        pieces[k] = None
        lines, last = lines + len(step[-1]), end if last is None else max(last, end)
    if step:
        yield pa.concat_tables(step).sort_by("offset")


def _whole_records(offsets: np.ndarray, values: pa.Array):
    """Records in lines that are in order: (offsets of their first lines, texts, index of the
    ``[Event`` line that is still open or None, which lines are tags)."""
    starts = lambda x: pc.fill_null(pc.starts_with(values, x), False).to_numpy(zero_copy_only=False)
    event, closing, tag = np.flatnonzero(starts("[Event ")), np.flatnonzero(starts("1")), starts("[")
    if not len(event):
        return offsets[:0], values[:0], None, tag
    at = np.append(closing, len(values))[np.searchsorted(closing, event)]
    closed = at < np.append(event[1:], len(values))
    first, end = event[closed], at[closed]
    inside = np.zeros(len(values) + 1, np.int8)
    inside[first] += 1
    inside[end] -= 1
    keep = (np.cumsum(inside[:-1]) > 0) & tag
    keep[end] = True
    ends = np.zeros(len(values), bool)
    ends[end] = True
    # a blank line stands before the movetext
    lines = pc.replace_with_mask(values.filter(pa.array(keep)), pa.array(ends[keep]),
                                 pc.binary_join_element_wise("", values.take(pa.array(end)), "\n"))
    borders = np.append(0, np.flatnonzero(ends[keep]) + 1).astype(np.int32)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders), lines), "\n")
    return offsets[first], raw, None if closed[-1] else event[-1], tag


def _assemble_group(key, packed: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Lines of one key in offset order -> finished game records.

    A ``[Event`` line opens a record (dropping an unfinished one: no tag
    leaks); a movetext line starting with '1' closes it; notes and other
    lines between are passed over; state keeps the open record between
    micro-batches (at most one game's lines), which stands before the new lines.
    Memory per call is one key's packed lines of one micro-batch: ``maxOffsetsPerTrigger``
    bounds it for a topic, ``SEGMENT_LINES`` times the files of a trigger for the file log."""
    lines, first = [], None
    if state.exists:
        text, first = state.get
        lines = text.split("\n") if text else []
    for step in _steps(packed):
        values = pa.concat_arrays([pa.array(lines, step.schema.field("value").type), *step.column("value").chunks])
        offsets = np.append(np.full(len(lines), first if lines else 0, np.int64), step.column("offset").to_numpy())
        at, raw, still_open, tag = _whole_records(offsets, values)
        lines, first = [], None
        if still_open is not None:
            lines = values[still_open:].filter(pa.array(tag[still_open:])).to_pylist()
            first = int(offsets[still_open])
        if len(raw):
            yield pd.DataFrame({"key": key[0], "offset": at, "raw": raw.to_pandas()})
    if lines:
        state.update(("\n".join(lines), first))
    elif state.exists:
        state.remove()


def assemble(lines: DataFrame) -> DataFrame:
    """Keyed state per source file.  Keys are worked off side by side, as far as a micro-batch
    holds lines of several: let it take in a file of the log for each key (``max_files``).

    The lines of a batch are packed where they are read, so the shuffle and the sort by key
    move some rows of many lines each instead of every line."""
    packed = lines.select("key", "offset", "value").mapInArrow(_pack, PACKED)
    return packed.groupBy("key").applyInPandasWithState(
        _assemble_group, ASSEMBLED, PENDING, "append", "NoTimeout")


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drive a stream to completion (availableNow) into a Parquet folder."""
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
