"""Streams of events: rollouts with carried state, keyed de-duplication, and sinks that survive repeated batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import vocabulary as V
from ..functions import values as J
from ..plans import messages, rollouts
from ..session import ship
from ..sources import store

CARRIED = "path string, entry_index long, timestamp string, type string, kind string, payload string, call string, name string, arguments string, request_backfill boolean, response_backfill boolean"
STATE = "turn_id string, model string, thread_id string, made_name string, made_arguments string, generation long"
CURSOR = "turn string, model string, thread string, generation long, latest string, older boolean"
#: Keeps each value of a state by itself, as map states need; other stores keep a state as one row.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that files are dealt into by their names, as each group costs a batch some 40 ms of Python however little is in it.
#: A checkpoint is bound to their number.
GROUPS = 1024
#: The latest calls of a file, at most so many and of so many characters, stand with the file itself, as what a call says is
#: mostly asked for soon, and each access to a state costs some 0.3 ms.
LATEST, LATEST_CHARS = 32, 4096


class Cursor(StatefulProcessor):
    """Entries of a group of files, each in order, with what earlier ones of the file said: turn, model and thread, and by call its name and arguments.

    A batch reads and writes the state of the files that it names, with their latest calls, and of older calls that it names, however
    many there were before. A file whose first line comes again was truncated and written anew: it starts its next generation with no
    state, and a batch with such files looks once through the older calls of their group. With `ttl_ms` what a call said is
    forgotten when so much time has gone since; then no calls stand with the file.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms, self.room = ttl_ms, LATEST if ttl_ms is None else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursors = handle.getMapState("cursors", "path string", CURSOR)
        self.names = handle.getMapState("names", "path string, call string", "name string", self.ttl_ms)
        self.arguments = handle.getMapState("arguments", "path string, call string", "arguments string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["path", "entry_index"])
        told, stay, found = list(rows.astype(object).where(rows.notna(), None).itertuples(index=False)), [], []
        begun = self.begun(told)
        for path, lines in groupby(told, lambda row: row.path):
            turn, model, thread, generation, latest, older = begun.pop(path)
            calls = Calls(path, self.names, self.arguments, json.loads(latest), older)
            for row in lines:
                stay.append(row.payload is not None and row.payload.startswith("{"))
                if stay[-1]:
                    turn, thread, model = row.own_turn or turn, thread or row.own_thread, row.context_model or model or row.meta_model
                    # A call itself doesn't ask what it was; arguments are asked for by one kind.
                    name = calls.name(row.call) if row.learn_name is None else None
                    said = calls.said(row.call) if row.kind == "function_call_output" else None
                    found.append(("" if row.own_turn == "" else turn, model, thread, name, said, generation))
                    calls.learn(row.call, row.learn_name, row.learn_arguments)
            latest, older = calls.kept(self.room)
            self.cursors.updateValue((path,), (turn, model, thread, generation, latest, older))
        own = rows.loc[stay, [part.split()[0] for part in CARRIED.split(", ")]].reset_index(drop=True)
        yield pd.concat([own, pd.DataFrame(found, columns=[part.split()[0] for part in STATE.split(", ")])], axis=1)

    def begun(self, told: list) -> dict[str, tuple]:
        """Where each file stands before these entries. Those that start anew are forgotten."""
        first = {}
        for row in told:
            first.setdefault(row.path, row.entry_index)
        known = {path: tuple(self.cursors.getValue((path,))) for path in first if self.cursors.containsKey((path,))}
        anew = {path for path in known if first[path] == 0}
        there = {path for path in anew if known[path][-1]}
        for state in (self.names, self.arguments) if there else ():
            for call in [call for call in state.keys() if call[0] in there]:
                state.removeKey(call)
        return {path: known[path] if path in known and path not in anew else (None, None, None, known[path][3] + 1 if path in anew else 0, "{}", False) for path in first}


class Calls:
    """What the calls of a file said, as a batch sees it. `latest` has a name and maybe arguments of each, the earliest learnt first;
    `older` ones, if any, are in the map states, which are read once for each call that is asked for and not among the latest."""

    def __init__(self, path: str | None, names, arguments, latest: dict[str, list], older: bool):
        self.path, self.names, self.arguments, self.latest, self.older, self.read = path, names, arguments, latest, older, {}

    def _older(self, place: int, call: str | None) -> str | None:
        if not self.older or call is None:
            return None
        if (place, call) not in self.read:
            state, key = (self.names, self.arguments)[place], (self.path, call)
            self.read[place, call] = state.getValue(key)[0] if state.containsKey(key) else None
        return self.read[place, call]

    def name(self, call: str | None) -> str | None:
        return self.latest[call][0] if call in self.latest else self._older(0, call)

    def said(self, call: str | None) -> str | None:
        said = self.latest[call][1] if call in self.latest else None
        return self._older(1, call) if said is None else said

    def learn(self, call: str | None, name: str | None, arguments: str | None) -> None:
        """Arguments come with a name only; a name alone leaves the arguments that were learnt before."""
        if call is not None and name is not None:
            before = self.latest.pop(call, [None, None])
            self.latest[call] = [name, before[1] if arguments is None else arguments]

    def kept(self, room: int) -> tuple[str, bool]:
        """The latest calls that stay with the file, and whether it has others, which are written to the map states."""
        size = lambda call: len(call) + sum(len(said or "") for said in self.latest[call])
        chars = sum(map(size, self.latest))
        while self.latest and (len(self.latest) > room or chars > LATEST_CHARS):
            call = next(iter(self.latest))
            chars -= size(call)
            name, arguments = self.latest.pop(call)
            self.names.updateValue((self.path, call), (name,))
            if arguments is not None:
                self.arguments.updateValue((self.path, call), (arguments,))
            self.older = True
        return json.dumps(self.latest), self.older


def entries(lines: DataFrame) -> DataFrame:
    """Tailed lines (path, offset, line) as rollout entries; the offset is the order.

    The first line of a file stays whatever it holds, as its coming again tells that the file was truncated.
    """
    parsed = lines.select("path", F.col("offset").alias("entry_index"), F.try_parse_json("line").alias("value"))
    return parsed.where(F.coalesce(J.is_object(F.col("value")), F.lit(False)) | (F.col("entry_index") == 0))


def rollout_events(entries: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The events of a stream of rollout entries, as `rollouts.canonical` gives them for the whole files, with the
    generation of their file: how often it was truncated and written anew. The stream needs the store of `PROVIDER`, which is set."""
    ship(entries.sparkSession).conf.set(PROVIDER, ROCKS)
    rows = rollouts.fields(entries, F.col("entry_index") == 0)
    text = {name: F.to_json(name) for name in ("payload", "arguments", "learn_arguments")}
    flat = rows.withColumns(text | {"path": F.col("path").cast("string")}).withColumn("group", F.pmod(F.xxhash64("path"), F.lit(GROUPS)))
    known = flat.groupBy("group").transformWithStateInPandas(Cursor(ttl_ms), f"{CARRIED}, {STATE}", "Append", "None" if ttl_ms is None else "ProcessingTime")
    return rollouts.emit(known.withColumns({name: F.parse_json(name) for name in ("payload", "arguments", "made_arguments")}), "generation")


OPEN = "key string, index long, block long, model string, type string, id string, name string, text string"


def _assemble(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Pieces of one stream in order: blocks that are open wait in the state, their stop gives them out."""
    model, held = (state.get[0], json.loads(state.get[1])) if state.exists else (None, {})
    rows, found = pd.concat(list(parts)).sort_values("block"), []
    for row in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
        model, place = row.model or model, None if row.index is None else str(int(row.index))
        if row.begun:
            held[place] = [row.type, row.id, row.name, row.piece or ""]
        elif place in held:
            held[place][3] += row.piece or ""
            if row.stop:
                found.append((key[0], int(place), row.block, model, *held.pop(place)))
    state.update((model, json.dumps(held)))
    yield pd.DataFrame(found, columns=[part.split()[0] for part in OPEN.split(", ")])


def assembled(blocks: DataFrame) -> DataFrame:
    """The events of streams of blocks (key, block, event, data) as they arrive, as `messages.block_streams` gives them for
    whole streams: a block is given out at its stop. Only open blocks are kept."""
    pieces = messages.stream_pieces(blocks, carried=False)
    flat = pieces.select("key", "index", "block", "model", "begun", "stop", "head.type", F.to_json("head.id").alias("id"), "head.name", "piece")
    whole = flat.groupBy("key").applyInPandasWithState(_assemble, OPEN, "model string, held string", "append", "NoTimeout")
    head = F.struct("type", F.try_parse_json("id").alias("id"), "name")
    return messages.finished_blocks(whole.select("key", "index", "block", "model", head.alias("head"), "text"))


def once(events: DataFrame) -> DataFrame:
    """A stream of events (event_type, content as JSON text, path, entry_index, emit) with one event of each session,
    call, type and delivery state.

    The session is session_id where events have it, else thread_id, else their file and its generation. Rows without a
    call and of other types all stay: their key is their own place in a generation. The set of keys is kept for ever.
    """
    call = F.nullif(F.get_json_object("content", "$.tool_call_id"), F.lit(""))
    keyed = call.isNotNull() & F.col("event_type").isin(V.KEYED_TYPES)
    state = F.when(F.col("event_type") == "subagent_message", F.coalesce(F.get_json_object("content", "$.delivery_state"), F.lit(""))).otherwise("")
    file = F.concat_ws("\0", *[name for name in ("path", "generation") if name in events.columns])
    named = [F.when(F.col(name) != "", F.concat_ws("\0", F.lit(name), name)) for name in ("session_id", "thread_id") if name in events.columns]
    session = F.coalesce(*named, F.concat_ws("\0", F.lit("file"), file))
    key = F.when(keyed, F.concat_ws("\0", F.lit("call"), session, "event_type", call, state)).otherwise(F.concat_ws("\0", F.lit("row"), file, "entry_index", "emit"))
    return events.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def append(events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, refresh=None, counters: dict[str, Column] | None = None):
    """Write a stream to `folder`, one subfolder for each batch, which a repeated batch replaces. After a batch with actions
    `refresh(spark, folder)` is called, to rebuild what is derived from it; `finish` calls it once more when a stream has ended.

    `counters` are aggregates (sums of whole numbers) that are observed while a batch is written, without a pass of their
    own; their running totals are kept by the checkpoint, where `totals` finds them while the stream runs and after it."""

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation() if counters else None
        watched = batch.observe(seen, *[value.alias(name) for name, value in counters.items()]) if counters else batch
        watched.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if counters:
            _count(checkpoint, number, seen.get)
        if refresh and not batch.sparkSession.read.parquet(f"{folder}/batch={number}").where(F.col("event_type").isin(V.ACTION_TYPES)).isEmpty():
            refresh(batch.sparkSession, folder)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def _counted(checkpoint: str) -> dict[int, dict[str, int]]:
    """The totals after each of the last batches."""
    files, base = store.opened(checkpoint)
    there = files.get_file_info(store.pafs.FileSelector(f"{base}/counters", allow_not_found=True))
    return {int(f.base_name.partition(".")[0]): json.loads(files.open_input_stream(f.path).read()) for f in there if f.base_name.endswith(".json") and not f.base_name.startswith(".")}


def _count(checkpoint: str, number: int, seen: dict[str, int]) -> None:
    """Keep the totals after a batch: those after the one before and what was seen in it. A batch that is repeated counts once."""
    known = _counted(checkpoint)
    before = known[max(k for k in known if k < number)] if any(k < number for k in known) else {}
    store.put(checkpoint, f"counters/{number:012d}.json", json.dumps({name: before.get(name, 0) + (n or 0) for name, n in seen.items()}).encode())
    files, base = store.opened(checkpoint)
    for old in sorted(k for k in known if k < number)[:-1]:
        files.delete_file(f"{base}/counters/{old:012d}.json")


def totals(checkpoint: str) -> dict[str, int]:
    """The totals of a stream's counters after its last batch."""
    known = _counted(checkpoint)
    return known[max(known)] if known else {}


def finish(query, spark, folder: str, refresh, seconds: float | None = None) -> None:
    """Wait for the end of a stream of `append` and rebuild what is derived from all that it wrote, whether it had actions or not."""
    query.awaitTermination(seconds)
    refresh(spark, folder)
