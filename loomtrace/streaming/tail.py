"""A streaming source that follows growing files by byte offset.

Spark's own file source reads a file once; this one reads what is appended. An offset is a place in each file. A line
comes with the batch that its end falls into, so a half-written line waits for its rest and no character is split. A file
that has become shorter is read from its start again. The driver asks for sizes only; files are read by tasks, in ranges of `RANGE` bytes.

Register it with `register(spark)`; then
`spark.readStream.format("loomtrace_tail").option("path", "/logs/*.jsonl").load()` gives path, offset and line.
With `startAtEnd` the stream begins at what is there. With `maxBytesPerBatch` what comes is taken in batches of about so many
bytes, file after file; without it, and in the first batch of a run (as Spark doesn't tell a source of Python before it
where the stream stands), all that is there is one batch, which `availableNow` needs. With `maxBatchesBehind` too, that bound
gives way where more has come than so many batches hold: a batch is then its share of what has come, until the stream has
caught up, as a batch has a price of its own and a backlog in batches of one size would take as many as it is long. The path,
local or a URI, is one that driver and executors can open with pyarrow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship
from ..sources import growing
from ..sources.store import opened

RANGE = 32 << 20


@dataclass
class Piece(InputPartition):
    path: str
    low: int
    high: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern, self.at_end = options["path"], str(options.get("startAtEnd", "false")).lower() == "true"
        self.most, self.at = int(options.get("maxBytesPerBatch", 0)), None
        self.batches, self.step = int(options.get("maxBatchesBehind", 0)), 0

    def initialOffset(self) -> dict:
        self.at = growing.sizes(self.pattern) if self.at_end else {}
        return self.at

    def latestOffset(self) -> dict:
        there = growing.sizes(self.pattern)
        if not self.most or self.at is None:
            return there
        begins = {path: 0 if size < self.at.get(path, 0) else self.at.get(path, 0) for path, size in there.items()}
        behind = sum(there.values()) - sum(begins.values())
        # The share of the longest that the stream has been behind since it last had caught up.
        self.step = max(self.step, -(-behind // self.batches)) if behind and self.batches else 0
        ends, left = {}, max(self.most, self.step)
        for path, size in there.items():
            ends[path] = begins[path] + min(size - begins[path], left)
            left -= ends[path] - begins[path]
        return ends

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at, pieces = end, []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = 0 if stop < begin else begin
            pieces += [Piece(path, low, min(low + RANGE, stop)) for low in range(begin, stop, RANGE)]
        return pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece):
        """The lines whose ends lie in [low, high)."""
        if not piece.path:
            return
        with opened(self.pattern)[0].open_input_file(piece.path) as source:
            for place, lines in growing.lines_in(source, piece.low, piece.high):
                for line in lines:
                    yield piece.path, place, line.rstrip(b"\r").decode("utf-8", "replace")
                    place += len(line) + 1


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomtrace_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known, and this package to the workers that read."""
    ship(spark).dataSource.register(TailSource)
