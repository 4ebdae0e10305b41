"""Block files as a source that reads only the blocks that are asked for.

The plan of a scan is the list of byte ranges, made from the files' sizes; a partition is some ranges of one file, or of several small ones, and
seeks to each. A file may have any size, as only its sampled blocks, or the windows around its known ones, are ever read. Files are reached by Arrow's file
systems (local paths, file:, hdfs:, s3:, gs:), so the machines that run tasks must see them under the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "block_ranges"
SCHEMA = "source_id string, source string, block_size int, block bigint, first bigint, stop bigint, chunk binary"
_ARROW = pa.schema([("source_id", pa.string()), ("source", pa.string()), ("block_size", pa.int32()), *[(c, pa.int64()) for c in ("block", "first", "stop")], ("chunk", pa.binary())])
#: Bytes that one partition reads of a file, and of one batch that it gives.
PARTITION_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: Bytes up to which small files share a partition, and what opening one counts as: a task takes longer to start than to read some hundred KB.
SHARED_BYTES, OPEN_BYTES = 4 << 20, 64 << 10


def sampled(n_blocks: int, samples: int, known: list[int]) -> list[tuple[int, int, int]]:
    """(block, first, stop) of each block in steps of max(1, n // samples), and of the known ones, ascending."""
    chosen = set(range(0, n_blocks, max(1, n_blocks // samples))) | {k for k in known if k < n_blocks}
    return [(b, b, b + 1) for b in sorted(chosen)]


def around(n_blocks: int, known: list[int], before: int, after: int) -> list[tuple[int, int, int]]:
    """(block, first, stop) of the window around each known block that the file has."""
    return [(k, max(0, k - before), min(n_blocks, k + after + 1)) for k in known if k < n_blocks]


#: (source_id, path, block_size, ranges)
Part = tuple[str, str, int, list[tuple[int, int, int]]]


class Ranges(InputPartition):
    def __init__(self, parts: list[Part]) -> None:
        super().__init__(parts)


def packed(parts: list[Part]) -> list[list[Part]]:
    """Parts in their order, several in one list up to SHARED_BYTES."""
    out: list[list[Part]] = []
    held = 0
    for part in parts:
        size = OPEN_BYTES + sum(stop - first for _, first, stop in part[3]) * part[2]
        if not out or held + size > SHARED_BYTES:
            out.append([])
            held = 0
        out[-1].append(part)
        held += size
    return out


def _opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files: list[tuple[str, str]] = [tuple(x) for x in json.loads(options["files"])]
        self.sizes, self.known = json.loads(options["sizes"]), json.loads(options["known"])
        self.samples, self.window = json.loads(options.get("samples", "null")), json.loads(options.get("window", "null"))

    def partitions(self) -> list[Ranges]:
        out: list[Part] = []
        for source_id, path in self.files:
            fs, at = _opened(path)
            info = fs.get_file_info(at)
            if not info.is_file:
                raise FileNotFoundError(path)
            for size in self.sizes:
                n = info.size // size
                ranges = sampled(n, self.samples, self.known) if self.window is None else around(n, self.known, *self.window)
                most = max(1, PARTITION_BYTES // max((stop - first) * size for _, first, stop in ranges)) if ranges else 1
                out += [(source_id, path, size, ranges[i : i + most]) for i in range(0, len(ranges), most)]
        return [Ranges(parts) for parts in packed(out)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for source_id, path, size, ranges in partition.value:
            fs, at = _opened(path)
            with fs.open_input_file(at) as file:
                for block, first, stop in ranges:
                    chunk = file.read_at((stop - first) * size, first * size)
                    rows.append({"source_id": source_id, "source": path, "block_size": size, "block": block, "first": first, "stop": stop, "chunk": chunk})
                    held += len(chunk)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class BlockRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def read_ranges(
    spark: SparkSession, files: list[tuple[str, str]], sizes: list[int], known: list[int], samples: int | None = None, window: tuple[int, int] | None = None
) -> DataFrame:
    """The sampled blocks (samples) of (source_id, path) files, or the windows (window: blocks before and after) around the known ones.

    Columns as in SCHEMA: first and stop are the blocks that the chunk holds. Partial blocks at a file's end are none; a missing file is an error.
    """
    if (samples is None) == (window is None):
        raise ValueError("give either samples or window")
    spark.dataSource.register(BlockRanges)
    options = {"files": files, "sizes": sizes, "known": known, "samples": samples, "window": window}
    return spark.read.format(NAME).options(**{k: json.dumps(v) for k, v in options.items()}).load()
