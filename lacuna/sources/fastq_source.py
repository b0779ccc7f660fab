"""FASTQ read in pairs as a Spark data source, in batch and as a stream.

``register(spark)``, then ``spark.read.format("fastq_pairs").option("r1", folder)
.option("r2", folder).load()``.  A pair of files is a partition, its mates read in lockstep
a few records at a time; a plain file without mates is cut at byte offsets, each cut moved
to the next record.  Gzip files may have several members.  As a stream every complete pair
of files that has arrived since the last batch is read once.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a plain file without mates that one partition reads.
SPLIT_BYTES = 64 << 20
BATCH_RECORDS = 4096
SCHEMA = "pair string, start long, record_no long, name string, seq_r1 string, qual_r1 string, seq_r2 string, qual_r2 string"
_MATE = re.compile(r"([._])R?[12](?=[._][^/]*$)")


class BrokenPair(ValueError):
    """Mates that do not go together."""


@dataclass
class Piece(InputPartition):
    pair: str
    r1: str
    r2: str | None
    start: int
    end: int | None


def _found(uri: str) -> list[fs.FileInfo]:
    system, path = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f for f in every if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


def _named(files: list[fs.FileInfo]) -> dict[str, fs.FileInfo]:
    return {_MATE.sub(r"\1", f.base_name): f for f in files}


def _open(uri: str, path: str, start: int = 0) -> io.BufferedReader:
    system, _ = fs.FileSystem.from_uri(uri)
    if path.endswith(".gz"):
        return io.BufferedReader(gzip.GzipFile(fileobj=system.open_input_stream(path, compression=None)))
    file = system.open_input_file(path)
    file.seek(start)
    return io.BufferedReader(file)


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str]]:
    """``name, seq, qual`` of whole four-line records; an unfinished last one is left out."""
    while len(four := list(islice(lines, 4))) == 4:
        head, seq, plus, qual = (x.rstrip(b"\r\n").decode() for x in four)
        if not head.startswith("@") or not plus.startswith("+") or len(seq) != len(qual):
            raise ValueError(f"not a FASTQ record: {head[:80]!r}")
        yield head[1:], seq, qual


def _from(file: io.BufferedReader, at: int, end: int | None, cut: bool) -> Iterator[bytes]:
    """Lines of the records that begin before ``end``, from the byte ``at``; with ``cut``
    the line there is left to the piece before."""
    ahead = []
    if cut:
        at += len(file.readline())  # the line that the cut is in, or ends before
        while True:
            while len(ahead) < 3 and (line := file.readline()):
                ahead.append(line)
            if len(ahead) < 3 or (ahead[0].startswith(b"@") and ahead[2].startswith(b"+")):
                break
            at += len(ahead.pop(0))
    while end is None or at < end:
        four = [ahead.pop(0) if ahead else file.readline() for _ in range(4)]
        if not four[0]:
            return
        at += sum(map(len, four))
        yield from (x for x in four if x)


def short_name(name: str) -> str:
    """What the names of two mates have in common."""
    return re.sub(r"/[12]$", "", name.split(" ")[0])


def _both(piece: Piece, options: dict[str, str]) -> Iterator[tuple]:
    with _open(options["r1"], piece.r1, max(piece.start - 1, 0)) as one:
        if piece.r2 is None:
            lines = _from(one, max(piece.start - 1, 0), piece.end, piece.start > 0) if not piece.r1.endswith(".gz") else iter(one.readline, b"")
            for name, seq, qual in records(lines):
                yield name, seq, qual, None, None
            return
        with _open(options["r2"], piece.r2) as two:
            mates = records(iter(two.readline, b""))
            for name, seq, qual in records(iter(one.readline, b"")):
                mate = next(mates, None)
                if mate is None or short_name(mate[0]) != short_name(name):
                    raise BrokenPair(f"{piece.pair}: {name!r} has no mate" if mate is None else f"{piece.pair}: {name!r} beside {mate[0]!r}")
                yield name, seq, qual, mate[1], mate[2]
            if "maxrecords" not in options and next(mates, None) is not None:
                raise BrokenPair(f"{piece.pair}: more second mates than first")


def _read(piece: Piece, options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    rows = _both(piece, options)
    if "maxrecords" in options:
        rows = islice(rows, int(options["maxrecords"]))
    kinds = pa.schema([("pair", pa.string()), ("start", pa.int64()), ("record_no", pa.int64()), *((c, pa.string()) for c in ("name", "seq_r1", "qual_r1", "seq_r2", "qual_r2"))])
    done = 0
    while held := list(islice(rows, BATCH_RECORDS)):
        n = len(held)
        columns = [[piece.pair] * n, [piece.start] * n, range(done, done + n), *zip(*held, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        done += n


def _pieces(options: dict[str, str], complete: bool) -> list[tuple[tuple[int, str], Piece]]:
    """Pieces with the time and name of the later of their files."""
    ones = _named(_found(options["r1"]))
    twos = _named(_found(options["r2"])) if "r2" in options else {}
    if complete and "r2" in options and ones.keys() != twos.keys():
        raise BrokenPair(f"files without mates: {sorted(ones.keys() ^ twos.keys())[:5]}")
    step, out = int(options.get("splitbytes", SPLIT_BYTES)), []
    for name, file in ones.items():
        mate = twos.get(name)
        if "r2" in options and mate is None:
            continue
        when = (max(f.mtime_ns or 0 for f in (file, mate) if f is not None), name)
        if mate is not None or file.path.endswith(".gz") or "maxrecords" in options:
            out.append((when, Piece(name, file.path, mate and mate.path, 0, None)))
        else:
            # A cut is one byte early: a record that begins at the cut is then the next line.
            out += [(when, Piece(name, file.path, None, at, min(at + step, file.size))) for at in range(0, file.size, step)]
    return sorted(out, key=lambda p: (p[0], p[1].start))


class PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        return [p for _, p in _pieces(self.options, complete=True)]

    def read(self, partition):
        return _read(partition, self.options)


class PairStream(DataSourceStreamReader):
    """Offsets are the time and name of the last file read."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self):
        return {"time": -1, "name": ""}

    def latestOffset(self):
        found = _pieces(self.options, complete=False)
        return {"time": found[-1][0][0], "name": found[-1][0][1]} if found else self.initialOffset()

    def partitions(self, start, end):
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return [p for when, p in _pieces(self.options, complete=False) if low < when <= high]

    def read(self, partition):
        return _read(partition, self.options)


class FastqPairs(DataSource):
    """Options: ``r1``, ``r2`` (files or folders; without ``r2`` reads have no mates),
    ``maxRecords`` for each pair, ``splitBytes``."""

    @classmethod
    def name(cls):
        return "fastq_pairs"

    def schema(self):
        return SCHEMA

    def _plain(self) -> dict[str, str]:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        if "r1" not in options:
            raise ValueError("fastq_pairs needs the option r1")
        return options

    def reader(self, schema):
        return PairReader(self._plain())

    def streamReader(self, schema):
        return PairStream(self._plain())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqPairs)


def write_pairs(reads: DataFrame, path: str, order: list[str]) -> tuple[str, str]:
    """Gzip FASTQ folders of the two mates of ``name, seq_r1, qual_r1, seq_r2, qual_r2``,
    a file of each for every task, in the ``order`` within it; their paths."""
    def record(k: int):
        return F.struct(F.lit(f"R{k}").alias("mate"), F.concat(F.lit("@"), "name", F.lit(f"/{k}\n"), f"seq_r{k}", F.lit("\n+\n"), f"qual_r{k}").alias("value"))

    rows = reads.select(*order, F.inline(F.array(record(1), record(2)))).sortWithinPartitions("mate", *order)
    rows.select("mate", "value").write.partitionBy("mate").option("compression", "gzip").text(path)
    return f"{path}/mate=R1", f"{path}/mate=R2"
