"""The log in its binary form: codec, columns, and a data source for logs.

A log is a folder of segments, each of one core's records in the order of their
LSNs, and a manifest that names them.  An append adds segments and then puts a
new manifest in the old one's place, so readers see all of it or nothing.  A
folder without a manifest holds one file ``core_<i>.wal`` for each core.
Folders are reached through Arrow's file systems (local, HDFS, S3, GCS).

A record is a 32-byte little-endian header (magic, size, LSN, type, 3 bytes of
padding, transaction id, masked CRC-32C of the whole record with this field
zero) and a payload by type.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.functions.checksum import crc32c, mask
from tidemark.schema import WAL, WAL_TYPES

#: Magic number and header of a record (fixed values).
MAGIC, HEADER = 0xDB4C4F47, struct.Struct("<IIQB3xQI")
_CODES = {name: i + 1 for i, name in enumerate(WAL_TYPES)}
#: Types whose payload is one number, and the column that it is in.
_NUMBERS = {"TX_BEGIN": "snapshot_ts", "COMMIT_DECISION": "commit_ts", "COMMIT_FINALIZE": "commit_ts", "CHECKPOINT": "snapshot_lsn"}
RECORD_SCHEMA = WAL
_DECODED = "core_id int, lsn bigint, type string, tx_id bigint, snapshot_ts bigint, commit_ts bigint, key string, value binary, is_deleted boolean, vote_yes boolean, snapshot_lsn bigint"
_TYPES = [("core_id", pa.int32()), ("lsn", pa.int64()), ("type", pa.string()), ("tx_id", pa.int64()), ("snapshot_ts", pa.int64()), ("commit_ts", pa.int64()), ("key", pa.string()), ("value", pa.binary()), ("is_deleted", pa.bool_()), ("vote_yes", pa.bool_()), ("snapshot_lsn", pa.int64())]


def encode(record: dict) -> bytes:
    """The bytes of a record; columns that its type doesn't have are ignored."""
    kind = record["type"]
    if kind in _NUMBERS:
        payload = struct.pack("<Q", record.get(_NUMBERS[kind]) or 0)
    elif kind == "INTENT":
        key, value = (record.get("key") or "").encode(), bytes(record.get("value") or b"")
        payload = struct.pack("<I", len(key)) + key + struct.pack("<I", len(value)) + value + bytes([bool(record.get("is_deleted"))])
    elif kind == "PREPARE":
        payload = bytes([bool(record.get("vote_yes"))])
    else:
        payload = b""
    parts = (MAGIC, HEADER.size + len(payload), record["lsn"], _CODES[kind], record["tx_id"])
    return HEADER.pack(*parts, mask(crc32c(HEADER.pack(*parts, 0) + payload))) + payload


def decode(raw: bytes) -> dict | None:
    """The record that ``raw`` starts with, or None if it is short, damaged or of no known type."""
    if len(raw) < HEADER.size:
        return None
    magic, size, lsn, code, tx_id, crc = HEADER.unpack_from(raw)
    if magic != MAGIC or size < HEADER.size or size > len(raw) or not 1 <= code <= len(WAL_TYPES):
        return None
    raw = raw[:size]
    if mask(crc32c(raw[:28] + b"\0\0\0\0" + raw[32:])) != crc:
        return None
    kind, payload = WAL_TYPES[code - 1], raw[HEADER.size :]
    out: dict = {"type": kind, "lsn": lsn, "tx_id": tx_id}
    try:
        if kind in _NUMBERS:
            (out[_NUMBERS[kind]],) = struct.unpack_from("<Q", payload)
        elif kind == "INTENT":
            (n,) = struct.unpack_from("<I", payload)
            (m,) = struct.unpack_from("<I", payload, 4 + n)
            if len(payload) < 9 + n + m:
                return None
            out |= {"key": payload[4 : 4 + n].decode(), "value": payload[8 + n : 8 + n + m], "is_deleted": payload[8 + n + m] != 0}
        elif kind == "PREPARE":
            out["vote_yes"] = payload[0] != 0
    except (struct.error, IndexError, UnicodeDecodeError):
        return None
    return out


def read_all(data: bytes, after_lsn: int = 0) -> tuple[list[dict], int, bool]:
    """Records up to the first bad one with larger LSNs than ``after_lsn``, where the good part ends, and whether something bad follows it.

    Any bytes that are left count as bad, also fewer than a header: a writer
    that kept them would hide what it appends.
    """
    out, at = [], 0
    while at < len(data):
        record = decode(data[at:] if len(data) - at < 1 << 16 else data[at : at + max(HEADER.size, int.from_bytes(data[at + 4 : at + 8], "little"))])
        if record is None:
            return out, at, True
        at += int.from_bytes(data[at + 4 : at + 8], "little")
        if record["lsn"] > after_lsn:
            out.append(record)
    return out, at, False


class WalFile:
    """One core's log file: drops a damaged tail when opened and appends with the next LSN."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path, "rb") as f:
                data = f.read()
        except FileNotFoundError:
            data = b""
        records, good, bad = read_all(data)
        if bad:
            with open(path, "r+b") as f:
                f.truncate(good)
        self.dropped_tail, self.next_lsn = bad, max((r["lsn"] for r in records), default=0) + 1

    def append(self, record: dict) -> int:
        lsn, self.next_lsn = self.next_lsn, self.next_lsn + 1
        with open(self.path, "ab") as f:
            f.write(encode(record | {"lsn": lsn}))
        return lsn


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [encode(r) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("core_id"), batch.column("lsn"), pa.array(raws, pa.binary())], names=["core_id", "lsn", "record"])


def encode_records(log: DataFrame) -> DataFrame:
    """``core_id``, ``lsn``, ``record`` (binary) of a log table."""
    rows = log.select(*(F.col(n) if n in log.columns else F.lit(None).cast("bigint").alias(n) for n, _ in _TYPES))
    return rows.mapInArrow(_encode_rows, "core_id int, lsn bigint, record binary")


def _decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(decode(raw) or {"lsn": lsn}) | {"core_id": core} for core, lsn, raw in zip(batch.column("core_id").to_pylist(), batch.column("lsn").to_pylist(), batch.column("record").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _TYPES], names=[n for n, _ in _TYPES])


def decode_records(raw: DataFrame) -> DataFrame:
    """A log table of binary records (core_id, lsn, record); a damaged one has no type."""
    return raw.mapInArrow(_decode_rows, _DECODED)


MANIFEST = "log.json"
_STATE = "core_id int, segment string, records bigint, good_bytes bigint, last_lsn bigint, damaged boolean"


def _file_system(folder: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder.removeprefix("file:")))


def stream_records(source, tell: dict | None = None) -> Iterator[dict]:
    """Records up to the first bad one of an open file, one in memory at a time; ``tell`` learns how many, how many bytes they have and whether something bad follows."""
    tell = {} if tell is None else tell
    tell |= {"records": 0, "good_bytes": 0, "last_lsn": 0, "damaged": False}
    while head := source.read(HEADER.size):
        size = int.from_bytes(head[4:8], "little")
        plausible = len(head) == HEADER.size and int.from_bytes(head[:4], "little") == MAGIC and size >= HEADER.size
        record = decode(head + source.read(size - HEADER.size)) if plausible else None
        if record is None:
            tell["damaged"] = True
            return
        tell["records"] += 1
        tell["good_bytes"] += size
        tell["last_lsn"] = max(tell["last_lsn"], record["lsn"])
        yield record


def _segments(folder: str) -> list[dict]:
    """core, name, good bytes (none: to the end) and last LSN (none: unknown) of each segment, in the order in which they were added."""
    import json

    from pyarrow import fs

    system, root = _file_system(folder)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())["segments"]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.startswith("core_") and f.base_name.endswith(".wal"))
    return [{"core": int(n[5:-4]), "name": n, "bytes": None, "last": None} for n in names]


class _Partition(InputPartition):
    def __init__(self, segment: dict):
        super().__init__(segment["name"])
        self.segment = segment


class WalSource(DataSource):
    """``format("tidemark_wal")``: the records of a folder, a segment to a partition.

    Options: ``min_lsn`` (records with larger LSNs only), ``state`` (``true``:
    a row for each segment with its good records and bytes and whether its tail
    is damaged).  Filters on ``lsn`` and ``core_id`` reach the reader.  Written
    rows follow what the log holds: they are numbered on from each core's last
    LSN; mode ``overwrite`` starts a new log.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_wal"

    def schema(self) -> str:
        return _STATE if self.options.get("state", "").lower() == "true" else _DECODED

    def reader(self, schema) -> DataSourceReader:
        return _WalReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _WalWriter(self.options, overwrite)


class _WalReader(DataSourceReader):
    def __init__(self, options):
        self._folder, self._after = options["path"], int(options.get("min_lsn", 0))
        self._state, self._core = options.get("state", "").lower() == "true", None

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", None)
            if not self._state and name == ("lsn",) and type(f).__name__ in ("GreaterThan", "GreaterThanOrEqual"):
                self._after = max(self._after, f.value - (type(f).__name__ == "GreaterThanOrEqual"))
            elif name == ("core_id",) and type(f).__name__ == "EqualTo":
                self._core = f.value
            else:
                yield f

    def partitions(self):
        wanted = [x for x in _segments(self._folder) if self._core in (None, x["core"]) and (x["last"] is None or x["last"] > self._after)]
        return [_Partition(x) for x in wanted] or [_Partition({"core": -1, "name": "", "bytes": 0, "last": 0})]

    def read(self, partition: _Partition):
        segment, tell = partition.segment, {}
        if not segment["name"]:
            return
        system, root = _file_system(self._folder)
        with system.open_input_stream(f"{root}/{segment['name']}", buffer_size=1 << 20) as f:
            for r in stream_records(f, tell):
                if not self._state and r["lsn"] > self._after:
                    yield tuple((r | {"core_id": segment["core"]}).get(n) for n, _ in _TYPES)
        if self._state:
            yield segment["core"], segment["name"], tell["records"], tell["good_bytes"], tell["last_lsn"], tell["damaged"]


class _Written(WriterCommitMessage):
    def __init__(self, segments: list[dict]):
        self.segments = segments


class _WalWriter(DataSourceWriter):
    """A segment for each core of a task; a core's rows must be in one partition, in their order."""

    def __init__(self, options, overwrite: bool):
        self._folder, self._overwrite = options["path"], overwrite
        self._old = [] if overwrite else _segments(self._folder)
        system, root = _file_system(self._folder)
        for x in self._old:
            if x["last"] is None:  # a file from elsewhere is read once for its last LSN
                tell: dict = {}
                with system.open_input_stream(f"{root}/{x['name']}", buffer_size=1 << 20) as f:
                    for _ in stream_records(f, tell):
                        pass
                x |= {"bytes": tell["good_bytes"], "last": tell["last_lsn"]}
        self._last: dict[int, int] = {}
        for x in self._old:
            self._last[x["core"]] = max(self._last.get(x["core"], 0), x["last"])

    def write(self, rows) -> _Written:
        import uuid

        system, root = _file_system(self._folder)
        system.create_dir(root, recursive=True)
        done, out, core = [], None, None
        for row in rows:
            r = row.asDict()
            if r["core_id"] != core:
                if out:
                    out.close()
                core = r["core_id"]
                done.append({"core": core, "name": f"core_{core}-{uuid.uuid4().hex}.seg", "bytes": 0, "last": self._last.get(core, 0)})
                out = system.open_output_stream(f"{root}/{done[-1]['name']}")
            done[-1]["last"] += 1
            done[-1]["bytes"] += out.write(raw := encode(r | {"lsn": done[-1]["last"]})) or len(raw)
        if out:
            out.close()
        return _Written(done)

    def commit(self, messages) -> None:
        import json
        import uuid

        new = [x for m in messages if m for x in m.segments]
        cores = [x["core"] for x in new]
        if len(cores) != len(set(cores)):
            self.abort(messages)
            raise ValueError("a core's records came from several partitions")
        system, root = _file_system(self._folder)
        system.create_dir(root, recursive=True)
        before = _segments(self._folder) if self._overwrite else []
        made = f"{root}/{uuid.uuid4().hex}.manifest"
        with system.open_output_stream(made) as f:
            f.write(json.dumps({"segments": [*self._old, *sorted(new, key=lambda x: x["core"])]}).encode())
        system.move(made, f"{root}/{MANIFEST}")
        for x in before:  # nothing names them any more
            system.delete_file(f"{root}/{x['name']}")

    def abort(self, messages) -> None:
        system, root = _file_system(self._folder)
        for m in messages:
            for x in m.segments if m else ():
                system.delete_file(f"{root}/{x['name']}")


def register(spark: SparkSession) -> None:
    """Make the source known to the session, which must let filters reach readers in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalSource)


def write_log(log: DataFrame, folder: str, mode: str = "append") -> None:
    """Append a log table to a folder, or start it anew (``overwrite``)."""
    rows = log.select(*(F.col(n) if n in log.columns else F.lit(None).cast("bigint").alias(n) for n, _ in _TYPES))
    rows.repartition("core_id").sortWithinPartitions("core_id", "lsn").write.format("tidemark_wal").mode(mode).save(folder)


def log_state(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each segment: core_id, segment, records, good_bytes, last_lsn, damaged (whether something bad follows the good part)."""
    return spark.read.format("tidemark_wal").option("state", "true").load(folder)
