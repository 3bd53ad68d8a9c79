"""Operator 8, token ids as length-delimited binary records with an offset index.

Each document becomes one record of a ``.rec`` file:

    uint64  length of the payload, little-endian
    uint32  masked CRC-32 of those eight bytes
    payload: int64 document id, uint8 flags (bit 0: the id is null,
             bit 1: ids are 32-bit), then the token ids, uint16 or uint32
    uint32  masked CRC-32 of the payload

and beside each file lies a ``.idx`` file: for every record, in order, uint64
offset and uint64 length of the whole frame, so that a reader can visit records in
any (shuffled) order without scanning.  Masking is the usual rotation by 15
bits plus a constant, so that a checksum of data that holds checksums stays sound.

Documents are dealt into files by ranges of (id, text), so that files in order
of their names hold ascending ids, whatever the skew of any other column.  Files are
written by the tasks through pyarrow's file systems into the shared folder, each
attempt under a name of its own; the manifest, a Parquet table written
from the tasks' own reports, names the files that count.  A lost executor only means another attempt.

Encoding is exact but saves work: the pre-tokenizer never joins a
non-space with a following space or line feed, so a text is cut there and every
distinct piece is encoded once for each worker's cache.  Cut pieces are found and compared
by 64-bit hashes in numpy.  Control tokens in a text (``<|endoftext|>``) are encoded as the tokenizer's file says, to their
own id, unless ``plain_specials`` asks for them to be read as ordinary text; a vocabulary
whose control tokens hold or take in white space is never cut.

Defined results: a null or empty text is a record of the end id alone; repeated
ids each keep their record, in order of a hash of their texts; null ids come first, as Spark sorts them; an empty table
makes no files and no rows.  Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import zlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, new_path
from .words import mix64, powers, slices, text_bytes

# The mask of the record checksum.
_MASK_ROTATE, _MASK_ADD = 15, 0xA282EAD8
_WIDE, _NULL_ID = 2, 1
_U = np.uint64
_CHUNK = 1 << 18
_CACHE_IDS = 6_000_000
_READ_BYTES = 8 << 20

_rng = np.random.default_rng(81)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_TWO_BYTE = np.zeros(256, bool)
_TWO_BYTE[0xC3:0xE0] = True

MANIFEST_SCHEMA = "part int, path string, records long, tokens long"


def masked_crc(data) -> int:
    c = zlib.crc32(data)
    return (((c >> _MASK_ROTATE) | (c << (32 - _MASK_ROTATE))) + _MASK_ADD) & 0xFFFFFFFF


def solid_ends(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character which is surely no white space: printable ASCII, and two-byte characters from U+00C0."""
    out = _SOLID[data]
    out[1:] |= (data[1:] >= 128) & _TWO_BYTE[data[:-1]]
    return out


@lru_cache(2)
def _tables(n: int):
    return powers(_BASE, n + 1), powers(pow(_BASE, -1, 1 << 64), n + 1)


class Encoder:
    """Token ids of texts, by way of a cache of pieces."""

    def __init__(self, path: str, cache_ids: int = _CACHE_IDS, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        self.cache_ids = cache_ids
        added = self.tokenizer.get_added_tokens_decoder()
        self.cuts = not any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added.values())
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        # bytes of each token: in a byte-level vocabulary every character stands for one byte
        self.width = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token.encode()) if i in added else len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def _encode_pieces(self, data: np.ndarray, ends_solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and each piece's number of ids."""
        ids, counts = [], []
        for s in range(0, len(starts), 4096):
            b, e = starts[s : s + 4096], ends[s : s + 4096]
            # pieces that begin with a space or line feed after a solid end may follow one another in one text
            solid = ends_solid[e[:-1] - 1] & _SPACE[data[b[1:]]] & self.cuts if len(b) > 1 else np.zeros(0, bool)
            cut = [0, *(np.flatnonzero(~solid) + 1), len(b)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                raw = b"".join(data[x:y].tobytes() for x, y in zip(b[i:j], e[i:j], strict=True))
                got = np.asarray(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, np.int64)
                if j == i + 1:
                    ids.append(got.astype(self.dtype))
                    counts.append(np.array([len(got)]))
                    continue
                reach = np.cumsum(self.width[got])
                upto = np.searchsorted(reach, np.cumsum(e[i:j] - b[i:j]), side="left") + 1
                ids.append(got.astype(self.dtype))
                counts.append(np.diff(upto, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 bounds of the texts."""
        data, offsets = text_bytes(column)
        total = len(data)
        if not total:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        begin = np.zeros(total, bool)
        ends_solid = solid_ends(data)
        if self.cuts:
            begin[1:] = _SPACE[data[1:]] & ends_solid[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], total)
        keys = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):  # hash the pieces of about a MB at a time
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + _CHUNK)))
            s, e = starts[a], ends[b - 1]
            power, inverse = _tables(max(_CHUNK, 1 << int(e - s).bit_length()))
            sums = np.zeros(e - s + 1, np.uint64)
            np.cumsum(_TABLE[data[s:e]] * power[: e - s], out=sums[1:])
            keys[a:b] = mix64((sums[ends[a:b] - s] - sums[starts[a:b] - s]) * inverse[starts[a:b] - s])
            a = b
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[spot] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            if len(self.ids) > self.cache_ids:
                self._clear()
                new = np.arange(len(distinct))
            new = new[np.argsort(first[new])]
            ids, counts = self._encode_pieces(data, ends_solid, starts[first[new]], ends[first[new]])
            at = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids])
            by = np.argsort(distinct[new])
            place = np.searchsorted(self.keys, distinct[new][by])
            self.keys = np.insert(self.keys, place, distinct[new][by])
            self.at, self.length = np.insert(self.at, place, at[by].astype(np.int32)), np.insert(self.length, place, counts[by].astype(np.int32))
            spot = np.searchsorted(self.keys, distinct)
        spot = spot[back]
        length = self.length[spot].astype(np.int64)
        reach = np.cumsum(length)
        out = self.ids[np.arange(reach[-1]) + np.repeat(self.at[spot] - (reach - length), length)]
        return out, np.concatenate([[0], reach])[np.searchsorted(starts, offsets)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(tokenizer: str | Callable[[], str], plain_specials: bool) -> Encoder:
    """One for each Python worker, whose bounded cache lasts over its tasks; a path is looked up where the task runs."""
    key = (tokenizer if isinstance(tokenizer, str) else tokenizer(), plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(key[0], plain_specials=plain_specials)
    return _encoders[key]


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def read_frame(data, at: int) -> tuple[memoryview, int]:
    """The payload of the record at ``at`` and where the next record begins; fails on a wrong checksum."""
    view = memoryview(data)
    head = view[at : at + 8]
    n = int.from_bytes(head, "little")
    payload = view[at + 12 : at + 12 + n]
    if masked_crc(head) != int.from_bytes(view[at + 8 : at + 12], "little") or len(payload) != n or masked_crc(payload) != int.from_bytes(view[at + 12 + n : at + 16 + n], "little"):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def _writer(folder: str, tokenizer: str | Callable[[], str], end_id: int, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        enc = None
        sink = index = None
        at = records = tokens = 0
        for batch in batches:
            for rows in slices(batch, 1, most=3 << 20):
                if sink is None:
                    enc = encoder(tokenizer, plain_specials)
                    where, base = fs.FileSystem.from_uri(folder)
                    where.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{task.taskAttemptId()}"
                    sink = where.open_output_stream(f"{base}/{name}.rec")
                    index = where.open_output_stream(f"{base}/{name}.idx")
                dtype = np.uint32 if end_id >= 1 << 16 else enc.dtype
                wide = _WIDE * (dtype == np.uint32)
                ids, bounds = enc.encode(rows.column(1))
                offsets = []
                for d, doc_id in enumerate(rows.column(0).to_pylist()):
                    own = np.append(ids[bounds[d] : bounds[d + 1]].astype(dtype, copy=False), dtype(end_id))
                    head = (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([wide | _NULL_ID * (doc_id is None)])
                    data = frame(head + own.tobytes())
                    sink.write(data)
                    offsets.append((at, len(data)))
                    at += len(data)
                    tokens += len(own)
                records += len(offsets)
                index.write(np.array(offsets, np.uint64).tobytes())
        if sink is not None:
            sink.close()
            index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([tokens])], names=["part", "path", "records", "tokens"]
            )

    return run


def write_records(
    docs: DataFrame,
    folder: str | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | Callable[[], str],
    end_id: int = 0,
    plain_specials: bool = False,
    file_bytes: int = 256 << 20,
    partitions: int | None = None,
) -> DataFrame:
    """Encode ``docs`` and write them in ascending order of id; returns the manifest (part, path, records, tokens).

    ``tokenizer`` is a path that every machine has, or a function that finds it, called in the tasks.  ``partitions`` is
    the number of files; by default as many as hold ``file_bytes`` of text each, and the session's shuffle partitions at least.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-records")
    if not partitions:
        size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / file_bytes))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    order = ("id", F.xxhash64("text"), "text")
    ordered = rows.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(_writer(folder, tokenizer, end_id, plain_specials), MANIFEST_SCHEMA), "token-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads files record by record: (part, id, place in the file, tokens, start in the file, checksum of the ids)."""
    for b in batches:
        for part, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            where, base = fs.FileSystem.from_uri(path)
            with where.open_input_file(base + ".idx") as f:
                index = np.frombuffer(f.read(), np.uint64).reshape(-1, 2).astype(np.int64)
            start = 0
            with where.open_input_file(base + ".rec") as f:
                cut = np.flatnonzero(np.diff(index[:, 0] // _READ_BYTES, prepend=-1))
                for some in np.split(index, cut[1:]) if len(index) else []:
                    data = f.read_at(int(some[-1].sum() - some[0, 0]), int(some[0, 0]))
                    cols: list[list] = [[], [], [], []]
                    for at, _ in some - [some[0, 0], 0]:
                        payload, _ = read_frame(data, int(at))
                        ids = np.frombuffer(payload[9:], np.uint32 if payload[8] & _WIDE else np.uint16)
                        doc_id = None if payload[8] & _NULL_ID else int.from_bytes(payload[:8], "little", signed=True)
                        for col, x in zip(cols, (doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            col.append(x)
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(some), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], names=["part", "doc_id", "n_tokens", "local", "ids_crc32"]
                    )


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files of a manifest."""
    files = manifest.select("part", "path", "tokens")
    # one row for each file: a window over them all stays small
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    n = max(manifest.count(), 1)
    rows = files.repartition(n, "part").select("part", "path").mapInArrow(_reader, "part int, doc_id long, n_tokens long, local long, ids_crc32 long")
    # starts has one row for each file, a number that write_records sets
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
