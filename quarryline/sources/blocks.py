"""Statements and their blocks, of masked Python text.

A small helper of the tasks: it tells where statements begin (outside all brackets), how far they are indented and which statement ends a
block.  A file's text is read in one pass and gives a row for each block that is asked for; what the rows say is left to DataFrame expressions.  Files are rows, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_CHANGE = np.zeros(256, np.int8)
_CHANGE[[ord(x) for x in "([{"]] = 1
_CHANGE[[ord(x) for x in ")]}"]] = -1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 12, 13, 32]] = True
_FEED = 10
_MOST = 4 << 20  # bytes of text that are read, or put out, at a time
_FIELDS = "no int, indent int, body int, text string, end int, above string, around string, least int, last int"


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into slices of some _MOST bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _MOST)))
        yield batch.slice(start, stop - start)
        start = stop


def _read(texts: list[bytes], heads: re.Pattern | None, around: re.Pattern | None) -> Iterator[tuple]:
    """(file, no, indent, body, text, end, above, around, least, last) of each file as a whole, of number -1, and of the blocks of its statements that begin with ``heads``."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    data[_BLANK[data] & (data != _FEED)] = 32
    ends = np.flatnonzero(data == _FEED)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.array([len(t) + 1 for t in texts])
    first_line = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    depth = np.concatenate([[0], np.cumsum(_CHANGE[data], dtype=np.int32)])
    base = np.repeat(depth[np.cumsum(sizes) - sizes], np.diff(np.append(first_line, len(starts))))
    before, after = depth[starts] - base, depth[ends] - base
    filled = np.append(np.flatnonzero(~_BLANK[data]), len(data))
    code = filled[np.searchsorted(filled, starts)]
    begins = (before == 0) & (code < ends)
    # line feeds before lines that go on within brackets; those between files stay
    goes_on = before != 0
    goes_on[first_line] = False
    data[starts[goes_on] - 1] = 13
    raw = data.tobytes()
    bounds = np.append(first_line, len(starts)).tolist()
    for f in range(len(texts)):
        a, z = bounds[f], bounds[f + 1]
        least, last = int(after[a:z].min()), int(after[z - 1])
        stop = int(ends[z - 1])
        yield f, -1, 0, None, raw[starts[a] : stop], z - a, None, None, least, last
        if heads is None:
            continue
        lines = a + np.flatnonzero(begins[a:z])
        at, code_at = starts[lines].tolist(), code[lines].tolist()
        indents = (code[lines] - starts[lines]).tolist()
        number = (lines - a).tolist()
        n = len(number)
        open_: list[tuple] = []  # (indent, statement, texts above, statement of the block around)
        outer: list[tuple[int, int]] = []
        found = []
        marks_from = -1
        for i, indent in enumerate(indents):
            while open_ and open_[-1][0] >= indent:
                _, k, *more = open_.pop()
                found.append((k, i, *more))
            here = code_at[i]
            if around is not None:
                while outer and outer[-1][0] >= indent:
                    outer.pop()
                if around.match(raw, here):
                    inside = outer[-1][1] if outer else -1
                    outer.append((indent, i))
                else:
                    inside = outer[-1][1] if outer else -1
            else:
                inside = -1
            if raw[here] == 64:  # @
                marks_from = i if marks_from < 0 else marks_from
                continue
            if heads.match(raw, here):
                open_.append((indent, i, marks_from, inside))
            marks_from = -1
        found += [(k, n, *more) for _, k, *more in open_]
        for k, e, marks, inside in found:
            above = raw[at[marks] : at[k]] if marks >= 0 else None
            said = raw[at[inside] : at[inside + 1] if inside + 1 < n else stop] if inside >= 0 else None
            yield f, number[k], indents[k], indents[k + 1] if k + 1 < n else None, raw[at[k] : at[e] if e < n else stop], number[e] if e < n else z - a, above, said, least, last


def statement_blocks(sources: DataFrame, heads: str | None, around: str | None = None) -> DataFrame:
    """(path, no, indent, body, text, end, above, around, least, last) of ``sources(path, text)``, whose texts are masked and not null.

    A row of ``no`` -1 stands for each whole file, the others for the blocks of the statements whose lines begin with the pattern ``heads``, from line ``no`` up to ``end``: the next statement that is indented no
    deeper.  ``body`` is the indent of the next statement, ``above`` the decorators, ``around`` the innermost statement of that pattern whose block this one is in, ``least`` and ``last`` the depths of brackets after the file's lines.
    Blanks are spaces; a carriage return stands before a line that goes on within brackets, so that each line feed begins a statement or a blank line.
    """
    want, outer = (None if x is None else re.compile(x.encode()) for x in (heads, around))
    schema = T.StructType([sources.schema["path"], *T._parse_datatype_string(_FIELDS).fields])
    rows = sources.select("path", "text")
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(part: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            of, *columns = zip(*out, strict=True)
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(x.cast(pa.string()) if x.type == pa.binary() else x for x in arrays)], names=schema.names)

        for b in batches:
            for part in _parts(b, 1):
                out, size = [], 0
                for row in _read(part.column(1).cast(pa.binary()).to_pylist(), want, outer):
                    out.append(row)
                    size += len(row[4])
                    if size > _MOST or len(out) >= 1 << 16:
                        yield batch(part, out)
                        out, size = [], 0
                if out:
                    yield batch(part, out)

    return rows.mapInArrow(run, schema)
