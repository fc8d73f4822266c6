"""Byte positions in text: lines, line numbers and columns of other encodings. All run in the JVM but the line scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_spans(files: DataFrame) -> DataFrame:
    """(path, line, start_byte, end_byte) of each physical line of ``files`` (path, text); the end leaves the terminator out.

    Lines end at a line feed, a carriage return, or both together; nothing else ends one. A terminator at the end of the
    text does not begin another line. Null and empty texts have no lines.
    """
    kind = dict(files.dtypes)["path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text")[i]
                if not raw.is_valid or not len(raw.as_buffer()):
                    continue
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                feed, back = data == 10, data == 13
                pair = np.zeros(len(data), bool)
                pair[1:] = feed[1:] & back[:-1]
                stop = np.flatnonzero((feed | back) & ~pair)
                after = stop + 1 + (np.append(pair, False)[stop + 1])
                start, end = np.append(0, after), np.append(stop, len(data))
                if start[-1] == len(data):
                    start, end = start[:-1], end[:-1]
                path = pa.repeat(batch.column("path")[i], len(start))
                yield pa.RecordBatch.from_arrays([path, pa.array(np.arange(1, len(start) + 1), pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["path", "line", "start_byte", "end_byte"])

    return files.select("path", "text").mapInArrow(run, f"path {kind}, line long, start_byte long, end_byte long")


def line_at(text: Column, byte: Column) -> Column:
    """Number of the line, counted in line feeds from 1, that holds a byte offset of the text."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte.cast("int")), "ISO-8859-1")
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_to_byte(line: Column, column: Column, encoding: Column) -> Column:
    """Struct (byte, reason): the byte column of a column counted in units of ``utf8``, ``utf16`` or ``utf32``.

    Beyond the line's end the reason is position_out_of_line; inside a character it is position_not_on_boundary.
    """
    size = lambda c: F.octet_length(c)
    units = lambda c: F.when(encoding == "utf8", size(c)).when((encoding == "utf16") & (size(c) == 4), 2).otherwise(1)
    chars = F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))
    pack = lambda u, b: F.struct(u.cast("long").alias("units"), b.cast("long").alias("bytes"))
    step = lambda a, c: F.when(a["units"] < column, pack(a["units"] + units(c), a["bytes"] + size(c))).otherwise(a)
    end = F.aggregate(chars, pack(F.lit(0), F.lit(0)), step)
    reason = F.when(end["units"] < column, "position_out_of_line").when(end["units"] > column, "position_not_on_boundary")
    return F.struct(F.when(reason.isNull(), end["bytes"]).alias("byte"), reason.alias("reason"))
