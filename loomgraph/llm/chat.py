r"""Operator 13, chat formatting: columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. Inside texts a backslash
stands before every backslash and before each place where ``###`` or ``</turn>``
begins, so neither occurs unescaped but where a turn begins or ends, and dropping
the escapes gives the text back. In roles, colons, ``#`` and ``<`` are escaped too.

Rows are sorted by ranges of (conv_id, turn); a task takes many conversations at
once. In numpy, escapes give segment lengths, lengths give offsets by a running
sum, and offsets give every source byte its place: headers, contents and ends are
copied into one preallocated buffer, which is the Arrow column of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.llm.textbytes import utf8

HEAD, AFTER, END = b"### ", b": ", b"</turn>\n"
#: Bytes of turns that are assembled at once; a conversation with more is cut into parts, a longer turn is a part alone.
BLOCK = 4 << 20
#: The role whose texts count for the loss.
LEARNED = "assistant"

_BACK = 92
_FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss_start array<int>, loss_end array<int>"


def header(role: str | None) -> bytes:
    return HEAD + re.sub(rb"[\\:#<]", rb"\\\g<0>", (role or "").encode()) + AFTER


def escape_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the bytes that an escape stands before; nothing is found across two texts."""
    end_of = lambda at: offsets[np.searchsorted(offsets, at, "right")]
    found = [np.flatnonzero(data == _BACK)]
    for mark in (b"###", b"</turn>"):
        at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        found.append(at[at + len(mark) <= end_of(at)])
    return np.sort(np.concatenate(found))


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy each segment of ``data`` to its place in ``out``."""
    out[np.repeat(to - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data


def _packed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = utf8(col)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, offsets of turns in it, and where each turn's text begins and ends. Nulls are empty."""
    names = roles.cast(pa.string()).dictionary_encode()
    heads = pa.array([header(r) for r in names.dictionary.to_pylist()] + [header(None)], pa.binary())
    head_at, head = _packed(heads.take(names.indices.fill_null(len(names.dictionary))))
    at, data = _packed(texts)
    marks = escape_marks(data, at)
    more = np.zeros(len(data) + 1, np.int64)
    more[marks + 1] = 1
    more = np.cumsum(more)  # escapes before each byte, its own included at the next place
    content = np.diff(at) + more[at[1:]] - more[at[:-1]]
    size = np.diff(head_at) + content + len(END)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], np.uint8)
    begin = offsets[:-1] + np.diff(head_at)
    scatter(out, offsets[:-1], head, head_at)
    to = np.repeat(begin - at[:-1] - more[at[:-1]], np.diff(at)) + np.arange(len(data)) + more[1:]
    out[to] = data
    out[to[marks] - 1] = _BACK
    tail = begin + content
    out[tail[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    return out, offsets, begin, tail


def _rows(conv: pa.Array, roles: pa.Array, texts: pa.Array, first: np.ndarray, number: int) -> pa.RecordBatch:
    """One row for each run of turns that begins at ``first``."""
    out, offsets, begin, tail = assemble(roles, texts)
    edge = np.append(first, len(conv))
    start = offsets[edge]
    learned = np.flatnonzero(pc.equal(roles, LEARNED).fill_null(False).to_numpy(zero_copy_only=False))
    of = np.searchsorted(edge, learned, "right") - 1
    spans_at = pa.array(np.searchsorted(learned, edge), pa.int32())
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(start.astype(np.int32)), pa.py_buffer(out))
    spans = [pa.ListArray.from_arrays(spans_at, pa.array(x[learned] - start[of], pa.int32())) for x in (begin, tail)]
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(number + np.arange(len(first)), pa.int64()), pa.array(np.diff(edge), pa.int64()), text, *spans], names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, first row of each conversation in them): whole conversations, but for those of more than ``block`` bytes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        rows = pa.concat_batches(kept)
        first, at, lo = *_edges(rows), 0
        while lo < rows.num_rows:
            later = first[first > lo]
            fits = later[at[later] <= at[lo] + block]
            end = int(later[0]) if len(later) else rows.num_rows
            if len(fits):
                cut = int(fits[-1])
            elif at[end] > at[lo] + block:
                cut = min(end, max(lo + 1, int(np.searchsorted(at, at[lo] + block, "right")) - 1))
            else:
                break  # the last conversation may go on in the next batch
            yield rows.slice(lo, cut - lo), np.append(lo, later[later < cut]) - lo
            lo = cut
        kept = [rows.slice(lo)]
    rows = pa.concat_batches(kept) if kept else None
    if rows is not None and rows.num_rows:
        yield rows, _edges(rows)[0]


def _edges(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where conversations begin, and bytes before each row."""
    conv = rows.column("conv_id")
    key = np.stack([conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)])
    first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))[: rows.num_rows])
    return first, _packed(rows.column("text"))[0] + _packed(rows.column("role"))[0] + 32 * np.arange(rows.num_rows + 1)


def format_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_start, loss_end): conversations as text, with the learned texts' byte ranges in it.

    ``turns`` (conv_id, turn, role, text); other columns are ignored. Turns go by
    turn (null first), then role, then the text's hash and the text, so repeated
    and tied rows have a defined order and each counts. Null roles and texts are
    empty; rows of a null conv_id are one conversation. An empty table gives an
    empty result. A conversation is one row, but several, in the order of
    ``part``, where it has over ``block`` bytes or was cut between two ranges: a
    hot conversation spreads over tasks, and a task holds one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for rows, first in _runs(batches, block):
            yield _rows(*rows.columns, first, number)
            number += len(first)

    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64("text").alias("__h"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, "conv_id", "turn", "role", "__h").sortWithinPartitions("conv_id", "turn", "role", "__h", "text")
    return d.select("conv_id", "role", "text").mapInArrow(run, _FORMATTED)


def escaped(data: np.ndarray) -> np.ndarray:
    """Whether an escape stands before each byte: an odd number of backslashes."""
    back = data == _BACK
    at = np.arange(len(data))
    solid = np.maximum.accumulate(np.where(back, -1, at))
    out = np.zeros(len(data), bool)
    out[1:] = (at[:-1] - solid[:-1]) % 2 == 1
    return out


def parse(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a formatted block: bytes without escapes, their number before each place, and where roles begin, and texts begin and end."""
    free = ~escaped(data)
    plain = ~((data == _BACK) & free)
    before = np.concatenate([[0], np.cumsum(plain)])
    tail = np.flatnonzero(free & (data == END[0]))
    tail = tail[tail + len(END) <= len(data)]
    for k in range(1, len(END)):
        tail = tail[data[tail + k] == END[k]]
    role = np.concatenate([[0], tail[:-1] + len(END)]) + len(HEAD) if len(tail) else tail
    colon = np.flatnonzero(free & (data == AFTER[0]))
    text = colon[np.searchsorted(colon, role)] if len(role) else role
    return data[plain], before, role, text, tail


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say: turns, and the text under the loss mask. Parts of a conversation are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: list = []  # conv_id, turns, digest, loss chars, loss digest, chars

        def close() -> None:
            if now:
                rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])

        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                conv = conv.as_py()
                if not now or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = np.frombuffer(text.as_buffer(), np.uint8)
                plain, before, role, colon, tail = parse(data)
                whole = memoryview(plain)
                for a, b, c, d in zip(before[role].tolist(), before[colon].tolist(), before[colon + len(AFTER)].tolist(), before[tail].tolist(), strict=True):
                    now[2].update(b"".join((whole[a:b], b"\n", whole[c:d], b"\n")))
                for a, b in zip(before[start.values.to_numpy()].tolist(), before[end.values.to_numpy()].tolist(), strict=True):
                    now[4].update(whole[a:b])
                    now[3] += _chars(plain[a:b])
                now[1] += len(role)
                now[5] += _chars(data)
            if len(rows) > 1000:
                yield out()
        close()
        yield out()

    d = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return d.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, _DIGEST)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, LEARNED, hard)], "conv_id long, turn long, role string, text string")
    return read_back(written(format_conversations(turns.unionByName(more)), "formatted"))
