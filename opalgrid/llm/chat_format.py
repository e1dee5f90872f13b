r"""Chat formatting by columnar byte assembly.

``<s>[TURN] role\ntext[/TURN]...</s>``: one formatted value per conversation, in chunks of
bounded size when a conversation is longer than a batch. Control strings inside roles and
texts get a backslash before them, and backslashes are doubled, so unescaping gives back every
byte. For a batch, numpy computes the lengths of all segments, their cumulative offsets and
the scatter indices; headers and contents are copied into one preallocated Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import column_bytes, column_of, tune

OPEN, CLOSE, FIRST, LAST = b"[TURN] ", b"[/TURN]", b"<s>", b"</s>"
#: Strings that mark turns here or in common chat templates; none of them holds another.
CONTROL = (OPEN, CLOSE, FIRST, LAST, b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
_ROLE = re.compile(rb"([\\\n]|" + b"|".join(map(re.escape, CONTROL)) + b")")
_BLOCK = 4 << 20
CHUNKS = "conv_id long, chunk long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"


def escape_positions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in ``data`` that need a backslash before them; no match spans two rows."""
    hits = [np.flatnonzero(data == 92)]
    ends = offsets[1:]
    for first in (b"[", b"<"):
        at = np.flatnonzero(data == first[0])
        if not len(at):
            continue
        end = ends[np.searchsorted(ends, at, side="right")]
        for word in CONTROL:
            if word[:1] == first:
                ok = at[at + len(word) <= end]
                for j in range(1, len(word)):
                    ok = ok[data[ok + j] == word[j]]
                hits.append(ok)
    return np.sort(np.concatenate(hits))


def escape_all(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets of all rows at once."""
    at = escape_positions(data, offsets)
    if not len(at):
        return data, offsets
    out = np.empty(len(data) + len(at), np.uint8)
    marks = at + np.arange(len(at))
    plain = np.ones(len(out), bool)
    plain[marks] = False
    out[marks] = 92
    out[plain] = data
    return out, offsets + np.searchsorted(at, offsets)


def unescape(data: bytes) -> bytes:
    return re.sub(rb"(?s)\\(.)", rb"\1", data) if b"\\" in data else data


def assemble(roles: list[bytes], data: np.ndarray, offsets: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each row, start of each content, end of each content) of formatted rows.
    ``opens`` and ``closes`` say which rows begin and end a conversation."""
    body, at = escape_all(data, offsets)
    size = np.diff(at)
    kinds = {r: OPEN + _ROLE.sub(rb"\\\1", r) + b"\n" for r in dict.fromkeys(roles)}
    number = {r: i for i, r in enumerate(kinds)}
    kind = np.array([number[r] for r in roles], np.int64)
    head = np.array([len(h) for h in kinds.values()], np.int64)[kind]
    lengths = np.stack([opens * len(FIRST), head, size, np.full(len(roles), len(CLOSE)), closes * len(LAST)], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    begins = ends - lengths
    out = pa.allocate_buffer(int(ends[-1, -1]))
    to = np.frombuffer(out, np.uint8)

    def put(rows: np.ndarray, column: int, word: bytes) -> None:
        to[(begins[rows, column][:, None] + np.arange(len(word))).ravel()] = np.tile(np.frombuffer(word, np.uint8), len(rows))

    put(np.flatnonzero(opens), 0, FIRST)
    for r, h in kinds.items():
        put(np.flatnonzero(kind == number[r]), 1, h)
    put(np.arange(len(roles)), 3, CLOSE)
    put(np.flatnonzero(closes), 4, LAST)
    row = 0
    while row < len(roles):  # contents, in blocks that bound the index arrays
        stop = max(row + 1, int(np.searchsorted(at, at[row] + _BLOCK, side="right")) - 1)
        if stop == row + 1:
            to[begins[row, 2] : ends[row, 2]] = body[at[row] : at[stop]]
        else:
            shift = np.repeat(begins[row:stop, 2] - at[row:stop], size[row:stop])
            to[shift + np.arange(at[row], at[stop])] = body[at[row] : at[stop]]
        row = stop
    return out, begins[:, 0], begins[:, 2], ends[:, 2]


def _format(loss_role: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        before: pa.RecordBatch | None = None
        started, chunk, current = False, 0, None

        def work(batch: pa.RecordBatch, following) -> pa.RecordBatch:
            """following: the next batch's first conversation, or a value equal to none."""
            nonlocal started, chunk, current
            convs = column_of(batch, "conv_id").to_pylist()
            roles = column_bytes(column_of(batch, "role"))
            texts = column_bytes(column_of(batch, "text"))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            new = np.array([i == 0 or convs[i] != convs[i - 1] for i in range(len(convs))])
            opens = new.copy()
            opens[0] = not started or convs[0] != current
            closes = np.append(new[1:], following is _END or following != convs[-1])
            out, start, begin, end = assemble(roles, data, offsets, opens, closes)
            view, firsts, rows = memoryview(out), np.flatnonzero(new), []
            stops = np.append(firsts[1:], len(convs))
            for a, b in zip(firsts.tolist(), stops.tolist(), strict=True):
                chunk = 0 if opens[a] else chunk + 1
                z = int(start[b]) if b < len(convs) else len(view)
                mine = [i for i in range(a, b) if roles[i] == loss_role]
                rows.append((convs[a], chunk, b - a, view[start[a] : z].tobytes(), (begin[mine] - start[a]).tolist(), (end[mine] - start[a]).tolist()))
            started, current = True, convs[-1]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if before is not None:
                yield work(before, column_of(batch, "conv_id")[0].as_py())
            before = batch
        if before is not None:
            yield work(before, _END)

    return run


_END = object()


def chat_format(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations: conv_id, chunk, n_turns, formatted (UTF-8), loss_starts, loss_ends
    (bytes, contents of ``loss_role``). The chunks of a conversation, in order, are one text.

    Null texts and roles count as empty; a null conv_id is a conversation of its own. Rows are
    ordered by turn (null first); equal turns by role, then text, and rows that repeat each
    count. A conversation streams through a task in bounded batches, however long it is. An
    empty table gives an empty result; other columns are left out.
    """
    tune(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(loss_role.encode()), CHUNKS)


def turns_of(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of a formatted chunk, unescaped."""
    at = len(FIRST) if formatted.startswith(FIRST) else 0
    while formatted.startswith(OPEN, at):
        at += len(OPEN)
        line = _unescaped(formatted, b"\n", at)
        end = _unescaped(formatted, CLOSE, line + 1)
        yield unescape(formatted[at:line]), unescape(formatted[line + 1 : end])
        at = end + len(CLOSE)
    if formatted[at:] not in (b"", LAST):
        raise ValueError("not a formatted conversation")


def _unescaped(data: bytes, what: bytes, at: int) -> int:
    while True:
        at = data.index(what, at)
        n = at
        while n and data[n - 1] == 92:
            n -= 1
        if (at - n) % 2 == 0:
            return at
        at += 1


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives, per conversation. ``formatted`` comes straight from
    chat_format, whose partitions hold whole conversations in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        key, own, rows = _END, None, []
        points = lambda b: len(b.decode())

        def close() -> None:
            if own:
                rows.append((key, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))

        for batch in batches:
            for conv, chunk, _, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk == 0:
                    close()
                    key, own = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    own[0] += 1
                    own[1].update(role + b"\n" + said + b"\n")
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(text[a:b])
                    own[2] += points(said)
                    own[3].update(said)
                own[4] += points(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
