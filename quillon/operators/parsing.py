"""Loading delimited lines that may be broken (problem 4): typed valid rows and rejects with a reason.

Structural indexing over whole Arrow batches: a byte mask of quotes, its prefix parity per record, and from
that the separators outside quotes; all fields of a batch are then cut at once and checked column by column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut, dim_join

QUOTE, SPACE, TAB, COMMA, CR, HASH = 34, 32, 9, 44, 13, 35
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
LIMIT_63, LIMIT_32, LIMIT_31 = 2**63 - 1, 2**32 - 1, 2**31 - 1
REASONS = ["", "blank line", "broken quoting", "wrong number of fields", "not an integer", "integer out of range", "not a number", "end before begin", "bad object", "no header"]
BLANK, QUOTING, FIELDS, NOT_INT, RANGE, NOT_NUMBER, ORDER, OBJECT, NO_HEADER = range(1, 10)


class Index:
    """Fields of the records of one batch. ``start``/``end`` are byte ranges without outer blanks and quotes."""

    def __init__(self, records: pa.Array, separator: int) -> None:
        records = pc.fill_null(records, "")
        offsets = np.frombuffer(records.buffers()[1], np.int32, len(records) + 1, records.offset * 4).astype(np.int64)
        data = records.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        base = offsets[0]
        raw, offsets = raw[base:offsets[-1]], offsets - base
        n, size = len(records), len(raw)
        begin, stop = offsets[:-1], offsets[1:].copy()
        has = stop > begin
        stop[has] -= raw[stop[has] - 1] == CR
        self.n, self.raw, self.begin, self.stop = n, raw, begin, stop
        record = np.repeat(np.arange(n), np.diff(offsets))
        inside = np.arange(size) < stop[record] if size else np.zeros(0, bool)
        quote = (raw == QUOTE) & inside
        total = np.r_[0, np.cumsum(quote)]
        parity = (total[1:] - total[begin][record]) & 1 if size else np.zeros(0, np.int64)
        blank = (raw == SPACE) | (raw == TAB) if separator != TAB else raw == SPACE
        solid = np.flatnonzero(inside & ~blank)
        marks = np.flatnonzero((raw == separator) & inside & (parity == 0))
        in_record = record[marks] if size else marks
        self.fields = np.bincount(in_record, minlength=n) + 1
        self.first = np.r_[0, np.cumsum(self.fields)]
        start, end = np.empty(self.first[-1], np.int64), np.empty(self.first[-1], np.int64)
        start[self.first[:-1]], end[self.first[1:] - 1] = begin, stop
        at = np.arange(len(marks)) + in_record
        start[at + 1], end[at] = marks + 1, marks
        # trim blanks: next solid byte from the start, previous one before the end
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
        empty = lo > hi
        padded = np.r_[solid, 0]
        start, end = np.where(empty, start, padded[lo]), np.where(empty, start, padded[np.maximum(hi, 0)] + 1)
        # a quote opens (parity becomes 1) only at a field's first byte or right after a quote,
        # and closes (parity becomes 0) only at its last byte or right before a quote
        q = np.flatnonzero(quote)
        opens = parity[q] == 1 if size else np.zeros(0, bool)
        field = np.searchsorted(start, q, "right") - 1
        pad = np.r_[raw, 0, 0]
        same = lambda x, y: (x >= begin[record[q]]) & (x < stop[record[q]]) & (pad[x] == QUOTE) & y
        good = np.where(opens, (q == start[field]) | same(q - 1, True), (q + 1 == end[field]) | same(q + 1, True))
        bad = np.zeros(n, bool)
        if size:
            bad[record[q[~good]]] = True
            bad |= (total[stop] - total[begin]) % 2 == 1
        self.broken = bad
        self.blank = np.ones(n, bool)
        if size:
            self.blank[record[solid]] = False
        quoted = (end - start >= 2) & (pad[start] == QUOTE) & (pad[np.maximum(end - 1, 0)] == QUOTE) & ~empty
        self.start, self.end = start + quoted, end - quoted
        self.comment = has & (pad[begin] == HASH) & (stop > begin)

    def column(self, records: np.ndarray, k: int | np.ndarray) -> pa.Array:
        """The k-th field of the given records as strings, with doubled quotes undone."""
        f = self.first[records] + k
        s, size = self.start[f], np.maximum(self.end[f] - self.start[f], 0)
        offsets = np.r_[0, np.cumsum(size)]
        take = np.repeat(s - offsets[:-1], size) + np.arange(offsets[-1])
        out = pa.StringArray.from_buffers(len(f), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.raw[take].tobytes()))
        return pc.replace_substring(out, '""', '"') if len(take) and (self.raw[take] == QUOTE).any() else out


def integers(text: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, not-an-integer mask and out-of-range mask of ASCII digit strings."""
    plain = pc.ascii_is_decimal(text).to_numpy(False)
    digits = pc.ascii_ltrim(pc.if_else(pa.array(plain), text, "0"), "0")
    size = pc.binary_length(digits).to_numpy(False)
    short = pc.if_else(pa.array(size <= 19), digits, "0")
    value = pc.cast(pc.if_else(pc.equal(short, ""), "0", short), pa.uint64()).to_numpy(False)
    over = plain & ((size > 19) | (value > limit))
    return np.where(over, 0, value).astype(np.int64), ~plain, over


def numbers(text: pa.Array, nan: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values and bad mask; ``nan`` allows the word nan, which gives a missing value."""
    good = pc.match_substring_regex(text, NUMBER).to_numpy(False)
    missing = pc.equal(text, "nan").to_numpy(False) if nan else np.zeros(len(text), bool)
    value = pc.cast(pc.if_else(pa.array(good), pc.utf8_ltrim(text, "+"), "0"), pa.float64()).to_numpy(False)
    return np.where(good, value, np.nan), ~(good | missing)


LINE_KEYS = "line_id long, trace_id long, file_name string, line_no int"
BURST_FIELDS = "instance long, task_id long, thread_id long, begin_time long, end_time long, duration long, line long"
BURST_SCHEMA = f"{LINE_KEYS}, reason string, {BURST_FIELDS}, metrics map<string,double>, cluster_id int"
SEMANTIC_SCHEMA = f"{LINE_KEYS}, reason string, application long, task long, thread long, begin_time long, duration long, value long"
BURST_LIMITS = [LIMIT_63, LIMIT_32, LIMIT_32, LIMIT_63, LIMIT_63, LIMIT_63, LIMIT_63]


def _note(reason: np.ndarray, rows: np.ndarray, code: int) -> None:
    """Keep the first reason of a record."""
    rows = rows[reason[rows] == 0]
    reason[rows] = code


def _burst_batch(batch: pa.RecordBatch, with_metrics: bool = True) -> pa.RecordBatch:
    records = batch.column(batch.schema.get_field_index("record"))
    header = batch.column(batch.schema.get_field_index("_header"))
    ix = Index(records, COMMA)
    n = ix.n
    reason = np.zeros(n, np.int8)
    _note(reason, np.flatnonzero(ix.blank), BLANK)
    _note(reason, np.flatnonzero(header.is_null().to_numpy(False)), NO_HEADER)
    _note(reason, np.flatnonzero(ix.broken), QUOTING)
    kinds = header.dictionary_encode()
    codes = np.where(header.is_valid().to_numpy(False), pc.fill_null(kinds.indices, 0).to_numpy(False), -1)
    names = []
    for h in kinds.dictionary:
        hx = Index(pa.array([h.as_py().lstrip("#")]), COMMA)
        names.append([hx.column(np.array([0]), k)[0].as_py() for k in range(int(hx.fields[0]))])
    width = np.array([len(x) for x in names] or [0])[np.maximum(codes, 0)]
    _note(reason, np.flatnonzero(ix.fields != width), FIELDS)
    whole: list[np.ndarray] = []
    for k in range(7):
        value = np.zeros(n, np.int64)
        rows = np.flatnonzero((reason == 0) & (ix.fields > k))
        value[rows], bad, over = integers(ix.column(rows, k), BURST_LIMITS[k])
        _note(reason, rows[bad], NOT_INT)
        _note(reason, rows[over], RANGE)
        whole.append(value)
    cluster = np.zeros(n, np.int64)
    metric_of: dict[int, dict[str, np.ndarray]] = {}  # values by header and name, over all lines of the batch
    for c, cols in enumerate(names):
        at = next((i for i, x in enumerate(cols) if x.lower() == "clusterid"), len(cols) - 1)
        rows = np.flatnonzero((reason == 0) & (codes == c))
        metrics = [i for i in range(7, len(cols)) if i != at]
        for j, i in enumerate(metrics):
            rows = rows[reason[rows] == 0]
            value, bad = numbers(ix.column(rows, i), nan=j >= 4)
            _note(reason, rows[bad], NOT_NUMBER)
            if with_metrics:
                own = metric_of.setdefault(c, {})[cols[i]] = np.full(n, np.nan)
                own[rows] = value
        rows = rows[reason[rows] == 0]
        if at >= 7:
            cluster[rows], bad, over = integers(ix.column(rows, at), LIMIT_31)
            _note(reason, rows[bad], NOT_INT)
            _note(reason, rows[over], RANGE)
    _note(reason, np.flatnonzero(whole[4] < whole[3]), ORDER)
    keep = np.flatnonzero(~ix.comment)
    bad = reason[keep] != 0
    ints = [pa.array(v[keep], mask=bad) for v in whole]
    kv = _maps(metric_of, codes[keep], keep, bad) if with_metrics else pa.nulls(len(keep), pa.map_(pa.string(), pa.float64()))
    return _result(batch, keep, reason, [*ints, kv, pa.array(cluster[keep].astype(np.int32), mask=bad)], BURST_SCHEMA)


def _maps(metric_of: dict[int, dict[str, np.ndarray]], codes: np.ndarray, rows: np.ndarray, bad: np.ndarray) -> pa.Array:
    """Name to value of each row's metrics, null for bad rows; a missing value stands as null under its name."""
    size = np.zeros(len(rows), np.int64)
    for c, own in metric_of.items():
        size[(codes == c) & ~bad] = len(own)
    offsets = np.r_[0, np.cumsum(size)]
    value, name, names = np.empty(offsets[-1]), np.empty(offsets[-1], np.int64), []
    for c, own in metric_of.items():
        at = np.flatnonzero((codes == c) & ~bad)
        for j, (k, v) in enumerate(own.items()):
            value[offsets[at] + j], name[offsets[at] + j] = v[rows[at]], len(names)
            names.append(k)
    keys = pa.array(names, pa.string()).take(pa.array(name))
    edges = pa.array(offsets.astype(np.int32), mask=np.r_[bad, False])  # a null offset makes the entry null
    return pa.MapArray.from_arrays(edges, keys, pa.array(value, mask=np.isnan(value)))


def _semantic_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    ix = Index(batch.column(batch.schema.get_field_index("record")), TAB)
    n = ix.n
    reason = np.zeros(n, np.int8)
    _note(reason, np.flatnonzero(ix.blank), BLANK)
    _note(reason, np.flatnonzero(ix.broken), QUOTING)
    _note(reason, np.flatnonzero(ix.fields != 4), FIELDS)
    rows = np.flatnonzero(reason == 0)
    parts = pc.split_pattern(ix.column(rows, 0), ".")
    size = pc.list_value_length(parts).to_numpy(False)
    _note(reason, rows[(size < 2) | (size > 3)], OBJECT)
    ids = [np.zeros(n, np.int64) for _ in range(3)]
    for k in range(3):
        some = (size > k) & (reason[rows] == 0)
        at = rows[some]
        ids[k][at], bad, over = integers(pc.list_element(parts.filter(pa.array(some)), k), LIMIT_32)
        _note(reason, at[bad | ((ids[k][at] == 0) & ~over)], OBJECT)
        _note(reason, at[over], RANGE)
    two = np.zeros(n, bool)
    two[rows[size == 2]] = True
    values = []
    for k, limit in ((1, LIMIT_63), (2, LIMIT_63), (3, LIMIT_32)):
        value = np.zeros(n, np.int64)
        rows = np.flatnonzero(reason == 0)
        value[rows], bad, over = integers(ix.column(rows, k), limit)
        _note(reason, rows[bad], NOT_INT)
        _note(reason, rows[over], RANGE)
        values.append(value)
    bad = reason != 0
    cols = [pa.array(ids[0], mask=bad), pa.array(ids[1], mask=bad), pa.array(ids[2], mask=bad | two)]
    return _result(batch, np.arange(n), reason, [*cols, *(pa.array(v, mask=bad) for v in values)], SEMANTIC_SCHEMA)


def _result(batch: pa.RecordBatch, keep: np.ndarray, reason: np.ndarray, typed: list[pa.Array], schema: str) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array(keep)) for k in names[:4]]
    why = pa.array([REASONS[x] or None for x in reason[keep].tolist()], pa.string())
    return pa.RecordBatch.from_arrays([*keys, why, *typed], names)


def _mapper(one: Callable[..., pa.RecordBatch], *arguments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield one(batch, *arguments)

    return run


def parse_burst_lines(lines: DataFrame, metrics: bool = True) -> DataFrame:
    """Rows of BURST_SCHEMA: ``reason`` is null for valid lines, whose typed columns are set; else they are null.

    Without ``metrics`` their values are checked but not given.

    Headers and comments give no row. A null or blank record is rejected as a blank line, a line of a file
    without a header as such. The header of a file (per trace and file name) is its line with the least
    number; of several with that number the least text that starts with ``#``. Every line id is judged on
    its own, so repeated lines give repeated rows. Very long lines are handled like others. An empty table
    gives an empty result; other columns of the input are ignored.
    """
    keys = ["trace_id", "file_name"]
    own = lines.select("line_id", *keys, "line_no", "record")
    first = own.groupBy(*keys).agg(F.min_by(F.regexp_replace("record", "\r$", ""), F.struct("line_no", ~F.coalesce(F.col("record").startswith("#"), F.lit(False)), "record")).alias("_header"))
    # null-safe keys, as a missing trace or file name is a key as well
    safe = [F.coalesce(F.col("trace_id").cast("string"), F.lit("")).alias("_t"), F.coalesce("file_name", F.lit("")).alias("_f")]
    joined = dim_join(own.select("*", *safe), cut(first.select(*safe, "_header"), "headers"), ["_t", "_f"])
    return joined.select("line_id", *keys, "line_no", "record", "_header").mapInArrow(_mapper(_burst_batch, metrics), BURST_SCHEMA)


def parse_semantic_lines(lines: DataFrame) -> DataFrame:
    """Rows of SEMANTIC_SCHEMA, as in ``parse_burst_lines``; there are no headers or comments here."""
    return lines.select("line_id", "trace_id", "file_name", "line_no", "record").mapInArrow(_mapper(_semantic_batch), SEMANTIC_SCHEMA)
