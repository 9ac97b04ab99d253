"""Several values packed into one text field: one row per value, with its position.

The work is done per Arrow batch on the string buffers themselves: quote parity and delimiter masks are numpy
arrays over the bytes of the whole batch, child offsets are derived from the masks, and the pieces are list arrays
flattened with their parent ordinals. No Python code runs per cell or per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cells and pieces that say "nothing here".
MISSING = ("", "-", "--", "n/a", "na", "n.a.", "nan", "none", "null", "unknown", "not available", "[]", "?", "anonymous", "anon.")
# Particles that belong to a family name.
PARTICLES = ("de la", "de los", "de las", "van der", "van den", "von der", "von", "van", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu")

_HARD = np.zeros(256, bool)
_HARD[list(b";|\n\r\t&/")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
# Delimiters of several bytes, and whether each acts as a comma.
_WIDE = (("，", True), ("；", False), ("、", False), ("｜", False), ("＆", False), ("／", False), ("&amp;", False), (" and ", False), (" · ", False))
_Z = r"[\s\p{Z}]"
_GIVEN = rf"^[^\s\p{{Z}}]+(?:{_Z}+\p{{L}}[.．])*$"
_FAMILY = rf"^(?:(?i:{'|'.join(PARTICLES)}){_Z}+)*[^\s\p{{Z}}]+$"
_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _buffers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the array and row offsets into them, starting at 0."""
    cells = cells.cast(pa.large_string()).fill_null("")
    _, offsets, data = cells.buffers()
    offs = np.frombuffer(offsets, np.int64)[cells.offset : cells.offset + len(cells) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or offs[0] == offs[-1]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings data[starts[i]:ends[i]]; the spans are sorted and do not overlap."""
    k = len(starts)
    if not k:
        return pa.array([], pa.large_string())
    edges = np.empty(2 * k + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1]
    every = pa.LargeStringArray.from_buffers(2 * k, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    return every.take(pa.array(np.arange(0, 2 * k, 2)))


def _find(data: np.ndarray, needle: bytes) -> np.ndarray:
    """Positions of ``needle`` in the bytes."""
    if len(data) < len(needle):
        return np.zeros(0, np.int64)
    hit = data[: len(data) - len(needle) + 1] == needle[0]
    for i, byte in enumerate(needle[1:], 1):
        hit &= data[i : len(data) - len(needle) + 1 + i] == byte
    return np.flatnonzero(hit)


def split_cells(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent row, position from 1 and value of each value in the cells."""
    n = len(cells)
    data, offs = _buffers(cells)
    total = len(data)
    if not n or not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())
    lens = np.diff(offs)
    row = np.repeat(np.arange(n), lens)
    first, last = offs[:-1], offs[1:]
    at = np.arange(total)

    # nearest byte that is no space, before and after each byte, inside the row; -1 and -2 stand for the row's edges
    solid = ~_SPACE[data]
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(solid, at, -1))[:-1]))
    before = np.where(before >= first[row], before, -1)
    after = np.concatenate((np.minimum.accumulate(np.where(solid, at, total)[::-1])[::-1][1:], [total]))
    after = np.where(after < last[row], after, -2)
    prev_byte = np.where(before >= 0, data[before], 0)
    next_byte = np.where(after >= 0, data[np.maximum(after, 0)], 0)

    head = np.full(n, -1)  # first byte of a row that is no space
    where = np.flatnonzero(solid & (before == -1))
    head[row[where]] = where
    lead = np.where(head >= 0, data[np.maximum(head, 0)], 0)
    follow = np.where(head >= 0, next_byte[np.maximum(head, 0)], 0)
    listed = (lead == ord("[")) & ~_DIGIT[follow]

    # quote parity: double quotes toggle unless escaped; single quotes only at the edge of a value, in rows that open with one
    tail = np.where(at > 0, data[np.maximum(at - 1, 0)], 0)
    double = (data == ord('"')) & ~((tail == ord("\\")) & (at > first[row]))
    quoting = (lead == ord("'")) | (listed & (follow == ord("'")))
    edge_before = (before == -1) | np.isin(prev_byte, list(b",;|[/"))
    edge_after = (after == -2) | np.isin(next_byte, list(b",;|]/"))
    single = (data == ord("'")) & quoting[row] & (edge_before | edge_after)
    base = np.concatenate(([0], np.cumsum(double | single)))
    inside = ((base[1:] - base[first[row]]) & 1).astype(bool) & ~(double | single)
    outside = ~inside

    # delimiters: where they begin and end, and whether they act as a comma
    spans = [(np.flatnonzero(_HARD[data] & outside), 1, False), (np.flatnonzero((data == ord(",")) & outside), 1, True)]
    for text, comma in _WIDE:
        raw = text.encode()
        hit = _find(data, raw)
        hit = hit[outside[hit] & (row[hit] == row[hit + len(raw) - 1])]
        spans.append((hit, len(raw), comma))
    spans.append((head[listed], 1, False))
    closing = np.flatnonzero((data == ord("]")) & (after == -2) & listed[row] & outside)
    spans.append((closing, 1, False))
    begin = np.concatenate([s for s, _, _ in spans])
    finish = np.concatenate([s + size for s, size, _ in spans])
    comma = np.concatenate([np.full(len(s), flag) for s, _, flag in spans])
    # numbering such as "[3] " and "3) ": up to three digits, at the start of a value
    opener = np.flatnonzero((data == ord("[")) & outside)
    starts_number = np.flatnonzero(_DIGIT[data] & outside & ~_DIGIT[tail] & ((before == -1) | np.isin(prev_byte, list(b";,|/\n\r\t")) | _SPACE[tail]))
    for origin, skip, closer in ((opener, 1, ord("]")), (starts_number, 0, ord(")"))):
        open_, live = origin, np.ones(len(origin), bool)
        for digits in range(1, 4):
            here = open_ + skip + digits - 1
            live &= (here < total - 1) & _DIGIT[data[np.minimum(here, total - 1)]]
            stop = np.minimum(here + 1, total - 1)
            done = live & (data[stop] == closer) & (row[stop] == row[open_])
            begin = np.concatenate((begin, open_[done]))
            finish = np.concatenate((finish, stop[done] + 1))
            comma = np.concatenate((comma, np.zeros(done.sum(), bool)))
    order = np.lexsort((finish, begin))
    begin, finish, comma = begin[order], finish[order], comma[order]
    if len(begin):  # of overlapping delimiters the first counts
        reach = np.concatenate(([0], np.maximum.accumulate(finish)[:-1]))
        keep = begin >= reach
        begin, finish, comma = begin[keep], finish[keep], comma[keep]

    # pieces between delimiters; hard: how many delimiters other than commas stand before the piece
    owner = row[begin] if len(begin) else np.zeros(0, np.int64)
    s_row, s_pos = np.concatenate((np.arange(n), owner)), np.concatenate((first, finish))
    e_row, e_pos = np.concatenate((np.arange(n), owner)), np.concatenate((last, begin))
    s_hard = np.concatenate((np.ones(n, np.int64), (~comma).astype(np.int64)))
    rank = np.concatenate((np.zeros(n, np.int8), np.ones(len(owner), np.int8)))
    so = np.lexsort((rank, s_pos, s_row))
    eo = np.lexsort((1 - rank, e_pos, e_row))
    starts, ends, prow, hard = s_pos[so], np.maximum(e_pos[eo], s_pos[so]), s_row[so], np.cumsum(s_hard[so])
    texts = pc.utf8_trim_whitespace(_pieces(data, starts, ends))
    full = np.asarray(pc.not_equal(texts, ""))
    starts, ends, prow, hard, texts = starts[full], ends[full], prow[full], hard[full], texts.filter(pa.array(full))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())

    # "Family, Given" is one value: join pieces that only commas part, pairing from the left of each run
    plain = ~np.asarray(pc.match_substring_regex(texts, f"{_CJK}|^[\"']"))
    family = plain & np.asarray(pc.match_substring_regex(texts, _FAMILY))
    given = plain & np.asarray(pc.match_substring_regex(texts, _GIVEN))
    k = len(starts)
    link = np.zeros(k, bool)
    link[:-1] = (prow[:-1] == prow[1:]) & (hard[:-1] == hard[1:]) & family[:-1] & given[1:]
    seat = np.arange(k)
    run = seat - np.maximum.accumulate(np.where(~link, seat, -1)) - 1
    pair = link & (run % 2 == 0)
    absorbed = np.concatenate(([False], pair[:-1]))
    ends = np.where(pair, np.concatenate((ends[1:], [0])), ends)[~absorbed]
    starts, prow = starts[~absorbed], prow[~absorbed]
    values = pc.utf8_trim_whitespace(_pieces(data, starts, ends))

    # quotes off, escaped and doubled quotes restored
    for mark in ('"', "'"):
        wrapped = pc.and_(pc.and_(pc.starts_with(values, mark), pc.ends_with(values, mark)), pc.greater(pc.utf8_length(values), 1))
        if mark == "'":
            wrapped = pc.and_(wrapped, pa.array(quoting[prow]))
        if pc.any(wrapped).as_py():
            bare = pc.utf8_slice_codeunits(values, 1, -1)
            bare = pc.replace_substring(pc.replace_substring(bare, "\\" + mark, mark), mark * 2, mark)
            bare = pc.replace_substring(bare, "\\\\", "\\")
            values = pc.if_else(wrapped, pc.utf8_trim_whitespace(bare), values)
    values = pc.utf8_trim_whitespace(pc.replace_substring_regex(values, rf"(?:^|,?{_Z}+)(?i:et{_Z}+al)\.?$", ""))
    nothing = pc.is_in(pc.utf8_lower(pc.utf8_normalize(values, "NFKC")), pa.array(MISSING, pa.large_string()))
    keep = ~np.asarray(nothing)
    cell_missing = np.asarray(pc.is_in(pc.utf8_lower(pc.utf8_normalize(pc.utf8_trim_whitespace(cells.cast(pa.large_string()).fill_null("")), "NFKC")), pa.array(MISSING, pa.large_string())))
    keep &= ~cell_missing[prow]
    values, prow = values.filter(pa.array(keep)), prow[keep]

    # child offsets, list array, and flattening with parent ordinals
    child = np.concatenate(([0], np.cumsum(np.bincount(prow, minlength=n)))).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(child), values)
    parents = np.asarray(pc.list_parent_indices(lists))
    position = (np.arange(len(parents)) - child[parents] + 1).astype(np.int32)
    return parents, position, pc.list_flatten(lists)


def explode_packed(df: DataFrame, column: str, key: str = "id", value: str = "value", position: str = "pos") -> DataFrame:
    """One row (``key``, ``position``, ``value``) for each value packed in ``column``.

    Delimiters are ``, ; | / & · 、`` their full-width forms, line breaks, tabs, "and", and numbering; they do not
    count inside quotes. "Family, Given" is one value. Null cells, empty cells and markers for missing give no row,
    as do empty pieces and a closing "et al."; repeated values and repeated rows are kept, each with its own position;
    cells of any length are scanned whole; other columns of ``df`` are not read, so their names cannot clash. An empty
    table gives an empty result.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, pos, values = split_cells(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(parents)), pa.array(pos), values.cast(pa.string())], [key, position, value]
            )

    schema = f"`{key}` {kind.simpleString()}, `{position}` int, `{value}` string"
    return df.select(F.col(key), F.col(column).cast("string").alias("__packed")).mapInArrow(run, schema)
