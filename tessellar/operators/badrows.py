"""Delimited lines into typed rows, the failing ones set apart with the reason."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

MAX_INT = 2147483647
SCHEMA = "line_id long, frame int, interaction_type string, atom1 string, atom2 string, reason string"
NAMES = ["frame", "interaction_type", "atom1", "atom2"]
_ARROW = pa.schema([("line_id", pa.int64()), ("frame", pa.int32()), *((n, pa.string()) for n in [*NAMES[1:], "reason"])])
_QUOTING = r'^(?:\s*"(?:[^"]|"")*"\s*|[^"\t]*)(?:\t(?:\s*"(?:[^"]|"")*"\s*|[^"\t]*))*$'
_ATOM = re.compile(r"[^:\s]+:[^:\s]+:-?[0-9]+:[^:\s]+")
_QUOTED = re.compile(r'[^\S\t]*"((?:[^"]|"")*)"[^\S\t]*')


class BlockFails(ValueError):
    """The fast path can't vouch for every record of the block."""


def split_fields(line: str) -> list[str] | None:
    """Fields of one line by the strict rule, white space around values removed; None for a misplaced quote."""
    fields, i = [], 0
    while True:
        m = _QUOTED.match(line, i)
        if m:
            fields.append(m[1].replace('""', '"').strip())
            end = m.end()
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            if '"' in line[i:end]:
                return None
            fields.append(line[i:end].strip())
        if end == len(line):
            return fields
        if line[end] != "\t":
            return None
        i = end + 1


def diagnose(line: str, known: frozenset[str]) -> tuple[int | None, str | None, str | None, str | None, str | None]:
    """(frame, type, atom1, atom2, None) of a sound line, else Nones and the first reason that applies."""
    fields = split_fields(line)
    reason = None
    if fields is None:
        reason = "quoting"
    elif len(fields) != 4:
        reason = "column_count"
    else:
        frame, kind, a, b = fields
        digits = frame.lstrip("0")
        if not (frame and frame.isascii() and frame.isdigit() and len(digits) <= 10 and int(digits or 0) <= MAX_INT):
            reason = "frame"
        elif kind.lower() not in known:
            reason = "interaction_type"
        elif not _ATOM.fullmatch(a):
            reason = "atom1"
        elif not _ATOM.fullmatch(b):
            reason = "atom2"
        else:
            return int(frame), kind.lower(), a, b, None
    return None, None, None, None, reason


def bulk_parse(lines: pa.Array, known: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """All four typed columns of a block in one columnar pass, and which records they hold good for.

    BlockFails if the block can't be cut into records and fields beyond doubt. A record that is cut well but has a value
    that isn't good, or isn't ASCII, is only marked.
    """
    quoted = pc.match_substring(lines, '"')
    if pc.any(quoted).as_py() and not pc.all(pc.match_substring_regex(lines.filter(quoted), _QUOTING)).as_py():
        raise BlockFails
    data = "\n".join(lines.to_pylist()).encode()
    try:
        table = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=NAMES, use_threads=False, block_size=max(len(data) + 1, 64)),
            parse_options=pacsv.ParseOptions(delimiter="\t", ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(NAMES, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid as e:
        raise BlockFails from e
    if table.num_rows != len(lines):
        raise BlockFails
    frame, kind, a, b = (pc.utf8_trim_whitespace(c.combine_chunks()) for c in table.columns)
    kind, digits = pc.utf8_lower(kind), pc.utf8_ltrim(frame, "0")
    good = pc.and_(pc.match_substring_regex(frame, "^[0-9]+$"), pc.less_equal(pc.utf8_length(digits), 10))
    good = pc.and_(pc.and_(good, pc.string_is_ascii(lines)), pc.is_in(kind, value_set=known))
    for label in (a, b):
        good = pc.and_(good, pc.match_substring_regex(label, r"^[^:\s]+:[^:\s]+:-?[0-9]+:[^:\s]+$"))
    number = pc.if_else(pc.and_(good, pc.not_equal(digits, "")), digits, "0").cast(pa.int64())
    fits = pc.less_equal(number, MAX_INT)
    return [pc.if_else(fits, number, 0).cast(pa.int32()), kind, a, b], pc.and_(good, fits)


def doubtful(lines: pa.Array) -> np.ndarray:
    """Records that can't be cut by tabs alone, in one columnar pass: another number of tabs, a quote, a break inside."""
    cut = pc.equal(pc.count_substring(lines, "\t"), len(NAMES) - 1)
    for mark in '"\r\n':
        cut = pc.and_(cut, pc.invert(pc.match_substring(lines, mark)))
    return pc.invert(cut).to_numpy(zero_copy_only=False)


def isolated(doubt: np.ndarray, leaf: int) -> np.ndarray:
    """The block is halved as long as a part holds a doubtful record, down to ``leaf`` records: a mask of these. Whether a
    part holds one is a difference of running counts, so no part is parsed to find out."""
    before = np.concatenate([[0], np.cumsum(doubt)])
    mask, stack = np.zeros(len(doubt), bool), [(0, len(doubt))]
    while stack:
        start, n = stack.pop()
        if before[start + n] == before[start]:
            continue
        if n <= leaf:
            mask[start : start + n] = True
        else:
            half = n // 2
            stack += [(start, half), (start + half, n - half)]
    return mask


def _strict(ids: pa.Array, lines: pa.Array, known: frozenset[str]) -> pa.RecordBatch:
    found = list(zip(*(diagnose(x, known) for x in lines.to_pylist()), strict=True))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t.type) for c, t in zip(found, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def parse_block(ids: pa.Array, lines: pa.Array, known: frozenset[str], known_array: pa.Array, leaf: int = 1) -> Iterator[pa.RecordBatch]:
    """Bulk-parse what is left of the block when its doubtful records are isolated by halving; these are diagnosed strictly,
    as are the records whose values the bulk parse marks. A part that the bulk parse refuses all the same is halved in
    its turn."""
    mask = isolated(doubtful(lines), leaf)
    if mask.any():
        apart = pa.array(mask)
        yield _strict(ids.filter(apart), lines.filter(apart), known)
        apart = pa.array(~mask)
        ids, lines = ids.filter(apart), lines.filter(apart)
    stack = [(0, len(lines))]
    while stack:
        start, n = stack.pop()
        part, own = lines.slice(start, n), ids.slice(start, n)
        if n > leaf:
            try:
                columns, good = bulk_parse(part, known_array)
            except BlockFails:
                half = n // 2
                stack += [(start + half, n - half), (start, half)]
                continue
            whole = pa.RecordBatch.from_arrays([own, *columns, pa.nulls(n, pa.string())], schema=_ARROW)
            if pc.all(good).as_py():
                yield whole
            else:
                yield whole.filter(good)
                rest = pc.invert(good)
                yield _strict(own.filter(rest), part.filter(rest), known)
        elif n:
            yield _strict(own, part, known)


def load_lines(lines: DataFrame, known_types: list[str], id_col: str = "line_id", line_col: str = "line", block: int = 4096, leaf: int = 1) -> DataFrame:
    """Every record line as a typed row (reason null) or with its reason (the other columns null).

    Blank lines, null lines and lines whose first non-blank character is ``#`` are no records and give no row; repeated
    lines each give theirs. Columns other than the two named are ignored. One narrow pass without a shuffle; a block is
    ``block`` lines, however the file is split, so memory doesn't depend on the data's size.
    """
    known = frozenset(t.strip().lower() for t in known_types if t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_array = pa.array(sorted(known), pa.string())
        for batch in batches:
            text = batch.column(1).cast(pa.string())
            start = pc.utf8_ltrim_whitespace(text)
            record = pc.fill_null(pc.and_(pc.not_equal(start, ""), pc.invert(pc.starts_with(start, "#"))), False)
            kept = batch.filter(record)
            out = []
            for i in range(0, kept.num_rows, block):
                part = kept.slice(i, block)
                out += parse_block(part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), known, known_array, leaf)
            yield from pa.Table.from_batches(out, _ARROW).combine_chunks().to_batches() if out else []

    return lines.select(id_col, line_col).mapInArrow(run, SCHEMA)


def sound_rows(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is null").drop("reason")


def failing_rows(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is not null").select("line_id", "reason")
