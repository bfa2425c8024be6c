"""Exact frequencies of every distinct term, by heavy-light aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.session import materialise

SHARE = 1 / 512
SAMPLE = 0.02
BLOCK = 32_768  # bits of one bitmap, as the built-in bitmap aggregates have them
HELD = 2_000_000
_COUNTS = "field_name string, term string, unit int, n_rows long, block long, seen binary"
_ARROW = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("unit", pa.int32()), ("n_rows", pa.int64()), ("block", pa.int64()), ("seen", pa.binary())])


def heavy_terms(rows: DataFrame, fields: dict[str, Column], share: float = SHARE, fraction: float = SAMPLE, seed: int = 7) -> dict[str, list[str]]:
    """Terms that a sample shows in at least ``share`` of the rows: at most 1/share a field, which bounds the broadcast.

    The sample only decides which way a term is counted; either way counts all rows, so a miss costs time, not truth.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), c.alias("term")) for f, c in fields.items()])).alias("p")
    sample = rows.sample(fraction, seed).select(pairs)
    by_term = sample.groupBy("p").count()
    # both sides read one exchange of the sample's counts; a filter on the term would part them, so nulls go last
    total = by_term.agg(F.sum(F.when(F.col("p.field_name") == next(iter(fields)), F.col("count"))).alias("total"))
    counted = by_term.crossJoin(F.broadcast(total))
    limit = int(1 / share)
    found: dict[str, list[str]] = {f: [] for f in fields}
    best = counted.where(F.col("count") >= F.greatest(F.lit(2.0), share * F.col("total"))).orderBy(F.desc("count"), "p").limit((limit + 1) * len(fields))
    for r in best.collect():
        if r["p"]["term"] is not None and len(found[r["p"]["field_name"]]) < limit:
            found[r["p"]["field_name"]].append(r["p"]["term"])
    return found


class _Counters:
    """Row counters and the units seen, for the heavy terms of one field in one task."""

    def __init__(self, terms: list[str]):
        self.terms, self.index = terms, pa.array(terms, pa.string())
        self.rows = np.zeros(len(terms), np.int64)
        self.keys: list[np.ndarray] = []
        self.held, self.limit = 0, HELD

    def add(self, values: pa.Array, units: np.ndarray) -> np.ndarray:
        """Count the heavy ones; returns the mask of the rest."""
        at = pc.fill_null(pc.index_in(values, value_set=self.index), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = at >= 0
        self.rows += np.bincount(at[hit], minlength=len(self.terms))
        self.keys.append(np.unique((at[hit] << 40) | (units[hit] - np.iinfo(np.int32).min)))
        self.held += len(self.keys[-1])
        if self.held > self.limit:  # the limit doubles with what is left, so each key is sorted a few times at most
            self.keys = [np.unique(np.concatenate(self.keys))]
            self.held = len(self.keys[0])
            self.limit = max(HELD, 2 * self.held)
        return ~hit

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(term, block, bitmap of the units seen in the block)."""
        if not self.keys:
            return
        keys = np.unique(np.concatenate(self.keys))
        if not len(keys):
            return
        high, starts = np.unique(keys // BLOCK, return_index=True)
        low = keys % BLOCK
        for h, a, b in zip(high.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            bits = np.zeros(BLOCK, bool)
            bits[low[a:b]] = True
            yield h // ((1 << 40) // BLOCK), h % ((1 << 40) // BLOCK), np.packbits(bits).tobytes()


def term_frequencies(rows: DataFrame, fields: dict[str, Column] | Sequence[str], unit: str, share: float = SHARE, fraction: float = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Of every distinct term of every field: the rows and the distinct units (an int column) that hold it; and the number of
    distinct units of the whole table, as a row n_units.

    ``fields`` are columns, or names with the expressions to count. One pass over the rows does both: heavy terms (broadcast,
    at most 1/share a field) are counted in exact arrays inside each task, one counter a term and one bitmap for each 32,768
    units in which the task meets it, and the remaining terms are handed on as they are. Both are written once to the
    shared folder, a fraction of the input. Of the heavy terms only those partial counts are shuffled; the others go
    through an ordinary two-stage aggregation by (term, unit), of which no key is hot. The tables are then united. Null
    terms, empty terms and rows without a unit are left out. Nothing is sampled but the choice of the way.
    Result: field_name, term, n_rows, n_units.
    """
    given_fields = fields if isinstance(fields, dict) else {f: F.col(f) for f in fields}
    columns = {f: F.nullif(c, F.lit("")) for f, c in given_fields.items()}
    present = rows.where(F.col(unit).isNotNull())
    shared = rows.sparkSession.sparkContext.broadcast(heavy_terms(present, columns, share, fraction))
    given = present.select(F.col(unit).cast("int").alias("_unit"), *[c.alias(f"_{k}") for k, c in enumerate(columns.values())])
    names = list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {f: _Counters(shared.value[f]) for f in names}
        every = _Counters([""])
        for batch in batches:
            units = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            every.add(pa.array(np.full(len(units), "")), units)
            for k, f in enumerate(names):
                values = batch.column(k + 1).cast(pa.string())
                rest = pa.array(counters[f].add(values, units) & ~values.is_null().to_numpy(zero_copy_only=False))
                light = values.filter(rest)
                if n := len(light):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f]).take(pa.array(np.zeros(n, np.int32))), light, batch.column(0).filter(rest), pa.array(np.ones(n, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_ARROW
                    )
        out: list[tuple] = []
        for f, c in [*counters.items(), (None, every)]:
            out += [(f, t, None, int(n), None, None) for t, n in zip(c.terms, c.rows, strict=True) if n]
            for t, block, bits in c.blocks():
                out.append((f, c.terms[t], None, 0, block, bits))
                if len(out) >= 20_000:
                    yield _as_batch(out)
                    out = []
        if out:
            yield _as_batch(out)

    partial = materialise(given.mapInArrow(count, _COUNTS), "terms")
    by_block = partial.where("unit is null").groupBy("field_name", "term", "block").agg(F.sum("n_rows").alias("n_rows"), F.expr("bitmap_or_agg(seen)").alias("b"))
    counted = by_block.select("field_name", "term", "n_rows", F.coalesce(F.expr("bitmap_count(b)"), F.lit(0)).alias("n"))
    heavy = counted.groupBy("field_name", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n_units"))
    pairs = partial.where("unit is not null").groupBy("field_name", "term", "unit").agg(F.sum("n_rows").alias("c"))
    light = pairs.groupBy("field_name", "term").agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_units"))
    total = counted.where("field_name is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_units"))
    return heavy.where("field_name is not null").unionByName(light), total


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def marked(frequencies: DataFrame, total: DataFrame, rare: int = 1, common: int = 95) -> DataFrame:
    """Adds mark: ``rare`` under max(1, ceil(rare % of all units)) units, ``common`` over floor(common % of all units), else null.

    total: one row, n_units. The shares are whole percents, so the limits are computed in integers.
    """
    limits = total.select(F.expr(f"greatest(1, (n_units * {rare} + 99) div 100)").alias("_low"), F.expr(f"n_units * {common} div 100").alias("_high"))
    mark = F.when(F.col("n_units") < F.col("_low"), "rare").when(F.col("n_units") > F.col("_high"), "common")
    return frequencies.crossJoin(F.broadcast(limits)).withColumn("mark", mark).drop("_low", "_high")
