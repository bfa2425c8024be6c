"""Items of varying length into containers of fixed capacities."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_A_BUCKET = 500_000


def token_counts(documents: DataFrame, id_col: str, text_col: str, vocabulary: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """id and n_tokens of the whole text; a null or empty text has 0 tokens. ``vocabulary`` is read by the driver and broadcast
    (about a megabyte)."""
    with open(vocabulary, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.value.splitlines())}
        encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


@dataclass
class Bins:
    """``times`` equal containers: opened at ``capacity``, holding ``content`` (size -> how many)."""

    capacity: int
    times: int
    content: dict[int, int] = field(default_factory=dict)

    @property
    def load(self) -> int:
        return sum(s * n for s, n in self.content.items())


def _fill(left: Counter, sizes: list[int], first: int, capacity: int) -> int:
    """What a container opened for ``first`` would hold if the largest items that fit were put in one after another."""
    room, used = capacity - first, {first: 1}
    at = bisect_left(sizes, room + 1) - 1
    while at >= 0 and room > 0:
        s = sizes[at]
        n = min(room // s, left[s] - used.get(s, 0)) if s else 0
        if n > 0:
            room -= n * s
        at = min(at - 1, bisect_left(sizes, room + 1) - 1)
    return capacity - room


def best_fit(histogram: dict[int, int], capacities: Sequence[int]) -> list[Bins]:
    """Variable-capacity best fit, decreasing, over counts of equal sizes.

    Items are taken from the largest size down; each goes where it leaves the least room. If none has room, the bin size
    is opened whose cost (capacity per unit that the remaining items would fill) is least, the larger one on a tie. At the
    end each bin shrinks to the smallest capacity that holds its contents. Equal bins stay one record with a
    multiplicity, so the work follows the number of distinct sizes, not of items. Every size must fit the largest capacity.
    """
    capacities = sorted(capacities)
    left = Counter({s: n for s, n in histogram.items() if s > 0 and n > 0})
    if left and max(left) > capacities[-1]:
        raise ValueError("an item exceeds the largest capacity")
    open_at: dict[int, list[Bins]] = {}
    rooms: list[int] = []
    done: list[Bins] = []

    def put(bins: Bins, room: int) -> None:
        if room == 0:
            done.append(bins)
        else:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append(bins)

    ascending = sorted(left)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                bins = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
                fresh = None
            else:
                left[s] = n
                costs = [(c / _fill(left, ascending, s, c), -c) for c in capacities if c >= s]
                room = -min(costs)[1]
                fresh = bins = Bins(room, n)
            each = min(room // s, n)
            used = min(bins.times, n // each)
            if fresh is None and used < bins.times:
                put(Bins(bins.capacity, bins.times - used, dict(bins.content)), room)
            put(Bins(bins.capacity, used, bins.content | {s: bins.content.get(s, 0) + each}), room - each * s)
            n -= used * each
        left[s] = 0
        ascending.pop()
    result = done + [b for group in open_at.values() for b in group]
    for b in result:
        b.capacity = capacities[bisect_left(capacities, b.load)]
    return result


def _slots(plan: list[Bins]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], int]:
    """Of each size: rank starts, first containers, items a container and capacities; and the number of containers."""
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    container = 0
    for b in plan:
        for s, n in b.content.items():
            parts.setdefault(s, []).append((ranks[s], container, n, b.capacity))
            ranks[s] += n * b.times
        container += b.times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in parts.items()}, container


def _piece(k: int, top: int) -> Callable[[Column], Column]:
    return lambda p: F.struct(F.lit(k).alias("k"), p.alias("p"), F.least(F.lit(top).cast("long"), F.col("z") - p * top).alias("z"))


def pack(sizes: DataFrame, schemes: dict[str, Sequence[int]], id_col: str = "doc_id", size_col: str = "n_tokens", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Every item into a container, once for each scheme (a name and the capacities permitted in it).

    Result: scheme, id, piece_no, piece_tokens, container_id, capacity. An item that exceeds the scheme's largest
    capacity is split: whole pieces of that capacity, then the rest; any other item is one piece. An item of size 0 or
    null is put into the scheme's container 0 and takes no room. Ids may repeat; null ids are kept as they are.

    The plan is made on the histogram of sizes, which has at most one entry for each size up to the largest capacity,
    however many items there are; the pieces then find their containers by their rank among those of equal size. Of a size
    that more than ROWS_A_BUCKET pieces share, ranks are counted in as many buckets of a hash as keep a bucket to that
    number, so that a size which a third of the items share is still spread.
    """
    columns, number = [], list(schemes)
    for k, name in enumerate(number):
        top = max(schemes[name])
        pieces = F.greatest(F.lit(1), F.ceil(F.col("z") / top).cast("int"))
        columns.append(F.transform(F.sequence(F.lit(0), pieces - 1), _piece(k, top)))
    items = sizes.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("z"))
    exploded = items.select("id", F.explode(F.concat(*columns)).alias("i")).select("id", F.col("i.k").alias("k"), F.col("i.p").alias("p"), F.col("i.z").alias("z"))
    counted = exploded.groupBy("k", "z").agg(F.count("*").alias("n")).collect()  # at most one row a scheme and size
    spread = [(r["k"], r["z"], -(-r["n"] // rows_a_bucket)) for r in counted if r["n"] > rows_a_bucket]
    if spread:
        split = F.broadcast(sizes.sparkSession.createDataFrame(spread, "k int, z long, nb int"))
        pieces = exploded.join(split, ["k", "z"], "left").withColumn("b", F.pmod(F.xxhash64("id", "p"), F.coalesce("nb", F.lit(1))).cast("int")).drop("nb")
    else:
        pieces = exploded.withColumn("b", F.lit(0))
    by_bucket = pieces.groupBy("k", "z", "b").agg(F.count("*").alias("n"))
    slots: dict[int, dict] = {}
    floors: dict[int, int] = {}  # capacity of container 0
    for k, name in enumerate(number):
        plan = best_fit({r["z"]: r["n"] for r in counted if r["k"] == k}, schemes[name])
        slots[k] = _slots(plan)[0]
        floors[k] = plan[0].capacity if plan else min(schemes[name])
    shared = sizes.sparkSession.sparkContext.broadcast(slots)
    before = F.sum("n").over(Window.partitionBy("k", "z").orderBy("b")) - F.col("n")
    offsets = by_bucket.select("k", "z", "b", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("k", "z", "b").orderBy("id", "p")) - 1
    ranked = pieces.withColumn("r", rank)
    if spread:
        ranked = ranked.join(offsets, ["k", "z", "b"]).withColumn("r", F.col("r") + F.col("before"))
    ranked = ranked.select("k", "id", "p", "z", "r")

    floor_of = np.array([floors[k] for k in range(len(number))], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, z, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3, 4))
            container, capacity = np.zeros(len(k), np.int64), floor_of[k]
            order = np.lexsort((z, k))
            cuts = np.flatnonzero(np.diff(k[order]) | np.diff(z[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                found = shared.value[int(k[part[0]])].get(int(z[part[0]]))
                if found is not None:
                    starts, first, each, caps = found
                    at = np.searchsorted(starts, r[part], "right") - 1
                    container[part] = first[at] + (r[part] - starts[at]) // each[at]
                    capacity[part] = caps[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(number, object)[k], pa.string()), batch.column(1), batch.column(2), batch.column(3), pa.array(container), pa.array(capacity)],
                names=["scheme", id_col, "piece_no", "piece_tokens", "container_id", "capacity"],
            )

    kind = sizes.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"scheme string, `{id_col}` {kind}, piece_no int, piece_tokens long, container_id long, capacity long")


def pack_documents(documents: DataFrame, schemes: dict[str, Sequence[int]], id_col: str = "doc_id", text_col: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """Token counts, written once to the shared folder, then packed."""
    return pack(materialise(token_counts(documents, id_col, text_col, vocabulary), "tokens"), schemes)
