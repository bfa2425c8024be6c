"""Contact logs as sets of tokens per frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.functions.labels import residue_of, trimmed, undirected_token
from tessellar.operators.relational import band
from tessellar.operators.reshape import range_index
from tessellar.operators.vectors import QUERY_BLOCK
from tessellar.session import materialise, written_to

# Residue names of water.
WATERS = ("HOH", "WAT", "TIP", "TIP3", "SOL", "H2O")
MAX_FEATURES = 20_000
# Pairs of sets: about as many to a task and to a batch of rows, and cells of a block's matrix of tokens and queries.
PAIRS_PER_TASK, OUT_ROWS, MATRIX_CELLS = 10_000_000, 250_000, 32_000_000
QUERIES_PER_FILE = 100_000
# Pairs to a packed row, about, and most tokens of a set of which they can be.
PACKED_PAIRS, PACKED_TOKENS = 4_000, 2**15 - 1
# Most frequent tokens by which sets are put in order.
COMMON = 8


def spelt_log(log: DataFrame) -> DataFrame:
    """Trimmed fields in one spelling, nulls and repeats as they are."""
    return log.select("frame", F.lower(trimmed(F.col("interaction_type"))).alias("itype"), F.upper(trimmed(F.col("atom1"))).alias("atom1"), F.upper(trimmed(F.col("atom2"))).alias("atom2"))


def clean_log(log: DataFrame) -> DataFrame:
    """As spelt_log; rows lacking any field are dropped, repeats are one."""
    return spelt_log(log).na.drop().distinct()


def requested_types(log: DataFrame, types: DataFrame, families: Sequence[str], water_bridges: bool = True) -> DataFrame:
    """Rows whose type belongs to a requested family; bridges over water only if wanted. types: itype, family, needs_water."""
    chosen = types.where(F.col("family").isin(*families))
    if not water_bridges:
        chosen = chosen.where(~F.col("needs_water"))
    return log.join(F.broadcast(chosen.select("itype")), "itype", "left_semi")


def endpoints(log: DataFrame) -> DataFrame:
    """Adds ends: the residue labels of both atoms."""
    return log.withColumn("ends", F.array(residue_of(F.col("atom1")), residue_of(F.col("atom2"))))


def without_water(ends: Column, names: Sequence[str] = WATERS) -> Column:
    return F.filter(ends, lambda e: ~F.coalesce(F.try_element_at(F.split(e, ":"), F.lit(2)), F.lit("")).isin(*names))


def in_scope(ends: Column, selected: Column, scope: str = "selected_any") -> Column:
    """Two endpoints or more, and all or any of them with a residue number in the selected array."""
    inside = F.transform(ends, lambda e: F.array_contains(selected, F.try_element_at(F.split(e, ":"), F.lit(3)).try_cast("int")))
    test = {"all": F.lit(True), "selected_any": F.exists(inside, lambda x: x), "selected_both": F.forall(inside, lambda x: x)}[scope]
    return (F.size(ends) >= 2) & test


def token_rows(log: DataFrame) -> DataFrame:
    """(frame, token) of every row of a log that may hold nulls and repeats; the token is null for contacts inside one residue and rows lacking a field."""
    ends = log.select("frame", "itype", residue_of(F.col("atom1")).alias("a"), residue_of(F.col("atom2")).alias("b"))
    token = F.concat("itype", F.lit("|"), F.least("a", "b"), F.lit("|"), F.greatest("a", "b"))  # null if any part is
    return ends.select("frame", F.when(F.col("frame").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")), token).alias("token"))


def frame_tokens(log: DataFrame) -> DataFrame:
    """(frame, token) without repeats, of a log that may hold nulls and repeats; contacts inside one residue have no token.

    Null tokens are dropped by the aggregate's result: a filter on the token would be pushed below and work it out twice.
    """
    return token_rows(log).groupBy("frame", "token").agg(F.count("token").alias("_c")).where("_c > 0").drop("_c")


def last_with_token(rows: DataFrame) -> int | None:
    """The last frame of (frame, token) rows that has a token.

    The last frame of all is tried first, as only its rows' tokens are worked out then; all rows' are if it has none.
    """
    end = rows.agg(F.max("frame")).first()[0]
    if end is None or rows.where((F.col("frame") == end) & F.col("token").isNotNull()).head(1):
        return end
    return rows.where("token is not null").agg(F.max("frame")).first()[0]


def fingerprints(tokens: DataFrame, unit: str = "frame", token: str = "token") -> DataFrame:
    """One row per unit: the sorted array of its tokens and their number."""
    return tokens.groupBy(unit).agg(F.array_sort(F.collect_set(token)).alias("tokens")).withColumn("size", F.size("tokens"))


def multi_hot(tokens: DataFrame, last_frame: int, columns: Sequence[str], unit: str = "frame", token: str = "token") -> DataFrame:
    """Frames 0..last with a 0/1 entry for each column in order; frames without tokens have zeros."""
    frames = tokens.sparkSession.range(last_frame + 1).select(F.col("id").cast("int").alias(unit))
    held = fingerprints(tokens, unit, token)
    bits = F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.coalesce(F.array_contains(F.col("tokens"), c), F.lit(False)).cast("int"))
    return frames.join(held, unit, "left").select(unit, bits.alias("bits"))


def multi_hot_band(tokens: DataFrame, lo_percent: int, hi_percent: int, unit: str = "frame", token: str = "token", most: int = MAX_FEATURES) -> DataFrame:
    """Frames 0..last with a 0/1 entry for each token that the band keeps, in token order; frames without such tokens have zeros.

    Tokens become indices into the band's dictionary, whose size is checked. The last frame is the last with any token.
    """
    ids = materialise(dictionary(band(tokens, token, unit, lo_percent, hi_percent, unique=True), token), "band")
    n = ids.count()
    if n > most:
        raise ValueError(f"{n} tokens in the band; at most {most} become columns")
    last = tokens.agg(F.max(unit)).first()[0]
    frames = tokens.sparkSession.range(0 if last is None else last + 1).select(F.col("id").cast("int").alias(unit))
    held = tokens.join(F.broadcast(ids), token).groupBy(unit).agg(F.collect_set("id").alias("_ids"))

    def spread(batches):
        for f in batches:
            bits = np.zeros((len(f), n), np.int32)
            sizes = [0 if v is None else len(v) for v in f["_ids"]]
            at = [np.asarray(v, np.int64) for v in f["_ids"] if v is not None]
            bits[np.repeat(np.arange(len(f)), sizes), np.concatenate([*at, np.empty(0, np.int64)])] = 1
            yield pd.DataFrame({unit: f[unit], "bits": list(bits)})

    return frames.join(held, unit, "left").select(unit, "_ids").mapInPandas(spread, f"`{unit}` int, bits array<int>")


def set_distances(tokens: DataFrame, queries: DataFrame, unit: str, token: str, features: int | None = None) -> DataFrame:
    """Distances of a stated query set to every unit that shares a token: n_shared, jaccard, hamming (over ``features``).

    An inverted-index join on the token: only pairs that share something meet. A pair that shares nothing has distance 1
    (jaccard), which needs no row.
    """
    sized = tokens.withColumn("size", F.count("*").over(Window.partitionBy(unit)))
    a = sized.join(queries, unit, "left_semi").select(F.col(unit).alias("a"), token, F.col("size").alias("n_a"))
    b = sized.select(F.col(unit).alias("b"), token, F.col("size").alias("n_b"))
    shared = a.join(b, token).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n_shared"))
    union = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    out = shared.withColumn("jaccard", 1 - F.col("n_shared") / union)
    return out.withColumn("hamming", (union - F.col("n_shared")) / F.lit(features)) if features else out


def all_set_distances(tokens: DataFrame, queries: DataFrame, units: DataFrame, unit: str, token: str, measures: Sequence[str] = ("n_shared", "jaccard", "hamming"), digits: int | None = None, scaled: bool = False) -> DataFrame:
    """Distances of a stated query set to every unit, also to those that share no token or have none: a, b and the measures.

    tokens are (unit, token) rows, in which repeats count once and nulls not at all; hamming is over the distinct tokens,
    counted, and null if there are none. Two units without tokens have jaccard 0. ``scaled`` divides jaccard by its maximum
    over these pairs (all 0 if that is 0), ``digits`` rounds both distances.

    Each unit becomes one row with its tokens' 64-bit hashes; these rows and those of the queries are written once to the
    shared folder. The pairs themselves are neither shuffled nor written: a task reads the queries in blocks and adds up,
    for each of its units, the rows of a block's token matrix that it holds. The maximum is found by a pass of its own
    that keeps one number a task. A token that every unit has costs no more than any other, as no pair is formed for it.
    The task hands on a byte or two a pair (``_packed``); the rows and their distances are made of these in the JVM.

    Units (in each task) and queries are in the order of their numbers of tokens, then of the frequent tokens they hold:
    neighbouring rows then tend to have equal measures, and a file of them takes two thirds of the disk.
    """
    one = F.col(unit).cast("long").alias("id")
    parts = [tokens.select(one, F.when(F.col(token).isNotNull(), F.xxhash64(token)).alias("t"), F.lit(0).alias("as"))]
    parts += [df.select(one, F.lit(None).cast("long").alias("t"), F.lit(kind).alias("as")) for df, kind in ((units, 1), (queries, 2))]
    n_queries = queries.count()
    cut = min(max(2 * tokens.sparkSession.sparkContext.defaultParallelism, units.count() * n_queries // PAIRS_PER_TASK), 10_000)
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("id is not null").repartition(cut, "id")
    every = materialise(rows.groupBy("id").agg(F.collect_set("t").alias("t"), F.max(F.col("as") == 1).alias("known"), F.max(F.col("as") == 2).alias("asked")), "sets")
    held = every.select(F.explode("t").alias("t")).groupBy("t").count()
    common = [r["t"] for r in held.orderBy(F.desc("count"), "t").limit(COMMON).collect()]
    features = held.count() if "hamming" in measures else 0
    holds = sum((F.array_contains("t", x).cast("int") * 2**k for k, x in enumerate(reversed(common))), F.lit(0))

    def ordered(df: DataFrame) -> DataFrame:  # the keys are columns, else each comparison works them out again
        return df.select("id", "t", F.size("t").alias("_n"), holds.alias("_h")).sortWithinPartitions("_n", F.bit_count("_h"), "_h", "id").select("id", "t")

    sets = ordered(every.where("known"))
    asked = ordered(every.where("known and asked").repartition(-(-n_queries // QUERIES_PER_FILE) or 1))
    asked = written_to(materialise(asked, "asked"))
    top = 1.0
    if scaled and "jaccard" in measures:
        top = sets.mapInArrow(_largest_jaccard(asked), "top double").agg(F.max("top")).first()[0] or 0.0
    kind = units.schema[unit].dataType.simpleString()
    most = every.agg(F.max(F.size("t"))).first()[0] or 0
    if most <= PACKED_TOKENS:
        return _unpacked(sets.mapInArrow(_packed(asked, kind, most), _packed_type(kind, most)), measures, features, top, digits)
    kinds = {"n_shared": "long", "jaccard": "double", "hamming": "double"}
    schema = ", ".join([f"a {kind}", f"b {kind}", *(f"{m} {kinds[m]}" for m in measures)])
    return sets.mapInArrow(_distances(asked, kind, tuple(measures), features, top, digits), schema)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of tokens, and all tokens of a batch of (id, t)."""
    t = batch.column("t")
    return batch.column("id").to_numpy(zero_copy_only=False), t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), t.flatten().to_numpy(zero_copy_only=False)


def _query_blocks(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sizes, tokens in order and the matrix (token, query) of at most QUERY_BLOCK queries; fewer if the matrix would be too large."""
    system, root = fs.FileSystem.from_uri(folder)
    for batch in dataset.dataset(root, filesystem=system, format="parquet").to_batches(columns=["id", "t"], batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False):
        waiting = [batch] if batch.num_rows else []
        while waiting:
            part = waiting.pop()
            ids, sizes, tokens = _flat(part)
            if len(ids) > 1 and len(tokens) * len(ids) > MATRIX_CELLS and len(np.unique(tokens)) * len(ids) > MATRIX_CELLS:
                half = len(ids) // 2
                waiting += [part.slice(half), part.slice(0, half)]
                continue
            known, row = np.unique(tokens, return_inverse=True)
            matrix = np.zeros((len(known), len(ids)), np.min_scalar_type(max(int(sizes.max()), 1)))
            matrix[row, np.repeat(np.arange(len(ids)), sizes)] = 1
            yield ids, sizes, known, matrix


def _shared_counts(sizes: np.ndarray, tokens: np.ndarray, known: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of some units, and the shared tokens of each of them (rows) with every query of the block (columns)."""
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        held = known[at] == tokens
    else:
        at, held = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    n = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[held], minlength=len(sizes))
    at, first = at[held], np.cumsum(n) - n
    step = max(1, OUT_ROWS // matrix.shape[1])
    for i in range(0, len(n), step):
        part = i + np.argsort(-n[i : i + step], kind="stable")
        shared = np.zeros((len(part), matrix.shape[1]), matrix.dtype)
        more = np.searchsorted(-n[part], -np.arange(int(n[part[0]])), side="left")  # units with more than k known tokens come first
        for k, m in enumerate(more):
            shared[:m] += matrix[at[first[part[:m]] + k]]
        yield part, shared


def _jaccard(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
    """By the shared tokens and the sum of both sizes."""
    union = total - shared
    return np.where(union > 0, 1 - shared / np.maximum(union, 1), 0.0)


def _round_half_up(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _largest_jaccard(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        top = 0.0
        for batch in batches:
            _, sizes, tokens = _flat(batch)
            for _, asked, known, matrix in _query_blocks(folder) if top < 1 else ():  # there is no larger one
                for part, shared in _shared_counts(sizes, tokens, known, matrix):
                    top = max(top, float(_jaccard(shared.astype(np.int64), sizes[part][:, None] + asked).max()))
                    if top == 1:
                        break
                if top == 1:
                    break
        yield pa.RecordBatch.from_pydict({"top": pa.array([top], pa.float64())})

    return run


def _packed_type(kind: str, most: int) -> T.StructType:
    """Some units b and queries a, their sizes, and the shared tokens of each b with every a, one b after another."""
    ids = {"bigint": T.LongType, "int": T.IntegerType, "smallint": T.ShortType, "tinyint": T.ByteType}[kind]()
    count = T.ByteType() if most < 2**7 else T.ShortType()
    return T.StructType([T.StructField(name, T.ArrayType(of, False), False) for name, of in (("a", ids), ("n_a", count), ("b", ids), ("n_b", count), ("k", count))])


def _packed(folder: str, kind: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """No set may have more than ``most`` tokens."""
    id_type = {"bigint": np.int64, "int": np.int32, "smallint": np.int16, "tinyint": np.int8}[kind]
    count = np.int8 if most < 2**7 else np.int16

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    def run(batches):
        for batch in batches:
            units, sizes, tokens = _flat(batch)
            units, n = units.astype(id_type), sizes.astype(count)
            for ids, asked, known, matrix in _query_blocks(folder):
                ids, asked = ids.astype(id_type), asked.astype(count)
                for part, shared in _shared_counts(sizes, tokens, known, matrix):
                    ends = np.append(np.arange(0, len(part), max(1, PACKED_PAIRS // len(ids))), len(part))
                    rows = len(ends) - 1
                    of_a = np.arange(rows + 1) * len(ids)
                    yield pa.RecordBatch.from_pydict({
                        "a": lists(np.tile(ids, rows), of_a), "n_a": lists(np.tile(asked, rows), of_a), "b": lists(units[part], ends), "n_b": lists(n[part], ends),
                        "k": lists(shared.astype(count).ravel(), ends * len(ids)),
                    })

    return run


def _unpacked(rows: DataFrame, measures: Sequence[str], features: int, top: float, digits: int | None) -> DataFrame:
    """A row for each pair of packed rows. Nothing can be null but hamming without features."""

    # No index is outside and no divisor 0; coalesce says so, else rows and files keep account of nulls.
    def at(column: str, i: Column | str) -> Column:
        return F.coalesce(F.get(column, F.col(i) if isinstance(i, str) else i).cast("int"), F.lit(0))

    def rounded(x: Column) -> Column:
        return F.coalesce(x if digits is None else F.floor(x * 10.0**digits + 0.5) / F.lit(10.0**digits), F.lit(0.0))

    of_unit = rows.select("a", "n_a", "n_b", "k", F.posexplode("b").alias("_i", "b"))
    pair = of_unit.select("n_a", "k", "b", at("n_b", "_i").alias("_n"), (F.col("_i") * F.size("a")).alias("_from"), F.posexplode("a").alias("_j", "a"))
    counted = pair.select("a", "b", at("k", F.col("_from") + F.col("_j")).alias("_k"), (F.col("_n") + at("n_a", "_j")).alias("_total"))
    shared, total = F.col("_k"), F.col("_total")
    union = total - shared
    apart = F.when(union > 0, 1 - shared / F.greatest(union, F.lit(1))).otherwise(F.lit(0.0))
    out = {
        "n_shared": shared.cast("long"),
        "jaccard": rounded(apart / F.lit(float(top))) if top > 0 else F.lit(0.0),
        "hamming": rounded((total - 2 * shared) / F.lit(float(features))) if features else F.lit(None).cast("double"),
    }
    return counted.select("a", "b", *(out[m].alias(m) for m in measures))


def _distances(folder: str, kind: str, measures: Sequence[str], features: int, top: float, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        id_type = {"bigint": np.int64, "int": np.int32, "smallint": np.int16, "tinyint": np.int8}[kind]
        for batch in batches:
            units, sizes, tokens = _flat(batch)
            units = units.astype(id_type)
            for ids, asked, known, matrix in _query_blocks(folder):
                ids = ids.astype(id_type)
                for part, shared in _shared_counts(sizes, tokens, known, matrix):
                    shared, total = shared.astype(np.int64), sizes[part][:, None] + asked
                    out = {"a": np.tile(ids, len(part)), "b": np.repeat(units[part], len(ids))}
                    for m in measures:
                        if m == "n_shared":
                            out[m] = shared.ravel()
                        elif m == "jaccard":
                            out[m] = _round_half_up(_jaccard(shared, total) / top if top > 0 else np.zeros(shared.shape), digits).ravel()
                        else:
                            differ = total - 2 * shared
                            each = _round_half_up(np.arange(int(differ.max()) + 1) / max(features, 1), digits)  # few values, worked out once
                            out[m] = each[differ].ravel()
                    if "hamming" in out and not features:
                        out["hamming"] = pa.nulls(len(out["a"]), pa.float64())
                    yield pa.RecordBatch.from_pydict(out)

    return run


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Dense ids from 0 in the order of the values; the distinct values are cut into ranges, not gathered in one task."""
    return range_index(df.where(F.col(column).isNotNull()).select(column).distinct(), [column], "id").select(column, "id")
