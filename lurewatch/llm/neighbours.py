"""Nearest neighbours by cross-polytope hashing with several probes and exact reranking.

Vectors are scaled to unit length, turned by fast pseudo-rotations (three rounds of random signs
and a Hadamard transform) and assigned to the nearest signed axis; that is their bucket in a
table.  A query looks into the buckets of its nearest axes in every table and ranks what it finds
there by the inner product of the original vectors in double precision.

Vectors whose length differs are put into bands of similar length; within a band they get one
coordinate more, which makes the order by angle that of the inner product.  Every band is a small
index of its own and asked by every query.

The numbers of hashes and probes are chosen on the data: at most ``SAMPLE`` queries, drawn by hash,
are answered exactly in one pass over the index, and of all numbers of hashes the one is taken that
finds a share of ``TARGET`` of these answers with the least work.  A band of
at most ``BLOCK`` vectors, which is one block of work in any case, is a single bucket.  A query
whose buckets hold fewer than ``k`` vectors, since it points away from all of them for instance,
looks into all buckets instead.

Of identical vectors only the smallest ``k + 1`` ids can be in any result (ties go to smaller
ids); the others are left out of the index, and queries with identical vectors are searched once.
The buckets of a table are dealt to cells, and a cell is searched by a task bucket by bucket: a query
goes there once, with the buckets it looks into, and brings back its best of the whole cell.  Cells that
hold more vectors or queries than others are searched in blocks, on either side, so neither a popular
bucket nor a popular query fills a task; what a task has in hand at once is bounded as well.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id.  Repeated rows count once; an id with several vectors is a candidate with its best
one.  Vectors of another dimension than the query's never meet it.  With fewer candidates than
``k`` all are returned.  Lengths are kept as logarithms, so that none over- or underflows; scores
are plain double precision and may.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.session import stage

TABLES = 4
TARGET = 0.97
BLOCK = 1024
# Queries that are answered exactly to choose the number of probes; no result depends on it alone.
SAMPLE = 96
# Buckets are not made smaller than this; what a probe costs, counted in inner products.
SMALL_BUCKET, PROBE_WORK = 16, 20
RANKED_BUCKETS = 1 << 14
# Cells of buckets that a table of a band is dealt to, more when a cell would hold over the largest number
# of vectors; and scores, costs or buckets that a task has in hand at once.
CELLS, LARGEST_CELL = 12, 1 << 15
AT_ONCE = 1 << 19
# A cell with a little more than its share is no reason for a second block.
FULL = 0.8
SEED = 7
# Scores this close (in relation to the lengths) are kept together until the exact ranking.
SLACK = 1e-9


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    width, out, half = rows.shape[1], rows, 1
    while half < width:
        pairs = out.reshape(len(rows), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), width)
        half *= 2
    return out / np.sqrt(width)


def rotated(rows: np.ndarray, table: int, hash_number: int) -> np.ndarray:
    width = 1 << max(1, (rows.shape[1] - 1).bit_length())
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    signs = np.random.default_rng([SEED, table, hash_number, width]).choice([-1.0, 1.0], (3, width))
    for sign in signs:
        out = hadamard(out * sign)
    return out


def _signed(rows: np.ndarray) -> np.ndarray:
    """Nearness to each signed axis: the positive axes, then the negative ones."""
    return np.concatenate([rows, -rows], 1)


def buckets(unit: np.ndarray, table: int, hashes: int) -> np.ndarray:
    out = np.zeros(len(unit), np.int64)
    for number in range(hashes):
        near = _signed(rotated(unit, table, number))
        out = out * near.shape[1] + near.argmax(1)
    return out


def probes(unit: np.ndarray, table: int, hashes: int, count: int) -> np.ndarray:
    """The ``count`` most promising buckets of each row: least squared distance to their axes."""
    codes, cost = (None, None) if hashes else (np.zeros((len(unit), 1), np.int64), None)
    for number in range(hashes):
        near = _signed(rotated(unit, table, number))
        gap = (near.max(1, keepdims=True) - near) ** 2
        keep = min(count, gap.shape[1])
        best = np.argpartition(gap, keep - 1, 1)[:, :keep]
        gap = np.take_along_axis(gap, best, 1)
        if codes is None:
            codes, cost = best.astype(np.int64), gap
            continue
        all_codes = (codes[:, :, None] * near.shape[1] + best[:, None, :]).reshape(len(unit), -1)
        all_cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(unit), -1)
        keep = min(count, all_cost.shape[1])
        best = np.argpartition(all_cost, keep - 1, 1)[:, :keep]
        codes, cost = np.take_along_axis(all_codes, best, 1), np.take_along_axis(all_cost, best, 1)
    return codes


def plan(
    n: int, queries: np.ndarray, near: np.ndarray, owner: np.ndarray, tables: int = TABLES, target: float = TARGET
) -> tuple[int, int]:
    """Hashes per table and probes per table for a band of ``n`` vectors; no hash is one bucket.

    ``queries`` and ``near`` are unit vectors, ``owner`` the query that each of ``near`` belongs to.
    Of all numbers of hashes the one with the least work is taken; the number of probes is the
    smallest with which a share of ``target`` of ``near`` is found in any table.
    """
    if n <= BLOCK:
        return 0, 1
    axes = 2 << max(1, (queries.shape[1] - 1).bit_length())
    best, hashes = (np.inf, 1, 1), 0
    while not hashes or n / axes**hashes > SMALL_BUCKET:
        hashes += 1
        needed = 1
        if len(near):
            ranks = [_ranks(queries, near, owner, table, hashes) for table in range(tables)]
            needed = int(np.quantile(np.min(ranks, 0), target, method="higher")) + 1
        work = needed * (n / axes**hashes + PROBE_WORK)
        best = min(best, (work, hashes, min(needed, axes**hashes)))
    return best[1:]


def _ranks(queries: np.ndarray, near: np.ndarray, owner: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """How many buckets a query looks into before that of the vector near to it."""
    gaps, chosen = [], np.zeros(len(near))
    for number in range(hashes):
        signed = _signed(rotated(queries, table, number))
        gaps.append((signed.max(1, keepdims=True) - signed) ** 2)
        chosen += gaps[-1][owner, _signed(rotated(near, table, number)).argmax(1)]
    axes = gaps[0].shape[1]
    total = axes**hashes
    if total <= RANKED_BUCKETS:
        costs = gaps[0]
        for gap in gaps[1:]:
            costs = (costs[:, :, None] + gap[:, None, :]).reshape(len(queries), -1)
    else:  # a sample of the buckets tells the rank well enough
        draws = np.random.default_rng(SEED).integers(0, axes, (hashes, RANKED_BUCKETS))
        costs = sum(gap[:, draw] for gap, draw in zip(gaps, draws, strict=True))
    costs = np.sort(costs, 1)
    below = np.array([np.searchsorted(costs[q], c) for q, c in zip(owner, chosen, strict=True)])
    return np.ceil(below * (total / costs.shape[1])).astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector, length, dimension, same`` of the rows that take part; ``length`` is the
    binary logarithm of the length, identical vectors have equal ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows, norms, same, kept = [], [], [], []
            for row, values in enumerate(batch.column("vector").to_pylist()):
                if not values or None in values:
                    continue
                vector = np.array(values, np.float64) + 0.0  # no negative zeros
                if np.isfinite(vector).all() and vector.any():
                    rows.append(row)
                    norms.append(float(log_lengths(vector[None])[0]))
                    same.append(xxhash.xxh3_128_hexdigest(vector.tobytes()))
                    kept.append(vector)
            arrays = [
                batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(kept, pa.list_(pa.float64())),
                pa.array(norms, pa.float64()), pa.array([len(v) for v in kept], pa.int32()), pa.array(same, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vector", "length", "dimension", "same"])

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(
        "vec_id is not null and vector is not null"
    )
    kind = dict(vectors.dtypes)[id_col]
    return rows.mapInArrow(run, f"vec_id {kind}, vector array<double>, length double, dimension int, same string")


def _band():
    """Half powers of two of the length, with lengths near 1 in the middle of theirs."""
    return F.floor(2 * F.col("length") + 0.5).cast("int")


def log_lengths(values: np.ndarray) -> np.ndarray:
    """Binary logarithms of the lengths of rows that are not all zero."""
    largest = np.abs(values).max(1, keepdims=True)
    return np.log2(largest[:, 0]) + 0.5 * np.log2(((values / largest) ** 2).sum(1))


def scaled(values: np.ndarray, length: np.ndarray | float) -> np.ndarray:
    """Rows divided by two to the power of ``length``, in two steps that stay in range."""
    largest = np.abs(values).max(1, keepdims=True)
    return values / largest * np.exp2(np.log2(largest) - np.reshape(length, (-1, 1)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _lifted(values: np.ndarray, longest: float | None, lifted: bool) -> np.ndarray:
    """Unit vectors: queries (without ``longest``) by their own length, others by the longest one
    of their band, with a coordinate more that makes up for what is missing."""
    if not len(values):
        return np.zeros((0, values.shape[1] + lifted))
    unit = scaled(values, log_lengths(values) if longest is None else longest)
    if not lifted:
        return unit
    more = np.zeros((len(unit), 1)) if longest is None else np.sqrt(np.maximum(0, 1 - (unit**2).sum(1, keepdims=True)))
    return np.concatenate([unit, more], 1)


def _keyed(rows: DataFrame, bands: dict, tables: int, side: str, id_col: str, id_type: str) -> DataFrame:
    """A row for every band of an index vector, or a query, with its buckets listed by table and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dimensions = batch.column("dimension").to_numpy()
            own = batch.column("band").to_numpy() if side == "index" else None
            for (dimension, band), (longest, lifted, hashes, count, n) in bands.items():
                mask = dimensions == dimension
                if own is not None:
                    mask &= own == band
                if not mask.any():
                    continue
                part = batch.filter(pa.array(mask))
                axes = 2 << max(1, (dimension + lifted - 1).bit_length())
                # What a row takes: its buckets, and all that are weighed to choose them.
                least = 1 if side == "index" or not hashes else min(count, axes ** (hashes - 1)) * axes
                step = max(1, AT_ONCE // (least + tables * count + axes))
                for start in range(0, part.num_rows, step):
                    some = part.slice(start, step)
                    unit = _lifted(_matrix(some.column("vector")), longest if side == "index" else None, lifted)
                    if side == "index":
                        found = [buckets(unit, table, hashes)[:, None] for table in range(tables if hashes else 1)]
                    else:
                        found = [probes(unit, table, hashes, count) for table in range(tables if hashes else 1)]
                    arrays = [
                        pa.array(np.full(len(unit), dimension), pa.int32()), pa.array(np.full(len(unit), band), pa.int32()),
                        pa.array(np.full(len(unit), _room(n)), pa.int32()), some.column(id_col), some.column("vector"),
                        _by_cell(np.stack(found, 1), -(-n // _room(n))),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["dimension", "band", "room", id_col, "vector", "looks"])

    looks = "array<struct<tbl int, cell int, codes array<long>>>"
    return rows.mapInArrow(run, f"dimension int, band int, room int, {id_col} {id_type}, vector array<double>, looks {looks}")


def _room(n: int) -> int:
    """Vectors, and queries, that a task compares in a band of ``n`` vectors."""
    return min(max(BLOCK, -(-n // CELLS)), LARGEST_CELL)


def _by_cell(codes: np.ndarray, cells: int) -> pa.ListArray:
    """Buckets by row, table and place as a list a row, of tables and cells with their buckets."""
    rows, tables, count = codes.shape
    cell = codes % cells
    key = ((np.arange(rows)[:, None, None] * tables + np.arange(tables)[:, None]) * cells + cell).ravel()
    order = np.argsort(key, kind="stable")
    key, flat = key[order], codes.ravel()[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    row, rest = np.divmod(key[starts], tables * cells)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.int64()))
    looks = pa.StructArray.from_arrays(
        [pa.array(rest // cells, pa.int32()), pa.array(rest % cells, pa.int32()), lists], ["tbl", "cell", "codes"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), looks)


def _nearest_first() -> list:
    return [F.desc("score"), F.asc("vec_id")]


def _scan(index: DataFrame, asking: DataFrame, bands: dict, tables: int, k: int) -> DataFrame:
    """``same, vec_id, score`` of what every query finds in its buckets, the best of each block."""
    id_type = dict(index.dtypes)["vec_id"]
    stored = stage(_keyed(index, bands, tables, "index", "vec_id", id_type), "buckets")
    looks = stage(_keyed(asking, bands, tables, "query", "same", "string"), "probes")

    key = ["dimension", "band", "tbl", "cell"]
    in_cells = lambda df, *c: df.select("dimension", "band", *c, F.explode("looks").alias("at")).select(
        "dimension", "band", "at.tbl", "at.cell", *c, "at.codes"
    )
    sizes = in_cells(stored, "room").groupBy(key).agg(F.ceil(FULL * F.count("*") / F.first("room")).alias("v_blocks")).join(
        in_cells(looks, "room").groupBy(key).agg(
            F.ceil(F.greatest(FULL * F.count("*") / F.first("room"), F.sum(F.size("codes")) / AT_ONCE)).alias("q_blocks")
        ), key
    )
    parts = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    own_part = lambda c, n: F.array(F.pmod(F.xxhash64(c), F.col(n)).cast("int"))
    left = in_cells(stored, "vec_id", "vector").join(sizes, key).select(
        *key, F.explode(own_part("vec_id", "v_blocks")).alias("v"), "q_blocks", "vec_id", "vector", "codes"
    ).select(
        *key, "v", F.explode(parts("q_blocks")).alias("q"), "vec_id", F.lit(None).cast("string").alias("same"), "vector", "codes"
    )
    right = in_cells(looks, "same", "vector").join(sizes, key).select(
        *key, F.explode(own_part("same", "q_blocks")).alias("q"), "v_blocks", "same", "vector", "codes"
    ).select(
        *key, F.explode(parts("v_blocks")).alias("v"), "q", F.lit(None).cast(id_type).alias("vec_id"), "same", "vector", "codes"
    )
    blocks = left.unionByName(right).groupBy(*key, "v", "q")

    def nearest(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        is_query = table.column("same").is_valid()
        return _nearest(table.filter(is_query), table.filter(pc.invert(is_query)), k + 1)

    lists = blocks.applyInArrow(nearest, f"same string, vec_ids array<{id_type}>, scores array<double>")
    # The lists of a query come together before they become rows.
    found = lists.repartition(F.col("same")).select("same", F.explode(F.arrays_zip("vec_ids", "scores")).alias("one"))
    return found.select("same", F.col("one.vec_ids").alias("vec_id"), F.col("one.scores").alias("score"))


def _nearest(asking: pa.Table, held: pa.Table, n: int) -> pa.Table:
    """The ``n`` best ids of every query among the vectors in its buckets, each with its best vector.

    Bucket by bucket; scores that cannot be among the best so far are dropped at once, and the others
    are ranked whenever there are ``AT_ONCE``.
    """
    import pyarrow.compute as pc

    coded = held.column("vec_id").combine_chunks().dictionary_encode()
    by_rank = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_rank), np.int32)
    rank[by_rank.to_numpy()] = np.arange(len(by_rank))
    ids = rank[coded.indices.to_numpy()]  # as numbers in the order of the ids
    names = asking.column("same").combine_chunks()
    if not len(names) or not len(ids):
        none = pa.array([0], pa.int32())
        lists = [pa.ListArray.from_arrays(none, x) for x in (coded.dictionary.slice(0, 0), pa.array([], pa.float64()))]
        return pa.table({"same": names.slice(0, 0), "vec_ids": lists[0], "scores": lists[1]})
    q, v = _matrix(asking.column("vector")), _matrix(held.column("vector"))
    starts, held_rows = _bucketed(np.arange(len(v), dtype=np.int32), held.column("codes").combine_chunks().flatten().to_numpy())
    lists = asking.column("codes").combine_chunks()
    query_starts, query_rows = _bucketed(
        np.repeat(np.arange(len(q), dtype=np.int32), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    )
    with np.errstate(over="ignore", invalid="ignore"):
        slack = SLACK * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
    least = np.full(len(q), -np.inf)
    best = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    waiting, size = [], 0
    for code, (first, end) in starts.items():
        low, high = query_starts.get(code, (0, 0))
        inside = held_rows[first:end]
        vectors, step = v[inside].T, max(1, AT_ONCE // (end - first))
        for at in range(low, high, step):
            asked = query_rows[at : min(at + step, high)]
            with np.errstate(over="ignore", invalid="ignore"):
                # Where lengths overflow nothing is left out before the exact ranking.
                row, column = np.nonzero(~(q[asked] @ vectors < (least - slack)[asked, None]))
            waiting.append((asked[row], inside[column]))
            size += len(row)
            if size >= AT_ONCE:
                best, least = _ranked(best, waiting, q, v, ids, n)
                waiting, size = [], 0
    (query, found, score), _ = _ranked(best, waiting, q, v, ids, n)
    rows, firsts = np.unique(query, return_index=True)
    ends = pa.array(np.append(firsts, len(query)), pa.int32())
    return pa.table({
        "same": names.take(pa.array(rows)),
        "vec_ids": pa.ListArray.from_arrays(ends, coded.dictionary.take(by_rank.take(pa.array(found)))),
        "scores": pa.ListArray.from_arrays(ends, pa.array(score)),
    })


def _bucketed(rows: np.ndarray, codes: np.ndarray) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """Rows in the order of their buckets, and where each bucket begins and ends."""
    order = np.argsort(codes, kind="stable")
    found, firsts = np.unique(codes[order], return_index=True)
    ends = np.append(firsts[1:], len(codes))
    return dict(zip(found.tolist(), zip(firsts.tolist(), ends.tolist(), strict=True), strict=True)), rows[order]


def _ranked(best: tuple, waiting: list, q: np.ndarray, v: np.ndarray, ids: np.ndarray, n: int) -> tuple[tuple, np.ndarray]:
    """Query, id and exact score of the ``n`` best after those that wait, by query and rank, and the
    score that others of a query must reach."""
    query, found, score = best
    if waiting:
        new, rows = (np.concatenate(x) for x in zip(*waiting, strict=True))
        exact, step = np.empty(len(new)), max(1, AT_ONCE // q.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            # The same sum in the same order wherever a pair meets.
            for at in range(0, len(new), step):
                exact[at : at + step] = (q[new[at : at + step]] * v[rows[at : at + step]]).sum(1)
        query, found, score = np.append(query, new), np.append(found, ids[rows]), np.append(score, exact)
    # Not a number comes first, as in Spark's order.
    falling = np.where(np.isnan(score), -np.inf, -score)
    order = np.lexsort((found, falling, ~np.isnan(score), query))
    query, found, score = query[order], found[order], score[order]
    if len(np.unique(ids)) < len(ids):  # an id with several vectors counts with its best one
        pair = query.astype(np.int64) * (int(ids.max()) + 1) + found
        first = np.zeros(len(pair), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        query, found, score = query[first], found[first], score[first]
    starts = np.searchsorted(query, np.arange(len(q) + 1))
    kept = np.arange(len(query)) - starts[query] < n
    least, full = np.full(len(q), -np.inf), np.flatnonzero(np.diff(starts) >= n)
    least[full] = score[starts[full] + n - 1]
    return (query[kept], found[kept], score[kept]), least


def _best(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of each query; what several tables have found counts once."""
    best = found.groupBy("same", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("same").orderBy(*_nearest_first())))
    return ranked.filter(F.col("rank") <= n).drop("rank")


def _exactly(index: DataFrame, sample: list, k: int) -> list:
    """The ``k`` nearest vectors of each sampled query, by one pass over the index."""
    asked: dict[int, list] = {}
    for row in sample:
        asked.setdefault(row.dimension, []).append(row)
    groups = {d: ([r.same for r in rows], np.array([r.vector for r in rows])) for d, rows in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pa.RecordBatch] = {}
        for batch in batches:
            dimensions = batch.column("dimension").to_numpy()
            for dimension, (names, queries) in groups.items():
                part = batch.filter(pa.array(dimensions == dimension))
                if not part.num_rows:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.nan_to_num(queries @ _matrix(part.column("vector")).T)
                for name, row in zip(names, scores, strict=True):
                    best = np.argsort(-row, kind="stable")[: k + 1]
                    taken = part.take(pa.array(best)).append_column("query", pa.array([name] * len(best)))
                    taken = taken.append_column("score", pa.array(row[best]))
                    if name in kept:
                        both = pa.Table.from_batches([kept[name], taken]).combine_chunks().to_batches()[0]
                        taken = both.take(pa.array(np.argsort(-both.column("score").to_numpy(), kind="stable")[: k + 1]))
                    kept[name] = taken
        for found in kept.values():
            yield found.select(["query", "score", "same", "dimension", "band", "vector"])

    rows = index.select("same", "dimension", "band", "vector")
    found = rows.mapInArrow(run, "query string, score double, same string, dimension int, band int, vector array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "same")
    ranked = found.filter("query <> same").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).collect()  # SAMPLE * k rows


def _planned(index: DataFrame, asking: DataFrame, k: int, tables: int) -> dict:
    """For each dimension and band: longest, whether it is lifted, hashes, probes, vectors."""
    # One row for each dimension and half power of two of the length: some thousands at most.
    sizes = index.groupBy("dimension", "band").agg(
        F.count("*").alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest")
    ).collect()
    sample, near = [], []
    if any(r.n > BLOCK for r in sizes):
        sample = asking.orderBy(F.xxhash64("same"), "same").limit(SAMPLE).select("same", "dimension", "vector").collect()
        near = _exactly(index, sample, k)
    bands = {}
    for r in sizes:
        lifted = r.longest - r.shortest > 0.0015
        queries = [s for s in sample if s.dimension == r.dimension]
        place = {s.same: i for i, s in enumerate(queries)}
        own = [v for v in near if (v.dimension, v.band) == (r.dimension, r.band)]
        asked = _lifted(np.array([s.vector for s in queries]).reshape(len(queries), r.dimension), None, lifted)
        found = _lifted(np.array([v.vector for v in own]).reshape(len(own), r.dimension), r.longest, lifted)
        chosen = plan(r.n, asked, found, np.array([place[v.query] for v in own], int), tables)
        bands[r.dimension, r.band] = (r.longest, lifted, *chosen, r.n)
    return bands


def search(
    vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which the
    condition ``queries`` (on the column ``vec_id``) holds, among all other rows."""
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    copies = Window.partitionBy("same").orderBy("vec_id")
    index = (
        rows.withColumn("copy", F.dense_rank().over(copies)).filter(F.col("copy") <= k + 1)
        .dropDuplicates(["same", "vec_id"]).drop("copy").withColumn("band", _band())
    )
    index = stage(index, "index-vectors")
    asked = rows.filter(queries)
    asking = asked.withColumn("copy", F.row_number().over(copies)).filter("copy = 1").drop("copy", "vec_id")

    bands = _planned(index, asking, k, tables)
    held: dict[int, int] = {}
    for (dimension, _), band in bands.items():
        held[dimension] = held.get(dimension, 0) + band[-1]
    best = stage(_best(_scan(index, asking, bands, tables, k), k + 1), "nearest")

    # Who has found too few looks everywhere: every band is one bucket then.
    enough = best.groupBy("same").agg(F.count("*").alias("n"))
    everyone = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])[F.col("dimension")] if held else F.lit(0)
    wanted = F.least(F.lit(k + 1), everyone)
    few = asking.join(enough, "same", "left").filter(F.coalesce("n", F.lit(0)) < wanted).drop("n")
    few = stage(few, "short-queries")
    if not few.isEmpty():
        everywhere = {key: (longest, lifted, 0, 1, n) for key, (longest, lifted, _, _, n) in bands.items()}
        rest = _best(_scan(index, few, everywhere, 1, k), k + 1)
        best = best.join(few.select("same"), "same", "left_anti").unionByName(rest)
    pairs = asked.select("same", F.col("vec_id").alias("query_id")).distinct().join(best, "same")
    pairs = pairs.filter("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_nearest_first())))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
