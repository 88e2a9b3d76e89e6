"""Exact top-k search by distributed histogram selection (operator 12).

Every query is scored against every candidate, in blocks: a block of queries and a group of candidate blocks are one unit of work and
one matrix product. No scores are kept. Each round counts, for every query, how many of its scores fall into each bin of the
range that still holds its k-th highest score; the counts of all units are added up by a tree, the bin of the k-th score is
found, and the next round looks into that bin with bins ``2 ** BIN_BITS`` times finer, until a bin is one score. A last round
returns the scores above the k-th, and of those equal to it as many as are wanting, with the smallest vec_ids; each unit
returns no more of them than that, so a vector that half the table repeats gives a few rows per unit and no pile.

Components are ``floor(scale * x)``, so scores are whole numbers. They are computed in single or double floats only where all
partial sums are exact in them (bounded by the largest squared length), else in 64-bit integers; scores that could pass 64 bits
are an error. Queries and candidates are dealt by the hash of their place, never by id or content.

Vectors that are null or hold null or non-finite components take no part. Only vectors of equal length have a score; empty ones
have score 0. A row is its own candidate under no circumstances, but other rows with its vec_id or vector are. Repeated query rows
each get their results. A null vec_id is no query and comes last among equal scores. Extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BIN_BITS = 9
#: Mean rows of a block of queries and of candidates, and candidate blocks of one unit of work.
QUERY_ROWS, CANDIDATE_ROWS, BLOCKS = 1024, 4096, 8
FAN_IN = 16
_BLOCK = "rows binary, ids array<bigint>, vectors binary"


def with_whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """Usable vectors: vec_id, dim, components (bigint) and the squared length as a double."""
    given = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), given.alias("_given")).where("_given IS NOT NULL")
    # A product with 0 is 0 for finite components only.
    rows = rows.where(F.forall("_given", lambda x: F.coalesce(x * 0.0 == 0.0, F.lit(False)) & ~F.isnan(x)))
    rows = rows.select("vec_id", F.size("_given").cast("bigint").alias("dim"), F.transform("_given", lambda x: F.floor(x * float(scale))).alias("components"))
    return rows.withColumn("_square", F.aggregate("components", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _packer(code: str):
    def pack(table: pa.Table) -> pa.Table:
        keys = [table[name][:1] for name in ("dim", "block")]
        flat = table["components"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = [pa.array([table["_row"].to_numpy().astype("<i8").tobytes()]), pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([flat.astype(code).tobytes()])]
        return pa.table([*keys, *out], ["dim", "block", "rows", "ids", "vectors"])

    return pack


def _blocks(rows: DataFrame, many: Column, code: str) -> DataFrame:
    """One row per block of vectors of one length: dim, block, rows, ids, vectors."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_row"), many))
    return dealt.select("dim", "block", "_row", "vec_id", "components").groupBy("dim", "block").applyInArrow(_packer(code), f"dim bigint, block bigint, {_BLOCK}")


def _scored(queries: pa.Table, candidates: pa.Table, code: str, lift: int):
    """For the one query block and each candidate block: rows of both and scores, lifted to be non-negative; -1 for a row itself."""
    dim = queries["dim"][0].as_py()
    asked = np.frombuffer(queries["rows"][0].as_py(), "<i8")
    left = np.frombuffer(queries["vectors"][0].as_py(), code).reshape(len(asked), dim)
    for row in range(candidates.num_rows):
        there = np.frombuffer(candidates["rows"][row].as_py(), "<i8")
        right = np.frombuffer(candidates["vectors"][row].as_py(), code).reshape(len(there), dim)
        scores = (left @ right.T).astype(np.int64) + lift
        _, mine, own = np.intersect1d(asked, there, return_indices=True)
        scores[mine, own] = -1
        yield row, there, scores


def _counter(code: str, lift: int, width_bits: int, shift: int):
    """Counts of scores by query and bin of ``2 ** shift`` within the ``2 ** width_bits`` scores from the query's ``low`` on."""
    bins = 1 << (width_bits - shift)

    def count(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:  # a block to which no hash led
            return pa.table([pa.array([], kind) for kind in [pa.int64()] * 3 + [pa.binary()]], ["dim", "query_block", "part", "counts"])
        low = np.frombuffer(queries["low"][0].as_py(), "<i8")[:, None]
        total = np.zeros(len(low) * bins, np.int64)
        for _, _, scores in _scored(queries, candidates, code, lift):
            inside = (scores >= low) & (scores - low < 1 << width_bits) & (low >= 0)
            query = np.nonzero(inside)[0]
            total += np.bincount(query * bins + ((scores - low)[inside] >> shift), minlength=len(total))
        return pa.table([*[pa.array([k.as_py()]) for k in key], pa.array([total.tobytes()])], ["dim", "query_block", "part", "counts"])

    return count


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b.as_py(), "<i8") for b in table["counts"]], axis=0)
    return pa.table([*[table[c][:1] for c in ("dim", "query_block", "part")], pa.array([total.tobytes()])], ["dim", "query_block", "part", "counts"])


def _locator(width_bits: int, shift: int):
    """Narrow every query's range to the bin of the score that is wanted; ``low`` is -1 where there are fewer scores than that."""
    bins = 1 << (width_bits - shift)

    def locate(queries: pa.Table, counted: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return queries
        low, need = (np.frombuffer(queries[c][0].as_py(), "<i8") for c in ("low", "need"))
        counts = np.zeros((len(low), bins), np.int64)
        for part in counted["counts"]:
            counts += np.frombuffer(part.as_py(), "<i8").reshape(counts.shape)
        down = np.cumsum(counts[:, ::-1], axis=1)
        place = (down < need[:, None]).sum(axis=1)  # bins from the top that hold fewer
        found = (place < bins) & (low >= 0)
        above = np.where(place > 0, down[np.arange(len(low)), np.minimum(place, bins) - 1], 0)
        new_low = np.where(found, low + ((bins - 1 - place) << shift), -1)
        new_need = np.where(found, need - above, 0)
        at = [queries.schema.get_field_index(c) for c in ("low", "need")]
        for k, name, values in zip(at, ("low", "need"), (new_low, new_need), strict=True):
            queries = queries.set_column(k, name, pa.array([values.astype("<i8").tobytes()]))
        return queries

    return locate


def _chooser(code: str, lift: int):
    """Candidates above each query's k-th score, and the smallest ids at it."""
    names = ["query_row", "query_id", "vec_id", "score"]

    def choose(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        low, need = (np.frombuffer(queries[c][0].as_py(), "<i8") for c in ("low", "need"))
        asked = np.frombuffer(queries["rows"][0].as_py(), "<i8")
        query_ids = np.array(queries["ids"][0].as_py(), np.int64)
        out = []
        for row, _, scores in _scored(queries, candidates, code, lift):
            ids = candidates["ids"][row].values
            order = pa.compute.sort_indices(ids).to_numpy()  # nulls last
            scores = scores[:, order]
            tied = (scores == low[:, None]) & (low[:, None] >= 0)
            tied &= np.cumsum(tied, axis=1) <= need[:, None]
            query, at = np.nonzero((scores > low[:, None]) | tied)
            out.append(pa.table([pa.array(asked[query]), pa.array(query_ids[query]), ids.take(pa.array(order[at])), pa.array(scores[query, at] - lift)], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 4, names)

    return choose


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """The k highest integer inner products of each query row: query_id, rank, vec_id, score; ties to smaller vec_ids.

    ``is_query`` is a condition on vec_id.
    """
    rows = cut(with_whole_numbers(vectors, scale).withColumns({"_row": F.monotonically_increasing_id(), "_asked": F.coalesce(is_query, F.lit(False))}), "vectors")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("_n"), F.count_if("_asked").alias("_queries"), F.max("_square").alias("_most"))
    sizes = cut(sizes, "sizes")  # a row for each length, so at most as many as the longest vector has components, and one
    most, largest = sizes.agg(F.max("_most"), F.max("_n")).first()
    if most is not None and most >= 2**62:
        raise ValueError("scores of these vectors may not fit into 64 bits")
    lift = math.ceil(most or 0)
    code = "<f4" if lift < 1 << 24 else "<f8" if lift < 1 << 53 else "<i8"
    rows = rows.join(F.broadcast(sizes), "dim").where("_queries > 0")
    groups = F.ceil(F.ceil(F.col("_n") / CANDIDATE_ROWS) / BLOCKS)
    # A multiple of the blocks of a unit, so that all units are alike.
    candidates = cut(_blocks(rows, groups * BLOCKS, code), "candidates").join(F.broadcast(sizes), "dim")
    asked = F.ceil(F.col("_queries") / QUERY_ROWS)
    units = candidates.select("dim", F.floor(F.col("block") / BLOCKS).alias("part"), "rows", "ids", "vectors", F.explode(F.sequence(F.lit(0), asked - 1)).alias("query_block"))
    queries = _blocks(rows.where("_asked"), asked, code).withColumnRenamed("block", "query_block")
    n = F.size("ids")
    whole = lambda value: F.unhex(F.repeat(F.lit(value.to_bytes(8, "little").hex()), n))
    queries = cut(queries.withColumns({"low": whole(0), "need": whole(k)}), "queries")
    shape = f"dim bigint, query_block bigint, {_BLOCK}, low binary, need binary"
    keys = ["dim", "query_block", "part"]

    def dealt(state: DataFrame) -> DataFrame:
        return state.join(F.broadcast(sizes), "dim").select(*state.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)).alias("part"))

    bits, parts = (2 * lift).bit_length(), math.ceil((largest or 0) / CANDIDATE_ROWS / BLOCKS)
    while bits:
        shift = max(0, bits - BIN_BITS)
        counts = dealt(queries).groupBy(*keys).cogroup(units.groupBy(*keys)).applyInArrow(
            _counter(code, lift, bits, shift), "dim bigint, query_block bigint, part bigint, counts binary"
        )
        left = parts
        while left > FAN_IN:
            counts = counts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy(*keys).applyInArrow(_add, counts.schema)
            left = math.ceil(left / FAN_IN)
        state = queries.groupBy("dim", "query_block").cogroup(counts.groupBy("dim", "query_block"))
        queries = cut(state.applyInArrow(_locator(bits, shift), shape), "queries")
        bits = shift
    chosen = dealt(queries).groupBy(*keys).cogroup(units.groupBy(*keys)).applyInArrow(_chooser(code, lift), "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    # At most k rows of each unit: the order within a query is of a few rows.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame) -> DataFrame:
    """Five best rows of every fiftieth vector."""
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5
"""
