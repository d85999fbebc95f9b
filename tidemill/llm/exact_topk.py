"""Exact top-k by exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors (term = component). A block of rows is held as
postings, one list of (row, weight) a term. A query goes through its terms and
scatters query weight times posting weight into the block's dense score array;
partition selection keeps the block's best, which merge per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .additive_ann import merge_top
from .common import KEPT, asked_vectors, block_number, lanes, lean, meet, partition_id, top_smallest, tune, valid_vectors

BLOCK, QUERY_BLOCK = 4096, 512
RECORD = np.dtype([("row", "<i4"), ("term", "<i4"), ("w", "<i8")])


def pack_sparse(df: DataFrame, prefix: str, block: int) -> DataFrame:
    """Rows (vec_id, weights array<bigint> and for queries vec_key) as blocks of
    ids (and keys) and (row, term, weight), with a number."""
    names = [c for c in ("vec_id", "vec_key") if c in df.columns]

    @lean
    def run(batches):
        part_no, seq, ids, parts, n = partition_id(), 0, [], [], 0

        def flush():
            nonlocal seq
            seq += 1
            cols = {f"{prefix}_{name.removeprefix('vec_')}s": pa.array([np.concatenate(c).astype("<i8").tobytes()], pa.binary()) for name, c in zip(names, zip(*ids))}
            data = pa.array([np.concatenate(parts).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict(cols | {f"{prefix}_data": data, f"{prefix}_no": pa.array([block_number(part_no, seq)], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                b = batch.slice(at, block)
                lists = b.column("weights")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                w = lists.flatten().to_numpy(zero_copy_only=False)
                part = np.empty(len(w), dtype=RECORD)
                part["row"] = np.repeat(np.arange(len(size)), size) + n
                part["term"] = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
                part["w"] = w
                ids.append([b.column(name).to_numpy() for name in names])
                parts.append(part[part["w"] != 0])
                n += b.num_rows
                if n >= block:
                    yield flush()
                    ids, parts, n = [], [], 0
        if n:
            yield flush()

    cols = ", ".join(f"{prefix}_{name.removeprefix('vec_')}s binary" for name in names)
    return df.select(*names, "weights").mapInArrow(run, f"{cols}, {prefix}_data binary, {prefix}_no long")


def _by_term(data: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(data["term"], kind="stable")
    terms, first = np.unique(data["term"][order], return_index=True)
    rows, w = np.split(data["row"][order], first[1:]), np.split(data["w"][order], first[1:])
    return list(zip(terms.tolist(), rows, w, strict=True)) if len(terms) else []


def score_block(q: np.ndarray, n_queries: int, r: np.ndarray, n_rows: int):
    """Yield (query, dense scores over the block's rows) term at a time."""
    postings = {t: (rows if len(rows) < n_rows else slice(None), w) for t, rows, w in _by_term(r)}
    order = np.argsort(q["row"], kind="stable")
    q, cut = q[order], np.searchsorted(q["row"][order], np.arange(n_queries + 1))
    for n in range(n_queries):
        score = np.zeros(n_rows, dtype=np.int64)
        mine = q[cut[n] : cut[n + 1]]
        for term, weight in zip(mine["term"].tolist(), mine["w"].tolist(), strict=True):
            if term in postings:
                rows, w = postings[term]
                score[rows] += weight * w
        yield n, score


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, factor: float = 1024.0) -> DataFrame:
    """The k highest integer inner products for every query row, itself excluded.

    A component x counts as floor(factor * x), a 64-bit integer, and so do scores
    (what exceeds 64 bits wraps round); vectors of different lengths meet on the
    components both have. Null or empty vectors and those with null or non-finite
    components take no part; zero vectors do, with score 0. Ties go to the smaller
    vec_id. Query rows equal in id and vector are one query; an id on unlike
    vectors is a query for each, with ranks of its own, and a row of any of its
    vectors is no candidate for it. A repeated id among the candidates is a row
    each time. An empty table gives no rows; other columns are ignored.
    """
    spark = tune(vectors.sparkSession)
    sparse = lambda df: df.withColumn("weights", F.transform("vec", lambda x: F.floor(x * factor).cast("long")))
    asked = asked_vectors(valid_vectors(queries, id_col, vec_col, allow_zero=True))
    rows = pack_sparse(sparse(valid_vectors(vectors, id_col, vec_col, allow_zero=True)), "r", BLOCK)

    @lean
    def score(batches):
        found = {}

        def given():
            for (query, key), (s, ids) in found.items():
                same = lambda x: pa.array(np.full(len(s), x))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"query_id": same(query), "vec_key": same(key), "vec_id": pa.array(ids), "score": pa.array(s)})
            found.clear()

        for batch in batches:
            for q_ids, q_keys, q_data, r_ids, r_data in zip(*(batch.column(n) for n in ("q_ids", "q_keys", "q_data", "r_ids", "r_data")), strict=True):
                qi, qk, ri = (np.frombuffer(x.as_buffer(), "<i8") for x in (q_ids, q_keys, r_ids))
                q, r = np.frombuffer(q_data.as_buffer(), RECORD), np.frombuffer(r_data.as_buffer(), RECORD)
                for n, s in score_block(q, len(qi), r, len(ri)):
                    other = ri != qi[n]
                    s, ids = (s, ri) if other.all() else (s[other], ri[other])
                    old = found.get((qi[n], qk[n]))
                    if old is not None:
                        s, ids = np.concatenate([old[0], s]), np.concatenate([old[1], ids])
                    at = top_smallest(-s, ids, k)
                    found[(qi[n], qk[n])] = (s[at], ids[at])
                if len(found) > KEPT:
                    yield from given()
        yield from given()

    near = meet(rows, pack_sparse(sparse(asked), "q", QUERY_BLOCK), asked.count(), lanes(spark)).mapInArrow(score, "query_id long, vec_key long, vec_id long, score long")
    out = merge_top(near, k, [F.desc("score"), F.col("vec_id")])
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
