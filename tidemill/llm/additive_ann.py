"""Approximate nearest neighbours by additive quantisation.

Every vector is the sum of one codeword from each of M full-dimensional
codebooks. Codebooks start as residual k-means and are refitted by least squares
between rounds of beam-search encoding. All rows are encoded and stored with the
squared norm of their reconstruction; a query scores them with one table look-up
a codebook (|x|^2 - 2 q.x), and the best are reranked exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, asked_vectors, block_number, lanes, lean, meet, partition_id, stored, top_smallest, tune, valid_vectors

#: Bound of the sample the codebooks are fitted on, and rows of a packed block.
SAMPLE, BLOCK, QUERY_BLOCK = 10_000, 8192, 1024
#: Dimensions that are refitted in one go: 10,000 rows of them stay in a cache.
COLUMNS = 8


@dataclass
class Codebooks:
    books: np.ndarray  # (M, K, d)

    @property
    def dim(self) -> int:
        return self.books.shape[2]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """Codes by beam search over residuals."""
        n, (m_books, k, _) = len(x), self.books.shape
        rest = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        for m in range(m_books):
            c = self.books[m]
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest @ c.T) + (c**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if m < m_books - 1 else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            b, word = best // k, best % k
            rest = np.take_along_axis(rest, b[:, :, None], 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, b[:, :, None], 1), word[:, :, None]], 2)
        return codes[:, 0, :]


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        total, count = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        full = count > 0
        c[full] = total[full] / count[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def refit(x: np.ndarray, codes: np.ndarray, books: np.ndarray, ridge: float = 0.1, exact: float = 1e-4, steps: int = 30) -> np.ndarray:
    """Codebooks of least squared error for ``codes``, held near ``books`` by ``ridge``.

    Conjugate gradients, scaled by the words' counts, go over the codes themselves:
    the matrix of the normal equations, of all words squared (302 MB at 24 x 256),
    is never made. Thirty steps leave an error within a thousandth of the least.
    Dimensions are solved apart, ``COLUMNS`` at a time.
    """
    (m, k, d), n = books.shape, len(x)
    columns = [np.ascontiguousarray(codes[:, i]) for i in range(m)]
    sorts = [np.argsort(c, kind="stable") for c in columns]
    begin = [np.flatnonzero(np.diff(c[s], prepend=-1)) for c, s in zip(columns, sorts)]
    scale = 1 / (np.stack([np.bincount(c, minlength=k) for c in columns]) + ridge)[:, :, None]

    def summed(y: np.ndarray) -> np.ndarray:
        out = np.zeros((m, k, y.shape[1]))
        for i, (c, s, b) in enumerate(zip(columns, sorts, begin)):
            out[i, c[s[b]]] = np.add.reduceat(y.take(s, axis=0), b, axis=0)
        return out

    def made(w: np.ndarray) -> np.ndarray:
        return sum(w[i].take(c, axis=0) for i, c in enumerate(columns))

    def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    out = books.astype(np.float64)
    for at in range(0, d, COLUMNS):
        w = out[:, :, at : at + COLUMNS]
        rest = summed(x[:, at : at + COLUMNS] - made(w))
        way = rest * scale
        size = (rest * way).sum((0, 1))
        least = size * exact**2
        for _ in range(steps):
            if (size <= least).all():
                break
            push = summed(made(way)) + ridge * way
            far = quotient(size, (way * push).sum((0, 1)))
            w += far * way
            rest -= far * push
            step = rest * scale
            size, old = (rest * step).sum((0, 1)), size
            way = step + quotient(size, old) * way
    return out.astype(np.float32)


def fit(x: np.ndarray, books: int = 24, words: int = 256, rounds: int = 1, beam: int = 4, seed: int = 7) -> Codebooks:
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    k = max(1, min(words, len(x)))
    rest, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, k, rng)
        rest -= c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
        out.append(c)
    model = Codebooks(np.stack(out).astype(np.float32))
    for _ in range(rounds):
        codes = np.concatenate([model.encode(x[i : i + 1024], beam) for i in range(0, len(x), 1024)])
        model = Codebooks(refit(x, codes, model.books))
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pack_vectors(df: DataFrame, prefix: str, block: int, encode=None) -> DataFrame:
    """Rows (vec_id, vec and for queries vec_key) as blocks: ids (and keys), row
    bytes (vectors or, with ``encode``, what it makes of them), a number."""
    names = [c for c in ("vec_id", "vec_key") if c in df.columns]

    @lean
    def run(batches):
        part, seq, held, n = partition_id(), 0, [], 0

        def flush():
            nonlocal seq
            *ids, v = (np.concatenate(c) for c in zip(*held))
            for at in range(0, len(v), block):
                seq += 1
                cols = {f"{prefix}_{name.removeprefix('vec_')}s": pa.array([i[at : at + block].astype("<i8").tobytes()], pa.binary()) for name, i in zip(names, ids)}
                some = v[at : at + block]
                data = pa.array([(encode(some) if encode else some.astype("<f8")).tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict(cols | {f"{prefix}_data": data, f"{prefix}_no": pa.array([block_number(part, seq)], pa.int64())})

        for batch in batches:
            if batch.num_rows:
                held.append([*(batch.column(name).to_numpy() for name in names), _matrix(batch.column("vec"))])
                n += batch.num_rows
                if n >= block:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    cols = ", ".join(f"{prefix}_{name.removeprefix('vec_')}s binary" for name in names)
    return df.select(*names, "vec").mapInArrow(run, f"{cols}, {prefix}_data binary, {prefix}_no long")


def merge_top(parts: DataFrame, k: int, order: list) -> DataFrame:
    """The best k rows of each query out of what the blocks kept."""
    w = Window.partitionBy("query_id", "vec_key").orderBy(*order)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, shortlist: int = 256, books: int = 24, words: int = 256) -> DataFrame:
    """The k rows nearest to every query row, itself excluded by id.

    Distances are Euclidean on the original vectors in double precision; ties go
    to the smaller vec_id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part. A distance is defined between vectors of
    one dimension: each dimension is a search of its own. Query rows equal in id
    and vector are one query; an id on unlike vectors is a query for each, with
    ranks of its own, and a row of any of its vectors is no candidate for it. A
    repeated id among the candidates is a row each time. An empty table gives no
    rows; other columns are ignored. The codebooks of a dimension are fitted on at
    most ``SAMPLE`` of its rows, those of smallest id hash; every row is encoded
    and searched.
    """
    spark = tune(vectors.sparkSession)
    rows = valid_vectors(vectors, id_col, vec_col, allow_zero=False)
    asked = asked_vectors(valid_vectors(queries, id_col, vec_col, allow_zero=False))
    out = None
    for r in asked.groupBy(F.size("vec").alias("dim")).count().sort("dim").collect():  # one row a dimension
        same = F.size("vec") == r["dim"]
        found = _search(rows.where(same), asked.where(same), r["count"], k, shortlist, books, words)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, asked: DataFrame, n_asked: int, k: int, shortlist: int, books: int, words: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(fit(_matrix(sample.column("vec").combine_chunks()), books, words).books)
    record = np.dtype([("code", "u1" if words <= 256 else "<u2", (books,)), ("norm", "<f4")])

    def encode(x: np.ndarray) -> np.ndarray:
        m = Codebooks(held.value)
        codes = np.concatenate([m.encode(x[i : i + 512]) for i in range(0, len(x), 512)])
        out = np.empty(len(x), dtype=record)
        out["code"], out["norm"] = codes, (m.decode(codes) ** 2).sum(1)
        return out

    index, blocks = pack_vectors(rows, "r", BLOCK, encode), pack_vectors(asked, "q", QUERY_BLOCK)

    @lean
    def score(batches):
        c, found = held.value, {}

        def given():
            for (query, key), (s, ids) in found.items():
                same = lambda x: pa.array(np.full(len(s), x))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"query_id": same(query), "vec_key": same(key), "vec_id": pa.array(ids), "approx": pa.array(s.astype(np.float64))})
            found.clear()

        for batch in batches:
            for q_ids, q_keys, q_data, r_ids, r_data in zip(*(batch.column(n) for n in ("q_ids", "q_keys", "q_data", "r_ids", "r_data")), strict=True):
                qi, qk, ri = (np.frombuffer(x.as_buffer(), "<i8") for x in (q_ids, q_keys, r_ids))
                q = np.frombuffer(q_data.as_buffer(), "<f8").reshape(len(qi), -1).astype(np.float32)
                r = np.frombuffer(r_data.as_buffer(), record)
                tables = (q @ c.reshape(-1, c.shape[2]).T).reshape(len(q), *c.shape[:2])
                for query, key, t in zip(qi.tolist(), qk.tolist(), tables, strict=True):
                    s = r["norm"] - 2 * sum(t[m][r["code"][:, m]] for m in range(len(c)))
                    s[ri == query] = np.inf
                    old = found.get((query, key))
                    if old is not None:  # what this task has kept of the query so far
                        s, ids = np.concatenate([old[0], s]), np.concatenate([old[1], ri])
                    else:
                        ids = ri
                    at = top_smallest(s, ids, shortlist)
                    at = at[np.isfinite(s[at])]
                    found[(query, key)] = (s[at], ids[at])
                if len(found) > KEPT:
                    yield from given()
        yield from given()

    near = meet(index, blocks, n_asked, lanes(spark)).mapInArrow(score, "query_id long, vec_key long, vec_id long, approx double")
    near = merge_top(near, shortlist, [F.col("approx"), F.col("vec_id")]).select("query_id", "vec_key", "vec_id").distinct()
    near = stored(near, "ann-shortlist")
    pairs = near.join(rows, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), "vec_key", F.col("vec").alias("q")), ["query_id", "vec_key"])
    exact = F.sqrt(F.aggregate(F.zip_with("q", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    out = merge_top(pairs.select("query_id", "vec_key", "vec_id", exact.alias("score")), k, [F.col("score"), F.col("vec_id")])
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
