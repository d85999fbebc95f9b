"""Best-fit packing by the configuration linear program over the length histogram.

The histogram (at most ``capacity`` numbers, whatever the input) goes to the
driver. There the covering program over sequence configurations is solved by
multiplicative weights: each round prices configurations with a knapsack
dynamic program over the current worths, takes for each length that lags behind
the best configuration that holds it, and lowers the worth of what is covered.
The worths give a lower bound of the program (and of any packing). Rounding takes
whole multiples of the configurations; what they leave is packed best-fit
decreasing. Pieces are then matched to places by their rank within their length,
counted per partition, so that no length (one may hold a third of all pieces)
has to meet in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_ids, lean, partition_id, stored, tune
from .tokens import encode_with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_no long"


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, list[list[int]]]:
    """Pricing: for every space up to ``capacity`` the largest total worth of
    pieces that fit, any number of each, and these pieces (indices)."""
    best, chosen = np.zeros(capacity + 1), [[]]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        chosen.append(chosen[c - 1])
        if fits[c]:
            total = worth[: fits[c]] + best[c - lengths[: fits[c]]]
            at = int(total.argmax())
            if total[at] > best[c]:
                best[c] = total[at]
                chosen[c] = [at, *chosen[c - int(lengths[at])]]
    return best, chosen


def solve_lp(hist: np.ndarray, capacity: int, rounds: int = 60, eta: float = 1.0, width: float = 16.0, slack: float = 0.02) -> tuple[Counter, float]:
    """The covering program by multiplicative weights: amounts of configurations
    (fractions) that cover every length's pieces, and a lower bound of their sum.

    After round t of T every length should have t/T of its pieces covered. A
    length's worth is its share of the capacity times e to the power of ``eta``
    times what it lags, so pricing turns to what lacks cover. Lengths whose best
    configuration is worth ``1 - slack`` of the best of all get it, until they
    are on time; none gets ahead by more than ``width`` rounds. What the rounds
    leave uncovered is covered best-fit decreasing. By duality the pieces' worth
    over the worth of the best configuration bounds every packing from below.
    """
    lengths = np.flatnonzero(hist[: capacity + 1])
    need = hist[lengths].astype(float)
    cover, amounts, bound = np.zeros(len(lengths)), Counter(), 0.0
    for turn in range(1, rounds + 1) if len(lengths) else ():
        worth = lengths / capacity * np.exp(eta * ((turn - 1) / rounds - cover))
        best, chosen = knapsack(lengths, worth, capacity)
        bound = max(bound, float(need @ worth / best[capacity]))
        value = worth + best[capacity - lengths]
        due = turn / rounds
        for at in np.argsort(-value, kind="stable").tolist():
            if value[at] < (1 - slack) * best[capacity]:
                break
            if cover[at] >= due:
                continue
            config = Counter([at, *chosen[capacity - int(lengths[at])]])
            ks, times = np.array(list(config)), np.array(list(config.values()), dtype=float)
            x = min((due - cover[at]) * need[at] / config[at], ((due + width / rounds - cover[ks]) * need[ks] / times).min())
            if x > 0:
                cover[ks] += x * times / need[ks]
                amounts[tuple(sorted((int(lengths[k]), n) for k, n in config.items()))] += x
    left, out = hist[: capacity + 1].astype(float), Counter()
    for config, x in amounts.most_common():  # nothing is covered twice
        x = min(x, *(left[l] / n for l, n in config))
        if x > 0:
            out[config] += x
            for l, n in config:
                left[l] -= n * x
    out.update(best_fit(np.ceil(left - 1e-6).astype(np.int64), capacity))
    return out, bound


def best_fit(rest: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over groups of equal sequences, so that its work
    depends on the capacity and not on the number of pieces."""
    spaces: list[int] = []  # sorted free spaces that have groups
    groups: dict[int, list[tuple[tuple, int]]] = {}
    out: Counter = Counter()

    def put(space: int, config: tuple, times: int) -> None:
        if times <= 0:
            return
        if space == 0:
            out[config] += times
            return
        if space not in groups:
            spaces.insert(bisect_left(spaces, space), space)
            groups[space] = []
        groups[space].append((config, times))

    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                config, times = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            else:
                space, config, times = capacity, (), -(-left // (capacity // length))
            each = min(space // length, left)  # equal pieces go on filling the same sequence
            full = min(times, left // each)
            put(space - each * length, config + ((length, each),), full)
            left -= full * each
            if full < times:
                if left and left < each:
                    put(space - left * length, config + ((length, left),), 1)
                    left, full = 0, full + 1
                if config:
                    put(space, config, times - full)
    for found in groups.values():
        for config, times in found:
            out[config] += times
    return out


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole numbers of configurations that pack exactly the histogram.

    ``hist[l]`` is the number of pieces of length l, 0 < l <= capacity. The
    program's amounts are rounded down and what they leave is packed best-fit
    decreasing. If that takes more sequences than best-fit decreasing of all
    pieces (rounding may cost one a length), the latter stands.
    """
    rest = hist.astype(np.int64).copy()
    out: Counter = Counter()
    if rest[capacity]:
        out[((capacity, 1),)] = int(rest[capacity])
        rest[capacity] = 0
    plain, rounded = best_fit(rest, capacity), Counter()
    for config, x in solve_lp(rest, capacity)[0].most_common():
        times = min(int(x + 1e-6), *(int(rest[l]) // a for l, a in config))
        if times > 0:
            rounded[config] += times
            for l, a in config:
                rest[l] -= times * a
    rounded.update(best_fit(rest, capacity))
    out.update(min(rounded, plain, key=lambda c: sum(c.values())))
    return list(out.items())


def slots(packed, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as rank intervals per length."""
    used, sequence, rows = Counter(), 0, []
    for config, times in packed:
        offset = 0
        for length, a in config:
            rows.append((length, used[length], a, sequence, offset))
            used[length] += times * a
            offset += length * a
        sequence += times
    rows.sort()
    names = ("length", "first", "each", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)}


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    key = table["length"] << 44 | table["first"]
    at = np.searchsorted(key, length << 44 | rank, side="right") - 1
    nth = rank - table["first"][at]
    each = table["each"][at]
    return table["sequence"][at] + nth // each, table["offset"][at] + nth % each * length


def _pieces(path: str, capacity: int, end_id: int):
    @lean
    def run(batches):
        part, count = partition_id(), np.zeros(capacity + 1, dtype=np.int64)
        for batch, ids, offsets in encode_with_end(path, batches, end_id):
            size = np.diff(offsets)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            begin = offsets[:-1][doc] + start
            crc = [crc_ids(ids[b : b + m]) for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs, first, many = np.unique(length[order], return_index=True, return_counts=True)
            local = np.empty(len(length), dtype=np.int64)
            local[order] = np.arange(len(length)) - np.repeat(first, many) + count[length[order]]
            count[runs] += many
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "part": pa.array(np.full(len(doc), part), pa.int32()),
                    "local_no": pa.array(local),
                }
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack every document's ids (closed by ``end_id``) into few sequences.

    Documents longer than ``capacity`` are cut; nothing is dropped. A null or
    empty text is the end id alone. Repeated doc_ids are packed as separate
    documents; a null doc_id stays null. Other columns are ignored. An empty
    table gives no rows. Returns one row per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(slots(plan(hist, capacity), capacity))

    @lean
    def placed(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = place(where.value, length, rank)
            keep = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(keep | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_no"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
