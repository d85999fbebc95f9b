"""SimHash near-duplicates through segment popcounts.

A fingerprint is mapped to the vector of its segments' bit counts. The Manhattan
distance of two such vectors is a lower bound of the Hamming distance, so pairs
within ``bits`` are found by a grid range-join there: segments are dealt to
``groups`` coordinate groups, a pair within distance ``bits`` differs in at most
``bits`` groups, and hence shares the grid cell of some ``groups - bits`` of
them. Cells are compared in blocks of bounded size; the coarse Manhattan bound
comes first, the exact Hamming distance decides, and each block gives only the
edges of a spanning forest. Copies of a fingerprint are one vertex throughout.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lanes, lean, named, picked, planes, recorded, remove, stored, stored_alone, tune, unplanes

#: Fingerprints of one cell that are compared in one go with as many others.
BLOCK = 1024
#: Characters of text whose prefix shingles make a bucket; rows gathered before they are dealt.
BUCKET, GATHER = 64_000_000, 1_000_000
#: One text of so many tells which shingles are frequent; how many of these are told.
ONE_OF, FREQUENT = 4, 500_000


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, repeats: bool = True, keep: bool = False) -> DataFrame:
    """doc_id and fp (signed 64-bit SimHash of the word shingles).

    A-Z is lower-cased, words are runs of anything but space and \\x09-\\x0d;
    without ``repeats`` each shingle counts once. A null text, or one without words, has fingerprint zero.
    """
    tune(docs.sparkSession)

    @lean
    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            out = np.zeros(b.num_rows, dtype=np.uint64)
            for i, text in enumerate(b.column("text").cast(pa.large_binary())):
                parts = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
                if not parts:
                    continue
                joined = b" ".join(parts)
                ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
                starts = [0, *(ends[:-1] + 1).tolist()]
                stops = ends[words - 1 :].tolist() if len(parts) >= words else [len(joined)]
                h = np.array([xxh64_intdigest(joined[x:y], seed) for x, y in zip(starts, stops)], dtype="<u8")
                h = h if repeats else np.unique(h)
                on = sum(np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for at in range(0, len(h), 65536))
                out[i] = np.packbits(on * 2 > len(h), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(out.view(np.int64))})

    named = F.col("doc_id") if keep else F.col("doc_id").cast("long")
    rows = docs.select(named.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def cell_masks(groups: int, bits: int) -> list[int]:
    """64-bit masks of every choice of ``groups - bits`` coordinate groups; a
    group is a run of adjacent 2-bit segments."""
    cuts = [round(i * 32 / groups) * 2 for i in range(groups + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, groups - bits)]


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, kept in place (two bits each)."""
    return fp - (fp >> np.uint64(1) & np.uint64(0x5555555555555555))


def forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Edges that connect whatever is linked within ``a`` (b None) or between a
    and b: at most one fewer than there are vertices."""
    every = a if b is None else np.concatenate([a, b])
    parent = list(range(len(every)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    quarters = [np.uint64(0xFFFF << s) for s in (0, 16, 32, 48)]
    counts = np.stack([np.bitwise_count(every & q) for q in quarters]).astype(np.int16)
    for i in range(len(a)):
        lo = i + 1 if b is None else len(a)
        if lo >= len(every):
            break
        bound = np.abs(counts[:, lo:] - counts[:, i : i + 1]).sum(0)
        near = np.flatnonzero(bound <= bits) + lo
        near = near[np.bitwise_count(every[near] ^ every[i]) <= bits]
        for j in near.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def links(points: DataFrame, bits: int = 3, groups: int = 6) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that connect exactly what
    the links within ``bits`` connect. ``points``: fp, distinct."""
    masks = cell_masks(groups, bits)

    @lean
    def cells(batches):
        salt = [np.uint64((i * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)) for i in range(len(masks))]
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            counts = segment_counts(fp)
            keys = []
            for m, s in zip(masks, salt, strict=True):
                with np.errstate(over="ignore"):
                    k = (counts & np.uint64(m)) * np.uint64(0xBF58476D1CE4E5B9) + s
                    k = (k ^ (k >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                keys.append(k ^ (k >> np.uint64(32)))
            yield pa.RecordBatch.from_pydict(
                {"cell": pa.array(np.concatenate(keys).view(np.int64)), "fp": pa.array(np.tile(fp, len(masks)).view(np.int64))}
            )

    celled = stored(points.select("fp").mapInArrow(cells, "cell long, fp long"), "cells")
    size = celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    # Most shared cells hold two fingerprints: those need no more than one comparison.
    far = lambda m: F.abs(F.bit_count(F.col("lo").bitwiseAND(F.lit(m))) - F.bit_count(F.col("hi").bitwiseAND(F.lit(m))))
    quarter = [np.array(0xFFFF << s, dtype=np.uint64).view(np.int64).item() for s in (0, 16, 32, 48)]
    two = size.where("n = 2").where(sum((far(m) for m in quarter), F.lit(0)) <= bits)
    two = two.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= bits).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    # Larger cells are dealt to blocks of bounded size and compared block by block.
    many = size.where("n > 2").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = celled.join(many, "cell").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("x"), F.greatest(o, "mine").alias("y")))
    rows = rows.select("cell", "fp", "mine", F.explode(pairs).alias("pair")).select("cell", "fp", "mine", "pair.x", "pair.y")
    packed = rows.groupBy("cell", "x", "y").agg(
        F.collect_list(F.when(F.col("mine") == F.col("x"), F.col("fp"))).alias("a"),
        F.collect_list(F.when(F.col("mine") != F.col("x"), F.col("fp"))).alias("b"),
    )

    @lean
    def compare(batches):
        for batch in batches:
            src, dst = [], []
            same = (batch.column("x").to_numpy() == batch.column("y").to_numpy()).tolist()
            for diagonal, a, b in zip(same, batch.column("a"), batch.column("b"), strict=True):
                p = a.values.to_numpy().view(np.uint64)
                q = None if diagonal else b.values.to_numpy().view(np.uint64)
                every = p if q is None else np.concatenate([p, q])
                for i, j in forest(p, q, bits):
                    src.append(every[i])
                    dst.append(every[j])
            yield pa.RecordBatch.from_pydict({n: pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for n, v in (("src", src), ("dst", dst))})

    return two.unionByName(packed.mapInArrow(compare, "src long, dst long"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst: longs): every vertex with the
    smallest vertex of its component, by alternating large-star and small-star
    rounds over stored tables."""
    edges = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    now = sign(edges)
    for _ in range(rounds):
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        small_least = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(small_least, "src")
        small = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        edges = stored(small.unionByName(small_least.select("src", F.col("m").alias("dst"))).distinct(), "edges")
        after = sign(edges)
        if after == now:
            break
        now = after
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """Every document with its fingerprint and component.

    Documents link when their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest doc_id reachable. Null or wordless texts have
    fingerprint zero and link like any other. Rows with a null doc_id are kept
    and count as copies, but give no component its id unless all are null.
    Repeated ids are one vertex per fingerprint. Returns doc_id, fp (long),
    component_id; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words, seed), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    root = components(links(reps, bits))
    # a component's root is a fingerprint; its id is the smallest rep among its members
    member = reps.join(root, reps["fp"] == root["vertex"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose texts (key, text) have word shingles of at
    least this Jaccard similarity; two texts without words are alike."""

    @lean
    def run(batches):
        def shingles(text: str) -> set:
            w = text.encode().lower().split()
            return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

        for b in batches:
            ok, prior, t = [], None, set()
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                s, t = shingles(x or ""), t if y == prior else shingles(y or "")
                prior, both = y, len(s & t)
                ok.append(both >= similarity * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("src", "dst")}).filter(pa.array(ok, pa.bool_()))

    named = pairs.select(F.col("src").alias("key")).unionByName(pairs.select(F.col("dst").alias("key")))
    held = stored(picked(texts.select("key", "text"), named, "key").dropDuplicates(["key"]), "texts")
    both = pairs.join(held.select(F.col("key").alias("src"), F.col("text").alias("a")), "src").join(held.select(F.col("key").alias("dst"), F.col("text").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def texts_of(texts: DataFrame) -> DataFrame:
    """Rows as ``shingled`` takes them."""
    return texts.select("key", F.coalesce("text", F.lit("")).alias("text"))


def shingled(batches, words: int):
    """(keys, sizes, hashes) of each batch of rows (key, text): the distinct shingles
    of every text as ``similar`` sees them, hashed and sorted by hash.

    Called inside the function that uses them: as a mapInArrow of its own it would
    take a second Python worker a task, and all hashes through the JVM.
    """
    from xxhash import xxh64_intdigest

    seen: dict[str, int] = {}
    for b in batches:
        offsets, codes, words_ = chunks(pc.ascii_trim_whitespace(pc.ascii_lower(b.column("text"))))
        h = np.array(named(words_, xxh64_intdigest, seen), dtype=np.uint64)[codes]
        out = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            n = max(1, hi - lo - words + 1)
            k = np.full(n, min(words, hi - lo), dtype=np.uint64)
            for i in range(min(words, hi - lo)):
                k = k * np.uint64(0x9E3779B97F4A7C15) + h[lo + i : lo + i + n]
            with np.errstate(over="ignore"):
                k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(np.unique(k ^ (k >> np.uint64(29))))
        if out:
            yield b.column("key").to_numpy(), np.array([len(x) for x in out], dtype=np.int64), np.concatenate(out)


def _by_bucket(flat: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Hashes by bucket: their order, buckets, low 40 bits, and the runs of a bucket."""
    of = ((flat >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(of, kind="stable")
    of, raw = of[order], flat[order].view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return order, of, raw, list(zip(cuts[:-1], cuts[1:]))


def _hashes(table: pa.Table) -> np.ndarray:
    raw = np.frombuffer(b"".join(table.column("shingle").to_pylist()), dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def frequent(texts: DataFrame, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (40 bits of the) shingles that stand in three or more of every
    ``ONE_OF``-th text, and in how many; the ``FREQUENT`` most frequent of them."""

    @lean
    def run(batches):
        parts, total = [], 0

        def deal():
            _, of, raw, cuts = _by_bucket(np.concatenate(parts), buckets)
            return pa.RecordBatch.from_pydict({"bucket": pa.array(of[[a for a, _ in cuts]].astype(np.int32)), "shingle": pa.array([raw[a:b].tobytes() for a, b in cuts], pa.binary())})

        for _, _, flat in shingled(batches, words):
            parts.append(flat)
            total += len(flat)
            if total >= GATHER:
                yield deal()
                parts, total = [], 0
        if total:
            yield deal()

    @lean
    def count(table: pa.Table) -> pa.Table:
        flat, n = np.unique(_hashes(table), return_counts=True)
        kept = n > 2
        return pa.table({"shingle": pa.array(flat[kept].view(np.int64)), "n": pa.array(n[kept])})

    some = texts_of(texts.where(F.pmod(F.xxhash64("key"), F.lit(ONE_OF)) == 0))
    counted = some.mapInArrow(run, "bucket int, shingle binary").groupBy("bucket").applyInArrow(count, "shingle long, n long")
    often = stored_alone(counted, "frequent").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas().groupby("shingle")["n"].max()
    return often.index.to_numpy(np.int64), often.to_numpy(np.int64)


def prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(shingle, key, n, pos, texts): the first shingles of every text, so many that
    two texts of the similarity must share one (the prefix filter, exact), as far
    as more than one text has them, and how many texts have them.

    That holds for any order all texts share. Here ``frequent`` shingles come
    last, so that common lines head few texts; which ones are known to be frequent
    moves the cost, never the result. Rows travel once, packed by a hash of the
    shingle (40 bits: unlike shingles that meet are told apart by ``similar``).
    """
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = int(chars // BUCKET) + lanes(texts.sparkSession)
    held = texts.sparkSession.sparkContext.broadcast(frequent(texts, words, buckets))

    def deal(parts):
        flat, key, n, pos = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order, of, raw, cuts = _by_bucket(flat, buckets)
        column = lambda x: pa.array([planes(x[a:b]) for a, b in cuts], pa.binary())
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(of[[a for a, _ in cuts]].astype(np.int32)),
                "shingle": pa.array([raw[a:b].tobytes() for a, b in cuts], pa.binary()),
                "key": column(key[order]), "n": column(n[order]), "pos": column(pos[order]),
            }
        )

    @lean
    def run(batches):
        common, times = held.value
        parts, total = [], 0
        for keys, size, flat in shingled(batches, words):
            flat, doc = flat.view(np.int64), np.repeat(np.arange(len(size)), size)
            count = np.zeros(len(flat), dtype=np.int64)
            if len(common):
                low = flat & ((1 << 40) - 1)
                at = np.minimum(np.searchsorted(common, low), len(common) - 1)
                count = np.where(common[at] == low, times[at], 0)
            order = np.lexsort((flat, count, doc))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            kept = np.flatnonzero(pos < first[doc])
            of = doc[kept]
            parts.append((flat[order][kept].view(np.uint64), keys[of], size[of].astype(np.int32), pos[kept].astype(np.int32)))
            total += len(kept)
            if total >= GATHER:
                yield deal(parts)
                total = 0
        if total:
            yield deal(parts)

    @lean
    def shared(table: pa.Table) -> pa.Table:
        """Rows whose shingle stands in two different texts or more."""
        flat = _hashes(table)
        order = np.argsort(flat)
        flat = flat[order]
        same = flat[1:] == flat[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order, flat = order[kept], flat[kept]
        key, n, pos = (np.concatenate([unplanes(x, t) for x in table.column(c).to_pylist()])[order] for c, t in (("key", "<i8"), ("n", "<i4"), ("pos", "<i4")))
        order = np.lexsort((key, flat))
        flat, key, n, pos = flat[order], key[order], n[order], pos[order]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (key[1:] != key[:-1])])[: len(flat)]  # equal texts are one
        flat, key, n, pos = flat[new], key[new], n[new], pos[new]
        same = flat[1:] == flat[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(flat) else new
        flat, key, n, pos = flat[kept], key[kept], n[kept], pos[kept]
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        return pa.table({"shingle": pa.array(flat.view(np.int64)), "key": pa.array(key), "n": pa.array(n), "pos": pa.array(pos), "texts": pa.array(times[at])})

    packed = texts_of(texts).mapInArrow(run, "bucket int, shingle binary, key binary, n binary, pos binary")
    return packed.groupBy("bucket").applyInArrow(shared, "shingle long, key long, n int, pos int, texts long")


def overlap_possible(similarity: float, n, pos, m, at, least):
    """Whether texts of n and m shingles whose first shared ones are at ``pos``
    and ``at`` can still reach the similarity (columns or arrays alike)."""
    return least(n - pos, m - at) * (1 + similarity) + 1e-6 >= similarity * (n + m)


def prefix_pairs(shared: DataFrame, roots: DataFrame, similarity: float, block: int = 4096) -> DataFrame:
    """(src, dst): every two texts of different roots that share a prefix shingle
    and can reach the similarity, compared in blocks of bounded size."""
    named = shared.select("shingle", "key", "n", "pos").distinct().join(roots.select(F.col("vertex").alias("key"), "root"), "key", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "key")), "rooted")
    many = named.groupBy("shingle").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    rows = named.join(many, "shingle").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("x"), F.greatest(o, "mine").alias("y")))
    rows = rows.select("shingle", F.struct("key", "root", "n", "pos").alias("p"), F.explode(both).alias("pair"))
    packed = rows.groupBy("shingle", "pair.x", "pair.y").agg(F.collect_list("p").alias("p"))

    @lean
    def compare(batches):
        for batch in batches:
            for p in batch.column("p"):
                key, root, n, pos = (p.values.field(i).to_numpy() for i in range(4))
                for lo in range(0, len(key), 256):
                    hi = min(lo + 256, len(key))
                    ok = overlap_possible(similarity, n[lo:hi, None], pos[lo:hi, None], n[None], pos[None], np.minimum)
                    ok &= (root[lo:hi, None] != root[None]) & (key[lo:hi, None] > key[None])
                    i, j = np.nonzero(ok)
                    if len(i):
                        yield pa.RecordBatch.from_pydict({"src": pa.array(key[lo + i]), "dst": pa.array(key[j])})

    return packed.mapInArrow(compare, "src long, dst long").distinct()


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 3) -> DataFrame:
    """The documents without their copies: of each group, whole, the row of
    smallest doc_id (of rows with that id the text of smallest hash).

    Documents with equal texts are one vertex, whatever their ids; an id on
    unlike texts is a document for each. Two link if their word shingles have
    the Jaccard similarity. First tried are the links of the fingerprints of the
    *set* of words within ``bits`` bits (few changed words leave most of the set
    alone) and one document with the same prefix shingles; then every pair the
    prefix filter leaves between the groups so far, so that no link is lost.
    Null, empty and wordless texts are copies of each other. Rows without a
    doc_id can't be told apart and stay. An empty table gives no rows; other
    columns stay as they are.
    """
    with recorded() as written:
        found, repeated = _first_of_each(docs, words, similarity, bits)
    remove(written[:-1])  # only ``found`` is read again
    names = list(docs.columns)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    who, where = F.col(f"c{names.index('doc_id')}"), F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    mine = F.xxhash64(where, F.length(where))
    kept = inner.join(found, (who.cast("long") == F.col("rep")) & (mine == F.col("least")), "left_semi")
    if repeated:  # rows alike in id and text: one stays
        every = [F.col(c) for c in inner.columns]
        kept = kept.groupBy(who.cast("long").alias("id"), mine.alias("hash")).agg(F.first(F.struct(*every)).alias("row")).select("row.*")
    return kept.unionByName(inner.where(who.isNull())).toDF(*names)


def _first_of_each(docs: DataFrame, words: int, similarity: float, bits: int) -> tuple[DataFrame, bool]:
    """(rep, least): doc_id and text hash of the document that stays of each group,
    and whether rows repeat in both."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.length(F.coalesce(F.col("text"), F.lit(""))))
    named = docs.where(F.col("doc_id").isNotNull())
    prints = fingerprints(named.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")).alias("doc_id"), "text"), 1, repeats=False, keep=True)
    rows = stored(prints.select("doc_id.doc_id", "doc_id.key", "fp"), "fingerprints")
    points = stored(rows.groupBy("key", "fp").agg(F.min("doc_id").alias("rep")), "points")
    texts = named.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    shared = stored_alone(prefixes(texts, words, similarity), "shared")
    # Of a large group the text whose shingles most others have is likely similar
    # to all of them: it heads its shingles, and each text tries its commonest head.
    known = shared.groupBy("key").agg(F.sum("texts").alias("known"))
    head = shared.join(known, "key").groupBy("shingle").agg(F.max_by(F.struct("key", "n", "pos"), F.struct("known", "key")).alias("head"))
    possible = overlap_possible(similarity, F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos"), F.least)
    star = shared.join(head, "shingle").where(possible & (F.col("key") != F.col("head.key"))).groupBy("key", F.col("head.key").alias("head")).agg(F.count("*").alias("n"))
    star = star.groupBy("key").agg(F.max_by("head", F.struct("n", "head")).alias("head")).select(F.greatest("key", "head").alias("src"), F.least("key", "head").alias("dst"))
    first = stored(points.groupBy("fp").agg(F.min("key").alias("key")), "first")
    alike = points.join(first.withColumnRenamed("key", "least"), "fp").where("key <> least").select(F.col("key").alias("src"), F.col("least").alias("dst"))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("key").alias(f"{end}_key"))
    near = links(first, bits).join(of("src"), "src").join(of("dst"), "dst").select(F.greatest("src_key", "dst_key").alias("src"), F.least("src_key", "dst_key").alias("dst"))
    pairs = stored(near.unionByName(alike).unionByName(star).distinct(), "candidates")
    linked = stored(similar(pairs, texts, words, similarity), "linked")
    rest = stored(prefix_pairs(shared, components(linked), similarity), "candidates")
    if not rest.isEmpty():
        linked = linked.unionByName(similar(rest, texts, words, similarity))
    root = components(linked)
    member = points.join(root, points["key"] == root["vertex"], "left").select("rep", "key", F.coalesce("root", "key").alias("root"))
    repeated = not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    found = member.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("of")).select(F.col("of.rep").alias("rep"), F.col("of.key").alias("least"))
    return stored(found, "found"), repeated
