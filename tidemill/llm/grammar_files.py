"""Token-id files compressed by Re-Pair grammars, readable at random.

A shard holds consecutive documents. Frequent id pairs are replaced by
nonterminals, round after round; pairs never cross a document's end. The shard
stores the rules, the length each nonterminal expands to, the documents' symbol
and id offsets, and the symbols in 2 bytes where they fit (4 otherwise). One row
of a Parquet table carries one shard: Spark commits such files atomically on any
store, so a lost executor leaves no half-written shard.

Image (little-endian): ``TMRP``, u16 version, u16 symbol bytes, u32 base,
u32 rules, u32 rounds, u32 documents, u64 symbols, u64 ids; then u32 round ends,
u32 left, u32 right, u32 expansion lengths, i64 doc_ids, u8 doc_id nulls,
u64 symbol offsets, u64 id offsets, symbols.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_ids, hold, lean, partition_id, spread, stored, tune
from .tokens import encode_with_end

HEAD = struct.Struct("<4sHHIIIIQQ")
SHARDS = "part int, shard int, n_docs long, n_ids long, image binary"


def repair(ids: np.ndarray, ends: np.ndarray, base: int, max_rules: int, rounds: int = 4, least: int = 8):
    """Replace frequent pairs. ``ends`` marks the last symbol of each document.

    Every round counts all pairs in a table of 2^18 buckets (one candidate pair a
    bucket) and replaces the most frequent pairs at once, left to right. Returns
    symbols, ends, left, right and the number of rules after each round.
    """
    sym, stops = ids.astype(np.uint32), np.flatnonzero(ends)
    left, right, marks, n = [], [], [], 0
    # a pair takes 4 bytes where all symbols fit in 2; one array serves all rounds' buckets
    half, key = (16, np.uint32) if base + max_rules <= 1 << 16 else (32, np.uint64)
    none, buckets = 1 << 18, np.empty(len(sym), dtype=np.int64)
    for turn in range(rounds):
        if len(sym) < 2 or n >= max_rules:
            break
        bucket = buckets[: len(sym) - 1]
        bucket[:] = ((sym[:-1] * np.uint32(0x9E3779B1)) ^ (sym[1:] * np.uint32(0x85EBCA77))) >> np.uint32(14)
        pair = sym[:-1].astype(key) << key(half) | sym[1:]
        held = np.zeros(none, dtype=key)
        held[bucket] = pair
        np.copyto(bucket, none, where=held.take(bucket) != pair)
        bucket[stops[stops < len(bucket)]] = none
        count = np.bincount(bucket, minlength=none + 1)[:none]
        room = min(max_rules - n, -(-(max_rules - n) // (rounds - turn)))
        top = np.flatnonzero(count >= least)
        if len(top) > room:
            top = top[np.argpartition(-count[top], room - 1)[:room]]
        if not len(top):
            break
        name = np.zeros(none + 1, dtype=np.uint32)
        name[top] = base + n + np.arange(len(top), dtype=np.uint32)
        got = name.take(bucket)
        at = np.flatnonzero(got != 0)
        # of a run of overlapping matches, every second one starting with the first
        later = np.flatnonzero(np.diff(at, prepend=-2) == 1)
        nth = np.arange(len(later))
        begins = np.where(np.diff(later, prepend=-2) != 1, nth, 0)
        chosen = np.ones(len(at), dtype=bool)
        chosen[later[(nth - np.maximum.accumulate(begins)) % 2 == 0]] = False
        at = at[chosen]
        sym[at] = got[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, stops = sym[keep], stops - np.searchsorted(at, stops)
        left.append((held[top] >> key(half)).astype(np.uint32))
        right.append((held[top] & key((1 << half) - 1)).astype(np.uint32))
        n += len(top)
        marks.append(n)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.uint32)
    last = np.zeros(len(sym), dtype=bool)
    last[stops] = True
    return sym, last, cat(left), cat(right), np.array(marks, dtype=np.uint32)


def lengths_of(left: np.ndarray, right: np.ndarray, marks: np.ndarray, base: int) -> np.ndarray:
    """Ids each nonterminal expands to."""
    size, at = np.ones(len(left), dtype=np.uint32), 0
    of = lambda s: np.where(s < base, 1, size[np.maximum(s.astype(np.int64) - base, 0)])
    for end in marks.tolist():
        size[at:end] = of(left[at:end]) + of(right[at:end])
        at = end
    return size


def write_image(ids: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, base: int) -> bytes:
    """One shard from the ids of its documents (each with at least its end id)."""
    ends = np.zeros(len(ids), dtype=bool)
    ends[offsets[1:] - 1] = True
    room = 65536 - base if base < 60000 else 16384
    sym, last, left, right, marks = repair(ids, ends, base, room)
    width = 2 if base + len(left) <= 65536 else 4
    where = np.concatenate([[0], np.flatnonzero(last) + 1])
    head = HEAD.pack(b"TMRP", 1, width, base, len(left), len(marks), len(doc_ids), len(sym), len(ids))
    sizes = lengths_of(left, right, marks, base)
    parts = (marks, left, right, sizes, doc_ids.astype("<i8"), nulls.astype("u1"), where.astype("<u8"), offsets.astype("<u8"))
    return head + b"".join(x.tobytes() for x in parts) + sym.astype(f"<u{width}").tobytes()


class Shard:
    """A shard image; documents or id ranges decode without the rest."""

    def __init__(self, image: bytes):
        magic, _, width, self.base, rules, rounds, docs, symbols, self.n_ids = HEAD.unpack_from(image)
        if magic != b"TMRP":
            raise ValueError("not a token-id shard")
        at = HEAD.size

        def read(kind, n):
            nonlocal at
            out = np.frombuffer(image, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.marks, self.left, self.right, self.sizes = (read("<u4", n) for n in (rounds, rules, rules, rules))
        self.doc_ids, self.nulls = read("<i8", docs), read("u1", docs).astype(bool)
        self.symbol_at, self.id_at = read("<u8", docs + 1).astype(np.int64), read("<u8", docs + 1).astype(np.int64)
        self.symbols = read(f"<u{width}", symbols)

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of every symbol, plain ids being their own, one symbol after another:
        where each begins, how many they are, and the ids."""
        size = np.concatenate([np.ones(self.base, dtype=np.int64), self.sizes])
        begin = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), dtype=np.uint32)
        ids[: self.base] = np.arange(self.base)
        lo = 0
        for hi in self.marks.tolist():  # a round's rules are made of earlier symbols
            parts = np.stack([self.left[lo:hi], self.right[lo:hi]], axis=1).ravel()
            made = ids[spread(begin[parts], size[parts])]
            at = begin[self.base + lo]
            ids[at : at + len(made)] = made
            lo = hi
        return begin, size, ids

    def expand(self, sym: np.ndarray) -> np.ndarray:
        begin, size, ids = self.expansions
        return ids.take(spread(begin.take(sym), size.take(sym)))

    def document(self, n: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_at[n] : self.symbol_at[n + 1]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard: finds the document by its id offset and
        the symbols by their expansion lengths, and expands only those."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        d0 = int(np.searchsorted(self.id_at, start, side="right")) - 1
        d1 = int(np.searchsorted(self.id_at, stop, side="left"))
        sym = self.symbols[self.symbol_at[d0] : self.symbol_at[d1]].astype(np.int64)
        size = np.where(sym < self.base, 1, self.sizes[np.maximum(sym - self.base, 0)] if len(self.sizes) else 1).astype(np.int64)
        at = self.id_at[d0] + np.cumsum(size) - size
        a, b = int(np.searchsorted(at, start, side="right")) - 1, int(np.searchsorted(at, stop, side="left"))
        return self.expand(sym[a:b])[start - at[a] : stop - at[a]]


def _shards(path: str, end_id: int, base: int, shard_ids: int):
    @lean
    def run(batches):
        hold()
        part, shard, held, size = partition_id(), 0, [], 0

        def flush():
            nonlocal shard, held, size
            ids = np.concatenate([h[0] for h in held])
            lens = np.concatenate([h[1] for h in held])
            offsets = np.concatenate([[0], np.cumsum(lens)])
            image = write_image(ids, offsets, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), base)
            out = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "shard": pa.array([shard], pa.int32()),
                    "n_docs": pa.array([len(lens)], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "image": pa.array([image], pa.binary()),
                }
            )
            shard, held, size = shard + 1, [], 0
            return out

        for b, ids, offsets in encode_with_end(path, (b for b in batches if b.num_rows), end_id):
            doc = b.column("doc_id")
            held.append((ids, np.diff(offsets), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)))
            size += len(ids)
            if size >= shard_ids:
                yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, base: int = 49408, shard_ids: int = 1 << 19) -> DataFrame:
    """Encode whole texts, close each with ``end_id`` and write shards in ascending
    doc_id order (null first; repeated ids in the order of their text's hash).

    A null or empty text is the end id alone. Returns the written shard table:
    part (ascending ranges of doc_id), shard (ascending within part), n_docs,
    n_ids, image.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(_shards(tokenizer_path, end_id, base, shard_ids), SHARDS), "token-files")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Decode every document of the shards: doc_id, start (ids before it in the
    whole order), n_tokens, ids_crc32. No shards give no rows."""
    tune(shards.sparkSession)

    @lean
    def decode(batches):
        hold()
        for b in batches:
            for part, shard, image in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("image"), strict=True):
                s = Shard(image.as_buffer())
                # whole documents of a shard in one expansion; a document's ids are a slice of it
                ids = s.expand(s.symbols)
                n = len(s.doc_ids)
                cut = s.id_at.tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(n, part), pa.int32()),
                        "shard": pa.array(np.full(n, shard), pa.int32()),
                        "doc_id": pa.array(s.doc_ids, mask=s.nulls),
                        "local": pa.array(s.id_at[:-1]),
                        "n_tokens": pa.array(np.diff(s.id_at)),
                        "ids_crc32": pa.array([crc_ids(ids[x:y]) for x, y in zip(cut, cut[1:])], pa.int64()),
                    }
                )

    rows = shards.select("part", "shard", "image").mapInArrow(
        decode, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    sizes = shards.select("part", "shard", "n_ids")
    # one row per range partition meets in one task, never one per shard or document
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("of_shard")).join(parts, "part")
    return rows.join(at, ["part", "shard"]).select(
        "doc_id", (F.col("of_part") + F.col("of_shard") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
