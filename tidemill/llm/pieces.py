"""SentencePiece encoding and decoding over a relational lattice of pieces.

The lattice of a word is the equi-join of its substrings of bounded length with
the piece table. For a BPE model the best path is not the one of highest total
score, so the fold over a word's lattice does not take the Viterbi step: it takes,
from the best score down and leftmost first, each edge that joins two neighbours,
which is the library's result, as a piece always scores below the two it is made
of.

Two forms: ``encode_words`` is plain Spark (explode, equi-join, group, fold with
``aggregate``; a word's boundaries are the bits of one number) and serves word
tables; ``encode_documents`` does the same joins and folds with numpy for the
distinct words of an Arrow batch, because the distinct words of a corpus are too
many for the former (README has the figures).
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_ids, lean, spread, strings, tune

SPACE = "▁"
#: Longer words go through a heap (the bits of a number bound ``encode_words``);
#: words a worker remembers, the first it meets.
LONG, CACHE = 48, 300_000
BITS = 61
#: Characters folded at once; bits of a key by which its piece is looked for; no join.
CHARS, SLOTS, NONE = 1 << 18, 18, 2**31 - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceModel:
    """The piece table of a model file: text, score, id; ids of bytes; bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [i for i in range(n) if m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)]
        self.table = [(m.id_to_piece(i), m.get_score(i), i) for i in range(n) if i not in set(special)]
        self.byte_ids = {int(m.id_to_piece(i)[1:-1], 16): i for i in special if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.longest = max(len(p) for p, _, _ in self.table)
        self.by_text = {p: (s, i) for p, s, i in self.table}
        keys = np.array([self._key(p) for p, _, _ in self.table], dtype=np.uint64) * _P
        order = np.argsort(keys)
        # one more row, behind all, stands for no piece
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.ids = np.append(np.array([i for _, _, i in self.table], dtype=np.int64)[order], -1)
        scores = np.array([s for _, s, _ in self.table])[order]
        self.cost = np.append(np.unique(-scores, return_inverse=True)[1], NONE).astype(np.int32)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS))
        out = [b""] * n
        for p, _, i in self.table:
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_len = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.seen: dict[str, bytes] = {}

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c)) & (2**64 - 1)
        return h

    def spell(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or unknown."""
        return [self.byte_ids.get(b, self.unknown) for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash: the equi-join of substrings with the piece table,
        by the first piece with the key's highest bits and a few steps on."""
        key = (hashes * _P).ravel()
        at = self.first.take((key >> np.uint64(64 - SLOTS)).astype(np.int64))
        found = self.keys.take(at)
        late = np.flatnonzero(found < key)
        while len(late):
            at[late] += 1
            found[late] = self.keys.take(at[late])
            late = late[found[late] < key[late]]
        at[found != key] = len(self.ids) - 1
        return at.reshape(hashes.shape)

    def fold(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each word: explode, join, group, fold, for the words
        of each length together."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        cp = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
        begin = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        out: list[bytes] = [b""] * len(words)
        for n, first, many in zip(*(x.tolist() for x in np.unique(size[order], return_index=True, return_counts=True)), strict=True):
            step = max(1, CHARS // max(1, n))
            for lo in range(first, first + many if n else 0, step):
                part = order[lo : min(lo + step, first + many)]
                for i, ids in zip(part.tolist(), self._fold_equal(cp[begin[part][:, None] + np.arange(n)]), strict=True):
                    out[i] = ids
        return out

    def _fold_equal(self, cp: np.ndarray) -> list[bytes]:
        """The fold of words of one length, a row of characters each. Columns 0 and
        ``size + 1`` stand beside the word: they join nothing."""
        count, size = cp.shape
        wide, most = size + 2, min(size, self.longest)
        # explode substrings of bounded length, equi-join them with the pieces
        piece = np.full((most + 2, count, wide), len(self.ids) - 1, dtype=np.int32)
        h = np.zeros((count, size + 1), dtype=np.uint64)
        for n in range(1, most + 1):
            h = h[:, :-1] * _P + cp[:, n - 1 :]
            piece[n, :, 1 : size + 2 - n] = self.rows(h)
        # group by word and fold: one join of neighbours a word and round
        flat, layer = piece.ravel(), count * wide
        end = np.tile(np.arange(1, wide + 1), count)
        end[wide - 1 :: wide] = wide + most  # too far for any piece
        before = np.tile(np.arange(-1, wide - 1), count)
        live = np.ones((count, wide), dtype=bool)
        live[:, [0, -1]] = False
        live = live.ravel()
        cost = np.full((count, wide), NONE, dtype=np.int32)
        if most > 1:
            cost[:, 1:size] = self.cost.take(piece[2, :, 1:size])
        row = np.arange(count) * wide  # where the words still folded begin
        while len(row):
            here = np.arange(len(row))
            at = cost.argmin(axis=1)  # the leftmost of the best
            going = cost[here, at] < NONE
            if not going.all():
                cost, row, at = cost[going], row[going], at[going]
                here = here[: len(row)]
            left = row + at
            mid = end.take(left)
            stop = end.take(row + mid)
            end[left] = stop
            before[row + stop] = at
            live[row + mid] = False
            cost[here, mid] = NONE
            span = np.minimum(end.take(row + stop) - at, most + 1)
            cost[here, at] = self.cost.take(flat.take(span * layer + left))
            at = before.take(left)
            span = np.minimum(stop - at, most + 1)
            cost[here, at] = self.cost.take(flat.take(span * layer + row + at))
        begin = np.flatnonzero(live)
        owner = begin // wide
        ids = self.ids.take(flat.take((end.take(begin) - begin % wide) * layer + begin))
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            spelt = [self.spell(chr(c)) for c in cp[owner[lone], begin[lone] % wide - 1].tolist()]
            reps = np.ones(len(ids), dtype=np.int64)
            reps[lone] = [len(x) for x in spelt]
            odd = np.repeat(ids < 0, reps)
            owner, ids = np.repeat(owner, reps), np.repeat(ids, reps)
            ids[odd] = [y for x in spelt for y in x]
        cut = (np.searchsorted(owner, np.arange(count + 1)) * 4).tolist()
        raw = ids.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def fold_long(self, word: str) -> bytes:
        """The same fold for one long word, with a heap of joinable neighbours."""
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end, live, heap = list(range(1, n + 1)), [True] * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= self.longest:
                got = self.by_text.get(word[i : end[j]])
                if got:
                    heapq.heappush(heap, (-got[0], i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not live[i] or end[i] != mid or mid >= n or not live[mid] or end[mid] != stop:
                continue
            live[mid], end[i], after[i] = False, stop, after[mid]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out = []
        for i in range(n):
            if live[i]:
                got = self.by_text.get(word[i : end[i]])
                out += [got[1]] if got else self.spell(word[i])
        return np.array(out, dtype="<i4").tobytes()

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words with their leading spaces: offsets, codes, distinct words."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), pc.equal(texts, ""))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat = lists.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = [SPACE + w for w in strings(flat.dictionary)]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(strange):
            return offsets - offsets[0], codes, words
        names, parts, size = {w: i for i, w in enumerate(words)}, np.split(codes, offsets[1:-1] - offsets[0]), []
        for i in strange.tolist():
            text = texts[i].as_py()
            units = _UNIT.findall((SPACE + text).replace(" ", SPACE)) if text else []
            parts[i] = np.array([names.setdefault(u, len(names)) for u in units], dtype=np.int64)
        size = [len(p) for p in parts]
        return np.concatenate([[0], np.cumsum(size)]), np.concatenate(parts), list(names)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch and the offsets of each text in them."""
        if not len(texts):
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        offsets, codes, words = self._units(texts)
        parts = list(map(self.seen.get, words))
        fresh = [i for i, ids in enumerate(parts) if ids is None]
        short = [i for i in fresh if len(words[i]) <= LONG]
        for i, ids in zip(short, self.fold([words[i] for i in short]), strict=True):
            parts[i] = ids
        for i in fresh:
            if len(words[i]) > LONG:
                parts[i] = self.fold_long(words[i])
        self.seen.update((words[i], parts[i]) for i in fresh[: max(CACHE - len(self.seen), 0)])
        lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), dtype="<i4")
        each = lens[codes]
        at = np.concatenate([[0], np.cumsum(each)])
        return flat[spread((np.cumsum(lens) - lens)[codes], each)], at[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; the space put before its first word is taken off."""
        each = self.out_len[ids]
        raw = self.out[spread(self.out_at[ids], each)].tobytes()
        at = np.concatenate([[0], np.cumsum(each)])[offsets].tolist()
        return [raw[a:b].removeprefix(b" ") for a, b in zip(at[:-1], at[1:])]


_LOADED: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every whole text; a null or empty text has no ids.

    Repeated and null doc_ids are rows of their own; other columns are ignored;
    an empty table gives no rows.
    """
    tune(docs.sparkSession)

    @lean
    def run(batches):
        m = model(model_path)
        for b in batches:
            ids, offsets = m.encode(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": lists})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text): what the ids spell."""
    tune(encoded.sparkSession)

    @lean
    def run(batches):
        m = model(model_path)
        for b in batches:
            lists = b.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            cut = offsets.tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "n_ids": pa.array(np.diff(offsets)),
                    "ids_crc32": pa.array([crc_ids(ids[x:y]) for x, y in zip(cut, cut[1:])], pa.int64()),
                    "text": pa.array([t.decode("utf-8", "replace") for t in m.decode(ids, offsets)], pa.string()),
                }
            )

    return encoded.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")


def encode_words(words: DataFrame, model_path: str) -> DataFrame:
    """(word, ids) for a table of distinct words (with their ``▁``): explode,
    equi-join, group, fold. Null and empty words give no row.

    An edge is a piece found at [b, e) of a word; a character that is no piece is
    an edge without an id and is spelt in bytes, or as unknown.
    """
    m = model(model_path)
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(m.table, "piece string, score double, id int"))  # one row a piece of the file
    w = words.select("word").where(f"length(word) BETWEEN 1 AND {BITS}")
    spans = w.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("b"))
    most = F.least(F.lit(m.longest), F.length("word") - F.col("b"))
    spans = spans.select("word", "b", F.explode(F.sequence(F.lit(1), most)).alias("n"))
    edges = spans.select("*", F.substring("word", F.col("b") + 1, F.col("n")).alias("piece")).join(table, "piece", "left").where("id IS NOT NULL OR n = 1")
    edge = F.struct((-F.col("score")).alias("cost"), "b", (F.col("b") + F.col("n")).alias("e"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"))
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    within = lambda x: bit(x["e"]) - bit(x["b"] + 1)  # the boundaries inside an edge
    ends = lambda cut, x: (cut.bitwiseAND(bit(x["b"])) != 0) & (cut.bitwiseAND(bit(x["e"])) != 0)

    def step(cut, x):
        joins = ends(cut, x) & (F.bit_count(cut.bitwiseAND(within(x))) == 1)
        return F.when(joins, cut - cut.bitwiseAND(within(x))).otherwise(cut)

    whole = bit(F.length("word") + 1) - 1
    folded = lattice.select("word", "edges", F.aggregate("edges", whole, step).alias("cut"))
    cut = F.col("cut")
    kept = F.filter("edges", lambda x: ends(cut, x) & (cut.bitwiseAND(within(x)) == 0))
    ids = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["b"], x["id"]))), lambda x: x["id"])

    @lean
    def spelt(batches):
        for b in batches:
            lists = [[y for x in ids for y in ([x] if x >= 0 else m_of().spell(chr(-1 - x)))] if min(ids) < 0 else ids for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"word": b.column("word"), "ids": pa.array(lists, pa.list_(pa.int32()))})

    def m_of():
        return model(model_path)

    @lean
    def one_by_one(batches):
        for b in batches:
            ids = [np.frombuffer(m_of().fold_long(w), "<i4") for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_pydict({"word": b.column("word"), "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))})

    short = folded.select("word", ids.alias("ids")).mapInArrow(spelt, "word string, ids array<int>")
    return short.unionByName(words.select("word").where(f"length(word) > {BITS}").mapInArrow(one_by_one, "word string, ids array<int>"))
