"""Fuzzy passages shared by documents, by collinear chaining.

Seeds are all 5-word k-mers. Every seed links to its first occurrence (smallest
doc_id) and to the holder before (the next smaller doc_id), never each occurrence
to each, so a passage in a third of all documents costs two links a document.
Seeds and links travel as packed byte planes. The links of two documents are
chained in order with gap costs through a Fenwick tree. Chains that are a passage
by their seeds alone need no text; the others are aligned on the words
themselves, and what is aligned to earlier documents is joined to passages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lanes, lean, named, partition_id, picked, planes, stored, stored_alone, tune, unplanes

#: Words of a seed, words that end a run of one seed, least words and similarity
#: of a passage.
K, WINDOW, LEAST, SIMILAR = 5, 12, 50, 0.8
#: Characters of text whose seeds make a bucket; seeds gathered before they are dealt.
BUCKET, GATHER = 12_000_000, 2_000_000
#: Places of a seed among those gathered from which on it is linked there.
HOT = 64
#: Words of a source sent along at each side of a chain.
MARGIN = 32
#: Least words of a piece aligned to one document; cost of a skipped word;
#: unmatched words that end a piece.
PIECE, GAP_COST, BREAK = 12, 0.05, 16
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_SHAPE = "doc_id long, source_id long, t0 int, t1 int, s0 int, s1 int, matched int"


def _bare(word: str) -> str:
    return _EDGE.sub("", word).lower() or word


def _steps(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.int64(0)))


def _read(table: pa.Table, name: str, dtype: str, steps: bool = False) -> np.ndarray:
    parts = [unplanes(x, dtype) for x in table.column(name).to_pylist()]
    return np.concatenate([np.cumsum(x) if steps else x for x in parts] or [np.zeros(0, dtype)])


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; their list is empty then."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _number(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def pair_up(key, doc, pos, near):
    """Occurrences of seeds in order of seed, document and position, and links
    between them (indices t, f): every later document's with those of the first
    and of the one before. Also which occurrences are the first document's."""
    order = np.lexsort((pos, doc, key))
    key, doc, pos, near = key[order], doc[order], pos[order], near[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    new_run = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(key)]
    starts = np.flatnonzero(new_run)
    run_of = np.cumsum(new_run) - 1
    first = np.flatnonzero(new_key)[np.cumsum(new_key) - 1]
    is_first = doc == doc[first]
    later = np.flatnonzero(~is_first)
    before = starts[run_of[later] - 1]
    more = before != first[later]
    t, f = np.concatenate([later, later[more]]), np.concatenate([first[later], before[more]])
    return order, doc, pos, near, t, f, is_first


def _link_rows(doc, pos, near, t, f, buckets: int) -> dict[str, list]:
    """Links packed by bucket of the document. The two highest bits of s say
    whether the second words before and behind may be alike."""
    of = (doc[t] % buckets).astype(_number(buckets))
    order = np.lexsort((pos[t], doc[f], doc[t], of))
    t, f, of = t[order], f[order], of[order]
    unlike = near[t] ^ near[f]
    s = pos[f] | (unlike < 256).astype(np.uint32) << 30 | (unlike & 255 == 0).astype(np.uint32) << 31
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
    cuts = list(zip(cuts[:-1], cuts[1:]))
    out = {"bucket": [int(of[a]) for a, _ in cuts]}
    for name, x, pack in (("doc", doc[t], _steps), ("source", doc[f], _steps), ("t", pos[t], planes), ("s", s, planes)):
        out[name] = [pack(x[a:b]) for a, b in cuts]
    return out


_SEEDS = "bucket int, seed binary, doc binary, times binary, pos binary, near binary, source binary, t binary, s binary"


def seeds(docs: DataFrame, buckets: int) -> DataFrame:
    """Every k-mer of every document, dealt to buckets by its hash; a row packs 40
    bits of each hash (seed), the doc_ids (doc) with how many of the seeds are
    theirs (times), the positions, and a byte each of the second word before and
    the second word behind (near).

    Of a seed in HOT or more places of those gathered only the first document's go
    on; the others are linked here, as rows (doc, source, t, s) like those of
    ``link``. So what a bucket gets of a seed grows with the gathers, not with the
    documents that hold it.
    """
    tune(docs.sparkSession)
    number = _number(buckets)

    def deal(held):
        key, doc, pos, near = (_taken(c) for c in held)
        order = np.argsort(key)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        often = np.diff(np.append(begin, len(key)))
        hot = order[np.repeat(often >= HOT, often)]
        del begin, often
        links = {}
        if len(hot):
            order, *rest, t, f, is_first = pair_up(key[hot], doc[hot], pos[hot], near[hot])
            links = _link_rows(*rest, t, f, buckets)
            stay = np.ones(len(key), dtype=bool)
            stay[hot[order[~is_first]]] = False
            key, doc, pos, near = key[stay], doc[stay], pos[stay], near[stay]
        of = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(number)
        order = np.argsort(of, kind="stable")  # a radix sort on 16 bits
        of, key = of[order], key[order]
        doc = doc[order]
        pos, near = pos[order], near[order]
        del order
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        cuts = list(zip(cuts[:-1], cuts[1:]))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(doc))).astype(np.uint32)
        at = np.searchsorted(begin, [a for a, _ in cuts] + [len(doc)]).tolist()
        raw = key.view(np.uint8).reshape(-1, 8)[:, :5]
        out = {
            "bucket": of[[a for a, _ in cuts]].tolist(),
            "seed": [raw[a:b].tobytes() for a, b in cuts],
            "doc": [_steps(doc[begin[x:y]]) for x, y in zip(at[:-1], at[1:])],
            "times": [planes(times[x:y]) for x, y in zip(at[:-1], at[1:])],
            "pos": [planes(pos[a:b]) for a, b in cuts],
            "near": [near[a:b].astype("<u2").tobytes() for a, b in cuts],
        }
        names = ("bucket", "seed", "doc", "times", "pos", "near", "source", "t", "s")
        n, m = len(cuts), len(links.get("bucket", ()))
        cols = [out.get(c, [None] * n) + links.get(c, [None] * m) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if name == "bucket" else pa.binary()) for name, c in zip(names, cols)], names=list(names))

    @lean
    def run(batches):
        from xxhash import xxh64_intdigest

        held, n_held, hashed = ([], [], [], []), 0, {}
        for b in batches:
            offsets, codes, words = chunks(b.column("text"))
            if len(codes) < K:
                continue
            h = np.array(named(words, lambda w: xxh64_intdigest(_bare(w)), hashed), dtype=np.uint64)[codes]
            n = len(h) - K + 1
            key = np.zeros(n, dtype=np.uint64)
            for i in range(K):
                key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            key ^= key >> np.uint64(31)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
            doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            at = np.flatnonzero(doc[:n] == doc[K - 1 :])  # no seed reaches over a document's end
            if not len(at):
                continue
            bits = (h >> np.uint64(24) & np.uint64(255)).astype(np.uint16)
            left, right = np.maximum(at - 2, 0), np.minimum(at + K + 1, len(h) - 1)
            near = np.where(doc[left] == doc[at], bits[left], 0) << 8 | np.where(doc[right] == doc[at], bits[right], 0)
            for column, x in zip(held, (key[at], b.column("doc_id").to_numpy()[doc[at]], (at - offsets[doc[at]]).astype(np.uint32), near.astype(np.uint16))):
                column.append(x)
            n_held += len(at)
            if n_held >= GATHER:
                yield deal(held)
                n_held = 0
        if n_held:
            yield deal(held)

    return docs.select("text", "doc_id").mapInArrow(run, _SEEDS)


def link(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc, source, t, s): every seed of a document that a smaller doc_id
    holds too, with the first such document and the one just before, dealt to
    buckets by the document."""

    shape = ["bucket", "doc", "source", "t", "s"]

    @lean
    def run(table: pa.Table) -> pa.Table:
        ready = table.filter(pc.is_valid(table.column("source"))).select(shape)
        table = table.filter(pc.is_valid(table.column("seed")))
        raw = np.frombuffer(b"".join(table.column("seed").to_pylist()), dtype=np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), dtype=np.uint8)
        key[:, :5] = raw
        key = key.view("<u8").ravel()
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.concatenate([[False], same])[: len(key)] | np.concatenate([same, [False]])[: len(key)]  # most seeds stand alone
        order, key = order[shared], key[shared]
        owner = np.searchsorted(np.cumsum(_read(table, "times", "<u4").astype(np.int64)), order, side="right")
        doc = _read(table, "doc", "<i8", steps=True)[owner]
        pos = _read(table, "pos", "<u4")[order]
        near = np.frombuffer(b"".join(table.column("near").to_pylist()), dtype="<u2")[order]
        _, *rest, t, f, _ = pair_up(key, doc, pos, near)
        links = _link_rows(*rest, t, f, buckets)
        new = pa.table([pa.array(links[c], pa.int32() if c == "bucket" else pa.binary()) for c in shape], names=shape)
        return pa.concat_tables([ready.cast(new.schema), new])

    return found.groupBy("bucket").applyInArrow(run, "bucket int, doc binary, source binary, t binary, s binary")


def chain(tpos: np.ndarray, spos: np.ndarray) -> list[list[tuple[int, int]]]:
    """Best collinear chains of matches, disjoint, of at least two seeds (one, if
    it heads a run of the same seed).

    A match is worth K; going from one to the next costs GAP_COST for every word
    skipped on either side. The best predecessor of smaller source position comes
    from a Fenwick tree of prefix maxima, matches being added by target position.
    """
    order = np.lexsort((spos, tpos))
    t, s = tpos[order].tolist(), spos[order].tolist()
    rank = {v: i + 1 for i, v in enumerate(sorted(set(s)))}
    size = len(rank)
    tree = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * len(t), [-1] * len(t)
    i = 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] == t[i]:  # equal target positions can't follow each other
            at, best, whence = rank[s[j]] - 1, -1e18, -1
            while at > 0:
                if tree[at][0] > best:
                    best, whence = tree[at]
                at &= at - 1
            gain = best - GAP_COST * (t[j] + s[j])
            score[j] = K + max(gain, 0.0)
            back[j] = whence if gain > 0 else -1
            j += 1
        for m in range(i, j):
            entry, at = (score[m] + GAP_COST * (t[m] + s[m]), m), rank[s[m]]
            while at <= size:
                if entry[0] > tree[at][0]:
                    tree[at] = entry
                at += at & -at
        i = j
    used, out, single = [False] * len(t), [], []
    for end in sorted(range(len(t)), key=lambda x: -score[x]):
        path, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            path.append((t[at], s[at]))
            at = back[at]
        if len(path) > 1:
            out.append(path[::-1])
        elif path:
            single.append(path[0])
    # A run of one word over and over is one seed again and again, which can't
    # chain: the head of each such run stands for it, and aligning extends it.
    heads: dict[int, tuple[int, int, int]] = {}
    for x, y in sorted(single):
        head, prior, times = heads.get(y, (x, x, 0))
        if x - prior > WINDOW:
            head, times = x, 0
        heads[y] = (head, x, times + 1)
        if times == 1:
            out.append([(head, y)])
    return out


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, in order: one long integer a column, one bit a word of b."""
    where: dict[int, int] = {}
    for i, y in enumerate(b.tolist()):
        where[y] = where.get(y, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bool]:
    """How far two runs go on alike: +1 a match, -2 a mismatch, best sum, ended
    8 below it. Returns words, matches and whether more of b could change that."""
    n = min(len(a), len(b))
    total = best = at = 0
    more = len(a) > len(b)
    for lo in range(0, n, 64):
        sums = total + np.cumsum(np.where(a[lo : min(lo + 64, n)] == b[lo : min(lo + 64, n)], 1, -2))
        peak = np.maximum.accumulate(np.maximum(sums, best))
        stop = np.flatnonzero(sums <= peak - 8)
        upto = sums[: stop[0]] if len(stop) else sums
        if len(upto) and upto.max() > best:
            best, at = int(upto.max()), lo + int(upto.argmax()) + 1
        if len(stop):
            more = False
            break
        total = int(sums[-1])
    return at, int((a[:at] == b[:at]).sum()), more


def align(t: np.ndarray, s: np.ndarray, path: list[tuple[int, int]], before: bool = False, behind: bool = False) -> list[tuple[int, int, int, int, int]] | None:
    """Pieces (t0, t1, s0, s1, matched words) of a chain, on word codes. None if
    words of the source ``before`` or ``behind`` ``s`` could change them."""
    out = []
    lo, so = path[0]
    hi, sh, matched = lo + K, so + K, K
    for x, y in path[1:]:
        if x < hi or y < sh:  # overlapping seeds: same diagonal continues, others wait
            if x - hi == y - sh:
                matched += max(0, x + K - hi)
                hi, sh = max(hi, x + K), max(sh, y + K)
            continue
        gap_t, gap_s = x - hi, y - sh
        common = int((t[hi:x] == s[sh:y]).sum()) if gap_t == gap_s else _lcs(t[hi:x], s[sh:y])
        if max(gap_t, gap_s) - common > BREAK:
            out.append((lo, hi, so, sh, matched))
            lo, so, matched = x, y, K
        else:
            matched += common + K
        hi, sh = x + K, y + K
    out.append((lo, hi, so, sh, matched))
    grown = []
    for a, b, c, d, m in out:
        right, more, cut_right = _extend(t[b:], s[d:])
        left, also, cut_left = _extend(t[:a][::-1], s[:c][::-1])
        if cut_right and behind or cut_left and before:
            return None
        grown.append((a - left, b + right, c - left, d + right, m + more + also))
    return grown


def by_seeds(path: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[list[tuple[int, int]]]]:
    """What of a chain is a passage by its seeds alone (only words in seeds count
    as matched), as pieces, and the parts of the chain left to be aligned."""
    segments, begin = [], 0
    lo, so = path[0]
    hi, sh, matched = lo + K, so + K, K
    for i, (x, y) in enumerate(path[1:], 1):
        if x < hi or y < sh:
            if x - hi == y - sh:
                matched += max(0, x + K - hi)
                hi, sh = max(hi, x + K), max(sh, y + K)
            continue
        if max(x - hi, y - sh) > BREAK:
            segments.append((begin, i, (lo, hi, so, sh, matched)))
            begin, lo, so, matched = i, x, y, 0
        matched += K
        hi, sh = x + K, y + K
    segments.append((begin, len(path), (lo, hi, so, sh, matched)))
    done, left = [], []
    for a, b, p in segments:
        if p[1] - p[0] >= LEAST and p[4] >= SIMILAR * max(p[1] - p[0], p[3] - p[2]):
            done.append(p)
        elif left and left[-1][1] == a:
            left[-1][1] = b
        else:
            left.append([a, b])
    return done, [path[a:b] for a, b in left]


def chain_bucket(doc: np.ndarray, source: np.ndarray, t: np.ndarray, s: np.ndarray):
    """Pieces (doc, source, t0, t1, s0, s1, matched) that seeds alone prove, and
    chains (doc, source, path) to be aligned, from the links of some documents.

    One run of equal words at whose ends the second word differs too is not
    aligned: it could only grow over two words that differ. Of a document's sources the one with most links comes first; a later one all
    of whose seeds lie in passages found by then adds no word and is passed over.
    At last a run of words all of whose seeds are known from anywhere is a piece.
    """
    ends, s = s >> 30, (s & 0x3FFFFFFF).astype(np.int64)
    t = t.astype(np.int64)
    order = np.lexsort((t, t - s, source, doc))
    doc, source, t, s, ends = doc[order], source[order], t[order], s[order], ends[order]
    proven, open_ = [], []
    if not len(doc):
        return proven, open_
    same = (np.diff(doc) == 0) & (np.diff(source) == 0)
    pair = np.cumsum(np.concatenate([[False], ~same]))
    links = np.bincount(pair)
    # Of a run of matches at one word after another the first, the last and
    # every K-th are chained; the others add no word.
    on = same & (np.diff(t) == 1) & (np.diff(s) == 1)
    begin, end = np.concatenate([[True], ~on]), np.concatenate([~on, [True]])
    since = np.arange(len(t)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
    kept = np.flatnonzero(begin | end | (since % K == 0))
    kept = kept[np.lexsort((s[kept], t[kept], pair[kept]))]
    kt, ks, kp, kh = t[kept], s[kept], pair[kept], ends[kept]
    dt, ds = np.diff(kt), np.diff(ks)
    # a chain in which every step gains is the best one as it stands
    plain = np.concatenate([[True], (np.diff(kp) != 0) | ((dt > 0) & (ds > 0) & (GAP_COST * (dt + ds) < K))])
    cut = np.searchsorted(kp, np.arange(len(links) + 1))
    plain = np.logical_and.reduceat(plain, cut[:-1]).tolist()
    first = np.searchsorted(pair, np.arange(len(links) + 1)).tolist()
    cut = cut.tolist()
    of_doc = np.concatenate([[True], doc[first[1:-1]] != doc[np.array(first[:-2], dtype=np.int64)]]) if len(links) > 1 else np.array([True])
    doc_at = np.flatnonzero(of_doc).tolist() + [len(links)]
    for a, b in zip(doc_at[:-1], doc_at[1:]):
        lo, hi = first[a], first[b]
        name = int(doc[lo])
        hits = np.zeros(int(t[lo:hi].max()) + K + 1, dtype=bool)  # all seeds known
        hits[t[lo:hi]] = True
        done = np.zeros(len(hits), dtype=bool)  # words in passages
        waiting = []
        for p in sorted(range(a, b), key=lambda p: -links[p]) if b - a > 1 else (a,):
            mine = t[first[p] : first[p + 1]]
            if b - a > 1 and done[mine].all() and done[mine + K - 1].all():
                continue
            x, y = kt[cut[p] : cut[p + 1]], ks[cut[p] : cut[p + 1]]
            if plain[p]:
                paths = [list(zip(x.tolist(), y.tolist()))] if len(x) > 1 else []
            else:
                paths = chain(x, y)
            for path in paths:
                got, left = by_seeds(path) if len(path) > 1 else ([], [path])
                if left and path[-1][0] - path[0][0] == path[-1][1] - path[0][1] and len(left[0]) == len(path) > 1:
                    lo_t, hi_t = path[0], path[-1]
                    if plain[p]:
                        grows = kh[cut[p]] & 1 or kh[cut[p + 1] - 1] & 2
                    else:
                        where = dict(zip(zip(x.tolist(), y.tolist()), kh[cut[p] : cut[p + 1]].tolist()))
                        grows = where[lo_t] & 1 or where[hi_t] & 2
                    if not grows and all(v[0] - u[0] <= K for u, v in zip(path, path[1:])):
                        n = hi_t[0] + K - lo_t[0]
                        got, left = [(lo_t[0], lo_t[0] + n, lo_t[1], lo_t[1] + n, n)] if n >= PIECE else [], []
                for g in got:
                    proven.append((name, int(source[first[p]]), *g))
                    if g[1] - g[0] >= LEAST:
                        done[g[0] : g[1]] = True
                waiting += [(int(source[first[p]]), x) for x in left]
        run = np.diff(np.concatenate([[0], hits.view(np.int8), [0]]))
        for x, y in zip(np.flatnonzero(run == 1).tolist(), np.flatnonzero(run == -1).tolist()):
            if y - x >= LEAST - K + 1 and not done[x : y + K - 1].all():
                inside = np.flatnonzero((t[lo:hi] >= x) & (t[lo:hi] < y)) + lo
                best = inside[np.bincount(pair[inside] - pair[lo])[pair[inside] - pair[lo]].argmax()]
                proven.append((name, int(source[best]), x, y + K - 1, int(s[best]), int(s[best]) + y + K - 1 - x, y + K - 1 - x))
                done[x : y + K - 1] = True
        for whence, path in waiting:
            if not done[path[0][0] : path[-1][0] + K].all():
                open_.append((name, whence, path))
    return proven, open_


def _batch(rows) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("source_id", pa.int64()), *((n, pa.int32()) for n in ("t0", "t1", "s0", "s1", "matched"))]
    return pa.RecordBatch.from_pydict({n: pa.array(c, x) for c, (n, x) in zip(list(zip(*rows)) or [()] * 7, kinds, strict=True)})


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, source_id, t0, t1, s0, s1, matched): pieces of every document that
    earlier ones hold. ``docs``: doc_id and text, without nulls, an id on one text."""
    rows = docs.select("doc_id", "text")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = int(chars // BUCKET) + lanes(docs.sparkSession)

    @lean
    def chains(table: pa.Table) -> pa.Table:
        got = (_read(table, n, k, steps) for n, k, steps in (("doc", "<i8", True), ("source", "<i8", True), ("t", "<u4", False), ("s", "<u4", False)))
        proven, open_ = chain_bucket(*got)
        paths = [None] * len(proven) + [[v for xy in path for v in xy] for _, _, path in open_]
        rows = [*proven, *((d, s, -1, 0, 0, 0, 0) for d, s, _ in open_)]
        return pa.Table.from_batches([_batch(rows)]).append_column("path", pa.array(paths, pa.list_(pa.int32())))

    linked = link(seeds(rows, buckets), buckets)
    chained = stored_alone(linked.groupBy("bucket").applyInArrow(chains, f"{_SHAPE}, path array<int>"), "chains")
    waiting = chained.where("path IS NOT NULL").select("doc_id", "source_id", "path")

    @lean
    def windows(batches):
        for b in batches:
            offsets, codes, words = chunks(b.column("source"))
            out = []
            for i, (source, near) in enumerate(zip(b.column("source_id").to_pylist(), b.column("near").to_pylist(), strict=True)):
                mine = codes[offsets[i] : offsets[i + 1]]
                for x in near:
                    path = x["path"]
                    lo, hi = max(0, path[1] - MARGIN), path[-1] + K + MARGIN
                    out.append((x["doc_id"], source, path, lo, hi < len(mine), " ".join([words[c] for c in mine[lo:hi].tolist()])))
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.string())
            whole = pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["doc_id", "source_id", "path", "lo", "behind", "part"])
            for lo in range(0, whole.num_rows, 4096):
                yield whole.slice(lo, 4096)

    def good(p):
        return p[1] - p[0] >= PIECE and p[4] >= SIMILAR * max(p[1] - p[0], p[3] - p[2])

    @lean
    def aligned_near(batches):
        """Pieces from parts of the sources; a chain that needs more has t0 = -1."""
        bare: dict[str, str] = {}
        for b in batches:
            near = b.column("near").to_pylist()
            parts = pa.array([x["part"] for d in near for x in d], pa.string())
            texts = b.column("text").cast(pa.string())
            offsets, codes, words = chunks(pa.concat_arrays([texts, parts]))
            names: dict[str, int] = {}
            codes = np.array([names.setdefault(w, len(names)) for w in named(words, _bare, bare)], dtype=np.int64)[codes]
            out, at = [], b.num_rows
            for i, (doc, links) in enumerate(zip(b.column("doc_id").to_pylist(), near, strict=True)):
                t = codes[offsets[i] : offsets[i + 1]]
                for x in links:
                    s, lo, path = codes[offsets[at] : offsets[at + 1]], x["lo"], x["path"]
                    at += 1
                    got = align(t, s, [(u, v - lo) for u, v in zip(path[::2], path[1::2])], lo > 0, x["behind"])
                    if got is None:
                        out.append((doc, x["source_id"], -1, 0, 0, 0, 0))
                    else:
                        out += [(doc, x["source_id"], p[0], p[1], p[2] + lo, p[3] + lo, p[4]) for p in sorted(set(got)) if good(p)]
            yield _batch(out)

    @lean
    def aligned(batches):
        bare: dict[str, str] = {}
        for b in batches:
            if not b.num_rows:
                continue
            offsets, codes, words = chunks(pa.concat_arrays([b.column("text"), b.column("source")]))
            names: dict[str, int] = {}
            codes = np.array([names.setdefault(w, len(names)) for w in named(words, _bare, bare)], dtype=np.int64)[codes]
            out = []
            for i, (doc, source, paths) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("source_id").to_pylist(), b.column("paths").to_pylist(), strict=True)):
                t = codes[offsets[i] : offsets[i + 1]]
                s = codes[offsets[b.num_rows + i] : offsets[b.num_rows + i + 1]]
                got = [p for path in paths for p in align(t, s, list(zip(path[::2], path[1::2])))]
                out += [(doc, source, *p) for p in sorted(set(got)) if good(p)]
            yield _batch(out)

    # Both texts of every pair would be many times the input: first only the
    # words around a chain travel, then whole texts for the pairs that go on.
    # No text moves that has no open chain.
    mentioned = waiting.select("doc_id").unionByName(waiting.select(F.col("source_id").alias("doc_id")))
    texts = stored(picked(rows, mentioned, "doc_id").dropDuplicates(["doc_id"]), "linked-texts")
    sources = texts.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source"))
    near = waiting.groupBy("source_id", F.floor(F.col("doc_id") / 4096).alias("lot")).agg(F.collect_list(F.struct("doc_id", "path")).alias("near"))
    parts = near.join(sources, "source_id").select("source_id", "near", "source").mapInArrow(windows, "doc_id long, source_id long, path array<int>, lo int, behind boolean, part string")
    by_doc = parts.groupBy("doc_id").agg(F.collect_list(F.struct("source_id", "path", "lo", "behind", "part")).alias("near"))
    tried = stored(by_doc.join(texts, "doc_id").select("doc_id", "near", "text").mapInArrow(aligned_near, _SHAPE), "pieces")
    rest = tried.where("t0 < 0").select("doc_id", "source_id").distinct()
    again = waiting.groupBy("doc_id", "source_id").agg(F.collect_list("path").alias("paths")).join(rest, ["doc_id", "source_id"], "left_semi")
    both = again.join(texts, "doc_id").join(sources, "source_id").select("doc_id", "source_id", "paths", "text", "source")
    whole = both.mapInArrow(aligned, _SHAPE)
    return chained.where("path IS NULL").drop("path").unionByName(tried.join(rest, ["doc_id", "source_id"], "left_anti")).unionByName(whole)


def join_pieces(found: list[tuple[int, int, int, int]], least: int = LEAST, slack: int = 3) -> list[tuple[int, int, int, int]]:
    """Passages (start, end, source_id, matched) out of pieces (t0, t1, source,
    matched): pieces that touch, overlap or nearly do become one; those of
    ``least`` words stay. The source of the longest piece is named."""
    out, now = [], None
    for t0, t1, source, matched in sorted(found):
        if now and t0 <= now[1] + slack:
            if t1 > now[1]:
                now[3] += round(matched * min(1.0, (t1 - max(t0, now[1])) / (t1 - t0)))
                now[1] = t1
            if t1 - t0 > now[4]:
                now[2], now[4] = source, t1 - t0
        else:
            now = [t0, t1, source, matched, t1 - t0]
            out.append(now)
    return [tuple(p[:4]) for p in out if p[1] - p[0] >= least]


def numbered(rows: DataFrame) -> DataFrame | None:
    """(row_no, doc_id, hash, text) with a number for every distinct row, ascending
    with doc_id and the text's hash, if an id stands on unlike texts; else None."""
    key = F.xxhash64("text")
    by_id = rows.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    if by_id.where("lo <> hi").isEmpty():
        return None

    def count(batches):
        part, n = partition_id(), 0
        for b in batches:
            new = pa.array(np.full(b.num_rows, part), pa.int32())
            local = pa.array(np.arange(n, n + b.num_rows))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([new, local, *b.columns], names=["part", "local", *b.schema.names])

    hashed = rows.withColumn("hash", key).dropDuplicates(["doc_id", "hash"])
    ordered = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    at = stored(ordered.mapInArrow(count, "part int, local long, doc_id long, text string, hash long"), "numbered")
    sizes = at.groupBy("part").agg(F.count("*").alias("n"))  # one row a task of the write
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(F.broadcast(before), "part").select((F.col("before") + F.col("local")).alias("row_no"), "doc_id", "hash", "text")


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Passages of at least ``least`` words that a document repeats, at a
    similarity of 0.8 or more, from documents of smaller doc_id.

    Words are runs without ASCII white space, compared lower-cased and without
    punctuation at their ends. The first holder of a passage has no row for it; a
    passage that one document holds twice gives no row for that. Null texts and
    ids, empty and short texts have no passages; an empty table gives no rows.
    Rows equal in id and text count once. Where an id stands on unlike texts each
    of these is a document of its own, in the order of the texts' hashes, and
    text_hash (xxhash64; else null) says which one is meant. Other columns are
    ignored. Returns doc_id, start, end (word positions, end exclusive),
    source_id (whose piece is longest), similarity, text_hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    apart = numbered(rows)
    found = pieces(rows if apart is None else apart.select(F.col("row_no").alias("doc_id"), "text"))
    grouped = found.groupBy("doc_id").agg(F.collect_set(F.struct("t0", "t1", "source_id", "matched")).alias("found"))

    @lean
    def run(batches):
        for b in batches:
            at, out = [], []
            for i, found in enumerate(b.column("found").to_pylist()):
                for p in join_pieces([(f["t0"], f["t1"], f["source_id"], f["matched"]) for f in found], least):
                    at.append(i)
                    out.append(p)
            start, end, source, matched = (np.array(c, dtype=np.int64) for c in (zip(*out) if out else [()] * 4))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id").take(pa.array(at, pa.int64())),
                    "start": pa.array(start.astype(np.int32)),
                    "end": pa.array(end.astype(np.int32)),
                    "source_id": pa.array(source),
                    "similarity": pa.array(np.minimum(matched / np.maximum(end - start, 1), 1.0)),
                }
            )

    out = grouped.mapInArrow(run, "doc_id long, start int, end int, source_id long, similarity double")
    if apart is None:
        return out.withColumn("text_hash", F.lit(None).cast("long"))
    names = apart.select(F.col("row_no").alias("doc_id"), F.col("doc_id").alias("name"), "hash")
    out = out.join(names, "doc_id").drop("doc_id").join(names.select(F.col("doc_id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return out.select(F.col("name").alias("doc_id"), "start", "end", F.col("source").alias("source_id"), "similarity", F.col("hash").alias("text_hash")).distinct()


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and the white space behind them)."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in sorted(spans):
        a, b = at[min(a, len(at) - 1)], at[min(b, len(at) - 1)]
        out.append(text[done:a])
        done = max(done, b)
    return "".join([*out, text[done:]])


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents without their repeated passages; all columns stay, ``n_chars``
    (if there) is counted anew, and documents left without a word go. Documents
    without passages, null texts and null ids stay as they are; of rows equal in
    id and text all are cut alike."""
    names = list(docs.columns)
    where, who = names.index("text"), names.index("doc_id")
    spans = passages.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("of"), "text_hash", "spans")
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    meant = F.coalesce(F.col("text_hash") == F.xxhash64(F.col(f"c{where}").cast("string")), F.lit(True))
    joined = inner.join(spans, (F.col(f"c{who}").cast("long") == F.col("of")) & meant, "left").select(*inner.columns, "spans")

    @lean
    def run(batches):
        for b in batches:
            spans, text = b.column("spans").to_pylist(), b.column(where).to_pylist()
            new = [cut_text(t, [(x["start"], x["end"]) for x in s]) if s and t is not None else t for s, t in zip(spans, text, strict=True)]
            keep = [not s or t is None or bool(_WORD.search(t)) for s, t in zip(spans, new, strict=True)]
            cols = [pa.array(new, pa.string()) if i == where else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        fresh = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", fresh.cast(docs.schema["n_chars"].dataType))
    return out
