"""URL filter: rules first, then a ratio of character language models.

Two smoothed variable-order Markov models (contexts of up to ORDER - 1 bytes,
interpolated Witten-Bell, so a context never seen falls back to a shorter one)
are fitted on the URLs that rules accept and reject. A URL that no rule decides
passes when its length-normalised log-likelihood difference reaches a calibrated
threshold.

Symbols are the URL's bytes as they stand and an end mark. All distinct grams are
kept, in sorted arrays, so the models grow with what the URLs hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, tune

#: Symbols of a gram, bits of a symbol (0 ends, and stands before the first; then
#: the bytes) and how many symbols there are.
ORDER, BITS, A = 5, 9, 257
BINS, SPAN = 2000, 8.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both '' for null or without '://'."""
    found = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, found, i), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def rule_columns(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict. A rule is
    host/path-prefix; it fits the host, its subdomains and paths that start so."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=len):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def grams_of(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram that each symbol (and the end) closes, and the URLs' offsets."""
    raw = urls.cast(pa.large_binary()).fill_null(b"").to_pylist()
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    start = np.cumsum(size) - size
    sym = np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8).astype(np.uint64) + np.uint64(1) if raw else np.zeros(0, dtype=np.uint64)
    sym[start + size - 1] = 0
    at, first = np.arange(len(sym)), np.repeat(start, size)
    gram = sym.copy()
    for back in range(1, ORDER):
        gram |= np.where(at - back >= first, np.roll(sym, back), np.uint64(0)) << np.uint64(BITS * back)
    return gram, start, size


@dataclass
class WittenBell:
    """For orders 1..ORDER: sorted grams with their share of the probability,
    sorted contexts with the share that is left to the shorter context."""

    grams: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """log p of the last symbol given those before it."""
        p = np.full(len(gram), 1.0 / A)
        for order, (g, share, c, left) in enumerate(zip(self.grams, self.shares, self.contexts, self.left, strict=True), 1):
            key = gram & np.uint64((1 << BITS * order) - 1)
            at = np.minimum(np.searchsorted(g, key), len(g) - 1)
            own = np.where(g[at] == key, share[at], 0.0)
            ctx = key >> np.uint64(BITS)
            at = np.minimum(np.searchsorted(c, ctx), len(c) - 1)
            p = own + np.where(c[at] == ctx, left[at], 1.0) * p
        return np.log(p)


def fit_witten_bell(grams: np.ndarray, counts: np.ndarray) -> WittenBell:
    """From the distinct grams of the highest order and their counts."""
    model = WittenBell([], [], [], [])
    for order in range(1, ORDER + 1):
        g, at = np.unique(grams & np.uint64((1 << BITS * order) - 1), return_inverse=True)
        c = np.bincount(at, weights=counts)
        ctx, at = np.unique(g >> np.uint64(BITS), return_inverse=True)
        total, kinds = np.bincount(at, weights=c), np.bincount(at)
        model.grams.append(g)
        model.shares.append(c / (total + kinds)[at])
        model.contexts.append(ctx)
        model.left.append(kinds / (total + kinds))
    return model


def ratio_of(urls: pa.Array, good: WittenBell, bad: WittenBell) -> np.ndarray:
    """Log-likelihood difference of every URL over its symbols."""
    gram, start, size = grams_of(urls)
    if not len(size):
        return np.zeros(0)
    key, at = np.unique(gram, return_inverse=True)
    return np.add.reduceat((good.log_prob(key) - bad.log_prob(key))[at], start) / size


def _scored(keep, models):
    """mapInArrow: the score of every URL, beside what identifies it."""

    @lean
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in keep} | {"score": pa.array(ratio_of(b.column("url"), *models.value))})

    return run


@lean
def _counts(batches):
    """(good, gram, n) of a partition, merged whenever much is held."""
    held: list[list] = [[], []]

    def merged(parts):
        key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    for b in batches:
        gram, _, size = grams_of(b.column("url"))
        good = np.repeat(b.column("good").to_numpy(), size)
        for k in (0, 1):
            held[k].append(np.unique(gram[good == k], return_counts=True))
            if len(held[k]) >= 24:
                held[k] = [merged(held[k])]
    for k in (0, 1):
        if held[k]:
            key, n = merged(held[k])
            yield pa.RecordBatch.from_pydict({"good": pa.array(np.full(len(key), k), pa.int32()), "gram": pa.array(key.view(np.int64)), "n": pa.array(n)})


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", fold: int = 5) -> DataFrame:
    """One verdict per row: page_id, host, path, rule, verdict, score.

    Models count every URL a rule decides but each ``fold``-th by crc32 of the
    id, which calibrate the threshold (the largest balanced accuracy of telling
    accepted from rejected). A null URL has empty host and path and is scored as
    an empty string. Without accepted or without rejected URLs there is no ratio:
    what no rule decides is allowed. Repeated rows are judged one by one; other
    columns are ignored; an empty table gives no rows.
    """
    spark = tune(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    taught = rows.where("ruled IS NOT NULL").select(
        "url", F.when(F.col("ruled") == "allow", 1).otherwise(0).cast("int").alias("good"),
        (F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % fold == 0).alias("held"),
    )

    # every URL counts; what goes to the driver are the distinct grams
    sums = taught.where("NOT held").select("url", "good").mapInArrow(_counts, "good int, gram long, n long").groupBy("good", "gram").agg(F.sum("n").alias("n")).toPandas()
    found = []
    for k in (1, 0):
        mine = sums[sums["good"] == k]
        if not len(mine):
            verdict = F.coalesce("ruled", F.lit("allow"))
            return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(0.0).alias("score"))
        found.append(fit_witten_bell(mine["gram"].to_numpy(np.int64).view(np.uint64), mine["n"].to_numpy()))
    models = spark.sparkContext.broadcast(tuple(found))
    held = taught.where("held").mapInArrow(_scored(["good"], models), "good int, score double")
    place = F.floor((F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) + SPAN) / (2 * SPAN) * BINS).cast("int")
    hist = np.zeros((2, BINS + 1))
    for r in held.groupBy("good", place.alias("bin")).count().collect():  # at most 2 x 2001 rows
        hist[r["good"], r["bin"]] = r["count"]
    if hist.sum(1).all():
        kept = hist[:, ::-1].cumsum(1)[:, ::-1] / hist.sum(1, keepdims=True)  # share at or above each bin
        gain = kept[1] - kept[0]
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        threshold = float(best.mean().round()) / BINS * 2 * SPAN - SPAN
    else:
        threshold = 0.0
    names = ["page_id", "host", "path", "rule", "ruled"]
    scored = rows.mapInArrow(_scored(names, models), "page_id long, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
