"""Language identification by interpolated Kneser-Ney character models.

A letter run with one boundary at each side is a word of the model; a gram is
four 16-bit symbols in one 64-bit integer, so that contexts and suffixes are
shifts and masks. All training documents but a calibration share are counted,
and all distinct grams are kept, so the model grows with the input (as distinct
grams do: far slower than texts). Per language the model is a few sorted arrays
(grams with their discounted probability, contexts with their back-off weight).
The language of lowest cross-entropy per symbol wins; a text less likely than all
but a few of the language's own calibration texts, by a margin, is marked
rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, stored, tune

ORDER = 4
#: One training text of so many calibrates instead; the share of these that may be
#: surprising beyond the limit, and how much wider the limit is drawn.
CALIBRATE, BEYOND, WIDER = 20, 0.001, 1.5

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (general category L*)."""
    if not _LETTER:
        out = np.zeros(0x110000, dtype=bool)
        out[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L"]] = True
        _LETTER.append(out)
    return _LETTER[0]


def grams_of(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of the letters and closing boundaries of some strings, the string
    each belongs to, and how many letters each string has."""
    text = "\n".join([w.lower() for w in words]) + "\n"
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    of = np.cumsum(cp == 10)
    of = of - (cp == 10)
    is_letter = letters()[cp]
    sym = np.where(is_letter, np.where(cp & 0xFFFF == 0, 1, cp & 0xFFFF), 0).astype(np.uint64)
    begin = np.roll(is_letter, 1)
    if len(begin):
        begin[0] = False
    wanted = is_letter | begin
    gram, alive = sym.copy(), np.ones(len(sym), dtype=bool)
    for back in range(1, ORDER):
        before = np.roll(sym, back)
        before[:back] = 0
        alive &= before != 0  # nothing reaches over a boundary
        gram |= np.where(alive, before, np.uint64(0)) << np.uint64(16 * back)
    count = np.bincount(of[is_letter], minlength=len(words))
    return gram[wanted], of[wanted], count


@dataclass
class KneserNey:
    """For orders 1..n: sorted grams, their discounted probability, sorted
    contexts and their back-off weight; ``mean`` and ``sd`` of the training
    text's surprisal per symbol; ``spread`` of that of whole texts, and the
    ``limit`` of what is no surprise, in such spreads."""

    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    mean: float = 0.0
    sd: float = 1.0
    spread: float = 0.3
    limit: float = 6.0

    def surprise(self, surprisal, symbols):
        """How far a text's mean surprisal is above the language's own, in
        spreads of texts of that length (columns or arrays alike)."""
        return (surprisal - self.mean) / (self.spread + self.sd / symbols**0.5)

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """log p of the last symbol given those before it."""
        p = np.full(len(gram), 1e-5)
        for order, (g, d, c, w) in enumerate(zip(self.grams, self.probs, self.contexts, self.weights, strict=True), 1):
            key = gram & np.uint64((1 << 16 * order) - 1)
            at = np.minimum(np.searchsorted(g, key), len(g) - 1)
            own = np.where(g[at] == key, d[at], 0.0)
            ctx = key >> np.uint64(16)
            at = np.minimum(np.searchsorted(c, ctx), len(c) - 1)
            p = own + np.where(c[at] == ctx, w[at], 1.0) * p
        return np.log(p)


def fit_kneser_ney(grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> KneserNey:
    """From the distinct grams of the highest order and their counts."""
    top, n = np.asarray(grams, dtype=np.uint64), np.asarray(counts, dtype=np.int64)
    sort = np.argsort(top)
    top, n = top[sort], n[sort]
    levels, g, c = [], top, n
    for k in range(order, 0, -1):
        levels.append((g, c))
        if k > 1:  # lower orders count in how many kinds of longer gram they end
            g, c = np.unique(g & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
    model = KneserNey([], [], [], [])
    for g, c in levels[::-1]:
        n1, n2 = int((c == 1).sum()), int((c == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, at = np.unique(g >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(at, weights=c), np.bincount(at)
        model.grams.append(g)
        model.probs.append((np.maximum(c - d, 0) / total[at]).astype(np.float32))
        model.contexts.append(ctx)
        model.weights.append((d * kinds / total).astype(np.float32))
    s = -model.log_prob(top)
    model.mean = float((s * n).sum() / n.sum())
    model.sd = float(np.sqrt(((s - model.mean) ** 2 * n).sum() / n.sum()))
    return model


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang), counted per batch first."""

    @lean
    def run(batches):
        held: dict[str, list] = {}

        def merge(parts):
            key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [(key, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for b in batches:
            if not b.num_rows:
                continue
            offsets, codes, words = chunks(b.column("text"))
            gram, of, _ = grams_of(words)
            lang = b.column("lang").dictionary_encode()
            doc_lang = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
            for i, name in enumerate(lang.dictionary.to_pylist()):
                times = np.bincount(codes[doc_lang == i], minlength=len(words))[of]
                there = times > 0
                key, at = np.unique(gram[there], return_inverse=True)
                parts = held.setdefault(name, [])
                parts.append((key, np.bincount(at, weights=times[there], minlength=len(key)).astype(np.int64)))
                if len(parts) >= 24:
                    held[name] = merge(parts)
        for name, parts in held.items():
            ((key, n),) = merge(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(key), pa.string()), "gram": pa.array(key.view(np.int64)), "n": pa.array(n)})

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], list[KneserNey]]:
    """Models of every non-null lang of (text, lang) rows that has letters.

    Texts whose hash mod ``CALIBRATE`` is 0 are not counted (unless their language
    has no others) but calibrate the limit of rejection: the surprise that the
    share ``BEYOND`` of them exceeds, ``WIDER`` times. Repeated rows count as often
    as they stand. Null texts and langs teach nothing; without rows there is no
    model. The distinct grams with their counts go to the driver, which makes the
    arrays (about 60 bytes a gram there, 16 in the arrays).
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = taught.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.pmod(F.xxhash64("text"), F.lit(CALIBRATE)) == 0
    models = _models(stored(count_grams(taught.where(~held)), "grams"))
    rest = [r["lang"] for r in taught.select("lang").distinct().collect() if r["lang"] not in models]
    if rest:
        models |= _models(count_grams(taught.where(F.col("lang").isin(rest))))
    names = sorted(models)
    if names:
        _calibrate(taught.where(held), names, [models[n] for n in names])
    return names, [models[n] for n in names]


def _models(counted: DataFrame) -> dict[str, KneserNey]:
    table = counted.toArrow()
    lang = table.column("lang").combine_chunks().dictionary_encode()
    code = lang.indices.to_numpy(zero_copy_only=False)
    gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return {name: fit_kneser_ney(gram[code == i], n[code == i]) for i, name in enumerate(lang.dictionary.to_pylist())}


def _calibrate(held: DataFrame, names: list[str], models: list[KneserNey]) -> None:
    """Set spread and limit of the models from texts they have not seen."""
    scored = stored(predict(held, names, models, [F.col("lang")]).where("lang = lang_pred").select("lang", "surprisal", "symbols"), "calibration")
    for r in scored.where("symbols >= 100").groupBy("lang").agg(F.stddev_samp("surprisal").alias("sd")).collect():
        if r["sd"] == r["sd"] and r["sd"]:
            models[names.index(r["lang"])].spread = max(r["sd"], 0.02)
    by_lang = F.lit(None).cast("double")
    for name, m in zip(names, models, strict=True):
        by_lang = F.when(F.col("lang") == name, m.surprise(F.col("surprisal"), F.col("symbols"))).otherwise(by_lang)
    limit = scored.agg(F.percentile_approx(by_lang, 1 - BEYOND, 100_000)).first()[0]
    for m in models:
        m.limit = max(WIDER * limit, 3.0) if limit is not None else m.limit


def predict(docs: DataFrame, names: list[str], models: list[KneserNey], keep: Sequence[Column] = ()) -> DataFrame:
    """``keep`` columns and lang_pred, score, rejected, surprisal, symbols for
    every row's ``text``.

    ``und`` (score 0, rejected) if the text is null or has no letter, or if no
    language was learned. score is the winner's share of the likelihoods of a
    text of at most 100 symbols, at this text's mean. surprisal is the mean of
    the winner over the text's symbols; rejected: it is beyond the winner's
    calibrated limit. Ties go to the first name. Repeated rows are judged one by
    one; an empty table gives no rows. ``keep`` may not bring a column of these
    names.
    """
    spark = tune(docs.sparkSession)
    held = spark.sparkContext.broadcast((names, models))
    rows = docs.select(F.struct(F.lit(0).alias("any"), *keep).alias("kept"), F.col("text").cast("string").alias("text"))
    shown = ["lang_pred", "score", "rejected", "surprisal", "symbols"]
    kept = rows.select("kept.*").columns[1:]
    if clash := set(shown) & set(kept):
        raise ValueError(f"keep may not bring {sorted(clash)}")

    @lean
    def run(batches):
        langs, found = held.value
        for b in batches:
            offsets, codes, words = chunks(b.column("text"))
            n_docs = b.num_rows
            gram, of, n_letters = grams_of(words)
            cum = lambda per_word: np.concatenate([[0], np.cumsum(per_word[codes])])
            total = lambda per_word: np.diff(cum(per_word)[offsets])
            has = total(n_letters.astype(np.int64)) > 0
            symbols = total(np.bincount(of, minlength=len(words)))
            if found and n_docs:
                key, at = np.unique(gram, return_inverse=True)
                cost = np.stack([total(np.bincount(of, weights=-m.log_prob(key)[at], minlength=len(words))) for m in found])
                mean = cost / np.maximum(symbols, 1)
                best = mean.argmin(0)
                low = mean[best, np.arange(n_docs)]
                share = 1 / np.exp(-(mean - low) * np.clip(symbols, 1, 100)).sum(0)
                n = np.maximum(symbols, 1).astype(float)
                odd = np.array([found[k].surprise(x, y) > found[k].limit for k, x, y in zip(best.tolist(), low.tolist(), n.tolist(), strict=True)], dtype=bool)
            else:
                best, share, odd, low = np.zeros(n_docs, dtype=int), np.zeros(n_docs), np.ones(n_docs, dtype=bool), np.zeros(n_docs)
                has = has & False
            yield pa.RecordBatch.from_pydict(
                {
                    "kept": b.column("kept"),
                    "lang_pred": pa.array([langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)], pa.string()),
                    "score": pa.array(np.where(has, share, 0.0)),
                    "rejected": pa.array(odd | ~has),
                    "surprisal": pa.array(np.where(has, low, 0.0)),
                    "symbols": pa.array(np.where(has, symbols, 0).astype(np.int64)),
                }
            )

    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, surprisal double, symbols long"
    return rows.mapInArrow(run, schema).select(*(F.col(f"kept.`{c}`") for c in kept), *shown)
