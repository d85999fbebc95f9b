"""Fast, exact use of a word-level BPE of the tokenizers library.

White space separates words and is dropped, so a text's ids are those of its
white-space chunks in order, joined. The distinct chunks of some batches are encoded
together; workers remember words. Chunks of plain ASCII and Latin-1 letters go
straight to the library's BPE model after the file's lower-casing and splitting;
anything else goes through the library's whole encoder.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spread, strings

#: The word pattern of the tokenizer file (fixed value; compared at load time).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks without ``<``, which begins the special tokens; those of letters alone.
_PLAIN, _LETTERS = "^[!-;=-~À-ÖØ-öø-ÿ]+$", "^[a-zß-öø-ÿ]+$"
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
#: How many words a worker remembers: the first, and so most of the frequent.
CACHE = 600_000
#: Bytes of texts whose chunks are made distinct at once.
GROUP = 8 << 20


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte: itself if printable, else 256 + rank."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        pieces = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = (pieces[0].get("pattern") or {}).get("Regex") == PATTERN
        self.plain = self.plain and all(t["content"].startswith("<") for t in spec.get("added_tokens", []))
        by_byte = _byte_chars()
        self.bytes = {c: "".join(by_byte[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        # numbers of the words remembered, and the edges of their ids; a line end has none
        self.words = {"\n": 0}
        self.edge, self.ids = np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: where they begin, how many they are, and an array with them."""
        at = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lacking = np.flatnonzero(at < 0)
        new, call, size, out = [words[i] for i in lacking.tolist()], self.model.tokenize, [], []
        for w in new:
            ids = [t.id for t in call(w if w.isascii() else w.translate(self.bytes))]
            size.append(len(ids))
            out += ids
        n, kept = len(self.words), len(self.words) + max(min(CACHE - len(self.words), len(new)), 0)
        at[lacking] = np.arange(n, n + len(new))
        edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(np.array(size, dtype=np.int64))])
        ids = np.concatenate([self.ids, np.array(out, dtype=np.int32)])
        if kept > n:
            self.words.update(zip(new, range(n, kept)))
            self.edge, self.ids = edge[: kept + 1], ids[: edge[kept]]
        return edge[at], edge[at + 1] - edge[at], ids

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of distinct chunks. A plain one that is letters
        alone is a word; the other plain ones are split as lines of one text."""
        plain = pc.match_substring_regex(chunks, _PLAIN) if self.plain else pa.array(np.zeros(len(chunks), dtype=bool))
        low = pc.utf8_lower(pc.if_else(plain, chunks, ""))
        alone = pc.match_substring_regex(low, _LETTERS)
        lines = strings(low.filter(pc.invert(alone)))
        found = _SPLIT.findall("\n".join([*lines, ""]))
        coded = pa.concat_arrays([low.filter(alone), pa.array(found, low.type)]).dictionary_encode()
        codes, words = coded.indices.to_numpy(), strings(coded.dictionary)
        alone = alone.to_numpy(zero_copy_only=False)
        of_lines = codes[np.count_nonzero(alone) :]
        end = np.flatnonzero(of_lines == words.index("\n")) if lines else np.zeros(0, dtype=np.int64)
        many = np.ones(len(chunks), dtype=np.int64)  # words of each chunk
        many[~alone] = np.diff(end, prepend=-1) - 1
        first = np.cumsum(many) - many
        word = np.empty(int(many.sum()), dtype=np.int64)
        word[first[alone]] = codes[: len(codes) - len(of_lines)]
        word[spread(first[~alone], many[~alone])] = np.delete(of_lines, end)
        begin, size, ids = self._words(words)
        at = np.concatenate([[0], np.cumsum(size[word])])
        ids, size = ids[spread(begin[word], size[word])], at[first + many] - at[first]
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            whole = [self.full.encode(c, add_special_tokens=False).ids for c in strings(chunks.take(pa.array(odd)))]
            size[odd] = [len(x) for x in whole]
            ids = np.insert(ids, np.repeat(at[first[odd]], size[odd]), np.array([y for x in whole for y in x], dtype=np.int32))
        return size, ids

    def encode(self, texts: list[pa.Array]):
        """For each of some batches of texts all ids, and the offsets of each text in them."""
        split = [pc.ascii_split_whitespace(pc.fill_null(t.cast(pa.large_string()), "")) for t in texts]
        coded = pa.concat_arrays([x.flatten() for x in split]).dictionary_encode()
        codes, (size, ids) = coded.indices.to_numpy(), self._chunks(coded.dictionary)
        begin, lo = np.cumsum(size) - size, 0
        for lists in split:
            offsets = lists.offsets.to_numpy().astype(np.int64)
            of_batch = codes[lo : lo + offsets[-1] - offsets[0]]
            lo += len(of_batch)
            each = size[of_batch]
            at = np.concatenate([[0], np.cumsum(each)])
            yield ids[spread(begin[of_batch], each)], at[offsets - offsets[0]]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def encode_with_end(path: str, batches, end_id: int):
    """For every batch: itself, the ids of every text followed by ``end_id``, and
    their offsets. Batches are encoded ``GROUP`` bytes at a time."""
    held, size = [], 0

    def encoded():
        for batch, (ids, offsets) in zip(held, tokenizer(path).encode([b.column("text") for b in held]), strict=True):
            n = len(offsets) - 1
            out = np.full(len(ids) + n, end_id, dtype=np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
            yield batch, out, offsets + np.arange(n + 1)

    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= GROUP:
            yield from encoded()
            held, size = [], 0
    if held:
        yield from encoded()
