"""Encoding a whole corpus with the byte-level BPE of a public tokenizer, by merge replay.

Instead of encoding word by word, the words that are new in a slice of at most SLICE_BYTES bytes of text (or one text)
are laid out as arrays of tokens, of REPLAY_BYTES bytes (or one word) each. An inverted index leads from every mergeable token pair to the positions where it stands; the merges present
are replayed in rank order over the whole array, and only the neighbours of a merged position are touched. Words of up
to CACHED_LENGTH characters stay known to the worker from slice to slice and task to task, until they have CACHE_CHARS
characters and all are forgotten, so a word is encoded again after that and on other workers; no index spans a partition
or the corpus. What a worker holds is bounded by these sizes and the longest single text. The
documents take their ids by word number. The plan is map-only: no shuffle, no collection; the merge table (50,000
pairs) is broadcast.

Defined results: null, empty texts give an empty list; text that looks like a special token is plain text; texts of
any length are encoded whole; repeated rows come out repeatedly.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.runtime import bounded_slices

#: Where the public vocabularies lie; a parameter of every operator.
TOKENIZER_DIR = os.environ.get("SPANFORGE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the splitting pattern of byte-level BPE vocabularies, with the white space of Unicode spelt out.
_S = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Characters of words whose ids a worker keeps; beyond that it starts afresh (results don't depend on it).
CACHE_CHARS = 8 << 20
#: Longer chunks are encoded where they stand and not kept.
CACHED_LENGTH = 64
#: Bytes of text encoded at once, and bytes of new words laid out as one array.
SLICE_BYTES, REPLAY_BYTES = 4 << 20, 1 << 20


@dataclass(frozen=True)
class Merges:
    """Merge table: ``pairs`` (left << 16 | right) sorted, with the rank and the product of each; ids of single bytes."""

    pairs: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    byte_ids: np.ndarray


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    for i, b in enumerate(b for b in range(256) if b not in set(keep)):
        out[chr(256 + i)] = b
    return out


def load_merges(name: str = "byte_bpe_50k", directory: str | None = None) -> Merges:
    """Read a vocabulary: ``NAME.json`` (with its list of merges) if there is one, else ``NAME.tiktoken`` (ranks)."""
    base = os.path.join(directory or TOKENIZER_DIR, name)
    left, right, product = [], [], []
    if os.path.exists(base + ".json"):
        with open(base + ".json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        bytes_of = _byte_chars()
        byte_ids = np.zeros(256, np.int64)
        for c, b in bytes_of.items():
            byte_ids[b] = vocab[c]
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            product.append(vocab[a + b])
        rank = np.arange(len(left))
    else:
        with open(base + ".tiktoken", "rb") as f:
            vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte_ids = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        for word, i in vocab.items():  # every split of a token into two tokens is a merge of the token's rank
            for k in range(1, len(word)):
                a, b = vocab.get(word[:k]), vocab.get(word[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    product.append(i)
        rank = np.array(product)
    key = np.array(left, np.int64) << 16 | np.array(right, np.int64)
    order = np.argsort(key, kind="stable")
    return Merges(key[order], np.asarray(rank, np.int64)[order], np.array(product, np.int64)[order], byte_ids)


def replay(words: list[bytes], m: Merges, table: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word)."""
    if table is None:
        table = pair_table(m)
    parts, lo, size = [], 0, 0
    for i, w in enumerate(words):
        if i > lo and size + len(w) > REPLAY_BYTES:
            parts.append(_replay(words[lo:i], m, table))
            lo, size = i, 0
        size += len(w)
    if lo < len(words):
        parts.append(_replay(words[lo:], m, table))
    return tuple(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int32) for k in (0, 1))


def _ints(values: np.ndarray | range) -> list[int] | array:
    """A list, or for one very long word an array, which is slower but takes a fifth of the space."""
    return list(values) if len(values) <= 4 * REPLAY_BYTES else array("q", np.asarray(values, np.int64).tobytes())


def _replay(words: list[bytes], m: Merges, table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words that are laid out as one array."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # one gap of -1 between words keeps pairs inside them
    at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(words)) + 1, lengths)
    size = int(lengths.sum()) + len(words) + 1
    flat = np.full(size, -1, np.int64)
    flat[at] = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    key = flat[:-1] << 16 | flat[1:]
    key[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
    i = np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)
    hit = np.flatnonzero(m.pairs[i] == key)
    slot = i[hit]
    order = np.lexsort((hit, slot))
    slot, hit = slot[order], hit[order]
    cut = np.flatnonzero(np.diff(slot)) + 1
    index: dict[int, list[int]] = {int(s[0]): p.tolist() for s, p in zip(np.split(slot, cut), np.split(hit, cut), strict=True)} if len(slot) else {}
    ranks, products, pairs = m.ranks, m.products, m.pairs
    heap = [(int(ranks[s]), s) for s in index]
    heapq.heapify(heap)
    tok, nxt, prv = _ints(flat.tolist() if size <= 4 * REPLAY_BYTES else flat), _ints(range(1, size + 1)), _ints(range(-1, size - 1))
    rank_of = ranks.tolist()
    while heap:
        _, s = heapq.heappop(heap)
        where = index.pop(s)
        where.sort()
        pair, c = int(pairs[s]), int(products[s])
        a, b = pair >> 16, pair & 0xFFFF
        for p in where:
            if tok[p] != a:
                continue
            q = nxt[p]
            if tok[q] != b:
                continue
            r = nxt[q]
            tok[p], tok[q] = c, -2
            nxt[p] = r
            prv[r] = p
            left, right = tok[prv[p]], tok[r]
            if left >= 0 and (t := table.get(left << 16 | c)) is not None:
                if t in index:
                    index[t].append(prv[p])
                else:
                    index[t] = [prv[p]]
                    heapq.heappush(heap, (rank_of[t], t))
            if right >= 0 and (t := table.get(c << 16 | right)) is not None:
                if t in index:
                    index[t].append(p)
                else:
                    index[t] = [p]
                    heapq.heappush(heap, (rank_of[t], t))
    out = np.array(tok, np.int64)
    keep = out >= 0
    word = np.cumsum(out == -1)[keep] - 1
    return out[keep].astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int32)


def pair_table(m: Merges) -> dict[int, int]:
    """Pair to its place in the merge table."""
    return dict(zip(m.pairs.tolist(), range(len(m.pairs)), strict=True))


def _gather(ids: np.ndarray, count: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``which`` of (ids, count), one after the other, and the length of each."""
    begin = np.cumsum(count, dtype=np.int64) - count
    n = count[which].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(begin[which] - (ends - n), n) + np.arange(total)], n


class Encoder:
    """Encodes batches of texts and keeps what it has seen.

    A text is cut before every blank that a non-blank follows: there the splitting pattern always ends a word and never
    looks across. Such a chunk is split into words and encoded when it is first seen; texts take their ids by chunk.
    """

    def __init__(self, merges: Merges) -> None:
        import re

        import regex

        self.merges, self.table = merges, pair_table(merges)
        self.words = regex.compile(PATTERN).findall
        self.cut, self.odd = re.compile(r" (?=\S)").split, re.compile(r" (?!\S)").search
        self.reset()

    def reset(self) -> None:
        self.kept = 0
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.word_ids, self.word_count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def chunks(self, text: str | None, fresh: list[str], long: list[str]) -> list[int]:
        """Numbers of the chunks of a text; new ones go to ``fresh``, those too long to be kept to ``long`` (as -1, -2 ..)."""
        if not text:
            return []
        head, *tail = self.cut(text) if self.odd(text) else text.split(" ")
        get = self.later.get
        out = [self.first.get(head, -1), *[get(x, -1) for x in tail]]
        if -1 in out:
            for i, n in enumerate(out):
                if n < 0:
                    seen, x = (self.later, tail[i - 1]) if i else (self.first, head)
                    if len(x) > CACHED_LENGTH:
                        long.append(" " + x if i else x)
                        n = -len(long)
                    elif (n := seen.get(x, -1)) < 0:
                        n = seen[x] = len(self.first) + len(self.later)
                        self.kept += len(x) + 8
                        fresh.append(" " + x if i else x)
                    out[i] = n
        return out

    def learn(self, fresh: list[str]) -> None:
        """Take in the ids of new chunks."""
        known, number = len(self.number), self.number
        of_chunk = [[number.setdefault(w, len(number)) for w in self.words(c)] for c in fresh]
        ids, count = replay([w.encode("utf-8", "surrogatepass") for w in list(number)[known:]], self.merges, self.table)
        self.word_ids, self.word_count = np.concatenate([self.word_ids, ids]), np.concatenate([self.word_count, count])
        ids, n = _gather(self.word_ids, self.word_count, np.fromiter((w for c in of_chunk for w in c), np.int64))
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, _per(of_chunk, n)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if self.kept > CACHE_CHARS:
            self.reset()
        fresh: list[str] = []
        long: list[str] = []
        docs = [self.chunks(t, fresh, long) for t in texts]
        if fresh:
            self.learn(fresh)
        ids, count = self.ids, self.count
        which = np.fromiter((c for d in docs for c in d), np.int64)
        if long:
            number: dict[str, int] = {}
            of_chunk = [[number.setdefault(w, len(number)) for w in self.words(c)] for c in long]
            word_ids, word_count = replay([w.encode("utf-8", "surrogatepass") for w in number], self.merges, self.table)
            more, n = _gather(word_ids, word_count, np.fromiter((w for c in of_chunk for w in c), np.int64))
            which = np.where(which < 0, len(count) - 1 - which, which)
            ids, count = np.concatenate([ids, more]), np.concatenate([count, _per(of_chunk, n)])
        out, n = _gather(ids, count, which)
        return out, _per(docs, n).astype(np.int64)


def _per(groups: list[list[int]], n: np.ndarray) -> np.ndarray:
    """Sums of ``n``, which has one entry per member of each group, by group."""
    ends = np.cumsum(np.fromiter(map(len, groups), np.int64, len(groups)))
    total = np.concatenate([[0], np.cumsum(n)])
    return np.diff(total[np.concatenate([[0], ends])]).astype(np.int32)


def encoded(batches: Iterator[pa.RecordBatch], enc: Encoder) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, ids, number of ids of each text) of the slices of batches (key, text)."""
    for b in batches:
        for part in bounded_slices(b, SLICE_BYTES):
            if part.num_rows:
                yield part.column(0), *enc.encode(part.column(1).to_pylist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, merges: Merges) -> Encoder:
    """The worker's encoder of one tokenizer, kept between tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(merges)
    return _ENCODERS[name]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """key, ids (array of int) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer, directory))
    name = f"{directory or TOKENIZER_DIR}/{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, n in encoded(batches, encoder(name, shared.value)):
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[key, "ids"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def token_bytes(m: Merges) -> dict[int, bytes]:
    """The bytes of every token that merges make."""
    out = {int(i): bytes([b]) for b, i in enumerate(m.byte_ids)}
    for j in np.argsort(m.ranks, kind="stable"):
        a, b = int(m.pairs[j]) >> 16, int(m.pairs[j]) & 0xFFFF
        if a in out and b in out:
            out.setdefault(int(m.products[j]), out[a] + out[b])
    return out


def decode_corpus(df: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """key, text of every row of key and ids; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(token_bytes(load_merges(tokenizer, directory)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            texts = [None if x is None else b"".join(map(known.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    src = df.select(key, "ids")
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, text string")
