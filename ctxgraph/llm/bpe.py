"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Semantics: a text is cut by the split pattern; each match is encoded separately, without special tokens: bytes that are
a vocabulary entry give its id, all others start as single bytes and the adjacent pair of the lowest rank is merged,
leftmost first, until no pair has a rank. Null texts count as empty; an empty text has no tokens. Decoding joins the
byte strings of the ids. Rows are kept one for one, whatever repeats or ties they hold, and extra columns pass through.

The queue: one bucket for each merge rank holds positions of a doubly linked list over the bytes; a two-level bitmap
(a word of 256 ranks, a word of words) finds the lowest non-empty bucket by find-first-set. Entries whose pair has
changed since are stale and skipped. Every push and pop is O(1) in the length of the pre-token but for the bucket's
own heap, so that a pre-token of a megabyte takes time in proportion.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: White space next to white space, or characters of which engines disagree whether they are white space.
HARD = re.compile(r"\s\s|[\x1c-\x1f\x85\u180e]|[^\S \n]")
#: Bytes of a pre-token beyond which it is merged alone.
LONG = 64


class RankEncoder:
    """Encoder of one worker. ``encode_all`` gives ids as packed little-endian unsigned 32-bit integers.

    No pre-token reaches over a place where white space follows something else, so texts are cut there into chunks and
    each distinct chunk is encoded once. ``cache`` bounds the chunks kept from one call to the next; it decides speed
    alone.
    """

    def __init__(self, path: str, pattern: str, cache: int = 150_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.cache, self.chunks = cache, {}
        get = self.ranks.get
        pairs = [(a << 32 | b, v) for k, v in self.ranks.items() for i in range(1, len(k)) if (a := get(k[:i])) is not None and (b := get(k[i:])) is not None]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([v for _, v in pairs] or [-1], np.int32)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens through one queue over all of them.

        Pre-tokens don't touch, so the lowest rank of all is the lowest of every pre-token that holds it; a step takes a
        whole bucket, but of each pre-token only the leftmost pair, as a merge may bring a lower rank next to it.
        """
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        rank = np.full(n, -1, np.int32)
        first = np.flatnonzero(after >= 0)
        rank[first] = self._rank(ids[first], ids[first + 1])
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        low = [0] * (len(self.bytes) // 256 + 1)
        top = 0

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            if len(at) == 1:
                parts = [(int(ranks[0]), at)]
            else:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                parts = zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at])
            for r, part in parts:
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [part]
                    low[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
                else:
                    bucket.append(part)

        start = np.flatnonzero(rank >= 0).astype(np.int32)
        if len(start):
            push(start, rank[start])
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            r = high << 8 | (word & -word).bit_length() - 1
            low[high] = word = word & (word - 1)
            if not word:
                top &= top - 1
            parts = buckets.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]  # the others are stale
            if len(at) == 0:
                continue
            if len(at) > 1:
                at = np.sort(at)
                own = of[at]
                leftmost = np.empty(len(at), bool)
                leftmost[0] = True
                np.not_equal(own[1:], own[:-1], out=leftmost[1:])
                if not leftmost.all():
                    push(at[~leftmost], np.full(int((~leftmost).sum()), r, np.int32))
                    at = at[leftmost]
            gone = after[at]
            end = after[gone]
            ids[at] = r
            alive[gone] = False
            rank[gone] = -1
            rank[at] = -1
            after[at] = end
            more = end >= 0
            left, right = at[more], end[more]
            before[right] = left
            back = before[at]
            lead = back[back >= 0]
            left, right = np.concatenate((left, lead)), np.concatenate((right, at[back >= 0]))
            if len(left) == 0:
                continue
            new = self._rank(ids[left], ids[right])
            rank[left] = new
            good = new >= 0
            if good.any():
                push(left[good], new[good])
        counts = np.add.reduceat(alive.astype(np.int64), ends - sizes)
        packed, stops = ids[alive].astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, longest = len(piece), self.longest
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                rank[i] = r
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [i]
                    high = r >> 8
                    low[high] = low.get(high, 0) | 1 << (r & 255)
                    top |= 1 << high
                else:
                    bucket.append(i)
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            r = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                word &= word - 1
                low[high] = word
                if not word:
                    top &= top - 1
            if rank[i] != r:
                continue  # stale: the pair at this position was merged or has grown
            gone = after[i]
            end = after[gone]
            rank[gone] = -1
            after[i] = end
            if end < n:
                before[end] = i
            for at in (i, before[i]):
                if at < 0:
                    continue
                mid = after[at]
                if mid >= n:
                    rank[at] = -1
                    continue
                stop = after[mid]
                r = get(piece[at:stop]) if stop - at <= longest else None
                if r is None:
                    rank[at] = -1
                    continue
                rank[at] = r
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [at]
                    high = r >> 8
                    low[high] = low.get(high, 0) | 1 << (r & 255)
                    top |= 1 << high
                else:
                    heappush(bucket, at)
        ids, ranks, i = [], self.ranks, 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk as ``encode_all`` makes them: one that starts with a line end stands for itself, others
        follow a space."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.split(chunk if chunk[:1] == "\n" else " " + chunk)

    def _encode_words(self, words: set[str]) -> dict[str, bytes]:
        done, short = {}, []
        for w in words:
            b = w.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                done[w] = whole.to_bytes(4, "little")
            elif len(b) > LONG:
                done[w] = array("I", self.merge(b)).tobytes()
            else:
                short.append((w, b))
        done.update(zip((w for w, _ in short), self.merge_all([b for _, b in short])))
        return done

    def encode_all(self, texts: list[str]) -> list[bytes]:
        known, cut, missing, words = self.chunks, [], set(), set()
        if len(known) > self.cache:
            known.clear()
        for t in texts:
            if HARD.search(t):
                first, chunks = self.split(t), []
            else:
                first, *chunks = t.replace("\n", " \n").split(" ")
                first = self.split(first)
            words.update(first)
            missing.update(filterfalse(known.__contains__, chunks))
            cut.append((first, chunks))
        lists = {c: self._words(c) for c in missing}
        for x in lists.values():
            words.update(x)
        done = self._encode_words(words)
        for c, x in lists.items():
            known[c] = done[x[0]] if len(x) == 1 else b"".join([done[w] for w in x])
        out = [b"".join([*map(done.__getitem__, first), *map(known.__getitem__, chunks)]) for first, chunks in cut]
        for c in lists:
            if len(c) > LONG:
                del known[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, array("I", packed)))


_encoders: dict[tuple, RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder for each worker process, kept over tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(path, pattern)
    return _encoders[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Texts one by one, nulls as empty."""
    for x in column:
        yield x.as_py() or ""


def portions(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text, so that memory doesn't follow the texts' lengths."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, text: str = "text", out: str = "token_ids", vocabulary: tuple[str, str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add ``out``: the ids as packed little-endian unsigned 32-bit integers (binary, never null). Replaces a column of
    that name. With ``decoded`` the ids are decoded again by the same worker, into a column of that name. No shuffle: rows
    are encoded where they are read."""
    made = [out] + [decoded] * (decoded is not None)

    def work(own: RankEncoder, part: pa.RecordBatch) -> list[list[bytes]]:
        ids = own.encode_all(list(texts_of(part.column(text))))
        return [ids] + [list(map(own.decode, ids))] * (decoded is not None)

    return _mapped(docs, text, made, vocabulary, work)


def decode(docs: DataFrame, ids: str = "token_ids", out: str = "decoded", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Add ``out``: the bytes (binary) that the packed ids stand for; null ids give empty bytes."""
    return _mapped(docs, ids, [out], vocabulary, lambda own, part: [[own.decode(x.as_py() or b"") for x in part.column(ids)]])


def _mapped(docs: DataFrame, source: str, made: list[str], vocabulary: tuple[str, str] | None, work) -> DataFrame:
    ship(docs.sparkSession)
    path, pattern = vocabulary or default_vocabulary()
    kept = [c for c in docs.columns if c not in made]
    schema = docs.select(*map(_q, kept)).withColumns({c: F.lit(b"") for c in made}).schema

    def run(batches):
        own = encoder(path, pattern)
        for b in batches:
            for part in portions(b, source):
                columns = [pa.array(x, pa.binary()) for x in work(own, part)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + columns, names=[*kept, *made])

    return docs.mapInArrow(run, schema)


def _q(c: str):
    return F.col("`" + c.replace("`", "``") + "`")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded="decoded").select(
        "doc_id",
        F.expr("CAST(octet_length(token_ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
