"""Token counts by a map-side two-tier lookup, without shuffling pre-tokens.

Semantics: ``n_tokens`` is what the ``tokenizers`` library gives for the whole text with the vocabulary file, without
added special tokens, with special strings inside a text treated as the library's default does, no truncation and no
padding. Null texts count as empty (0 tokens, 0 bytes). Rows are kept one for one; repeated rows count alike.

The normalizer and pre-tokenizer of ``NORMALIZER`` and ``SPLIT`` never join anything over a space or a line end, so with a
vocabulary of these a text is cut there into chunks; with any other, the library counts whole texts. Texts of any length are
counted whole. A column named as the result is replaced. Tier one is a broadcast table of frequent chunks with their token counts (a blob of strings and a vector of
16-bit counts). It is fitted on a bounded sample of documents (``fit_docs``) and holds at most ``table_size``
chunks, so its size doesn't grow with the data; it decides speed alone, never a count. Tier two is a bounded cache in
each worker, which encodes what it misses with the library.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table
from .bpe import _q, portions, texts_of

FIT_DOCS, TABLE_SIZE, CACHE, LIMIT = 2_000, 65_536, 250_000, 2_048
LONG = 64
#: What the cutting into chunks relies on: white space is a blank before anything else sees it, and splits.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_counters: dict = {}
_tokenizers: dict = {}


def load(path: str):
    """(the library's tokenizer of a file, whether texts may be cut into chunks), kept by the process."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        plain = form.get("normalizer") == NORMALIZER and form.get("pre_tokenizer") == SPLIT and form.get("post_processor") is None
        added = form.get("added_tokens") or []
        cuts = plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or any(c.isspace() for c in a["content"]) for a in added)
        _tokenizers.clear()
        _tokenizers[path] = own, cuts
    return _tokenizers[path]


def chunks_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Counts:
    """Tier one and the worker's cache in one mapping from chunk to number of tokens."""

    def __init__(self, path: str, frequent: tuple[bytes, bytes], size: int = CACHE):
        self.tokenizer, self.cuts = load(path)
        blob, lengths = frequent
        self.frequent = dict(zip(blob.decode().split("\n"), np.frombuffer(lengths, "<u2").tolist())) if blob else {}
        self.frequent[""] = 0
        self.known, self.size = dict(self.frequent), size + len(self.frequent)
        self.stops = dict(zip(",.", self.library([",", "."]))) if self.cuts else {}

    def library(self, chunks: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(self, missing: set[str]) -> None:
        """Counts of chunks that aren't known. A full stop or comma after letters is a token of its own."""
        known, stem = self.known, {}
        for c in missing:
            if c[-1] in ",." and (w := c[:-1].lower()).isalpha():
                stem[c] = w
        ask = [c for c in missing if c not in stem] + [w for w in {*stem.values()} if w not in known and w not in missing]
        for k in range(0, len(ask), 20_000):
            part = ask[k : k + 20_000]
            known.update(zip(part, self.library(part)))
        for c, w in stem.items():
            known[c] = known[w] + self.stops[c[-1]]

    def count_all(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self.library(texts)
        if len(self.known) > self.size:
            self.known = dict(self.frequent)
        known, missing, cut = self.known, set(), []
        for t in texts:
            chunks = chunks_of(t)
            missing.update(filterfalse(known.__contains__, chunks))
            cut.append(chunks)
        self.learn(missing)
        out = [sum(map(known.__getitem__, chunks)) for chunks in cut]
        for c in missing:
            if len(c) > LONG:
                del known[c]
        return out


def fit(docs: DataFrame, path: str, text: str = "text", fit_docs: int = FIT_DOCS, table_size: int = TABLE_SIZE) -> tuple[bytes, bytes]:
    """The broadcast table: the most frequent chunks of about ``fit_docs`` documents, counted where they lie; empty where
    texts aren't cut into chunks."""
    if not load(path)[1]:
        return b"", b""
    n = docs.count()
    sample = docs.select(_q(text).alias("text")).sample(min(1.0, fit_docs / max(n, 1)), 7) if n > fit_docs else docs.select(_q(text).alias("text"))

    def run(batches):
        seen = Counter()
        for b in batches:
            for t in texts_of(b.column(0)):
                seen.update(c for c in chunks_of(t) if 0 < len(c) <= LONG)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], names=["chunk", "n"])

    rows = sample.mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(table_size).collect()
    chunks = [r.chunk for r in rows]
    return "\n".join(chunks).encode(), np.array(Counts(path, (b"", b"")).count_all(chunks), "<u2").tobytes()


def count(docs: DataFrame, text: str = "text", path: str | None = None, frequent: tuple[bytes, bytes] | None = None, out: str = "n_tokens") -> DataFrame:
    """Add ``out`` (long): the number of tokens. Other columns pass through."""
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    shared = spark.sparkContext.broadcast(frequent if frequent is not None else fit(docs, path, text))
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*map(_q, kept)).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        key = (path, shared.id if hasattr(shared, "id") else id(shared))
        counts = _counters.get(key)
        if counts is None:
            _counters.clear()
            counts = _counters[key] = Counts(path, shared.value)
        for b in batches:
            for part in portions(b, text):
                n = pa.array(counts.count_all(list(texts_of(part.column(text)))), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [n], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = count(docs.withColumn("n_bytes", n_bytes))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
