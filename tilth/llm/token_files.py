"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, level 1
the second chunk of the ids that have one, and so on. Beside each level but the last lies a bitmap
that says which ids continue, and a rank directory with the number of ones before every 512 bits; the
place of an id's next chunk is the rank of its bit, so any id is read by a few direct look-ups and no
block is ever decoded.

A file: 8 bytes magic, a table of little-endian 64-bit sizes, then the documents' ids, their starts,
and for each level chunks, bitmap and directory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.llm import files
from tilth.llm._shared import checkpoint, fresh_dir, remove_dir, text_of
from tilth.llm.encoding import encoder

MAGIC, BLOCK = b"TILTHDAC", 512
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _directory(bitmap: np.ndarray) -> np.ndarray:
    counts = np.add.reduceat(ONES[bitmap], np.arange(0, len(bitmap), BLOCK // 8), dtype=np.int64) if len(bitmap) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(counts)]).astype("<u8")


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """ids of all documents in order; doc_ids may hold None (kept as a mask)."""
    mask = np.array([d is None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), mask.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> 8 > 0
        parts.append((rest & 255).astype(np.uint8).tobytes())
        if not more.any():
            break
        bitmap = np.packbits(more, bitorder="little")
        parts += [bitmap.tobytes(), _directory(bitmap).tobytes()]
        rest = rest[more] >> 8
    return MAGIC + np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


class TokenFile:
    """Random access to the ids in the bytes of a file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(data, "<u8", 1, 8)[0])
        sizes = np.frombuffer(data, "<u8", n, 16).astype(np.int64)
        ends = 16 + 8 * n + np.cumsum(sizes)
        parts = [memoryview(data)[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        mask = np.frombuffer(parts[1], np.uint8)
        self.doc_ids = [None if m else int(d) for d, m in zip(np.frombuffer(parts[0], "<i8"), mask, strict=True)]
        self.starts = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.levels = []
        for i in range(3, n, 3):
            bitmap, ranks = (np.frombuffer(parts[i + 1], np.uint8), np.frombuffer(parts[i + 2], "<u8")) if i + 1 < n else (None, None)
            self.levels.append((np.frombuffer(parts[i], np.uint8), bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """The id at place i, by rank alone."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * depth
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            i = int(ranks[i // BLOCK]) + int(ONES[bitmap[first : i >> 3]].sum()) + bin(int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids at places start to end - 1."""
        out = np.zeros(max(0, end - start), np.uint32)
        where = np.arange(len(out))
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * depth)
            if bitmap is None:
                break
            more = np.unpackbits(bitmap[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].astype(bool)
            first = start // BLOCK * (BLOCK // 8)
            rank = int(ranks[start // BLOCK]) + int(ONES[bitmap[first : start >> 3]].sum()) + bin(int(bitmap[start >> 3]) & ((1 << (start & 7)) - 1)).count("1") if start >> 3 < len(bitmap) else 0
            where = where[more]
            start, end = rank, rank + len(where)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(docs: DataFrame, to: str, tokenizer: str, end: int = 1, cut: str | None = "words", file_tokens: int = 4_000_000) -> DataFrame:
    """Writes all documents' ids below the URI `to`, in ascending doc_id order over the files; the manifest: part, seq, path, n_docs, n_tokens, start.

    Documents are dealt by ranges of doc_id and sorted within a range; a task encodes and writes
    files of about file_tokens ids (a document is never cut) in places that depend on its range
    alone, so a task that is run again replaces them. Defined cases: null text is empty and gets the
    end id only; rows that share a doc_id (or have none) follow each other by text, whose beginning parts
    them into ranges too; null doc_ids come first; an
    empty table writes nothing; other columns are not looked at.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, kept, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        coder = encoder(tokenizer, cut)

        def flush() -> pd.DataFrame:
            path = f"{to}/part-{part:06d}-{seq:06d}.dac"
            files.write(path, pack(np.concatenate(ids), kept, np.array([len(x) for x in ids])))
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(kept)], "n_tokens": [size]})

        for b in batches:
            for doc, got in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), coder.encode(list(b["text"]), end), strict=True):
                kept.append(doc)
                ids.append(got)
                size += len(got)
                if size >= file_tokens:
                    yield flush()
                    seq, kept, ids, size = seq + 1, [], [], 0
        if kept:
            yield flush()

    sorted_docs = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = checkpoint(sorted_docs.mapInPandas(work, "part int, seq int, path string, n_docs long, n_tokens long"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    return manifest.withColumn("own", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("own") + F.col("part_start")).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                f = TokenFile(files.read(path))
                crc = [zlib.crc32(f.document(i).astype("<u4").tobytes()) for i in range(len(f.doc_ids))]
                yield pd.DataFrame({"doc_id": pd.array(f.doc_ids, "Int64"), "start": start + f.starts[:-1], "n_tokens": np.diff(f.starts), "ids_crc32": np.array(crc, np.int64)})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that these few rows aren't put into one task
    return manifest.select("path", "start").repartition(n, "path").mapInPandas(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end: int = 1, cut: str | None = "words") -> DataFrame:
    """Writes the files in the shared folder, reads every document back, and removes them."""
    spark = docs.sparkSession
    to = fresh_dir(spark, "tokens")
    out = checkpoint(read_token_files(write_token_files(docs, to, tokenizer, end, cut)))
    remove_dir(spark, to)
    return out
