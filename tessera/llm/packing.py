"""Packing token streams into windows by best-fit decreasing.

Each document is tokenised whole and ended by id 0. What is longer than a
window is first cut into full windows; the rests, longest first, go each into
the tightest open window that still holds them, found by a segment tree over
remaining capacities. Tasks pack what they have read on their own, in runs of
at most ``RUN_PIECES`` rests. The pieces of windows that a task leaves less than
``FULL`` full, few unless the table lies in many small partitions or its rests
don't pair, are dealt by window to partitions of some ``SECOND_TOKENS`` tokens
and packed once more, so the fill doesn't hang on how the table is split.
Window numbers carry the task's number in their upper bits (and a bit for the
second packing), so they are unique, and the same again if a task is repeated.

Defined results: null text is an empty text (its id 0 alone is one piece);
repeated rows are packed each, equal lengths in order of id, start and checksum;
very long texts are cut, never shortened; columns beside ``doc_id`` and ``text``
are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .common import SLICE_ROWS, arrow_schema, lean, settle, texts_of, tidied

WINDOW = 1024
#: Rests that a run holds in memory, 40 bytes each or so.
RUN_PIECES = 1 << 18
#: Windows below this share are packed again, in partitions of so many tokens.
FULL, SECOND_TOKENS = 0.98, 1 << 22
#: Distinct space-separated chunks whose ids a task remembers.
CACHE_CHUNKS = 1 << 18
TOKENIZER = "byte_bpe_50k.json"


#: White space of either splitter, and its pairs with a space.
SPACES = [(c, " " + c, c + " ") for c in map(chr, range(0x3001)) if c.isspace()]


class Chunks:
    """Exact ids of whole texts, through a memory of space-separated chunks.

    The tokenizer's splitter ends a token before every single space between
    two non-space characters, and never merges across its splits, so a text's
    ids are its chunks' ids in a row. Texts with white space beside a space
    are tokenised whole. Chunks that aren't remembered are encoded from the
    same vocabulary's rank file, where there is one, which gives the same ids
    in less time; chunks that may hold special tokens go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.ranked = None
        if path.endswith(".json") and os.path.exists(ranks := path[:-5] + ".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if self.ranked and "<|" not in c and len(c) <= 256]
        rest = [*{*chunks}.difference(plain)]
        out = {c: struct.pack(f"<{len(ids)}I", *ids) for c, ids in zip(plain, map(self.ranked, plain), strict=True)} if plain else {}
        return out | dict(zip(rest, self.encode(rest), strict=True))

    def parts(self, text: str) -> list[str]:
        if "\0" in text or text[:1] == " " or text[-1:] == " " or any(c in text and (pre in text or post in text) for c, pre, post in SPACES):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        known = self.known
        fresh = self.encode_chunks([p for p in {p for parts in split for p in parts} if p not in known])
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        room = CACHE_CHUNKS - len(known) + len(fresh)  # the first ones met stay: the common ones are among them
        for i, p in enumerate(fresh):
            if i >= room or len(p) > 64:
                del known[p]
        return out


class Tightest:
    """Open windows by remaining capacity: a segment tree of counts over 0..window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the least room >= need."""
        at, count = need + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # climb to a right sibling that has windows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length (all between 1 and ``window``)."""
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, windows = Tightest(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room, at = tree.take(need) or (window, windows)
        if at == windows:
            windows += 1
        which[i], offset[i] = at, window - room
        if room > need:
            tree.add(room - need, at)
    return which, offset


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def rows_to_batch(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)


def first_number(second: bool = False) -> int:
    """The first window number of this task."""
    task = TaskContext.get()
    return (int(second) << 62) + ((task.partitionId() if task else 0) << 40)


def packed(rests: list[tuple], used: int, window: int) -> list[tuple]:
    """Pieces with their window, offset and the window's tokens."""
    lengths = np.array([r[2] for r in rests])
    which, offset = best_fit(lengths, window)
    fill = np.bincount(which, lengths).astype(int)[which]
    return [(*r, used + w, o, f) for r, w, o, f in zip(rests, which.tolist(), offset.tolist(), fill.tolist(), strict=True)]


def by_task(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """Every task's pieces in windows of its own; ``fill`` is a window's tokens."""
    spark_schema, out = arrow_schema(DDL + ", fill long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        # of the task, not kept by its worker: it would stay beside all that runs there later
        chunks = Chunks(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        used = first_number()
        rests: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal used
            if rests:
                rows = packed(rests, used, window)
                used = max(r[5] for r in rows) + 1
                rests.clear()
                yield rows_to_batch(rows, out)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                full: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), chunks(texts_of(part)), strict=True):
                    ids += b"\0\0\0\0"
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)
                        if row[2] == window:
                            full.append((*row, used, 0, window))
                            used += 1
                        else:
                            rests.append(row)
                if full:
                    yield rows_to_batch(full, out)
                if len(rests) >= RUN_PIECES:
                    yield from close()
        yield from close()

    return docs.select("doc_id", "text").mapInArrow(lean(run), spark_schema)


def again(pieces: DataFrame, window: int) -> DataFrame:
    """The second packing of ``pieces``, by partition."""
    spark_schema, out = arrow_schema(DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, rests = first_number(second=True), []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal used
            if rests:
                rests.sort(key=lambda r: (r[0] is None, *(v or 0 for v in r)))
                rows = packed(rests, used, window)
                used = max(r[5] for r in rows) + 1
                rests.clear()
                yield rows_to_batch([r[:-1] for r in rows], out)

        for batch in batches:
            rests.extend(zip(*(batch.column(n).to_pylist() for n in PIECE), strict=True))
            if len(rests) >= RUN_PIECES:
                yield from close()
        yield from close()

    return pieces.select(*PIECE).mapInArrow(lean(run), spark_schema)


@tidied
def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """A row a piece; ``tokenizer`` names a file of the public tokenizers, or is a path."""
    first = settle(by_task(docs, tokenizer, window))
    loose = first.where(F.col("fill") < F.lit(int(FULL * window)))
    tokens = loose.agg(F.sum("length")).head()[0]
    done = first.where(F.col("fill") >= F.lit(int(FULL * window))).drop("fill")
    return done.unionByName(again(loose.repartition(-(-tokens // SECOND_TOKENS), "sequence_id"), window)) if tokens else done


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
