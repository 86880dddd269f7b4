"""Removal of word windows that an earlier document holds (operator 9).

A window is ``window`` consecutive words of one document. A word goes if some
window that covers it also starts in a document with a smaller doc_id.

Method: count-min prefilter, then exact groups.

1. Each partition sketches its windows. All windows around one spot share the
   smallest hash of the half-window runs inside them (their *anchor*), and equal
   windows have equal anchors, so the number of documents with a window's anchor
   is never below the number with that window. A partition's sketch is kept
   sparse, two rows of 2**32 cells; the sketches are added up cell range by cell
   range.
2. The cells that at least two documents hit are folded into a bitmap, which is
   broadcast. It has a bit for each eight bytes of text, from 2**FOLD_BITS to
   2**FOLD_MOST bits. Folding can only add windows, never lose one; beyond the
   largest bitmap more windows go on to step 3.
3. Windows estimated repeated are grouped exactly, by 96 bits of hash: each block
   of documents sends each distinct window once with its smallest doc_id, each
   shard of windows answers each block with the smallest doc_id of all. A window
   in a third of all documents thus costs its shard one entry per block.
4. Each block drops the words of its windows whose smallest doc_id is below the
   document's own.

Defined cases: null or empty text has no words and keeps an empty text. A row
without doc_id is judged as larger than every id. Rows with the same doc_id do
not remove each other's words. Other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import BLOCK_BYTES, n_blocks, pack, pack_sorted, shard_of, slices, stored, unpack, unpack_sorted, with_block
from varigrid.llm.textvec import mix, run_hashes, string_buffers, word_chunks

WINDOW = 50
FOLD_BITS = 24
FOLD_MOST = 30
FLUSH = 4_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)
_ROWS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, m = 1, x
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _windows(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions at which windows start, their anchors, and the row of each."""
    n = len(words.hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    whole = np.flatnonzero(row[:n] == row[window - 1 :])
    half = max(1, window // 2)
    anchors = _sliding_min(run_hashes(words.hashes, half, 0x2545F4914F6CDD1D), window - half + 1)
    return whole, anchors[whole], row[whole]


def _cells(anchors: np.ndarray, row: int) -> np.ndarray:
    return mix(anchors ^ _ROWS[row]) >> np.uint64(32)


def _sketch(window: int, bits: int):
    """mapInArrow: texts to the partition's sparse sketches, cut into ranges of cells."""

    def rows(seen: list[np.ndarray]):
        anchors = np.concatenate(seen)
        out = []
        for r in range(2):
            cells, n = np.unique(_cells(anchors, r), return_counts=True)
            at = np.searchsorted(cells, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
            for s in np.flatnonzero(np.diff(at)):
                part = slice(at[s], at[s + 1])
                out.append((r, int(s), pack_sorted(cells[part]), pack(np.minimum(n[part], 2))))
        return pa.RecordBatch.from_pylist([dict(zip(("sketch_row", "cell_range", "cells", "counts"), x, strict=True)) for x in out], pa.schema([("sketch_row", pa.int32()), ("cell_range", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))

    def run(batches):
        seen, held = [], 0
        for batch in batches:
            for words in word_chunks(batch.column(0), False):
                _, anchors, row = _windows(words, window)
                if not len(anchors):
                    continue
                new = np.ones(len(anchors), bool)  # neighbours mostly share an anchor
                new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                anchors, row = anchors[new], row[new]
                order = np.lexsort((anchors, row))
                anchors, row = anchors[order], row[order]
                new = np.ones(len(anchors), bool)  # a document counts once
                new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                seen.append(anchors[new])
                held += int(new.sum())
            if held > FLUSH:
                yield rows(seen)
                seen, held = [], 0
        if seen:
            yield rows(seen)

    return run


def _merge(bits: int, fold: int):
    """Sum the sketches of a cell range; give the cells with a count over one as a folded bitmap."""

    def run(table: pa.Table) -> pa.Table:
        cells = np.concatenate([unpack_sorted(x) for x in table["cells"].to_pylist()])
        counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        at = np.flatnonzero(np.diff(cells, prepend=cells[0] - np.uint64(1)))
        repeated = cells[at][np.add.reduceat(counts, at) > 1]
        flags = np.zeros(1 << (fold - bits), bool)
        flags[(repeated >> np.uint64(32 - fold)) & np.uint64(len(flags) - 1)] = True
        return pa.table({"sketch_row": table["sketch_row"][:1], "cell_range": table["cell_range"][:1], "bitmap": pa.array([np.packbits(flags, bitorder="little").tobytes() if len(repeated) else b""], pa.binary())})

    return run


def repeat_filter(docs: DataFrame, window: int = WINDOW, fold_bits: int = FOLD_BITS) -> list[bytes]:
    """The two folded bitmaps of cells that at least two documents hit, of 2**fold_bits to 2**FOLD_MOST bits each."""
    blocks = n_blocks(docs)
    bits = min(16, max(8, (blocks - 1).bit_length()))
    fold = max(fold_bits, bits + 3, min(FOLD_MOST, (blocks * BLOCK_BYTES // 8).bit_length()))
    parts = docs.select("text").mapInArrow(_sketch(window, bits), "sketch_row int, cell_range int, cells binary, counts binary").groupBy("sketch_row", "cell_range").applyInArrow(_merge(bits, fold), "sketch_row int, cell_range int, bitmap binary")
    size = 1 << (fold - bits - 3)
    maps = [bytearray(1 << (fold - 3)) for _ in range(2)]
    for r in parts.filter("length(bitmap) > 0").toLocalIterator():
        maps[r.sketch_row][r.cell_range * size : (r.cell_range + 1) * size] = r.bitmap
    return [bytes(m) for m in maps]


def _flagged(anchors: np.ndarray, maps: list[bytes]) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for r, m in enumerate(maps):
        cell = _cells(anchors, r) >> np.uint64(32 - (len(m) * 8 - 1).bit_length())
        out &= (np.frombuffer(m, np.uint8)[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _ordered_id(ids: pa.ChunkedArray) -> np.ndarray:
    """doc_id as an unsigned number of the same order; null above all."""
    null = np.asarray(ids.is_null())
    v = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64) ^ _SIGN
    v[null] = _NONE
    return v


class _Block:
    """The windows of a block that are estimated repeated, and the distinct ones in order."""

    def __init__(self, table: pa.Table, maps: list[bytes], window: int):
        self.ids = _ordered_id(table["doc_id"])
        self.n_words = np.zeros(len(table), np.int64)
        h, g, row, pos = [], [], [], []
        for words in word_chunks(table["text"].combine_chunks(), False):
            self.n_words[words.row0 : words.row0 + len(words.counts)] = words.counts
            starts, anchors, rows = _windows(words, window)
            if not len(starts):
                continue
            hit = _flagged(anchors, maps)
            starts, rows = starts[hit], rows[hit]
            h.append(run_hashes(words.hashes, window, 0x94D049BB133111EB)[starts])
            g.append(run_hashes(words.hashes, window, 0xD6E8FEB86659FD93)[starts] >> np.uint64(32))
            row.append(rows + words.row0)
            pos.append(starts - words.first[:-1][rows])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        h, g, self.row, self.pos = cat(h, np.uint64), cat(g, np.uint64), cat(row, np.int64), cat(pos, np.int64)
        order = np.lexsort((g, h))
        h, g, self.row, self.pos = h[order], g[order], self.row[order], self.pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.at = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.h, self.g = h[self.at], g[self.at]


_ASK = "shard int, block int, h binary, g binary, ids binary"


def _ask(filters, window: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, filters.value, window)
        first = np.minimum.reduceat(b.ids[b.row], b.at) if len(b.at) else np.zeros(0, np.uint64)
        at, out = slices(shard_of(b.h, shards), shards), []
        for s in np.flatnonzero(np.diff(at)):
            p = slice(at[s], at[s + 1])
            out.append({"shard": int(s), "block": table["block"][0].as_py(), "h": pack_sorted(b.h[p]), "g": pack(b.g[p]), "ids": pack(first[p])})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("ids", pa.binary())]))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each window that a block sent, the smallest doc_id that any block sent with it."""
    parts = [(unpack_sorted(h), unpack(g), unpack(i)) for h, g, i in zip(table["h"].to_pylist(), table["g"].to_pylist(), table["ids"].to_pylist(), strict=True)]
    h, g, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    out = np.empty(len(h), np.uint64)
    out[order] = first[np.cumsum(new) - 1]
    out = np.where(out == ids, np.uint64(0), out + np.uint64(1))  # 0: the block's own is the smallest
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pa.table({"block": table["block"], "shard": table["shard"], "smallest": pa.array([pack(x) for x in np.split(out, cut)], pa.binary())})


def _keep(filters, window: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        b = _Block(texts, filters.value, window)
        smallest = np.zeros(0, np.uint64)
        if len(answers):
            order = np.argsort(np.asarray(answers["shard"]))
            packed = answers["smallest"].to_pylist()
            smallest = np.concatenate([unpack(packed[i]) for i in order])
        own = np.minimum.reduceat(b.ids[b.row], b.at) if len(b.at) else np.zeros(0, np.uint64)
        smallest = np.where(smallest == 0, own, smallest - np.uint64(1))
        gone = smallest[b.group] < b.ids[b.row] if len(b.at) else np.zeros(0, bool)
        row, pos = b.row[gone], b.pos[gone]
        order = np.argsort(row, kind="stable")
        row, pos = row[order], pos[order]
        raw, at = string_buffers(texts["text"])
        kept, removed = [], np.zeros(len(texts), np.int64)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        for r in range(len(texts)):
            words = raw[at[r] : at[r + 1]].tobytes().split()
            if bounds[r] < bounds[r + 1]:
                p = pos[bounds[r] : bounds[r + 1]]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                removed[r] = len(words) - int(stay.sum())
                words = list(compress(words, stay.tolist()))
            kept.append(b" ".join(words))
        return pa.table({"doc_id": texts["doc_id"].cast(pa.int64()), "n_words": b.n_words, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, fold_bits: int = FOLD_BITS) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_removed, kept): the kept words joined by one space."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    filters = spark.sparkContext.broadcast(repeat_filter(docs, window, fold_bits))
    n = n_blocks(docs)
    blocks = with_block(docs, n)
    asked = blocks.groupBy("block").applyInArrow(_ask(filters, window, n), _ASK)
    answers = stored(asked.groupBy("shard").applyInArrow(_answer, "block int, shard int, smallest binary"), "windows")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_keep(filters, window), "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
