"""Near-duplicate documents by circulant MinHash (operator 1).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set holds its
distinct shingles of ``SHINGLE`` words (all words as one, if fewer). Documents are
linked if 100 * intersection >= PERCENT * union; a component is what links join.

1. Circulant signatures: one permutation of 32-bit numbers scatters a shingle,
   a second one, shifted circularly by k places, gives its k-th value; the least
   of them over the set is coordinate k. So two permutations make all
   ``BANDS * ROWS`` coordinates.
2. Documents with equal sets are one class from here on, so copies cost nothing.
3. Classes that agree in a whole band share a bucket. Buckets with equal members
   are taken once. Inside each bucket, signatures are compared and the pairs that
   agree in at least ``AGREE`` of all coordinates (four standard deviations below
   the threshold and more) are reduced to a spanning forest; connected components
   of these edges are families.
4. Families get the full sets, exact intersections are counted from an inverted
   list, and a spanning forest of the confirmed links is kept. Its connected
   components are the result. No pair beyond a forest is ever written.

A bucket or family larger than ``GROUP`` is dealt into parts, and each two parts
meet in a task of their own, so no group is bounded by one task's memory.
A link is lost only if its classes share none of the bands, at most 3e-7 at the
threshold, or fall below AGREE.

Defined cases: null text, empty text and text without words have an empty set,
are linked with nothing and are kept. A row without doc_id is linked with
nothing, has no component_id and is kept. Rows with equal doc_id are one
document, also where their texts differ: what one is linked with, the other is,
and all have the same component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded, stored
from varigrid.llm.textvec import mix, run_hashes, word_chunks
from varigrid.plans.components import connected_components
from varigrid.plans.storage import discard

SHINGLE = 5
PERCENT = 85
BANDS = 32
ROWS = 6
AGREE = 0.72
GROUP = 1024
GROUP_SHINGLES = 4 << 20
_BASE = 0x2545F4914F6CDD1D
_C1, _C2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Row number and sorted distinct 64-bit shingles of each text that has words."""
    for words in word_chunks(column, True):
        runs = run_hashes(words.hashes, k, _BASE)
        for r, n in enumerate(words.counts):
            at = words.first[r]
            if n >= k:
                yield words.row0 + r, np.unique(runs[at : at + n - k + 1])
            elif n:
                yield words.row0 + r, run_hashes(words.hashes[at : at + n], int(n), _BASE + 2 * int(n))


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash signatures, a row a set; no set may be empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    scattered = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(sets)), np.uint32)
    t, u = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(size):
        np.add(scattered, np.uint32(k), out=t)
        np.multiply(t, _C1, out=t)
        np.right_shift(t, np.uint32(15), out=u)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, _C2, out=t)
        out[k] = np.minimum.reduceat(t, starts)
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), part.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, d1, d2, bands, sig): set size, 128-bit digest of the set, band keys, low bytes of the signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for batch in bounded(batches):
            m = batch.num_rows
            n, digest = np.zeros(m, np.int64), np.zeros((m, 2), np.int64)
            keys: list = [None] * m
            sig: list = [None] * m
            held: list = []

            def flush():
                if held:
                    got = signatures([s for _, s in held], bands * rows)
                    for (r, _), k, g in zip(held, band_keys(got, bands, rows), (got & np.uint32(255)).astype(np.uint8), strict=True):
                        keys[r], sig[r] = k, g.tobytes()
                    held.clear()

            size = 0
            for r, s in shingle_sets(batch.column(1), shingle):
                n[r] = len(s)
                digest[r] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                held.append((r, s))
                size += len(s)
                if size > 1 << 16:
                    flush()
                    size = 0
            flush()
            none = n == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digest[:, 0], mask=none), pa.array(digest[:, 1], mask=none), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary")


def _parts(df: DataFrame, node: str, parts) -> DataFrame:
    """Deal the members of groups into ``parts`` parts; a row for each pair of parts that a member meets in."""
    mine = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    df = df.withColumn("parts", parts.cast("int")).withColumn("mine", mine).withColumn("other", F.explode(others))
    return df.withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other")).drop("mine", "other", "parts")


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """Spanning forest by breadth-first search; linked(i, rest) tells which of the rest i is linked with."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            found = rest[hit]
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
            rest = rest[~hit]
    return out


def _bucket_edges(agree: float):
    """mapInArrow over members sorted by bucket: spanning forests of pairs with like signatures."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(nodes, sigs):
        m = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
        need = int(np.ceil(agree * m.shape[1]))
        return [(nodes[i], nodes[j]) for i, j in _forest(len(m), lambda i, rest: (m[rest] == m[i]).sum(1) >= need)]

    def run(batches):
        last, nodes, sigs = None, [], []
        for batch in batches:
            out = []
            key, p, q, rep, sig = (c.to_pylist() for c in batch.columns)
            for k, node, s in zip(zip(key, p, q, strict=True), rep, sig, strict=True):
                if k != last:
                    if len(nodes) > 1:
                        out += edges(nodes, sigs)
                    last, nodes, sigs = k, [], []
                nodes.append(node)
                sigs.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)
        if len(nodes) > 1:
            out = edges(nodes, sigs)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)

    return run


def _exact_edges(percent: int):
    """Spanning forest of the exact links in one group of full sets."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        n = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(ids, kind="stable")
        owner = owner[order]
        lists = np.searchsorted(ids[order], np.arange(int(ids.max()) + 2))
        mine = np.split(ids, np.cumsum(n)[:-1])

        def linked(i, rest):
            starts, sizes = lists[mine[i]], lists[mine[i] + 1] - lists[mine[i]]
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            both = np.bincount(owner[at], minlength=len(sets))[rest]
            return 100 * both >= percent * (n[i] + n[rest] - both)

        out = _forest(len(sets), linked)
        return pa.table({"a": pa.array([nodes[i] for i, _ in out], pa.int64()), "b": pa.array([nodes[j] for _, j in out], pa.int64())})

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in bounded(batches):
            sets = [b""] * batch.num_rows
            for r, s in shingle_sets(batch.column(2), shingle):
                sets[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["family", "node", "shingles"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, agree: float = AGREE, group: int = GROUP) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = stored(sketches(docs, shingle, bands, rows), "sketches")
    known = sk.filter("doc_id IS NOT NULL AND d1 IS NOT NULL")
    classes = stored(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n").alias("n")), "classes")
    members = classes.select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo")).filter("c > 1")
    once = shared.groupBy("c", "x", "lo").agg(F.min("key").alias("key")).select("key", "c")
    pairs = members.join(once, "key").join(classes.select("rep", "sig"), "rep")
    dealt = _parts(pairs, "rep", F.ceil(F.col("c") / group)).select("key", "p", "q", "rep", "sig")
    rough = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_bucket_edges(agree), "a long, b long")
    # links are stored before they are contracted: in one stage each task would hold two Python workers, and an executor keeps all of them
    rough = stored(rough, "rough")
    families = connected_components(rough, name="families").select(F.col("node"), F.col("component").alias("family"))
    families = stored(families, "families")
    discard(rough)
    sizes = families.join(classes.select(F.col("rep").alias("node"), "n"), "node").groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    text = docs.join(families, docs["doc_id"] == families["node"]).select("family", "node", "text").mapInArrow(_sets(shingle), "family long, node long, shingles binary").filter("length(shingles) > 0")
    parts = F.greatest(F.ceil(F.col("c") / group), F.ceil(F.col("n") / GROUP_SHINGLES))
    # dealt by all three, as what is dealt by family alone would keep a family's parts in one task
    full = _parts(text.join(sizes, "family"), "node", parts).select("family", "p", "q", "node", "shingles").repartition("family", "p", "q")
    exact = full.groupBy("family", "p", "q").applyInArrow(_exact_edges(percent), "a long, b long")
    # a doc_id with several texts joins their classes
    several = known.groupBy("doc_id", "d1", "d2").agg(F.count("*")).groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    same = known.join(several, "doc_id").select("doc_id", "d1", "d2").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    links = stored(exact.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "exact")
    comps = stored(connected_components(links, name="links"), "components")
    discard(links)
    of_class = classes.select("d1", "d2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    with_words = sk.filter("d1 IS NOT NULL").select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left").select("doc_id", "n", "component")
    without = sk.filter("d1 IS NULL").select("doc_id", "n").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    out = with_words.unionByName(without).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Rows with equal doc_id are one document and stay or go together; rows without
    doc_id or words stay.
    """
    gone = near_duplicates(docs, **how).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
