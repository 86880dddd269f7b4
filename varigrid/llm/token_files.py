"""Token ids in directly addressable codes, written and read back (operator 7).

An id is split into chunks of ``CHUNK`` bits, lowest first. Level 0 holds the
first chunk of every id, level j the j-th chunk of those ids that need it. Each
level has a bitmap that says which of its ids go on; where an id goes on to is
the number of set bits before it, found from a rank directory (one running sum
for each ``RANK`` bits) and one popcount. So any token is reached by a few array
look-ups at each level, without decoding what is before it.

File format: a folder with two Parquet tables. A segment holds consecutive
documents in ascending doc_id order.

    index/     segment long, first_token long, n_tokens long, part int, seq int
    segments/  part int, seq int, n_tokens long,
               doc_ids binary     little-endian int64 of each document
               nulls binary       bitmap of documents without doc_id
               doc_starts binary  little-endian int64, n_documents + 1 starts in the segment
               levels array<struct<chunks binary, more binary, ranks binary>>

``segment`` counts from 0, ``first_token`` is the number of ids of all segments
before it, and (part, seq) says where a segment is. The folder is all that a
reader needs (``open_tokens``, ``tokens_at``). Parquet gives atomic commits, any store
that Spark writes, and reads of single segments by their statistics.

Defined cases: null text is empty and has the end id alone. Rows without doc_id
come first. Rows with equal doc_id follow each other, by a hash of the text. Very
long texts are one document of one segment; a run of white space too long for the
compiled library is encoded by operator 4. An empty table gives no segment. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded, n_blocks, shared_dir
from varigrid.llm.bpe import PATTERN, byte_alphabet, default_path, encoder, texts

END_ID = 0
CHUNK = 8
RANK = 512
SEGMENT_TOKENS = 1 << 20
_LEVELS = "array<struct<chunks:binary,more:binary,ranks:binary>>"
_PART = f"part int, seq int, n_tokens bigint, doc_ids binary, nulls binary, doc_starts binary, levels {_LEVELS}"
#: The compiled library recurses on each character of a run of white space.
_LONG_SPACE = re.compile(r"\s{20000}")
_LEVEL_TYPE = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))


def encode_levels(ids: np.ndarray) -> list[dict]:
    """Chunk levels of ids. The last level has no set bit in ``more``."""
    out, rest = [], np.ascontiguousarray(ids, np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        per = np.add.reduceat(on, np.arange(0, len(on), RANK)) if len(on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32) if len(on) else np.zeros(0, np.uint32)
        out.append({"chunks": (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        if not on.any():
            return out
        rest = more[on]


def decode_levels(levels: list[dict], n: int) -> np.ndarray:
    """All n ids."""
    parts, count = [], n
    for level in levels:
        on = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=count, bitorder="little").astype(bool)
        parts.append((np.frombuffer(level["chunks"], np.uint8), on))
        count = int(on.sum())
    value = np.zeros(0, np.uint32)
    for chunks, on in reversed(parts):
        up = np.zeros(len(chunks), np.uint32)
        up[on] = value
        value = (up << np.uint32(CHUNK)) | chunks
    return value


class Segment:
    """Random access to the tokens of one stored segment."""

    def __init__(self, n_tokens: int, levels: list[dict]):
        self.n = n_tokens
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], np.uint32)) for x in levels]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, more, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not more[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK
            whole = more[block * RANK // 8 : i >> 3].tobytes()
            i = int(ranks[block]) + int.from_bytes(whole, "little").bit_count() + (int(more[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            shift += CHUNK
        return value


class LibraryEncoder:
    """Ids of a byte-level vocabulary file by the compiled library that takes the vocabulary as ranks.

    Only for files whose ids ascend with their merges, as then rank and id are the
    same; its ids equal those of the library that the file is made for.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_alphabet()
        merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if merged != sorted(set(merged)):
            raise ValueError(f"ids of {path} don't ascend with its merges")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(names.__getitem__, t)): i for t, i in vocab.items() if t not in self.added}
        self.codes = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) >= 20_000 and _LONG_SPACE.search(text):
            return encoder(self.path).encode(text)
        if any(t in text for t in self.added):
            return np.array(self.codes.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.codes.encode_ordinary(text), np.uint32)


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def _segments(path: str):
    """mapInArrow over sorted documents: the partition's segments, without their place in the whole."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("doc_starts", pa.binary()), ("levels", _LEVEL_TYPE)])

    def row(part: int, seq: int, ids: list, got: list) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype("<i8")
        known = np.array([0 if i is None else i for i in ids], "<i8")
        nulls = np.packbits([i is None for i in ids], bitorder="little")
        return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_tokens": int(starts[-1]), "doc_ids": known.tobytes(), "nulls": nulls.tobytes(), "doc_starts": starts.tobytes(), "levels": encode_levels(np.concatenate(got))}], schema)

    def run(batches):
        from pyspark import TaskContext

        e, part, seq = library_encoder(path), TaskContext.get().partitionId(), 0
        ids, got, held = [], [], 0
        end = np.array([END_ID], np.uint32)
        for batch in bounded(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids.append(doc_id)
                got.append(np.concatenate([e.encode(text), end]))
                held += len(got[-1])
                if held >= SEGMENT_TOKENS:
                    yield row(part, seq, ids, got)
                    ids, got, held, seq = [], [], 0, seq + 1
        if ids:
            yield row(part, seq, ids, got)

    return run


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None) -> str:
    """Encode documents and write them to a new folder, by default in the shared one; returns the folder.

    A range partition by doc_id sorts the documents and each task writes whole
    segments. Where they begin in the whole are running sums over one figure a
    segment, of SEGMENT_TOKENS ids or more but for the last of a partition: first
    over partitions, then inside each.
    """
    path = path or default_path()
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/varigrid-tokens-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = docs.repartitionByRange(n_blocks(docs), *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(_segments(path), _PART).write.parquet(f"{folder}/segments")
    each = spark.read.schema(_PART).parquet(f"{folder}/segments").select("part", "seq", "n_tokens")
    before = lambda by, *keys: F.coalesce(F.sum(by).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s")).select("part", before("t", "part").alias("t"), before("s", "part").alias("s"))
    index = each.join(parts, "part").select((F.col("s") + F.col("seq")).alias("segment"), (F.col("t") + before("n_tokens", "part", "seq")).alias("first_token"), "n_tokens", "part", "seq")
    index.write.parquet(f"{folder}/index")
    return folder


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder, one row each, with their place in the whole."""
    segments = spark.read.schema(_PART).parquet(f"{folder}/segments")
    index = spark.read.schema("segment long, first_token long, n_tokens long, part int, seq int").parquet(f"{folder}/index")
    return segments.join(index.drop("n_tokens"), ["part", "seq"])


def tokens_at(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """(place, id) for each place, a column of positions in the whole: only the segments that hold one are read, and no block is decoded.

    Places outside the whole have no row.
    """
    index = spark.read.schema("segment long, first_token long, n_tokens long, part int, seq int").parquet(f"{folder}/index")
    # a place's segment is found by ranges of SEGMENT_TOKENS places: few segments meet one, and the join is on equal keys
    step = F.lit(SEGMENT_TOKENS)
    near = index.withColumn("_range", F.explode(F.sequence(F.floor(F.col("first_token") / step), F.floor((F.col("first_token") + F.col("n_tokens") - 1) / step))))
    asked = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("_range", F.floor(F.col("place") / step))
    met = asked.join(near, "_range").filter("place >= first_token AND place < first_token + n_tokens")
    wanted = met.groupBy("part", "seq").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("first_token")).alias("i"))).alias("places"))
    schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n, levels, places_ = (batch.column(j)[i].as_py() for j in range(3))
                segment = Segment(n, levels)
                yield pa.RecordBatch.from_arrays([pa.array([p["place"] for p in places_], pa.int64()), pa.array([segment[p["i"]] for p in places_], pa.int64())], schema=schema)

    segments = spark.read.schema(_PART).parquet(f"{folder}/segments").select("part", "seq", "n_tokens", "levels")
    return segments.join(wanted, ["part", "seq"]).select("n_tokens", "levels", "places").mapInArrow(run, "place long, id long")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each document, from stored segments."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for ids, start, parts, _ in _documents(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))], schema=schema)

    return segments.select(*_READ).mapInArrow(run, "doc_id long, start long, ids array<long>")


_READ = ("first_token", "n_tokens", "doc_ids", "nulls", "doc_starts", "levels")


def _documents(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: batch.column(j)[i].as_py() for j, k in enumerate(_READ)}
            starts = np.frombuffer(r["doc_starts"], "<i8")
            n = len(starts) - 1
            null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=n, bitorder="little").astype(bool)
            values = decode_levels(r["levels"], r["n_tokens"])
            segment = Segment(r["n_tokens"], r["levels"])
            middle = [segment[(a + b) // 2] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=null), starts[:-1] + r["first_token"], np.split(values, starts[1:-1]), middle


def token_digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, middle_id) of each document, from stored segments; its middle id by random access."""

    def run(batches):
        for ids, start, parts, middle in _documents(batches):
            crc = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array([len(p) for p in parts], pa.int64()), crc, pa.array(middle, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "middle_id"])

    return segments.select(*_READ).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, middle_id long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_digests(open_tokens(spark, write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
