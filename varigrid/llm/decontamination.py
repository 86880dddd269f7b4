"""Documents that hold benchmark items, also reworded ones, by latent semantic retrieval (operator 6).

1. Terms are the words of the benchmark, hashed into ``TERMS`` buckets; other words
   of a document are likeness to no item. Their document frequencies are taken over
   all documents. A term weighs FLOOR + log((N + 1) / (df + 1)).
2. All documents are cut into passages of ``PASSAGE`` words, rows of a TF-IDF matrix
   A. A randomised SVD gives its leading right singular vectors: each task sums
   A'(A Omega) over the passages it reads, Omega being ``SKETCH`` columns of random signs;
   the sums are added up by ranges of terms, and the driver, which gets SKETCH + 1
   numbers a term, takes the ``RANK`` leading directions (Nystroem's
   method for the positive matrix A'A, so one pass is enough). Latent coordinates
   are scaled to unit variance over passages and centred, as otherwise the
   direction that all passages share would decide every cosine.
3. Benchmark items are cut into passages of 28 to 84 words, or are one. Each has a latent
   vector. Documents are read in hops of ``HOP`` words; a window of hops, a little
   longer than the passage, is a candidate if its latent cosine with the passage
   reaches ``NEAR``, and it or the hops around hold enough of the passage's words
   for step 4 to accept.
4. Around each candidate the longest common subsequence of words is taken, if enough
   of the item's words are there, each as often as the item has it: it can't be
   longer than that, so no item is lost. An item is in the document if it covers ``COVER`` of its words, or ``REWORDED`` of them
   and the answer, the item's last fifth and three words at least, is there in full
   and in order.

One scan searches for up to ``GROUP`` passages, whose latent vectors and words are
broadcast; a larger benchmark takes a scan for each such group.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Texts are read whole;
no item and no document has a cap.

Defined cases: null or empty texts match nothing; items without words are never
found; items with the same words are each reported. A null doc_id or item_id is
reported as null. An empty table gives no rows. Repeated documents are each
searched and their equal rows reported once. Very long texts are searched in runs
of bounded size. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded
from varigrid.llm.textvec import mix, word_chunks

TERMS = 1 << 18
FLOOR = 0.05
PASSAGE = 56
SKETCH = 96
RANK = 96
HOP = 8
NEAR = 0.38
COVER = 0.8
REWORDED = 0.6
ANSWER = 5
GROUP = 1 << 15
RUN = 2048
_CHUNK_WORDS = 1 << 16
_SLICE = 1024
_MASK = np.uint64(TERMS - 1)


_SUMS = "slice int, at binary, values binary"


def _sliced(x: np.ndarray):
    """The rows of a table that aren't all zero, by slices of _SLICE rows."""
    for k in range(0, len(x), _SLICE):
        part = x[k : k + _SLICE]
        at = np.flatnonzero(part.any(1)).astype(np.uint16)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k // _SLICE], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["slice", "at", "values"])


def _added(parts: DataFrame, rows: int, width: int, kind: str) -> np.ndarray:
    """The sum of sliced tables. Parts of a slice stream through one task, which holds sums only; rows and width are bounded."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column(0)[i].as_py()
                if k not in total:
                    total[k] = np.zeros((_SLICE, width), kind)
                total[k][np.frombuffer(batch.column(1)[i].as_buffer(), np.uint16)] += np.frombuffer(batch.column(2)[i].as_buffer(), kind).reshape(-1, width)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b""], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["slice", "at", "values"])

    out = np.zeros((-(-rows // _SLICE) * _SLICE, width), kind)
    for r in parts.repartition("slice").mapInArrow(add, _SUMS).collect():
        out[r.slice * _SLICE : (r.slice + 1) * _SLICE] = np.frombuffer(bytes(r["values"]), kind).reshape(-1, width)
    return out[:rows]


def vocabulary(benchmark: DataFrame) -> np.ndarray:
    """For each bucket the number, from 1, of the benchmark's term there; 0 for none. At most TERMS numbers are collected."""

    def run(batches):
        seen = np.zeros(TERMS, bool)
        for batch in bounded(batches):
            for words in word_chunks(batch.column(0), True):
                seen[(words.hashes & _MASK).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int64())], names=["term"])

    place = np.zeros(TERMS, np.int32)
    terms = sorted(r.term for r in benchmark.select("text").mapInArrow(run, "term long").distinct().collect())
    place[terms] = np.arange(1, len(terms) + 1)
    return place


def _terms(words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and numbers, from 0, of the words that are terms."""
    found = place[(words.hashes & _MASK).astype(np.int64)]
    at = np.flatnonzero(found)
    return at, found[at].astype(np.int64) - 1


def document_frequencies(docs: DataFrame, place: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and how many of them hold each term."""
    terms, shared = int(place.max(initial=0)), docs.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        df = np.zeros((terms, 1), np.int64)
        for batch in bounded(batches):
            for words in word_chunks(batch.column(0), True):
                at, t = _terms(words, shared.value)
                row = np.searchsorted(words.first, at, "right")
                keys = np.sort(row * terms + t)
                df[:, 0] += np.bincount(keys[np.diff(keys, prepend=-1) != 0] % max(terms, 1), minlength=terms)
        yield from _sliced(df)

    return docs.count(), _added(docs.select("text").mapInArrow(run, _SUMS), terms, 1, "int64")[:, 0]


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return (FLOOR + np.maximum(np.log((n + 1) / (df + 1)), 0)).astype(np.float32)


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray

    def passages(self):
        """First word and words of each passage: the item in even parts of 28 to 84 words, or whole."""
        n = len(self.words)
        parts = max(1, -(-(n - PASSAGE // 2) // PASSAGE))
        cuts = [n * k // parts for k in range(parts + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    @property
    def answer(self) -> int:
        n = len(self.words)
        return min(n, max(3, -(-n // ANSWER)))


def _share(part: float, n: int) -> int:
    """The least whole number that is at least this share of n, as the rule compares them."""
    k = int(part * n)
    return k if k >= part * n else k + 1


def _run_sums(table: np.ndarray, at: np.ndarray, first: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Sum of the rows table[at], times a factor each, over every run from one first to the next: all runs' first rows, then all second ones."""
    n = np.diff(first, append=len(at))
    order = np.argsort(-n, kind="stable")
    begin, n = first[order], n[order]
    longer = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), "right")
    total = np.zeros((len(n), table.shape[1]), np.float32)
    for k, m in enumerate(longer.tolist()):
        rows = begin[:m] + k
        part = np.take(table, at[rows], axis=0)
        if times is not None:
            part *= times[rows, None]
        total[:m] += part
    out = np.empty_like(total)
    out[order] = total
    return out


def signs(terms: int, sketch: int = SKETCH) -> np.ndarray:
    """Omega: random signs for each term, the same in every task."""
    words = -(-sketch // 64)
    seed = np.arange(terms * words, dtype=np.uint64) + np.uint64(0x51ED270B)
    bits = np.unpackbits(mix(mix(seed)).view(np.uint8).reshape(terms, 8 * words), axis=1)[:, :sketch]
    return (bits.astype(np.int8) * 2 - 1).astype(np.float32)


def _passage_sums(z: np.ndarray, omega: np.ndarray, terms: np.ndarray, passage: np.ndarray, weights: np.ndarray) -> int:
    """Add x (x' Omega) for each passage row x of unit length to z, and x itself to z's last column; returns passages."""
    key, tf = np.unique(passage * len(z) + terms, return_counts=True)
    t, p = key % len(z), key // len(z)
    first = np.flatnonzero(np.diff(p, prepend=-1))
    p = np.cumsum(np.diff(p, prepend=-1) != 0) - 1
    x = tf * weights[t]
    x = (x / np.sqrt(np.add.reduceat(x * x, first))[p]).astype(np.float32)
    y = _run_sums(omega, t, first, x)
    order = np.argsort(t, kind="stable")
    t, x, p = t[order], x[order], p[order]
    at = np.flatnonzero(np.diff(t, prepend=-1))
    z[t[at], -1] += np.add.reduceat(x, at)
    # terms that a 64th of the passages hold are a dense matrix, of 64 numbers for each number of x at most
    often = np.diff(at, append=len(t)) * 64 >= max(len(first), 64 * 16)
    of = np.repeat(np.cumsum(often) - 1, np.diff(at, append=len(t)))
    dense = np.repeat(often, np.diff(at, append=len(t)))
    rows = np.zeros((int(often.sum()), len(first)), np.float32)
    rows[of[dense], p[dense]] = x[dense]
    z[t[at[often]], :-1] += rows @ y
    t, x, p = t[~dense], x[~dense], p[~dense]
    at = np.flatnonzero(np.diff(t, prepend=-1))
    z[t[at], :-1] += _run_sums(y, p, at, x)
    return len(first)


def latent_space(docs: DataFrame, place: np.ndarray, weights: np.ndarray, sketch: int = SKETCH, rank: int = RANK) -> np.ndarray:
    """What each occurrence of a term adds to a latent vector (terms x rank), from the passages of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((place, weights))

    def run(batches):
        place, w = shared.value
        omega = signs(len(w), sketch)
        z, n = np.zeros((len(w), sketch + 1), np.float32), 0
        for batch in bounded(batches):
            for words in word_chunks(batch.column(0), True):
                at, terms = _terms(words, place)
                row = np.searchsorted(words.first, at, "right") - 1
                before = np.concatenate([[0], np.cumsum(-(-words.counts // PASSAGE))])
                passage = before[row] + (at - words.first[row]) // PASSAGE
                k = 0
                while k < len(terms):  # whole passages
                    stop = min(len(terms), k + _CHUNK_WORDS)
                    if stop < len(terms):
                        stop = int(np.searchsorted(passage, passage[stop]))
                    n += _passage_sums(z, omega, terms[k:stop], passage[k:stop], w)
                    k = stop
        yield from _sliced(z)

    z = _added(docs.select("text").mapInArrow(run, _SUMS), len(weights), sketch + 1, "float32")
    return directions(z[:, :-1], z[:, -1], signs(len(weights), sketch), weights, rank)


def directions(z: np.ndarray, total: np.ndarray, omega: np.ndarray, weights: np.ndarray, rank: int) -> np.ndarray:
    """Latent vectors of single occurrences, from Z = A'A Omega and the sum of A's rows."""
    out = np.zeros((len(z), rank), np.float32)
    if not z.any():
        return out
    y, o = z.astype(np.float64), omega.astype(np.float64)
    core = o.T @ y
    value, vec = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value[-1], 0) * 1e-5  # what single precision can tell from nothing
    root = y @ (vec[:, keep] / np.sqrt(value[keep]))  # A'A is about root root'
    value, vec = np.linalg.eigh(root.T @ root)
    keep = np.flatnonzero(value > max(value[-1], 0) * 1e-5)[::-1][:rank]
    base = root @ (vec[:, keep] / np.sqrt(value[keep]))  # orthonormal directions, value: their sums of squares
    latent = base / np.sqrt(value[keep])
    mean = total.astype(np.float64) @ latent  # sums over passages of unit length; only its direction counts
    size = np.linalg.norm(mean)
    latent *= weights[:, None]
    if size > 0:  # what all passages share is no likeness
        latent -= np.outer(latent @ mean, mean) / size**2
    out[:, : latent.shape[1]] = latent
    return out


class Search:
    """What a task needs of a group of items: each term's number by bucket, and its latent vector."""

    def __init__(self, items: list[Item], place: np.ndarray, latent: np.ndarray):
        self.items, self.place, self.latent = items, place, latent
        passages = sorted(((i, start, words) for i, item in enumerate(items) for start, words in item.passages()), key=lambda x: len(x[2]))
        self.owner, self.offset = (np.array([p[k] for p in passages], np.int64) for k in (0, 1))
        vectors = np.array([latent[place[(words & _MASK).astype(np.int64)] - 1].sum(0) for _, _, words in passages], np.float32).reshape(len(passages), -1)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        sizes = [-(-len(words) // HOP) + 1 for _, _, words in passages]
        self.groups = [(size, slice(sizes.index(size), sizes.index(size) + sizes.count(size))) for size in sorted(set(sizes))]
        self.widest = max(sizes, default=1)
        self.need = np.array([_share(REWORDED, len(words)) for _, _, words in passages])
        # each term of each passage, by passage and number
        self.keys = np.unique(np.concatenate([[-1], *[k * len(latent) + place[(words & _MASK).astype(np.int64)] - 1 for k, (_, _, words) in enumerate(passages)]]).astype(np.int64))
        # each term of each item with its occurrences, by item and number; an item's first one; the words that it must have in common
        terms = [place[(item.words & _MASK).astype(np.int64)].astype(np.int64) - 1 for item in items]
        self.item_keys, self.times = np.unique(np.concatenate([np.zeros(0, np.int64), *[i * len(latent) + x for i, x in enumerate(terms)]]), return_counts=True)
        self.item_first = np.searchsorted(self.item_keys, np.arange(len(items) + 1) * len(latent))
        self.least = np.array([_share(min(COVER, REWORDED), len(item.words)) for item in items], np.int64)
        self.sizes = np.array([len(item.words) for item in items], np.int64)
        self._bits: dict[int, dict[int, int]] = {}

    def candidates(self, words, done):
        """(row, item, first word, end word, cosine) of what is to be compared with an item, in runs of bounded size; rows and items that get done are left out."""
        tried: set[tuple] = set()
        hops = -(-words.counts // HOP)
        row = np.repeat(np.arange(len(hops)), hops)
        last = np.cumsum(hops)  # the end of each row's hops
        begin = np.append(words.first[row] + (np.arange(len(row)) - (last - hops)[row]) * HOP, words.first[-1])
        terms_at, terms = _terms(words, self.place)
        of = np.searchsorted(words.first, terms_at, "right") - 1
        hop_of = (last - hops)[of] + (terms_at - words.first[of]) // HOP
        before = np.searchsorted(terms_at, begin)  # terms before each hop
        for at in range(0, len(row), RUN):
            here = np.arange(at, min(at + RUN, len(row)))
            stop = min(at + RUN + self.widest, len(row))
            span = slice(before[at], before[stop])
            total = np.zeros((stop - at + 1, self.latent.shape[1]), np.float32)
            if span.stop > span.start:
                hop = hop_of[span] - at
                new = np.flatnonzero(np.diff(hop, prepend=-1))
                total[hop[new] + 1] = _run_sums(self.latent, terms[span], new)
            np.cumsum(total, axis=0, out=total)
            for size, which in self.groups:
                end = np.minimum(here + size, last[row[here]])
                # no window with fewer words of any item can be accepted, nor can those around it
                wide = np.minimum(here + size + -(-size // 2), last[row[here]])
                low = np.maximum(here - -(-size // 2), (last - hops)[row[here]])
                some = np.flatnonzero(before[wide] - before[low] >= self.need[which].min())
                if not len(some):
                    continue
                v = np.take(total, end[some] - at, axis=0)
                v -= total[: len(here)] if len(some) == len(here) else np.take(total, some, axis=0)
                cos = v @ self.vectors[which].T
                cos /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
                near = np.flatnonzero(cos >= NEAR)
                i, j = np.divmod(near, cos.shape[1])
                for k in range(0, len(i), RUN):
                    w, passage, c = some[i[k : k + RUN]], j[k : k + RUN] + which.start, cos.ravel()[near[k : k + RUN]]
                    enough = self._enough(w, passage, terms, before, low, wide)
                    w, passage, c = w[enough], passage[enough], c[enough]
                    r, item = row[here[w]], self.owner[passage]
                    lo = np.maximum(words.first[r], begin[here[w]] - self.offset[passage] - self.sizes[item])
                    hi = np.minimum(words.first[r + 1], np.minimum(begin[end[w]], words.first[r + 1]) + self.sizes[item])
                    yield from self._can(r, item, lo, hi, c, terms_at, terms, done, tried)

    def _enough(self, k, passage, terms, before, low, wide):
        """Which candidates have enough of the passage's words around them."""
        first = before[low[k]]
        n = before[wide[k]] - first
        starts = np.cumsum(n) - n
        key = np.repeat(passage * len(self.latent), n) + terms[np.repeat(first - starts, n) + np.arange(n.sum())]
        found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        same = np.add.reduceat(found.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)  # no window here is without terms
        return np.flatnonzero(same >= self.need[passage])

    def _can(self, row, item, lo, hi, cos, terms_at, terms, done, tried):
        """Of candidates those that have enough of the item's words, each as often as the item has it, for any common subsequence that is accepted."""
        first, end = np.searchsorted(terms_at, lo), np.searchsorted(terms_at, hi)
        cost = np.cumsum(end - first)
        rows = list(zip(*(x.tolist() for x in (row, item, lo, hi, cos)), strict=True))
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(cost, cost[a] + _CHUNK_WORDS)))
            k = []
            for i in range(a, b):
                if rows[i][:2] not in done and rows[i][1:4] not in tried:
                    tried.add(rows[i][1:4])
                    k.append(i)
            a = b
            if not k:
                continue
            of, n, slots = item[k], (end - first)[k], np.diff(self.item_first)[item[k]]
            base = np.cumsum(slots) - slots
            key = np.repeat(of * len(self.latent), n) + terms[np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = np.minimum(np.searchsorted(self.item_keys, key), len(self.item_keys) - 1)
            found = self.item_keys[at] == key
            slot = (at + np.repeat(base - self.item_first[of], n))[found]
            most = self.times[np.repeat(self.item_first[of] - base, slots) + np.arange(slots.sum())]
            same = np.add.reduceat(np.minimum(np.bincount(slot, minlength=len(most)), most), base)
            for i in np.flatnonzero(same >= self.least[of]).tolist():
                yield rows[k[i]]

    def bits(self, item: int) -> dict[int, int]:
        if item not in self._bits:
            masks: dict[int, int] = {}
            for i, h in enumerate(self.items[item].words.tolist()):
                masks[h] = masks.get(h, 0) | 1 << i
            self._bits[item] = masks
        return self._bits[item]

    def check(self, item: int, hashes: np.ndarray) -> tuple[int, bool, list[int]]:
        """Common subsequence length, whether the answer is there in order, and the places of words of the item."""
        bits, n = self.bits(item), len(self.items[item].words)
        masks = [(i, m) for i, h in enumerate(hashes.tolist()) if (m := bits.get(h))]
        full = (1 << n) - 1
        v = full
        for _, m in masks:
            u = v & m
            v = ((v + u) | (v - u)) & full
        tail = self.items[item].answer
        want = self.items[item].words[n - tail :].tolist()
        k = 0
        for i, _ in masks:
            k += k < tail and int(hashes[i]) == want[k]
        return n - v.bit_count(), k == tail, [i for i, _ in masks]


def _search(search):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("common", pa.int64()), ("item_words", pa.int64()), ("cosine", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches):
        r: Search = search.value
        for batch in bounded(batches):
            out = {}
            for words in word_chunks(batch.column(1), True):
                done = set()
                for row, item, lo, hi, cos in r.candidates(words, done):
                    if (row, item) in done:
                        continue
                    n = len(r.items[item].words)
                    common, answer, at = r.check(item, words.hashes[lo:hi])
                    if common >= COVER * n or (common >= REWORDED * n and answer):
                        done.add((row, item))
                        base = lo - int(words.first[row])
                        out[row + words.row0, item] = (common, n, cos, base + at[0], base + at[-1] + 1)
            ids = batch.column(0)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (ids[row].as_py(), r.items[item].item_id, *found), strict=True)) for (row, item), found in out.items()], schema)

    return run


_FOUND = "doc_id long, item_id long, common long, item_words long, cosine double, first_word long, end_word long"


def _groups(benchmark: DataFrame, group: int):
    """Items with their word hashes, in groups of at most so many passages; one group at a time is on the driver."""

    def run(batches):
        for batch in bounded(batches):
            words = [np.zeros(0, np.uint64)] * batch.num_rows
            for w in word_chunks(batch.column(1), True):
                for r in range(len(w.counts)):
                    words[w.row0 + r] = w.hashes[w.first[r] : w.first[r + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in words], pa.binary())], names=["item_id", "words"])

    hashed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words binary").filter("length(words) > 0")
    items, n = [], 0
    for r in hashed.toLocalIterator():
        item = Item(r.item_id, np.frombuffer(bytes(r.words), np.uint64))
        more = len(item.passages())
        if items and n + more > group:
            yield items
            items, n = [], 0
        items.append(item)
        n += more
    if items:
        yield items


def contamination(docs: DataFrame, benchmark: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, text) and (item_id, text) to a row for each document and item that it holds.

    Columns: doc_id, item_id, common (words of the longest common subsequence),
    item_words, cosine in the latent space, and the place in the document's words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place, latent, found = None, None, None
    for items in _groups(benchmark, group):
        if latent is None:
            place = vocabulary(benchmark)
            latent = latent_space(docs, place, term_weights(*document_frequencies(docs, place)))  # at most TERMS x RANK
        search = spark.sparkContext.broadcast(Search(items, place, latent))
        more = docs.mapInArrow(_search(search), _FOUND)
        found = more if found is None else found.unionByName(more)
    return spark.createDataFrame([], _FOUND) if found is None else found.distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns. Rows without doc_id stay, as no row names them."""
    found = contamination(docs, benchmark).select(F.col("doc_id").alias("_leak")).filter("_leak IS NOT NULL").distinct()
    return docs.join(found, docs["doc_id"] == found["_leak"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
