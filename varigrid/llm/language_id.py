"""Language of texts from averaged hashed subword embeddings (operator 3).

A text is the mean of the embeddings of its subwords, byte runs of 1 to 4 bytes
of words with A-Z lower-cased and each word set off by one space, hashed
into ``BUCKETS`` rows; a linear softmax on top gives the languages. Embeddings
and softmax are trained together by stochastic gradient descent in numpy, on a
bounded sample of whole labelled texts (``SAMPLE`` rows). As both layers are linear, the trained model is
one score a bucket and language, so that a text costs one look-up a subword.

Calibration: on labelled rows that were not trained on, the softmax temperature
is fitted by likelihood, and the rejection threshold is the confidence below
which at most ``REJECT_RATE`` of right answers fall, at most ``MAX_THRESHOLD``.

Defined cases: null text and text without a letter is ``und`` with score 0.
Rows without label aren't trained on. Without any labelled row everything is
``und`` with score 0, as there is no language to name. Ties go to the language
that comes first by name. Repeated rows are predicted each, and are one row by
their hash when the sample is taken. Very long texts are summed in chunks of
bounded size. An empty table gives no rows. Other columns, lang and source among them, are never
inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import HASHES, bounded, hash_place, stored
from varigrid.llm.textvec import _LOWER, _SPACE, string_buffers

BUCKETS = 1 << 16
DIM = 16
SAMPLE = 4000
EPOCHS = 5
MIN_STEPS = 300
RATE = 0.5
BATCH = 64
REJECT_RATE = 0.001
MAX_THRESHOLD = 0.5
CHUNK = 1 << 19
_LETTER = regex.compile(r"\p{L}")
_MULT = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def _runs(data: np.ndarray, edges: np.ndarray):
    """Bucket, and whether it counts, of the subword of 1, 2, 3 and 4 bytes at each place of joined texts.

    A run counts if it is no single space, has no space after its first byte but
    for the last, and lies in one text. One that doesn't has the bucket BUCKETS.
    """
    space = _SPACE[data]
    b = np.where(space, np.uint8(32), _LOWER[data]).astype(np.uint32)
    n = len(b)
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)
    h, whole = np.zeros(n, np.uint32), np.ones(n, bool)
    for k in range(4):
        m = n - k
        if m <= 0:
            return
        h = (h[:m] ^ b[k : k + m]) * _MULT + np.uint32(k)
        if k >= 2:
            whole = whole[:m] & ~space[k - 1 : k - 1 + m]
        ok = whole[:m] & (left[:m] > k)
        if k == 0:
            ok &= ~space
        elif k == 1:
            ok &= ~(space[:m] & space[1:])
        x = h * _SPREAD
        bucket = ((x ^ (x >> np.uint32(15))) * _MULT >> np.uint32(16)) & np.uint32(BUCKETS - 1)
        bucket[~ok] = BUCKETS
        yield bucket, ok


def subword_shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subwords of a whole text and the share of each; at most BUCKETS of them however long it is."""
    raw, total = np.frombuffer(text, np.uint8), np.zeros(BUCKETS + 1, np.int64)
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + 3]  # runs that begin in this chunk
        for bucket, _ in _runs(part, np.array([0, len(part)])):
            total += np.bincount(bucket[:CHUNK], minlength=BUCKETS + 1)
    found = np.flatnonzero(total[:BUCKETS])
    return found.astype(np.uint16), (total[found] / max(1, total[:BUCKETS].sum())).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """Scores of each text, summed over whole texts in chunks of bounded size."""
        raw, at = string_buffers(column)
        n = len(column)
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        row = 0
        while row < n:
            stop = min(n, max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1))
            data, edges = raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
            s, c = self._sums(data, edges)
            total[row:stop] += s
            count[row:stop] += c
            row = stop
        return total / np.maximum(count, 1)[:, None] + self.bias

    def _sums(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword sums of each text. Runs of different length are summed apart: their order doesn't matter."""
        rows = len(edges) - 1
        total, count = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for bucket, ok in _runs(data, edges):
            m = len(bucket)
            summed = np.zeros((m + 1, self.table.shape[1]))
            np.cumsum(self.table[bucket], axis=0, out=summed[1:])
            e = np.minimum(edges, m)
            total += summed[e[1:]] - summed[e[:-1]]
            seen = np.concatenate([[0], np.cumsum(ok)])
            count += seen[e[1:]] - seen[e[:-1]]
        return total, count

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column))
        p = softmax(self.logits(column) / self.temperature)
        best = p.argmax(1)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


Row = tuple[np.ndarray, np.ndarray]


def train(rows: list[Row], lang: list[str], seed: int = 7) -> LanguageModel:
    """Fit embeddings and softmax by stochastic gradient descent on subword shares; a fifth of the rows calibrates."""
    langs = sorted(set(lang))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    y = np.searchsorted(langs, lang)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    batches = max(1, -(-len(fit) // BATCH))
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))  # small samples are gone through more often
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            ids = [i for i in fit[at : at + BATCH] if len(rows[i][0])]
            if not ids:
                continue
            flat = np.concatenate([rows[i][0] for i in ids]).astype(np.int64)
            share = np.concatenate([rows[i][1] for i in ids])
            n = np.array([len(rows[i][0]) for i in ids])
            mean = np.add.reduceat(emb[flat] * share[:, None], np.concatenate([[0], np.cumsum(n)[:-1]]))
            g = softmax(mean @ w + bias)
            g[np.arange(len(ids)), y[ids]] -= 1
            # a language's gradient reaches a bucket by the shares of the batch's texts, so languages are summed first
            owner = np.repeat(np.arange(len(ids)), n)
            bucket, inverse = np.unique(flat, return_inverse=True)
            pull = np.stack([np.bincount(inverse, share * g[owner, k], len(bucket)) for k in range(len(langs))], 1)
            back = (pull @ w.T).astype(np.float32)
            w -= rate * (mean.T @ g).astype(np.float32) / len(ids) * 4
            bias -= rate * g.sum(0).astype(np.float32) / len(ids)
            emb[bucket] -= rate * back * 4
    table = np.vstack([emb @ w, np.zeros((1, len(langs)))]).astype(np.float64)
    model = LanguageModel(langs, table, bias.astype(np.float64))
    _calibrate(model, [rows[i] for i in held], y[held])
    return model


def _calibrate(model: LanguageModel, rows: list[Row], y: np.ndarray) -> None:
    if not len(y):
        return
    z = np.array([share.astype(np.float64) @ model.table[bucket.astype(np.int64)] + model.bias for bucket, share in rows])
    grid = 2.0 ** np.arange(-6, 3.25, 0.25)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    if len(right):
        model.threshold = float(min(MAX_THRESHOLD, right[int(REJECT_RATE * len(right))]))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[Row], list[str]]:
    """Subword shares of at most ``sample`` labelled rows, those with the smallest hashes, in equal shares for each label as far as they go.

    Of more than ``sample`` labels the most frequent are taken, as each needs a row.
    Whole texts are read, where they lie; the driver gets at most BUCKETS numbers a
    row. Rows whose crc32(doc_id) has remainder 2 by 4 are held out.
    """
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    rows = docs.filter(known & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)).select("lang", "text", hash_place(F.xxhash64("doc_id", "text")).alias("place"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    labels = counts.count()
    if not labels:
        return [], []
    each = max(1, sample // labels)
    taken = counts.orderBy(F.desc("n"), "lang").limit(sample)
    likely = F.col("place") < F.least(F.lit(1.0), (each + 10 * each**0.5 + 50) / F.col("n")) * HASHES
    few = rows.join(F.broadcast(taken), "lang").filter(likely).select("lang", "place", "text")

    def run(batches):
        for batch in bounded(batches):
            got = [subword_shares(t.as_py().encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=["lang", "place", "buckets", "shares"])

    by_lang: dict[str, list[tuple]] = {}
    for r in few.mapInArrow(run, "lang string, place long, buckets binary, shares binary").collect():
        by_lang.setdefault(r.lang, []).append((r.place, bytes(r.buckets), bytes(r.shares)))
    out: list[Row] = []
    langs: list[str] = []
    for lang in sorted(by_lang):
        for _, buckets, shares in sorted(by_lang[lang])[:each]:
            out.append((np.frombuffer(buckets, np.uint16), np.frombuffer(shares, np.float32)))
            langs.append(lang)
    return out, langs


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    return train(*training_rows(docs, sample))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in bounded(batches):
            lang, score = shared.value.predict(batch.column(1))
            rejected = (score < shared.value.threshold) | (np.array(lang, object) == "und").astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Documents whose language is known with enough confidence, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in bounded(batches):
            lang, score = shared.value.predict(batch.column(at))
            yield batch.filter(pa.array((score >= shared.value.threshold) & (np.array(lang, object) != "und")))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
