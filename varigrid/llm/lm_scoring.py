"""Katz backoff language model over a corpus, and its score of every text (operator 10).

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token.
The model has Good-Turing discounted counts up to ``order`` and backs off with
weights that make every conditional distribution sum to one:

    P(w | h) = d(c(hw)) c(hw) / c(h)        if hw was seen in training
             = alpha(h) P(w | h without its first word)   otherwise
    alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of the same words' lower P)

and P(w | h) is the lower P(w | h') where h was never seen. Unigrams keep the
Good-Turing mass of unseen words for one unknown word. d(r) is Katz's discount
for 1 <= r <= 5, 1 above; where counts of counts give no value in (0, 1) it is 1.
A context that has no mass left keeps one part in c(h) + 1 for the rest. If a
context's seen words hold all lower mass, the weight is 1 and nothing is lost,
as no other word exists.

Plan: documents are dealt into blocks. Level by level, each block sends each
shard of contexts the distinct (context, word) pairs it holds with their training
counts; a shard adds them up, keeps its part of the level's table in the shared
folder, and answers each block with the counts and weights of that block's pairs.
Words and longer contexts get numbers on the way, so that keys are exact. The
numbers of what is shuffled grow with distinct pairs per block, never with how
often one pair occurs. The driver sees only counts of counts.

A frequent context has successors in every block. One that holds more training
tokens than a shard's even share has its successors dealt over as many shards as
it holds shares; the sums of such contexts, fewer than two for each shard, are
added up over their shards before weights are made of them.

Defined cases: null or empty text is the end token alone. A row without doc_id
has the crc32 of an empty text, 0, and so is held out. Without any training
tokens every token has base probability one over the one unknown word. Repeated
rows are each counted and scored. Very long texts are one block's. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import n_blocks, pack, pack_sorted, shard_of, slices, stored, unpack, unpack_sorted, with_block
from varigrid.llm.textvec import crc32_text, mix, word_chunks

ORDER = 2
BLOCK_BYTES = 4 << 20
HELD_MOD = 10
DISCOUNT_UP_TO = 5
_END = np.uint64(0x5851F42D4C957F2D)
_SHARD_BITS = np.uint64(40)
_START = np.uint64((1 << 63) - 1)
BROADCAST_BYTES = 16 << 20
_SHARD_SCHEMA = "shard int, stats array<bigint>, contexts binary, words binary, counts binary, sums binary, blocks array<int>, ranks array<binary>, context_ranks array<binary>, split array<struct<context:bigint,sums:array<double>>>"
_SPLIT_TYPE = pa.list_(pa.struct([("context", pa.int64()), ("sums", pa.list_(pa.float64()))]))
_ANSWER_SCHEMA = "block int, level int, shard int, counts binary, ranks binary, alphas binary, totals binary"


def katz_discounts(n: list[int], k: int = DISCOUNT_UP_TO) -> np.ndarray:
    """Discounts d[0..k] from counts of counts n[1..k + 1]; d[0] is unused."""
    d = np.ones(k + 1)
    if n[1] > 0:
        tail = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and tail < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                if 0 < x < 1:
                    d[r] = x
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1).astype(np.int64)], 1.0)


@dataclass
class Unigrams:
    """What the driver knows after the first level."""

    tokens: int
    distinct: int
    d: np.ndarray
    kept: float
    unknown: float

    def prob(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        return np.where(c > 0, discounted(c, self.d) / max(self.tokens, 1) * self.kept, self.unknown)


def unigrams(stats: list[int]) -> Unigrams:
    """stats: training tokens, distinct tokens, then counts of counts 1..6."""
    total, distinct, n = stats[0], stats[1], [0, *stats[2:]]
    d = katz_discounts(n)
    lost = sum((1 - d[r]) * r * n[r] for r in range(1, len(d))) / max(total, 1)
    if total == 0:
        return Unigrams(0, 0, d, 1.0, 1.0)
    if lost <= 0:  # no mass for unknown words: keep one part in N + 1
        return Unigrams(total, distinct, d, total / (total + 1), 1 / (total + 1))
    return Unigrams(total, distinct, d, 1.0, lost)


class _Tokens:
    """Tokens of a block with the row, training flag and local word number of each."""

    def __init__(self, table: pa.Table):
        h, row = [], []
        for words in word_chunks(table["text"].combine_chunks(), True):
            n = words.counts
            at = np.repeat(np.arange(len(n)), n)
            tokens = np.full(len(words.hashes) + len(n), _END, np.uint64)
            tokens[np.arange(len(words.hashes)) + at] = words.hashes
            h.append(tokens)
            row.append(np.repeat(np.arange(len(n)), n + 1) + words.row0)
        self.row = np.concatenate(row)
        crc = np.array(crc32_text(table["doc_id"].to_pylist()), np.int64)
        self.held_out = crc % HELD_MOD == 0
        self.train = ~self.held_out[self.row]
        self.begins = np.ones(len(self.row), bool)
        self.begins[1:] = self.row[1:] != self.row[:-1]
        self.hashes, self.word = np.unique(np.concatenate(h), return_inverse=True)
        self.counts = np.bincount(self.word, self.train, len(self.hashes)).astype(np.uint64)


def _by_shard(answers: pa.Table, level: int) -> list[dict]:
    rows = [r for r in answers.select(["level", "shard", "counts", "ranks", "alphas", "totals"]).to_pylist() if r["level"] == level]
    return sorted(rows, key=lambda r: r["shard"])


def _cat(parts, kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class _Levels:
    """Replays the levels that have answers over a block's tokens."""

    def __init__(self, texts: pa.Table, answers: pa.Table, uni: Unigrams, shards: int):
        self.t = t = _Tokens(texts)
        self.shards, self.tokens = shards, uni.tokens
        rows = _by_shard(answers, 1)
        self.count = _cat([unpack(r["counts"]) for r in rows])
        word_id = _cat([(np.uint64(r["shard"]) << _SHARD_BITS) + unpack_sorted(r["ranks"]) for r in rows])
        self.word_id = word_id[t.word]
        self.prob = uni.prob(self.count)[t.word]
        self.lower = self.count[t.word]  # of level 1 the counts travel: they pack better than probabilities
        self.id, self.seen = self.word_id, self.lower
        self.begun = self.count[np.searchsorted(t.hashes, _END)]  # a text begins as often as one ends
        self.level = 1

    def pairs(self) -> None:
        """Number the (context, word) pairs of the next level in ascending order of their ids."""
        t = self.t
        context, held = np.empty_like(self.id), np.empty_like(self.seen)
        context[1:], held[1:] = self.id[:-1], self.seen[:-1]
        context[t.begins], held[t.begins] = _START, self.begun
        self.contexts, at, c = np.unique(context, return_index=True, return_inverse=True)
        # shares of a shard that a context holds; its pairs are dealt over so many
        self.parts = np.maximum(1, -(-held[at].astype(np.float64) * self.shards // max(self.tokens, 1))).astype(np.uint64)
        self.words, w = np.unique(self.word_id, return_inverse=True)
        keys, self.pair = np.unique((c.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), return_inverse=True)
        self.pair_context = (keys >> np.uint64(32)).astype(np.int64)
        self.pair_word = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        home = np.minimum(self.contexts >> _SHARD_BITS, np.uint64(self.shards - 1))[self.pair_context]
        part = (mix(self.words[self.pair_word]) >> np.uint64(32)) % self.parts[self.pair_context]
        shard = (home + part) % np.uint64(self.shards)
        self.order = np.argsort(shard, kind="stable")  # inside a shard by context and word
        self.shard = shard[self.order]
        self.level += 1

    def ask(self) -> list[dict]:
        first = np.zeros(len(self.pair_context), self.lower.dtype)
        first[self.pair] = self.lower
        n = np.bincount(self.pair, self.t.train, len(first)).astype(np.uint64)[self.order]
        which, word, first, out = self.pair_context[self.order], self.words[self.pair_word][self.order], first[self.order], []
        context, split = self.contexts[which], self.parts[which] > 1
        at = slices(self.shard, self.shards)
        for s in np.flatnonzero(np.diff(at)):
            p = slice(at[s], at[s + 1])
            low = pack(first[p]) if self.level == 2 else first[p].astype(np.float64).tobytes()
            out.append({"shard": int(s), "contexts": pack_sorted(context[p]), "words": pack(word[p]), "counts": pack(n[p]), "lower": low, "split": pack_sorted(np.unique(context[p][split[p]]))})
        return out

    def answered(self, answers: pa.Table) -> None:
        rows = _by_shard(answers, self.level)
        c = _cat([unpack(r["counts"]) for r in rows]).astype(np.float64)
        alpha = _cat([np.frombuffer(r["alphas"]) for r in rows], float)
        total = _cat([np.frombuffer(r["totals"]) for r in rows], float)
        d = np.frombuffer(rows[0]["ranks"][:8 * (DISCOUNT_UP_TO + 1)])
        ids = _cat([(np.uint64(r["shard"]) << _SHARD_BITS) + unpack_sorted(r["ranks"][8 * (DISCOUNT_UP_TO + 1):]) for r in rows])
        # answers are by shard, weights once for each context in it
        which = self.pair_context[self.order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (self.shard[1:] != self.shard[:-1])
        weight = np.cumsum(new) - 1
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        c, alpha, total, ids = c[back], alpha[weight][back], total[weight][back], ids[back]
        known = np.divide(discounted(c, d), total, out=np.zeros(len(c)), where=c > 0)
        self.prob = np.where(c[self.pair] > 0, known[self.pair], alpha[self.pair] * self.prob)
        self.lower = self.prob
        self.id, self.seen = ids[self.pair], c[self.pair]


_ASK1 = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_ASKN = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("contexts", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("lower", pa.binary()), ("split", pa.binary())])


def _ask_words(shards: int):
    def run(table: pa.Table) -> pa.Table:
        t, out = _Tokens(table), []
        at = slices(shard_of(t.hashes, shards), shards)
        for s in np.flatnonzero(np.diff(at)):
            p = slice(at[s], at[s + 1])
            out.append({"shard": int(s), "block": table["block"][0].as_py(), "words": pack_sorted(t.hashes[p]), "counts": pack(t.counts[p])})
        return pa.Table.from_pylist(out, _ASK1)

    return run


_ASKED = "shard int, block int, contexts binary, words binary, counts binary, lower binary, split binary"


def _ask_pairs(shards: int, level: int, uni: Unigrams):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.Table.from_pylist([], _ASKN)
        m = _Levels(texts, answers, uni, shards)
        m.pairs()
        for _ in range(level - 2):
            m.answered(answers)
            m.pairs()
        block = texts["block"][0].as_py()
        return pa.Table.from_pylist([x | {"block": block} for x in m.ask()], _ASKN)

    return run


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, DISCOUNT_UP_TO + 2).astype(np.int64), minlength=DISCOUNT_UP_TO + 3)[1 : DISCOUNT_UP_TO + 2].tolist()


def _shard_row(shard, stats, blocks, ranks, **more) -> pa.Table:
    row = {"shard": shard, "stats": stats, "contexts": b"", "words": b"", "counts": b"", "sums": b"", "blocks": blocks, "ranks": ranks, "context_ranks": [], "split": []} | more
    return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("stats", pa.list_(pa.int64())), *[(k, pa.binary()) for k in ("contexts", "words", "counts", "sums")], ("blocks", pa.list_(pa.int32())), ("ranks", pa.list_(pa.binary())), ("context_ranks", pa.list_(pa.binary())), ("split", _SPLIT_TYPE)]))


def _add_words(table: pa.Table) -> pa.Table:
    """A shard of the unigram table: its words with their counts, and each block's words by rank."""
    words = [unpack_sorted(x) for x in table["words"].to_pylist()]
    keys, rank = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(rank, np.concatenate([unpack(x) for x in table["counts"].to_pylist()]).astype(float), len(keys)).astype(np.uint64)
    ranks = np.split(rank.astype(np.uint64), np.cumsum([len(x) for x in words])[:-1])
    stats = [int(c.sum()), int((c > 0).sum()), *_counts_of_counts(c)]
    return _shard_row(table["shard"][0].as_py(), stats, table["block"].to_pylist(), [pack_sorted(r) for r in ranks], words=pack_sorted(keys), counts=pack(c))


def _add_pairs(level: int, uni: Unigrams):
    def run(table: pa.Table) -> pa.Table:
        """A shard of a level's table: pairs with counts, sums for each context's weight, and each block's pairs and contexts by rank."""
        parts = [(unpack_sorted(a), unpack(b), unpack(c), uni.prob(unpack(d)) if level == 2 else np.frombuffer(d)) for a, b, c, d in zip(*(table[k].to_pylist() for k in ("contexts", "words", "counts", "lower")), strict=True)]
        context, word, n, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((word, context))
        context, word, n, low = context[order], word[order], n[order], low[order]
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        rank = np.empty(len(context), np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        c, context, word, low = np.add.reduceat(n, at), context[at], word[at], low[at]
        first = np.ones(len(c), bool)
        first[1:] = context[1:] != context[:-1]
        group, begins = np.cumsum(first) - 1, np.flatnonzero(first)
        sums = [np.add.reduceat(x, begins).astype(float) for x in (c.astype(float), np.where(c > 0, low, 0.0))]
        sums += [np.add.reduceat((c == r).astype(float), begins) for r in range(1, DISCOUNT_UP_TO + 1)]
        ranks = np.split(rank, np.cumsum([len(p[0]) for p in parts])[:-1])
        of_context = []
        for r in ranks:
            g = group[r.astype(np.int64)]
            of_context.append(pack_sorted(g[np.flatnonzero(np.diff(g, prepend=-1))].astype(np.uint64)))
        seen, of = c > 0, context[begins]
        divided = np.unique(np.concatenate([unpack_sorted(x) for x in table["split"].to_pylist()]))
        split = [{"context": int(of[k]), "sums": [float(x[k]) for x in sums]} for k in np.searchsorted(of, divided).tolist()]
        return _shard_row(table["shard"][0].as_py(), [int(c.sum()), int(seen.sum()), *_counts_of_counts(c)], table["block"].to_pylist(), [pack_sorted(r) for r in ranks], contexts=pack_sorted(context), words=pack(word), counts=pack(c), sums=_pack_sums(sums), context_ranks=of_context, split=split)

    return run


def _pack_sums(sums: list[np.ndarray]) -> bytes:
    """Whole numbers packed, the lower sums as doubles."""
    whole = [pack(x.astype(np.uint64)) for i, x in enumerate(sums) if i != 1]
    head = np.array([len(sums[0]), *map(len, whole)], np.int64).tobytes()
    return head + sums[1].tobytes() + b"".join(whole)


def _unpack_sums(data: bytes) -> list[np.ndarray]:
    k = DISCOUNT_UP_TO + 1
    head = np.frombuffer(data, np.int64, k + 1)
    at = 8 * (k + 1)
    low = np.frombuffer(data, np.float64, int(head[0]), at)
    at += 8 * int(head[0])
    whole = []
    for n in head[1:]:
        whole.append(unpack(data[at : at + int(n)]).astype(float))
        at += int(n)
    return [whole[0], low, *whole[1:]]


def weights(total, low, ones, d):
    """(alpha, divisor) of contexts from their count, their seen words' lower mass and numbers of pairs seen r times."""
    lost = sum((1 - d[r]) * r * n for r, n in enumerate(ones, 1))
    some = total > 0
    divisor = np.where(lost > 0, total, total + 1)
    left = np.where(lost > 0, lost, 1.0) / np.maximum(divisor, 1)
    rest = 1 - low
    alpha = np.where(rest > 1e-12, left / np.maximum(rest, 1e-12), 1.0)
    return np.where(some, alpha, 1.0), np.where(some, divisor, 1.0)


def _answers(level: int, d: np.ndarray | None):
    """mapInArrow over a level's stored shards: an answer for each block that asked."""
    schema = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), *[(k, pa.binary()) for k in ("counts", "ranks", "alphas", "totals")]])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("shard", "counts", "sums", "blocks", "ranks", "context_ranks", *(["contexts", "whole"] if level > 1 else []))}
                c, out = unpack(row["counts"]), []
                if level > 1:
                    sums = [x.copy() for x in _unpack_sums(row["sums"])]
                    if row["whole"]:
                        context = unpack_sorted(row["contexts"])
                        of = context[np.flatnonzero(np.diff(context, prepend=context[0] - np.uint64(1)))]
                        for x in row["whole"]:
                            k = int(np.searchsorted(of, np.uint64(x["context"])))
                            for s, v in zip(sums, x["sums"], strict=True):
                                s[k] = v
                    total, low, *ones = sums
                    alpha, divisor = weights(total, low, ones, d)
                for j, block in enumerate(row["blocks"]):
                    rank = unpack_sorted(row["ranks"][j]).astype(np.int64)
                    out.append({"block": block, "level": level, "shard": row["shard"], "counts": pack(c[rank]), "ranks": row["ranks"][j], "alphas": b"", "totals": b""})
                    if level > 1:
                        g = unpack_sorted(row["context_ranks"][j]).astype(np.int64)
                        out[-1] |= {"alphas": alpha[g].tobytes(), "totals": divisor[g].tobytes(), "ranks": d.tobytes() + row["ranks"][j]}
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _with_whole(table: DataFrame) -> DataFrame:
    """A level's shards with the sums over all shards of those contexts that are dealt over several."""
    parts = table.select("shard", F.explode("split").alias("x")).select("shard", "x.context", "x.sums")
    n = DISCOUNT_UP_TO + 2
    added = parts.groupBy("context").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("sums"))
    whole = stored(parts.select("shard", "context").join(added, "context").groupBy("shard").agg(F.collect_list(F.struct("context", "sums")).alias("whole")), "split")
    held = whole.agg(F.sum(F.size("whole"))).first()[0] or 0
    return table.join(F.broadcast(whole) if held * (8 * n + 32) <= BROADCAST_BYTES else whole, "shard", "left")


def _score(order: int, uni: Unigrams, shards: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not len(texts):
            return pa.Table.from_pylist([], schema)
        m = _Levels(texts, answers, uni, shards)
        for _ in range(order - 1):
            m.pairs()
            m.answered(answers)
        n = len(texts)
        c = m.count[m.t.word].astype(float)
        base = np.log10((c + 0.1) / (uni.tokens + 0.1 * (uni.distinct + 1)))
        add = lambda x: np.bincount(m.t.row, x, n)
        return pa.table([texts["doc_id"].cast(pa.int64()), pa.array(m.t.held_out), np.bincount(m.t.row, minlength=n), add(c > 0).astype(np.int64), np.full(n, uni.tokens), add(base), add(np.log10(m.prob))], schema=schema)

    return run


def _totals(level: DataFrame) -> list[int]:
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(DISCOUNT_UP_TO + 3)]
    return [int(x or 0) for x in level.agg(*sums).first()]


@dataclass
class Model:
    """The stored tables of each level, the driver's figures and the answers for the documents they were made from."""

    tables: list[DataFrame]
    uni: Unigrams
    discounts: list[np.ndarray]
    answers: DataFrame


def fit(blocks: DataFrame, shards: int, order: int = ORDER) -> Model:
    """blocks: (doc_id, text, block). Counts come from rows that aren't held out; answers are made for all rows."""
    words = blocks.groupBy("block").applyInArrow(_ask_words(shards), "shard int, block int, words binary, counts binary")
    tables = [stored(words.groupBy("shard").applyInArrow(_add_words, _SHARD_SCHEMA), "lm1")]
    uni = unigrams(_totals(tables[0]))
    answers = tables[0].mapInArrow(_answers(1, None), _ANSWER_SCHEMA)
    discounts = [uni.d]
    for level in range(2, order + 1):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_pairs(shards, level, uni), _ASKED)
        tables.append(stored(asked.groupBy("shard").applyInArrow(_add_pairs(level, uni), _SHARD_SCHEMA), f"lm{level}"))
        discounts.append(katz_discounts([0, *_totals(tables[-1])[2:]]))
        answers = answers.unionByName(_with_whole(tables[-1]).mapInArrow(_answers(level, discounts[-1]), _ANSWER_SCHEMA))
    return Model(tables, uni, discounts, answers)


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, text) to token counts, the smoothed unigram score and the Katz model's log10 probability of each text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = n_blocks(docs, BLOCK_BYTES)
    blocks = with_block(docs, n)
    model = fit(blocks, n, order)
    return blocks.groupBy("block").cogroup(model.answers.groupBy("block")).applyInArrow(_score(order, model.uni, n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def is_normalised(probabilities: np.ndarray) -> bool:
    return math.isclose(float(np.sum(probabilities)), 1.0, rel_tol=1e-9)
