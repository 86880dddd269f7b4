"""Byte-pair encoding by dynamic programming over prefixes (operator 4).

For each prefix of a word there is one last token in the word's encoding, as a
prefix of an encoding is the encoding of that prefix up to its last whole token.
So the last tokens of all prefixes are filled in from left to right: a suffix
automaton of the whole vocabulary, fed byte by byte, gives the tokens that end
at the current byte; a token can be the last one if the encoding of what is
before it ends with a token that is *compatible* with it, which means that the
pair alone, merged by rank, stays this pair. Exactly one token passes.
Back-pointers then give the ids.

Texts are cut into words by ``PATTERN``, the fixed one of byte-level vocabularies
without a pattern of their own, as the file here; each worker keeps
the ids of words and the answers for pairs that it has met, up to bounds.

Defined cases: null text is empty and has no ids. The added tokens of the file
are found in the text first, leftmost, as the library does. Other columns are
ignored; rows with equal doc_id are encoded each for itself. Very long texts and
words take time linear in their length and the tokens that end at a byte. An
empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded, free_memory

CACHE_WORDS = 600_000
CACHE_PAIRS = 400_000
RUN_CHARS = 2_000_000
CACHE_LENGTH = 64
#: Fixed value: the pattern by which byte-level vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters by which vocabulary files name bytes: printable ones stand for themselves, others are moved above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class SuffixAutomaton:
    """Generalised suffix automaton of all tokens.

    A state is a set of substrings of tokens that end at the same places; the
    state after some bytes holds their longest suffix that occurs in any token.
    A token is the longest string of its state, so ``token`` marks those states
    and ``ends`` lists those that a state and its suffix links lead to.
    """

    def __init__(self, tokens: dict[bytes, int]):
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for token in tokens:
            last = 0
            for b in token:
                q = nxt[last].get(b)
                if q is not None and length[q] == length[last] + 1:
                    last = q
                    continue
                if q is None:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    p = last
                    while p >= 0 and b not in nxt[p]:
                        nxt[p][b] = cur
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][b]
                        if length[q] == length[p] + 1:
                            link[cur] = q
                        else:
                            clone = self._clone(nxt, link, length, p, q, b)
                            link[cur] = clone
                    last = cur
                else:
                    last = self._clone(nxt, link, length, last, q, b)
        self.next, self.link, self.length = nxt, link, length
        self.token = [-1] * len(nxt)
        for token, i in tokens.items():
            s = 0
            for b in token:
                s = nxt[s][b]
            self.token[s] = i
        order = np.argsort(np.array(length), kind="stable").tolist()
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(nxt)  # (id, length) of tokens that end here, longest first
        for s in order[1:]:
            up = self.ends[link[s]]
            self.ends[s] = ((self.token[s], length[s]), *up) if self.token[s] >= 0 else up

    @staticmethod
    def _clone(nxt, link, length, p, q, b) -> int:
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(b) == q:
            nxt[p][b] = clone
            p = link[p]
        return clone


class Encoder:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(map(to_byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        ids = {t: i for i, t in self.bytes_of.items()}
        self.single = {t[0]: i for t, i in ids.items() if len(t) == 1}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            self.rank[pair] = (r, vocab[a + b])
            self.parts.setdefault(vocab[a + b], pair)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        reachable = {t: i for t, i in ids.items() if len(t) == 1 or self._merged(t) == (i,)}
        self.automaton = SuffixAutomaton(reachable)
        self.words: dict[str, bytes] = {}
        self._compatible: dict[int, bool] = {}
        self._base = max(self.bytes_of) + 1
        self._find = regex.compile(PATTERN).findall
        self._added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _merged(self, token: bytes) -> tuple[int, ...]:
        """A string by plain merging in rank order; only to see which tokens can arise."""
        return self._merge_ids([self.single[b] for b in token])

    def _merge_ids(self, ids: list[int]) -> tuple[int, ...]:
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.rank.get((ids[i], ids[i + 1]), (1 << 60,))[0])
            found = self.rank.get((ids[best], ids[best + 1]))
            if not found:
                break
            pair, out, i = (ids[best], ids[best + 1]), [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return tuple(ids)

    def compatible(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens stay as they are when their joined bytes are merged by rank.

        The pair breaks if some pair of pieces at the seam merges before the
        pieces on both sides are complete; tokens are unmerged step by step, the
        later merge first, and each seam is looked up.
        """
        limit = 1 << 60
        while True:
            found = self.rank.get((a, b))
            if found and found[0] < limit:
                return False
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            ra = self.rank[pa_][0] if pa_ else -1
            rb = self.rank[pb_][0] if pb_ else -1
            if ra < 0 and rb < 0:
                return True
            # Undo the merge that came last. Of equal ranks the right one did, as
            # merging goes from left to right; for the same reason a seam merge of
            # the right token's own rank would have come before it.
            if ra > rb:
                limit, a = ra, pa_[1]
            else:
                limit, b = rb + 1, pb_[0]

    def sorted_words(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of words by the prefix programme. Words in ascending order share the prefixes that were filled in last."""
        nxt, link, length, ends = self.automaton.next, self.automaton.link, self.automaton.length, self.automaton.ends
        known, seam, base = self._compatible, self.compatible, self._base
        states, matches, last, size = [0], [0], [0], [0]
        before = b""
        for word in words:
            at, most = 0, min(len(before), len(word))
            while at < most and before[at] == word[at]:
                at += 1
            del states[at + 1 :], matches[at + 1 :], last[at + 1 :], size[at + 1 :]
            before = word
            s, matched = states[at], matches[at]
            for i in range(at, len(word)):
                b = word[i]
                t = nxt[s].get(b)
                while t is None:
                    s = link[s]
                    matched = length[s]
                    t = nxt[s].get(b)
                s = t
                matched += 1
                for token, k in ends[s]:
                    if k > matched:  # the state also holds longer strings than what was read
                        continue
                    start = i + 1 - k
                    if start == 0:
                        break
                    key = last[start] * base + token
                    ok = known.get(key)
                    if ok is None:
                        ok = known[key] = seam(last[start], token)
                    if ok:
                        break
                states.append(s)
                matches.append(matched)
                last.append(token)
                size.append(k)
            out, n = [], len(word)
            while n:
                out.append(last[n])
                n -= size[n]
            out.reverse()
            yield out

    def word(self, word: bytes) -> list[int]:
        return next(self.sorted_words([word]))

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't kept; short ones are kept from now on."""
        order = sorted(words)  # code points and their UTF-8 bytes have the same order
        found = {w: array("I", ids).tobytes() for w, ids in zip(order, self.sorted_words(w.encode() for w in order), strict=True)}
        if len(self.words) + len(found) > CACHE_WORDS:
            self.words.clear()
        if len(self._compatible) > CACHE_PAIRS:
            self._compatible.clear()
        self.words.update((w, i) for w, i in found.items() if len(w) <= CACHE_LENGTH)
        return found

    def _pieces(self, text: str) -> list[str | bytes]:
        """A text's words; an added token is the bytes of its id."""
        if self._added is None or not self._added.search(text):
            return self._find(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [*self._find(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return [*out, *self._find(text[at:])]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts as unsigned 32-bit numbers; the words of all are looked up together."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        new = {w for w in set().union(*pieces) - self.words.keys() if type(w) is str}
        found = self._learn(new) if new else {}
        out = []
        for p in pieces:
            try:
                out.append(b"".join(map(self.words.__getitem__, p)))
            except KeyError:  # an added token, a long word, or one that the bound has put out
                out.append(b"".join([w if type(w) is bytes else self.words.get(w) or found.get(w) or self._again(w) for w in p]))
        return [np.frombuffer(x, np.uint32) for x in out]

    def _again(self, word: str) -> bytes:
        return array("I", self.word(word.encode())).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, built once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        gc.freeze()  # its tables are for good: collections needn't visit them
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts(column: pa.Array) -> Iterator[str | None]:
    """Texts one at a time, so that a batch is never held twice."""
    return (x.as_py() for x in column)


def finished(e: Encoder) -> None:
    """At the end of a task: other operators' workers need the memory."""
    e.words.clear()
    free_memory()


def encoded(e: Encoder, column: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each text with its ids, in runs of about RUN_CHARS characters."""
    run, held = [], 0
    for t in texts(column):
        run.append(t)
        held += len(t or "")
        if held >= RUN_CHARS:
            yield from zip(run, e.encode_all(run), strict=True)
            run, held = [], 0
    yield from zip(run, e.encode_all(run), strict=True)


def bpe(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, text) to (doc_id, ids, decoded): the ids of each text, and the text that they decode to."""
    path = path or default_path()

    def run(batches):
        e = encoder(path)
        for batch in bounded(batches):
            got = [ids for _, ids in encoded(e, batch.column(1))]
            values = np.concatenate(got) if got else np.zeros(0, np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([e.decode(g) for g in got], pa.string())], names=["doc_id", "ids", "decoded"])
        finished(e)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As bpe, with digests in place of ids and text; they are taken where the ids are made, so that ids aren't sent."""
    path = path or default_path()

    def run(batches):
        e = encoder(path)
        decimal = [str(i) for i in range(max(e.bytes_of) + 1)]
        for batch in bounded(batches):
            n, a, b = [], [], []
            for _, got in encoded(e, batch.column(1)):
                n.append(len(got))
                a.append(hashlib.sha256(",".join(map(decimal.__getitem__, got.tolist())).encode()).hexdigest())
                b.append(hashlib.sha256(e.decode(got).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finished(e)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
