"""Secrets by fixed patterns and by inferred grammars of credential formats (operator 8).

Base patterns give labelled credentials: the value of an assignment, an access
key, a hexadecimal run. From a bounded sample of them (``TRAIN_PER_KIND`` distinct
values a kind, those with the smallest hashes, of at most ``TRAIN_LENGTH`` bytes
each) one probabilistic automaton a kind is inferred from whole values. Its alphabet are classes of characters with statistically equal rates.
A prefix tree counts classes and ends at each state; its states are folded, in
breadth-first order, into the first kept state that is compatible: the Hoeffding
bound separates neither their end rates nor their rates for any class, nor those
of their successors.

Every candidate of a text, a whole run of characters of ``[A-Za-z0-9+/_=-]`` that
does not lie in a base span, is scored by each automaton: mean log10 likelihood a
character, where a class's mass is shared by its characters. Candidates that reach
the lowest score of an automaton's training values less ``MARGIN`` are added as
spans of kind ``format``, also beside a base span that is a part of them. A run
shorter than all values that were learned from can't be told from a word and is
not one of their formats.

Defined cases: null text is empty and has no spans. With fewer than
``MIN_TRAIN`` values of a kind no automaton is made for it, and a table without
credentials has base spans only (none). Repeated rows are each scanned. Other
columns are ignored. Offsets count code points; ends are exclusive. Ties of spans
are in the order of kinds. Time is linear in a text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded, first_by_hash, hash_place, stored
from varigrid.llm.bpe import texts

KINDS = ("assign", "access", "hex", "format")
TRAIN_PER_KIND = 2000
MIN_TRAIN = 20
TRAIN_LENGTH = 4096
MARGIN = 0.02
ALPHA = 0.05
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
_HINT = re.compile(rb"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]")


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of value) in bytes, by start, then kind."""
    out = []
    if _HINT.search(raw):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(raw)]
    return sorted(out)


@dataclass
class _State:
    n: int = 0
    ends: int = 0
    to: dict[int, int] = field(default_factory=dict)
    seen: Counter = field(default_factory=Counter)


class Automaton:
    """Deterministic stochastic automaton over classes of characters, inferred by state merging."""

    def __init__(self, values: list[bytes], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.class_of = self._alphabet(values)
        self.size = Counter(self.class_of.values())
        self.states = [_State()]
        for v in values:
            s = 0
            for c in v:
                k = self.class_of[c]
                st = self.states[s]
                st.n += 1
                st.seen[k] += 1
                if k not in st.to:
                    st.to[k] = len(self.states)
                    self.states.append(_State())
                s = st.to[k]
            self.states[s].n += 1
            self.states[s].ends += 1
        self._merge_all()
        self.low = min((self.score(v) for v in values), default=0.0) - MARGIN
        self.shortest = min(map(len, values), default=1)
        self.starts = bytes(c for c, k in self.class_of.items() if k in self.states[0].to)

    def _alphabet(self, values: list[bytes]) -> dict[int, int]:
        """Characters by descending rate; one starts a new class if its rate differs from the rate of the class's first."""
        count = Counter(c for v in values for c in v)
        total, out, first, k = sum(count.values()), {}, None, -1
        for c, n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
            if first is None or self._differ(first, total, n, total):
                first, k = n, k + 1
            out[c] = k
        return out

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            x, y = work.pop()
            p, q = self.states[x], self.states[y]
            if not p.n or not q.n:
                continue
            if self._differ(p.ends, p.n, q.ends, q.n) or any(self._differ(p.seen[k], p.n, q.seen[k], q.n) for k in {*p.seen, *q.seen}):
                return False
            work += [(p.to[k], q.to[k]) for k in p.to if k in q.to and p.to[k] != q.to[k]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add state b, the root of a tree, and all below it to state a."""
        work = [(a, b)]
        while work:
            x, y = work.pop()
            p, q = self.states[x], self.states[y]
            p.n += q.n
            p.ends += q.ends
            p.seen.update(q.seen)
            for k, t in q.to.items():
                if k in p.to:
                    work.append((p.to[k], t))
                else:
                    p.to[k] = t

    def _merge_all(self) -> None:
        """Take the tree states below kept ones, the first kept first; fold each into the first compatible kept state, or keep it."""
        kept: dict[int, None] = {0: None}
        while True:
            at = next(((s, k) for s in kept for k in sorted(self.states[s].to) if self.states[s].to[k] not in kept), None)
            if at is None:
                break
            s, k = at
            t = self.states[s].to[k]
            into = next((r for r in kept if self._compatible(r, t)), None)
            if into is None:
                kept[t] = None
            else:
                self.states[s].to[k] = into
                self._fold(into, t)
        number = {s: i for i, s in enumerate(kept)}
        self.states = [self.states[s] for s in kept]
        for st in self.states:
            st.to = {k: number[t] for k, t in st.to.items()}

    def score(self, value: bytes) -> float:
        """Mean log10 likelihood a character, the end included; minus infinity for what the automaton can't make."""
        total, s = 0.0, 0
        for c in value:
            k = self.class_of.get(c)
            st = self.states[s]
            if k not in st.to:
                return -math.inf
            total += math.log10(st.seen[k] / st.n / self.size[k])
            s = st.to[k]
        st = self.states[s]
        return (total + math.log10(st.ends / st.n)) / (len(value) + 1) if st.ends else -math.inf

    def fits(self, value: bytes) -> bool:
        return self.score(value) >= self.low


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, value) of all base matches."""

    def run(batches):
        for batch in bounded(batches):
            kinds, values = [], []
            for t in texts(batch.column(0)):
                if t:
                    raw = t.encode()
                    for _, kind, end, at in base_spans(raw):
                        if end - at <= TRAIN_LENGTH:
                            kinds.append(kind)
                            values.append(raw[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.binary())], names=["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind int, value binary")


def infer(docs: DataFrame, per_kind: int = TRAIN_PER_KIND, min_train: int = MIN_TRAIN) -> dict[int, Automaton]:
    """An automaton for each kind with enough distinct values; per_kind bounds what the driver takes."""
    values = stored(labelled(docs).distinct(), "credentials")
    place, found = hash_place(F.xxhash64("value")), F.lit(False)
    for r in values.groupBy("kind").count().collect():  # a row a kind
        found = found | ((F.col("kind") == r.kind) & first_by_hash(place, r["count"], per_kind))
    by_kind: dict[int, list[tuple[int, bytes]]] = {}
    for r in values.filter(found).select("kind", "value", place.alias("place")).collect():
        by_kind.setdefault(r.kind, []).append((r.place, bytes(r.value)))
    return {k: Automaton(sorted(x for _, x in sorted(v)[:per_kind])) for k, v in sorted(by_kind.items()) if len(v) >= min_train}


def _candidates(automata: dict[int, Automaton]) -> re.Pattern[bytes]:
    """Whole runs that are as long as the shortest learned value and start as some automaton does; no other can fit."""
    starts = re.escape(bytes(sorted({c for a in automata.values() for c in a.starts})))
    least = min(a.shortest for a in automata.values())
    return re.compile(rb"(?<![A-Za-z0-9+/_=-])(?=[%s])[A-Za-z0-9+/_=-]{%d,}" % (starts, least))


def all_spans(raw: bytes, automata: dict[int, Automaton], candidates: re.Pattern[bytes] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes: base spans and candidates that fit an inferred format."""
    out = [(s, k, e) for s, k, e, _ in base_spans(raw)]
    if automata:
        # both in ascending order: a candidate lies in a base span if one that starts no later ends no earlier
        i, reach, base, n = 0, 0, out, len(out)
        more = []
        for m in (candidates or _candidates(automata)).finditer(raw):
            while i < n and base[i][0] <= m.start():
                reach = max(reach, base[i][2])
                i += 1
            if reach < m.end() and any(a.fits(m[0]) for a in automata.values()):
                more.append((m.start(), 3, m.end()))
        out = sorted(out + more) if more else out
    return out


def _code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    at = sorted({x for s, _, e in spans for x in (s, e)})
    place, done, n = {}, 0, 0
    for x in at:
        n += len(raw[done:x].decode())
        place[x], done = n, x
    return [(place[s], k, place[e]) for s, k, e in spans]


def secret_scan(docs: DataFrame, automata: dict[int, Automaton] | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, base, spans): arrays of (kind, start, end), by start, then kind as listed."""
    automata = infer(docs) if automata is None else automata
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    candidates = _candidates(automata) if automata else None

    def run(batches):
        for batch in bounded(batches):
            base, spans = [], []
            for t in texts(batch.column(1)):
                raw = (t or "").encode()
                got = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in _code_points(raw, all_spans(raw, automata, candidates))]
                spans.append(got)
                base.append([x for x in got if x["kind"] != "format"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>")


def without_secrets(docs: DataFrame, automata: dict[int, Automaton] | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by a mark; all other columns are kept."""
    automata = infer(docs) if automata is None else automata
    candidates = _candidates(automata) if automata else None

    place = docs.columns.index("text")

    def one(t):
        if not t:
            return t
        raw = t.encode()
        out, at = [], 0
        for s, _, e in all_spans(raw, automata, candidates):
            if s >= at:
                out += [raw[at:s], mark.encode()]
            elif e <= at:
                continue
            at = max(at, e)
        return b"".join([*out, raw[at:]]).decode() if out else t

    def run(batches):
        for batch in bounded(batches):
            field = batch.schema.field(place)
            yield batch.set_column(place, field, pa.array(map(one, texts(batch.column(place))), field.type))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
