"""Personal data: fixed patterns and a skip-chain conditional random field over the words that could hold it.

Words with a digit or an at sign are the field's nodes; all other words have the label "none". Neighbouring
nodes share a transition potential. Nodes that repeat each other (equal but for punctuation, or in their
digits) share one that favours equal labels, however far apart, so a mention whose surroundings say little
takes the label of its clearer double: each is linked to the first mention and to the last one before it,
so no two doubles of a document are more than two links apart. Marginals come from loopy message passing
over a batch's documents at once, each until its messages settle. The weights are fitted here, by
pseudo-likelihood, on a bounded sample that the patterns label.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import lean, numbered, pick

#: Base kinds, in the order in which spans that begin at one place are listed; then the field's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9][\x20.0-9-]*")
_SECRET = re.compile(r"\b(AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b")
_CLUE = re.compile(r"[0-9@]+")
_BLANK = frozenset(" \t\n\v\f\r")
_EDGE = "\"'`.,;:!?()[]{}<>="

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    """Whether a run of digits, however long, is a number up to 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns: leftmost, not overlapping within a kind; failing matches are dropped.

    The time is in proportion to the text, whatever its runs. An email ends its first part at an at sign, so
    the part before one and the domain after it are read once each; a match of four numbers can only begin
    where a run of digits does, and takes runs whole. Numbers are looked for only in runs that begin with a
    digit: a match cannot leave such a run.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        done = found.end() if found else at + 1
        if found:
            out.append((low, done, 0))
        at = text.find("@", done)
    for run in _DIGIT_RUN.finditer(text):
        a, b = run.span()
        if b - a >= 7:
            out += [(m.start(), m.end(), 1) for m in _IP.finditer(text, a, b) if all(map(_is_byte, m[0].split(".")))]
            for m in _CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


class Overlaps:
    """Which of some spans, by start, is the first to overlap a place: found by halving, not by trying all."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: (s[0], s[2]))
        self.reach = list(accumulate((b for _, b, _ in self.spans), max))

    def first(self, a: int, b: int) -> Span | None:
        i = bisect_right(self.reach, a)
        return self.spans[i] if i < len(self.spans) and self.spans[i][0] < b else None


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """Words (parted by ASCII white space) that have a digit or an at sign, without punctuation at their ends."""
    out, done = [], -1
    for m in _CLUE.finditer(text):
        if m.start() < done:
            continue
        a, b, size = m.start(), m.end(), len(text)
        while a > 0 and text[a - 1] not in _BLANK:
            a -= 1
        while b < size and text[b] not in _BLANK:
            b += 1
        done = b
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGE and text[b - 1] != ")":
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def word_features(text: str, a: int, b: int, before: int, after: int) -> list[float]:
    """What a word looks like; before, after: where the neighbouring candidates end and begin."""
    w = text[a:b]
    digits = sum(c in "0123456789" for c in w)
    plain = w.replace("-", "").replace(".", "").replace("(", "").replace(")", "").replace("+", "")
    left = text[max(0, a - 12) : a]
    n = b - a
    return [
        1.0, "@" in w, "@" in w and "." in w.rsplit("@", 1)[-1], w.count("@") > 1, digits / n, digits >= 12, digits >= 9, 3 <= digits <= 4, digits <= 2,
        w.count(".") == 3, w.count(".") == 3 and digits + 3 == n, w.count(".") == 3 and all(x.isascii() and x.isdigit() and _is_byte(x) for x in w.split(".")), w[0] == "+", "(" in w and ")" in w, "-" in w and plain.isdigit(),
        plain.isascii() and plain.isdigit() and 12 <= len(plain) <= 19, plain.isascii() and plain.isdigit() and 12 <= len(plain) <= 19 and luhn(plain),
        n >= 16 and w.isalnum() and w.isupper(), n >= 32 and all(c in "0123456789abcdef" for c in w), n >= 20 and "@" not in w and digits < n, "=" in left or "key" in left or "token" in left,
        a - before == 1, after - b == 1, left.rstrip().endswith("+") or "+" in left, n > 60,
    ]


N_FEATURES = len(word_features("1 ", 0, 1, -9, 9))


class Graph:
    """The nodes and edges of a batch of texts: features, chain edges between neighbours, skip edges between doubles."""

    def __init__(self, texts: list[str]):
        self.where: list[tuple[int, int, int]] = []
        rows, chain, skip = [], [], []
        for d, text in enumerate(texts):
            words = candidates(text)
            ends: dict[tuple, tuple[int, int]] = {}  # of each word or number: its first and its latest mention
            for i, (a, b) in enumerate(words):
                node = len(self.where)
                self.where.append((d, a, b))
                before = words[i - 1][1] if i else -9
                after = words[i + 1][0] if i + 1 < len(words) else len(text) + 9
                rows.append(word_features(text, a, b, before, after))
                if i and text[before:a].strip(" ()-.") == "":
                    chain.append((node - 1, node))
                w = text[a:b]
                keys = [("w", w.lower())] if b - a >= 5 else []
                number = "".join(c for c in w if c in "0123456789")
                keys += [("d", number)] if len(number) >= 7 and number != w.lower() else []
                for key in keys:
                    first, latest = ends.get(key, (node, node))
                    skip += [(x, node) for x in dict.fromkeys((first, latest)) if x != node]
                    ends[key] = first, node
        self.x = np.array(rows, float).reshape(-1, N_FEATURES)
        self.chain = np.array(chain, int).reshape(-1, 2)
        self.skip = np.array(skip, int).reshape(-1, 2)


class SkipChain:
    """Weights: unary (features x labels), transition (labels x labels), agree (labels: for equal labels of doubles).

    Label 0 is "none", label k + 1 is KINDS[k].
    """

    labels = len(KINDS) + 1

    def __init__(self, unary=None, transition=None, agree=None):
        self.unary = np.zeros((N_FEATURES, self.labels)) if unary is None else unary
        self.transition = np.zeros((self.labels, self.labels)) if transition is None else transition
        self.agree = np.zeros(self.labels) if agree is None else agree

    def fit(self, graph: Graph, y: np.ndarray, steps: int = 500, rate: float = 0.3, ridge: float = 1e-3) -> SkipChain:
        """Gradient ascent on the pseudo-likelihood: each label given its neighbours' labels and the features.

        Nodes weigh as the inverse root of their label's frequency, so that many plain numbers don't drown the rest.
        """
        n, k = len(y), self.labels
        if not n:
            return self
        left, right = np.zeros((n, k)), np.zeros((n, k))
        a, b = graph.chain.T
        left[b, y[a]] = 1
        right[a, y[b]] = 1
        near = np.zeros((n, k))
        for p, q in (graph.skip.T, graph.skip.T[::-1]):
            np.add.at(near, (p, y[q]), 1)
        true, moment = np.eye(k)[y], [0.0] * 3
        weight = 1 / np.sqrt(np.bincount(y, minlength=k)[y])
        weight = (weight / weight.mean())[:, None]
        for t in range(steps):
            score = graph.x @ self.unary + left @ self.transition + right @ self.transition.T + near * self.agree
            p = np.exp(score - score.max(axis=1, keepdims=True))
            gap = weight * (true - p / p.sum(axis=1, keepdims=True))
            slopes = (graph.x.T @ gap / n - ridge * self.unary, (left.T @ gap + gap.T @ right) / n - ridge * self.transition, (near * gap).sum(axis=0) / n - ridge * self.agree)
            moment = [0.9 * m + s for m, s in zip(moment, slopes, strict=True)]
            self.unary = self.unary + rate * moment[0]
            self.transition = self.transition + rate * moment[1]
            self.agree = np.clip(self.agree + rate * moment[2], 0.0, 3.0)
        return self

    def marginals(self, graph: Graph, most_rounds: int = 200, damping: float = 0.3, settled: float = 1e-5) -> np.ndarray:
        """Loopy sum-product: each edge carries a message each way; a round sends them all at once.

        A document's rounds end when none of its messages changes by more than settled, so its result does
        not depend on the documents beside it; most_rounds ends those that swing for ever.
        """
        own = graph.x @ self.unary
        edges = np.concatenate([graph.chain, graph.skip])
        if not len(edges):
            return _softmax(own)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        e, chained = len(edges), len(graph.chain)
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        kind = np.concatenate([np.repeat([0, 2], [chained, e - chained]), np.repeat([1, 2], [chained, e - chained])])
        steps = np.exp(np.stack([self.transition, self.transition.T, np.diag(self.agree)]))
        owner = np.array([d for d, _, _ in graph.where])[source]
        log_m, going = np.zeros((2 * e, self.labels)), np.arange(2 * e)
        for _ in range(most_rounds):
            total = own.copy()
            np.add.at(total, target[going], log_m[going])
            out = total[source[going]] - log_m[back[going]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.empty_like(out)
            for k, step in enumerate(steps):
                mine = kind[going] == k
                new[mine] = out[mine] @ step
            new = np.log(new / new.sum(axis=1, keepdims=True) + 1e-300)
            new = damping * log_m[going] + (1 - damping) * new
            change = np.zeros(owner.max() + 1)
            np.maximum.at(change, owner[going], np.abs(new - log_m[going]).max(axis=1))
            log_m[going] = new
            going = going[change[owner[going]] > settled]
            if not len(going):
                break
        np.add.at(own, target, log_m)
        return _softmax(own)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return p / p.sum(axis=1, keepdims=True) if len(x) else p


def taught_labels(graph: Graph, texts: list[str]) -> np.ndarray:
    """Labels of the nodes by the base patterns and those of secrets: what the field learns from."""
    base = [Overlaps(base_spans(t)) for t in texts]
    secrets = [Overlaps([(m.start(), m.end(), len(BASE)) for m in _SECRET.finditer(t)]) for t in texts]
    hits = (base[d].first(a, b) or secrets[d].first(a, b) for d, a, b in graph.where)
    return np.array([s[2] + 1 if s else 0 for s in hits], int)


def find_spans(texts: list[str], model: SkipChain, sure: float = 0.6) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text: the field's are those of sure label that overlap no base span."""
    graph = Graph(texts)
    base = [base_spans(t) for t in texts]
    every = [list(s) for s in base]
    if len(graph.where):
        p = model.marginals(graph)
        label = np.where(p.max(axis=1) >= sure, p.argmax(axis=1), 0)
        follows, there = set(map(tuple, graph.chain.tolist())), [Overlaps(s) for s in base]
        last: tuple[int, int, int] | None = None
        for node in np.flatnonzero(label):
            d, a, b = graph.where[node]
            kind = int(label[node]) - 1
            if there[d].first(a, b):
                last = None
                continue
            if last and (node - 1, node) in follows and last == (d, kind, node - 1):
                every[d][-1] = (every[d][-1][0], b, kind)
            else:
                every[d].append((a, b, kind))
            last = (d, kind, node)
    return [(b, sorted(e, key=lambda s: (s[0], s[2]))) for b, e in zip(base, every, strict=True)]


def fit_pii(docs: DataFrame, *, text_col="text", sample_docs: int = 2000, sample_words: int = 100_000) -> SkipChain:
    """Fit the field on the at most sample_docs texts of least hash among those with a digit or an at sign.

    sample_words bounds what the driver fits on: whole texts are taken by hash until they have so many runs
    of digits or at signs in all; a text with over a tenth of that is not drawn. The sample is sorted, so
    the weights do not depend on how rows are dealt. Null texts are not drawn; without any text the weights
    are 0, and then only the base patterns find anything.
    """
    clues = F.regexp_count("text", F.lit("[0-9@]+"))
    rows = pick(docs, text=text_col).withColumn("n", clues).where((F.col("n") > 0) & (F.col("n") <= sample_words // 10)).withColumn("h", F.xxhash64("text"))
    least = rows.groupBy("h").agg(F.min("n").alias("n")).orderBy("h").limit(sample_docs)
    upto = F.sum("n").over(W.orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow))
    least = least.withColumn("upto", upto).where(F.col("upto") <= sample_words).select("h")
    sample = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min("text").alias("text"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                graph = Graph([text])
                parts = [graph.x, graph.chain.astype(np.int64), graph.skip.astype(np.int64), taught_labels(graph, [text]).astype(np.int64)]
                yield pa.RecordBatch.from_pydict({"h": pa.array([h], pa.int64()), "parts": pa.array([[x.tobytes() for x in parts]], pa.list_(pa.binary()))})

    graph, y, at = Graph([]), [np.zeros(0, np.int64)], 0
    chain, skip, x = [graph.chain], [graph.skip], [graph.x]
    for row in sorted(sample.mapInArrow(lean(nodes), "h long, parts array<binary>").collect(), key=lambda r: r["h"]):
        of_x, of_chain, of_skip, of_y = map(bytes, row["parts"])
        x.append(np.frombuffer(of_x).reshape(-1, N_FEATURES))
        chain.append(np.frombuffer(of_chain, np.int64).reshape(-1, 2) + at)
        skip.append(np.frombuffer(of_skip, np.int64).reshape(-1, 2) + at)
        y.append(np.frombuffer(of_y, np.int64))
        at += len(x[-1])
    graph.x, graph.chain, graph.skip = (np.concatenate(v) for v in (x, chain, skip))
    return SkipChain().fit(graph, np.concatenate(y))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span as its kind in brackets; of spans that overlap the first is named."""
    if not spans:
        return text
    out, last = [], 0
    for a, b, k in spans:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask_pii(docs: DataFrame, model: SkipChain, *, text_col="text") -> DataFrame:
    """The rows of docs, all columns as they are, but personal data in the text masked.

    Null and empty texts stay what they are; repeated rows are masked alike; an empty table gives an empty
    one; other columns are not read, whatever their names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(at).to_pylist()
                found = find_spans([t or "" for t in texts], model)
                new = pa.array([masked(t, e) for t, (_, e) in zip(texts, found, strict=True)], batch.schema.field(at).type)
                columns = list(part.columns)
                columns[at] = new
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain, _, back = numbered(docs)
    return back(plain.mapInArrow(lean(run), plain.schema))


def find_pii(docs: DataFrame, model: SkipChain, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, the number of base spans of each kind, of secrets and of all spans, base and all spans (kind:start:end) and the text with all masked.

    Places are code points, end exclusive. A null or empty text has none, and its masked text is what it
    was. Equal texts give equal rows; null and repeated ids are rows like any other; an empty table gives
    an empty one; other columns are not read.
    """
    counts = [*(f"n_{k}" for k in BASE), "n_secret", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                found = find_spans([t or "" for t in texts], model)
                base = [spelled(b) for b, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), *[pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(BASE))],
                        pa.array([sum(s[2] == len(BASE) for s in e) for _, e in found], pa.int64()), pa.array([len(e) for _, e in found], pa.int64()),
                        pa.array(base, pa.string()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                        pa.array([spelled(e) for _, e in found], pa.string()), pa.array([masked(t, e) for t, (_, e) in zip(texts, found, strict=True)], pa.string()),
                    ],
                    ["id", *counts, "base", "base_sha256", "spans", "masked"],
                )

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(c + ' long' for c in counts)}, base string, base_sha256 string, spans string, masked string")
