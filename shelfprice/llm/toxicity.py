"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat verb, target, intent, negation, reporting verb, other; a clause end is
one too. Four transducers read and rewrite them, one symbol for one: reported speech marks what follows a
reporting verb, negation what follows a negation, intent what follows a plan, target what is near a person
spoken of. Their composition is built once, as one machine; the sum of a clause's arc weights is the
clause's score. A logistic model over the matched clauses of a text, fitted on labelled rows, gives the
text's score. Isolated insult words count only by way of the clauses they stand in.

The insult lexicon is a few fixed words and those words and word beginnings that mark toxic texts in a
bounded sample of the labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, numbered, pick
from .textual import chunks, spans, word_hashes

#: Symbols of words: other, insult, threat verb, target, intent, negation, reporting verb; and a clause's end.
OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, END = "w", "i", "t", "y", "f", "n", "r", "|"
LEXICON = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown clowns fool imbecile filth vermin garbage creep jerk bastard".split(),
    THREAT: "kill killed hurt destroy beat smash shoot stab burn hang crush murder attack punish".split(),
    TARGET: "you your yours u he him his she her they them their these those this that are is was were du ihr sie vous tu ils eres usted ellos".split(),
    INTENT: "will ll gonna going shall must should ought deserve deserves deserved hope wish werde vais voy".split(),
    NEGATION: "not no never neither nor without isn aren wasn weren don doesn didn nicht kein keine pas jamais sin nunca".split(),
    REPORT: "said says say told tells wrote writes claimed claims called quoted quote according reported reports sagte dit dijo".split(),
}
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(c) for c in ".!?;:\n"]] = 1


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) to (state, symbol written, weight); it begins in state start and reads each symbol."""

    start: object
    arcs: dict

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; weights add up."""
        start, arcs = (self.start, other.start), {}
        todo, symbols = [start], {x for _, x in self.arcs}
        seen = {start}
        while todo:
            p, q = todo.pop()
            for x in symbols:
                p2, y, w1 = self.arcs[p, x]
                q2, z, w2 = other.arcs[q, y]
                arcs[(p, q), x] = (p2, q2), z, w1 + w2
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
        return Transducer(start, arcs)

    def run(self, symbols: str) -> tuple[list, float]:
        state, out, total = self.start, [], 0.0
        for x in symbols:
            state, y, w = self.arcs[state, x]
            out.append(y)
            total += w
        return out, total


def _marker(symbols: set, opens: str, reach: int, mark: str, weight: float, base: float) -> Transducer:
    """Marks insults and threats up to reach words after a symbol of opens (a clause's end closes it).

    A mark is a letter added to the symbol; the arc weighs ``weight`` where it marks, ``base`` where not.
    """
    arcs = {}
    for state in range(reach + 1):
        for x in symbols:
            kind = x[0]
            left = reach if kind in opens else 0 if kind == END else max(0, state - 1)
            hit = kind in (INSULT, THREAT)
            arcs[state, x] = left, x + mark if hit and state else x, (weight if state else base) * hit
    return Transducer(0, arcs)


def grammar() -> Transducer:
    """Reported speech, negation, intent and target composed: 'i' may leave as 'i', 'iN', 'iRY' and so on."""
    plain = {OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, END}

    def grown(symbols: set, mark: str) -> set:
        return symbols | {x + mark for x in symbols if x[0] in (INSULT, THREAT)}

    machine = _marker(plain, REPORT, 12, "R", -0.6, 0.0)
    symbols = grown(plain, "R")
    for opens, reach, mark, weight, base in ((NEGATION, 3, "N", -0.8, 1.0), (INTENT, 4, "F", 0.5, 0.0), (TARGET, 5, "Y", 0.7, 0.0)):
        machine = machine.then(_marker(symbols, opens, reach, mark, weight, base))
        symbols = grown(symbols, mark)
    return machine


_GRAMMAR = grammar()
FEATURES = ("targeted", "asserted", "reported", "negated", "threats", "planned", "best", "clauses", "weight", "density")


def _features(clauses: list[str], words: int) -> list[float]:
    """What a text's matched clauses amount to: marks counted, and the clauses' arc sums, their largest and their sum a word."""
    count, best, heavy = Counter(), 0.0, 0.0
    for clause in clauses:
        out, weight = _GRAMMAR.run(clause)
        best, heavy = max(best, weight), heavy + max(0.0, weight)
        for x in out:
            if x[0] in (INSULT, THREAT):
                marks = x[1:]
                kind = "reported" if "R" in marks else "negated" if "N" in marks else "planned" if x[0] == THREAT and "F" in marks else "threats" if x[0] == THREAT else "targeted" if "Y" in marks else "asserted"
                count[kind] += 1
    return [*(np.log1p(count[k]) for k in FEATURES[:6]), best, np.log1p(len(clauses)), np.log1p(heavy), min(1.0, 12 * heavy / max(words, 1))]


@dataclass
class ToxicityModel:
    """words, stems: the learnt insults, stems as word beginnings; weights: of FEATURES and, last, the constant."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [1.0, 0.7, 0.1, 0.0, 0.1, 1.0, 0.3, 0.2, 0.4, 1.0, -3.0])

    def _tables(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By length of the beginning in bytes (0: whole words): sorted hashes and their symbols."""
        entries: dict[int, dict[int, int]] = {0: {}}
        whole = {w: s for s, ws in LEXICON.items() for w in ws} | dict.fromkeys(self.words, INSULT)
        for length, items in [(0, whole), *[(len(s.encode()), {s: INSULT}) for s in self.stems]]:
            for w, symbol in items.items():
                buf, starts, ends, _ = spans([w.encode()], _LETTERS)
                if len(starts) == 1:
                    entries.setdefault(length, {})[int(word_hashes(buf, starts, ends)[0])] = ord(symbol)
        out = []
        for length, found in entries.items():
            keys = np.array(sorted(found), np.uint64)
            out.append((length, keys, np.array([found[int(k)] for k in keys], np.uint8)))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row of FEATURES for each text (null: empty)."""
        rows, tables = [], self._tables()
        for _, part in chunks([None if t is None else t.lower() for t in texts]):
            buf, starts, ends, first = spans(part, _LETTERS)
            symbol = np.full(len(starts), ord(OTHER), np.uint8)
            for length, keys, kinds in tables:
                if not len(keys) or not len(starts):
                    continue
                some = np.arange(len(starts)) if not length else np.flatnonzero(ends - starts > length)
                h = word_hashes(buf, starts[some], starts[some] + length if length else ends[some])
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = (keys[at] == h) & (symbol[some] == ord(OTHER))
                symbol[some[ok]] = kinds[at[ok]]
            clause = np.cumsum(_ENDS[buf])[starts] if len(starts) else np.zeros(0, np.int64)
            hits = np.flatnonzero((symbol == ord(INSULT)) | (symbol == ord(THREAT)))
            owner = np.searchsorted(first, hits, side="right") - 1
            for d in range(len(part)):
                mine = hits[owner == d] if len(hits) < 64 else hits[np.searchsorted(owner, d) : np.searchsorted(owner, d, side="right")]
                lo, hi = first[d], first[d + 1]
                if not len(mine):
                    rows.append([0.0] * len(FEATURES))
                    continue
                found = np.unique(clause[mine])
                a = lo + np.searchsorted(clause[lo:hi], found)
                b = lo + np.searchsorted(clause[lo:hi], found, side="right")
                clauses = [symbol[x:y].tobytes().decode() + END for x, y in zip(a, b, strict=True)]
                rows.append(_features(clauses, int(hi - lo)))
        return np.array(rows).reshape(-1, len(FEATURES))

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def is_held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _parts(text: str) -> set[str]:
    """The words of a text, and with a star the beginnings of longer ones."""
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}


def _counted(sample: DataFrame, only: set[str] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter()
            for t in batch.column("text").to_pylist():
                parts = _parts(t or "")
                n.update(parts if only is None else parts & only)
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["part", "n"])

    return sample.select("text").mapInArrow(lean(run), "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", sample_rows: int = 20_000, support: int = 3, share: float = 0.01, odds: float = 30.0,
) -> ToxicityModel:
    """Learn lexicon and weights from at most sample_rows labelled rows, those of least hash that are not held out.

    Lexicon: all words and word beginnings (4 to 6 letters) that occur in at least support toxic texts, and at
    least that share of them, and whose share of toxic texts is at least odds times that of other texts. As each
    is in that share of the sample's toxic texts, their number is bounded by the length of texts and not by the
    corpus. Where a class has no row, the model keeps its fixed lexicon and weights. Rows with a null id or
    label teach nothing; repeated labels of one id count as its largest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marked = pick(labels, id=id_col, label=label_col).where("id is not null and label is not null").where(~is_held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = pick(docs, id=id_col, text=text_col)
    sample = scratch.keep(texts.join(F.broadcast(scratch.keep(marked)), "id").select("text", "label"))
    sizes = {r["label"]: r["n"] for r in sample.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    if not bad or not good:
        return ToxicityModel()
    toxic = {r["part"]: r["n"] for r in _counted(sample.where("label = 1"), None).where(F.col("n") >= max(support, share * bad)).collect()}
    clean = {r["part"]: r["n"] for r in _counted(sample.where("label <> 1"), set(toxic)).collect()}
    rate = {p: ((n + 0.5) / (bad + 1)) / ((clean.get(p, 0) + 0.5) / (good + 1)) for p, n in toxic.items()}
    chosen: dict[str, None] = {}
    # The widest entries first: a word or longer beginning that one of them covers adds nothing.
    for p in sorted((p for p in rate if rate[p] >= odds), key=lambda p: (-toxic[p], len(p) if p.endswith("*") else 0, p)):
        if not any(p[:k] + "*" in chosen for k in range(1, len(p.removesuffix("*")) + 1)):
            chosen[p] = None
    model = ToxicityModel([p for p in chosen if not p.endswith("*")], [p[:-1] for p in chosen if p.endswith("*")])
    known = {w for w in LEXICON[INSULT]}
    model.words = [w for w in model.words if w not in known]
    rows = _featured(sample.select(F.col("label").cast("long").alias("id"), "text"), model).select("id", "x").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["id"] == 1) for r in rows])
    model.weights = _logistic(x, y, np.array(model.weights))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> list[float]:
    """Newton's method for the penalised likelihood; the constant is free."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def _featured(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = model.features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(x)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "score", "x"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, score double, x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, score (0 to 1) and x (FEATURES) of each whole text; only the text is read.

    A null or empty text scores as one without matches. Equal texts score alike; null and repeated ids are
    rows like any other; an empty table gives an empty one; other columns are not read.
    """
    return _featured(pick(docs, id=id_col, text=text_col), model)


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col="text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below threshold.

    A null or empty text scores as one without matches; repeated rows stay or go alike; an empty table gives
    an empty one; other columns are not read, whatever their names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                low = model.scores(model.features(part.column(at).to_pylist())) < threshold
                yield part.filter(pa.array(low, pa.bool_()))

    plain, _, back = numbered(docs)
    return back(plain.mapInArrow(lean(run), plain.schema))
