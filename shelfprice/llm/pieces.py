"""SentencePiece encoding and decoding by a batched numpy Viterbi, equal to the library's for BPE models.

Pieces hold the blank sign only at their front, so a text's words (blanks and what follows) are encoded
on their own. New words of a batch advance together by length: at each character the pieces that end
there are found by probing sorted keys with substring hashes, and the best is kept with a pointer back.

A BPE model's result is not the path of the largest score sum. But a segmentation is the one that merging
gives if and only if each two neighbours in it are what merging gives for the two joined, and each prefix
of a word has one such segmentation. So a step from one piece to the next counts only where the two agree
in that way, and the maximum runs over the steps left. Whether two pieces agree is found once per pair, by
merging their characters, and remembered. A unigram model needs no such test: all steps are left.

Long words are cut where no piece holds the two characters side by side: no piece can reach over such a
place, so what lies between two of them is encoded on its own, and texts without blanks advance together too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, pick
from .textual import mix

BLANK = "▁"
#: Words and pairs of pieces that a worker remembers; past that it forgets them all and begins again.
MEMO_WORDS, MEMO_PAIRS = 100_000, 200_000
#: Words of more characters are cut before they are encoded.
LONG_WORD = 32
_BASE = np.uint64(0x5851F42D4C957F2D)
_NONE = np.iinfo(np.int32).min
_loaded: dict[str, Pieces] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields (number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        field, wire = divmod(number(), 8)
        if wire == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}.get(wire) or number()
            yield field, data[at : at + size]
            at += size


def model_specs(path: str) -> tuple[int, dict[int, int | bytes]]:
    """A model file's type (1 unigram, 2 BPE) and its normaliser's fields: 2 rules, 3 blank put first, 4 extra blanks removed, 5 blanks escaped."""
    with open(path, "rb") as f:
        top = dict(_fields(f.read()))  # of repeated fields the last, which is not asked for here
    return dict(_fields(top.get(2, b""))).get(3, 1), dict(_fields(top.get(3, b"")))


class Pieces:
    """A vocabulary (pieces, scores) with its keys sorted for probing.

    merges: whether the model is BPE. bytes_at: the id of the piece for byte 0, or None for no byte fallback.
    """

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], *, merges: bool, unknown: int = 0, bytes_at: int | None = None):
        self.pieces, self.merges, self.unknown, self.bytes_at = pieces, merges, unknown, bytes_at
        self.scores = np.array(scores)
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces with a blank sign after other characters need whole texts")
        self.floor = float(min((scores[i] for i in self.ids.values()), default=0.0)) - 10.0
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sieve = np.zeros(1 << 20, bool)
        for n in sorted({len(p) for p in self.ids}):
            same = [p for p in self.ids if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p in same], np.uint64)
            key = self._windows(codes, n)[:, 0]
            order = np.argsort(key)
            self.keys[n] = key[order], np.array([self.ids[p] for p in same], np.int32)[order]
            self.sieve[key >> np.uint64(44)] = True
        self.pairs = np.unique(np.array([ord(a) << 32 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)] or [0], np.uint64))
        self.agreed: dict[int, bool] = {}
        self.slots = np.full(1 << 20, -1, np.int64)
        self.slot_ok = np.zeros(1 << 20, bool)
        self.memo: dict[str, bytes] = {}
        self.as_bytes = [p.replace(BLANK, " ").encode() for p in pieces]
        if bytes_at is not None:
            self.as_bytes[bytes_at : bytes_at + 256] = [bytes([b]) for b in range(256)]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The vocabulary of a model file, read once per worker; a model that changes texts before it encodes them is an error."""
        if path not in _loaded:
            import sentencepiece

            kind, rules = model_specs(path)
            if kind not in (1, 2) or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
                raise ValueError("only unigram and BPE models are known, with a blank put first and texts taken as they are")
            m = sentencepiece.SentencePieceProcessor(model_file=path)
            size = m.vocab_size()
            normal = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(size)]
            byte = next((i for i in range(size) if m.is_byte(i)), None)
            scores = [m.get_score(i) for i in range(size)]
            _loaded[path] = cls([m.id_to_piece(i) for i in range(size)], scores, normal, merges=kind == 2, unknown=m.unk_id(), bytes_at=byte)
        return _loaded[path]

    @staticmethod
    def _windows(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all substrings of n characters: words x starts."""
        width = codes.shape[1] - n + 1
        h = np.zeros((codes.shape[0], width), np.uint64)
        for k in range(n):
            h = h * _BASE + codes[:, k : k + width] + np.uint64(1)
        return mix(h + np.uint64(n))

    def _probe(self, codes: np.ndarray, n: int) -> np.ndarray:
        """The id of each substring of n characters, or _NONE; a single unknown character is minus its code, less one."""
        key = self._windows(codes, n)
        out = np.full(key.shape, _NONE, np.int32)
        near = self.sieve[key >> np.uint64(44)]
        keys, ids = self.keys.get(n, (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
        if len(keys) and near.any():
            some = key[near]
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            out[near] = np.where(keys[at] == some, ids[at], _NONE)
        return np.where(out == _NONE, -codes.astype(np.int32) - 1, out) if n == 1 else out

    def _text(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-token - 1)

    def merged(self, text: str) -> list[str]:
        """The text's characters merged, the best-scored neighbours first and the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether merging gives each two neighbours; before _NONE: whether it gives the token by itself."""
        key = ((before.astype(np.int64) + (1 << 31)) << 32) | (token.astype(np.int64) + (1 << 31))
        slot = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        lost = np.flatnonzero(self.slots[slot] != key)
        if len(self.agreed) > MEMO_PAIRS:
            self.agreed.clear()
        for k in np.unique(key[lost]).tolist():
            ok = self.agreed.get(k)
            if ok is None:
                a, b = ((k >> 32) & 0xFFFFFFFF) - (1 << 31), (k & 0xFFFFFFFF) - (1 << 31)
                pair = ([] if a == _NONE else [self._text(a)]) + [self._text(b)]
                ok = self.agreed[k] = self.merged("".join(pair)) == pair
        out = self.slot_ok[slot]
        if len(lost):
            out[lost] = [self.agreed[k] for k in key[lost].tolist()]
            self.slots[slot[lost]], self.slot_ok[slot[lost]] = key[lost], out[lost]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Little-endian int32 ids of words of one length."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        lengths = [k for k in sorted({1, *self.keys}, reverse=True) if k <= n]
        found = {k: np.ascontiguousarray(self._probe(codes, k).T) for k in lengths}
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        last = np.full((n + 1, m), _NONE, np.int32)
        back = np.zeros((n + 1, m), np.int32)
        for end in range(1, n + 1):
            open_rows = np.ones(m, bool)
            for k in lengths:
                if k > end:
                    continue
                token = found[k][end - k]
                rows = np.flatnonzero((token != _NONE) & open_rows)
                if not len(rows):
                    continue
                token = token[rows]
                if self.merges:
                    ok = self.agree(last[end - k][rows], token)
                    rows, token = rows[ok], token[ok]
                    open_rows[rows] = False  # no other step agrees
                score = best[end - k][rows] + np.where(token >= 0, self.scores[np.maximum(token, 0)], self.floor)
                up = score > best[end][rows]
                rows, token = rows[up], token[up]
                best[end, rows], last[end, rows], back[end, rows] = score[up], token, k
        path = np.zeros((m, n), np.int32)
        first, at, rows = np.full(m, n), np.full(m, n), np.arange(m)
        while len(rows):
            where = at[rows]
            first[rows] -= 1
            path[rows, first[rows]] = last[where, rows]
            at[rows] = where - back[where, rows]
            rows = rows[at[rows] > 0]
        known = (path >= 0).all(axis=1)
        ends = first.tolist()
        return [path[r, ends[r] :].tobytes() if k else self._spelled(path[r, ends[r] :].tolist()) for r, k in enumerate(known.tolist())]

    def _spelled(self, tokens: list[int]) -> bytes:
        """Unknown characters (minus their code, less one) become the pieces of their bytes, or the unknown piece."""
        spell = lambda t: [self.unknown] if self.bytes_at is None else [self.bytes_at + b for b in chr(-t - 1).encode("utf-8", "surrogatepass")]
        return np.array(list(chain.from_iterable([t] if t >= 0 else spell(t) for t in tokens)), np.int32).tobytes()

    def cut(self, word: str) -> list[str]:
        """The word in parts that no piece reaches over."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        key = codes[:-1] << np.uint64(32) | codes[1:]
        free = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] != key
        at = [0, *(np.flatnonzero(free) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Encode words not met before, those of one length together, at most 4096 at once."""
        new = words - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = words
        for n, same in groupby(sorted(new, key=len), key=len):
            same, step = list(same), max(1, min(4096, 200_000 // n))
            for i in range(0, len(same), step):
                self.memo.update(zip(same[i : i + step], self.viterbi(same[i : i + step]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text; a blank is put before the first word; an empty text has none."""
        words = [(BLANK + t.replace(" ", BLANK)).split(BLANK)[1:] if t else [] for t in texts]
        words = [[x for w in _with_blanks(ws) for x in (self.cut(w) if len(w) > LONG_WORD else (w,))] for ws in words]
        self.learn({w for ws in words for w in ws})
        memo = self.memo
        return [b"".join([memo[w] for w in ws]) for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank before the first word is dropped."""
        as_bytes = self.as_bytes
        text = b"".join([as_bytes[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _with_blanks(parts: list[str]) -> list[str]:
    """What stood between blanks as words that begin with all blanks before them."""
    if "" not in parts:
        return [BLANK + p for p in parts]
    out, blanks = [], 0
    for p in parts:
        blanks += 1
        if p:
            out.append(BLANK * blanks + p)
            blanks = 0
    if blanks:
        out.append(BLANK * blanks)
    return out


def _encoded(part: pa.RecordBatch, model: Pieces) -> tuple[list[np.ndarray], list[pa.Array]]:
    """The ids of each text, and the columns id, n_bytes, ids."""
    texts = [t or "" for t in part.column("text").to_pylist()]
    ids = [np.frombuffer(x, np.int32) for x in model.encode(texts)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
    return ids, [part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), lists]


def _decoded(ids: list[np.ndarray], model: Pieces) -> list[pa.Array]:
    """The columns n_tokens, ids_sha256, text, text_sha256."""
    texts = [model.decode(x) for x in ids]
    return [
        pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
        pa.array(texts, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
    ]


_ENCODED, _DECODED = ["id", "n_bytes", "ids"], ["n_tokens", "ids_sha256", "text", "text_sha256"]
_DECODED_DDL = "n_tokens long, ids_sha256 string, text string, text_sha256 string"


def _in_parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_pieces(docs: DataFrame, model_path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes, ids (array<int>) of each whole text (null: empty, no ids).

    model_path: the model's file on each executor. Null and repeated ids are rows like any other; other
    columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(model_path)
        for part in _in_parts(batches):
            yield pa.RecordBatch.from_arrays(_encoded(part, model)[1], _ENCODED)

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """encode_pieces' rows with their number, the digest of the ids, the text decoded from them and its digest.

    No ids give an empty text; null and repeated ids of documents are rows like any other; an empty table
    gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(model_path)
        for part in _in_parts(batches):
            ids = [np.asarray(x.values, np.int32) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([*part.columns, *_decoded(ids, model)], [*_ENCODED, *_DECODED])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select(*_ENCODED).mapInArrow(lean(run), f"id {kind}, n_bytes long, ids array<int>, {_DECODED_DDL}")


def round_trip(docs: DataFrame, model_path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """decode_pieces of encode_pieces in one pass, so that each task has one worker and one vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(model_path)
        for part in _in_parts(batches):
            ids, columns = _encoded(part, model)
            yield pa.RecordBatch.from_arrays([*columns, *_decoded(ids, model)], [*_ENCODED, *_DECODED])

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, ids array<int>, {_DECODED_DDL}")
