"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A segmentation is the BPE encoding exactly when every adjacent pair of its tokens, merged
again from single characters, comes back as that pair.  The encoder therefore walks the
text with the longest vocabulary match at each position (Aho-Corasick), keeps a token if
it and its left neighbour re-merge to themselves, falls back to the next shorter match,
and marks positions from which no continuation exists in a bitfield.

Texts are first cut where no vocabulary piece can span; pieces of text that recur are
encoded, and their ids decoded, once per Python worker and kept in a bounded cache.

Only BPE models with byte fallback, identity normalisation and a leading space are read;
others are refused.

Cases: a null text counts as empty; an empty text has no ids and decodes to ''; characters
outside the vocabulary become byte pieces.  Each input row gives one output row, so ties
and repeated rows need no rule.  The model file is read on the driver and its bytes are
sent to the executors (their size is checked), so executors need no local copy.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import hand_back

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MAX_MODEL_BYTES = 64 << 20
CACHED_CHUNKS = 150_000
KNOWN_PAIRS = 500_000
LONGEST_CACHED = 64
SHORT = 48
NEVER = float("-inf")
OUTSIDE, PAIR = 1 << 24, 26

ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unsupported wire type {kind} in the model file")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """A BPE model read from the bytes of its file."""

    def __init__(self, data: bytes) -> None:
        import struct

        import ahocorasick

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        normalizer: dict[int, bytes | int] = {}
        trainer: dict[int, bytes | int] = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in self.kinds:
            raise ValueError("only models of normal pieces with byte fallback are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only identity normalisation with a leading space is supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}

        # a token is its id, or OUTSIDE + code point for a single character without an id
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.pieces)
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
            for end in range(len(piece) - 1, 0, -1):
                if end == 1 or piece[:end] in self.ids:
                    self.shorter[i] = self.token(piece[:end])
                    break
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        alone = not any("\n" in p for p in self.ids if len(p) > 1)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        if inner or not alone:  # no safe cut is known: whole texts are single chunks
            self.cut = re.compile(r"(?s).+")
        else:
            self.cut = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.fast = not inner and alone
        self.fits_memo: dict[int, bool] = {}
        self.written = [str(i) for i in range(len(self.pieces))]
        #: What a piece is decoded to; a byte's meaning depends on its neighbours.
        shown = {NORMAL: lambda p: p.replace(SPACE, " "), UNKNOWN: lambda p: " ⁇ ", CONTROL: lambda p: "", BYTE: lambda p: None}
        self.shown = [shown[k](p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.after_space, self.bare = Encoded(self, SPACE), Encoded(self, "")

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the best adjacent merge first, the leftmost of equals."""
        if len(text) <= SHORT:
            short, score = list(text), self.scores.get
            ranks = [score(a + b, NEVER) for a, b in zip(short, short[1:])]
            while ranks and (best := max(ranks)) != NEVER:
                i = ranks.index(best)
                short[i : i + 2] = [short[i] + short[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = score(short[i - 1] + short[i], NEVER)
                if i < len(ranks):
                    ranks[i] = score(short[i] + short[i + 1], NEVER)
            return short
        parts: list[str | None] = list(text)
        right = list(range(1, len(parts) + 1))
        left = list(range(-1, len(parts) - 1))
        heap = [(-self.scores[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else len(parts)
            if j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < len(parts) and (pair := parts[x] + parts[y]) in self.scores:
                    heapq.heappush(heap, (-self.scores[pair], x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def token(self, text: str) -> int:
        return self.ids[text] if text in self.ids else OUTSIDE + ord(text)

    def text(self, token: int) -> str:
        return self.pieces[token] if token < OUTSIDE else chr(token - OUTSIDE)

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a (-1: none) and b, merged again from characters, stay these two."""
        if len(self.fits_memo) > KNOWN_PAIRS:
            self.fits_memo.clear()
        pair = [self.text(b)] if a < 0 else [self.text(a), self.text(b)]
        known = self.fits_memo[a << PAIR | b] = self.merged("".join(pair)) == pair
        return known

    def tokens(self, text: str) -> list[int]:
        """The encoding of one chunk."""
        size = len(text)
        lengths = [0] * size
        longest = [-1] * size
        for end, (n, token) in self.automaton.iter(text):
            start = end - n + 1
            if n > lengths[start]:
                lengths[start], longest[start] = n, token
        if -1 in longest:
            longest = [self.token(text[i]) if t < 0 else t for i, t in enumerate(longest)]
        known, shorter, sizes = self.fits_memo.get, self.shorter, self.sizes
        dead = 0  # bit i: no encoding passes through position i
        out: list[int] = []
        at, before, trial = 0, -1, longest[0]
        while True:
            while trial >= 0:
                n = sizes[trial] if trial < OUTSIDE else 1
                if not (dead and dead >> (at + n) & 1):
                    fit = known(before << PAIR | trial)
                    if fit or (fit is None and self.fits(before, trial)):
                        break
                trial = shorter[trial] if trial < OUTSIDE else -1
            if trial >= 0:
                out.append(trial)
                at += n
                if at == size:
                    return out
                before, trial = trial, longest[at]
            else:
                if not out:
                    raise AssertionError(f"no encoding of {text!r}")
                dead |= 1 << at
                last = out.pop()
                at -= sizes[last] if last < OUTSIDE else 1
                before, trial = out[-1] if out else -1, shorter[last] if last < OUTSIDE else -1

    def forget(self) -> None:
        """Lets the kept chunks go at the end of a task: the worker lives on for other stages."""
        for kept in (self.after_space, self.bare):
            kept.clear()
            kept.old = {}

    def token_ids(self, token: int) -> list[int]:
        if token < OUTSIDE:
            return [token]
        return [self.bytes[b] for b in chr(token - OUTSIDE).encode("utf-8", "surrogatepass")]

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without begin or end ids."""
        return [i for c in self.chunks(text or "") for t in self.tokens(c) for i in self.token_ids(t)]

    def raw(self, ids: list[int]) -> str:
        """The text of ids with its leading space still there."""
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out = bytearray()
        for i, text in zip(ids, shown, strict=True):
            if text is None:
                out.append(int(self.pieces[i][1:-1], 16))
            else:
                out += text.encode("utf-8", "surrogatepass")
        return out.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).removeprefix(" ")

    def both(self, text: str) -> tuple[str, str]:
        """The ids of a text in decimal, joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        spaced = "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "
        # no byte run or piece reaches beyond a chunk, so the parts' decoded texts make up that of all ids
        if self.fast and not spaced and SPACE not in text:
            first, *lines = text.split("\n")
            after, bare, (end_ids, end_text) = self.after_space, self.bare, self.bare["\n"]
            if first:
                found = [after[w] for w in first.split(" ")]
                ids, shown = [i for i, _ in found], [" ".join([t for _, t in found])]
            else:
                (only, only_text) = bare[SPACE]
                ids, shown = [only], [only_text.removeprefix(" ")]
            for line in lines:
                ids.append(end_ids)
                if line:
                    word, *words = line.split(" ")
                    found = [bare[word], *map(after.__getitem__, words)]
                    ids += [i for i, _ in found]
                    shown.append(" ".join([t for _, t in found]))
                else:
                    shown.append("")
            joined, decoded = ",".join(ids), end_text.join(shown)
        else:
            found = [self.bare[c] for c in self.chunks(text)]
            joined, decoded = ",".join([ids for ids, _ in found]), "".join([raw for _, raw in found]).removeprefix(" ")
        for kept in (self.after_space, self.bare):
            kept.age()
        return joined, decoded


class Encoded(dict):
    """Chunk (without its prefix) to its ids in decimal, joined by commas, and the text that these ids decode to (without the prefix's); old chunks are let go."""

    def __init__(self, model: Model, prefix: str) -> None:
        self.model, self.prefix, self.shown = model, prefix, prefix.replace(SPACE, " ")
        self.old: dict[str, tuple[str, str]] = {}

    def __missing__(self, word: str) -> tuple[str, str]:
        out = self.old.get(word)
        if out is None:
            model = self.model
            ids = [i for t in model.tokens(self.prefix + word) for i in ((t,) if t < OUTSIDE else model.token_ids(t))]
            shown = model.raw(ids)
            if not shown.startswith(self.shown):
                raise AssertionError(f"no prefix in {shown!r}")
            shown = shown[len(self.shown) :]
            out = ",".join([model.written[i] for i in ids]), word if shown == word else shown  # one text for both
        if len(word) <= LONGEST_CACHED:
            self[word] = out
        return out

    def age(self) -> None:
        """Starts a new generation when this one is full; words of the last one move over when met."""
        if len(self) > CACHED_CHUNKS:
            self.old = dict(self)
            self.clear()


_MODELS: dict[str, Model] = {}


def loaded(data: bytes) -> Model:
    """The model of these bytes, built once per Python process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(data)
    return _MODELS[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"the model file is larger than {MAX_MODEL_BYTES} bytes")
    return data


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array column of ids added (the general interface)."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(sent.value)
        for batch in texts:
            yield batch.map(model.encode, na_action=None)

    return docs.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of an array column of ids added."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(sent.value)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else model.decode(list(x)), na_action=None)

    return docs.withColumn(out, texts(F.col(ids)))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids and of the decoded text, one row per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(sent.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                joined, decoded = model.both(text or "")
                rows.append(
                    (
                        joined.count(",") + 1 if joined else 0,
                        hashlib.sha256(joined.encode()).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
                    )
                )
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out
        model.forget()
        hand_back()

    return docs.select("doc_id", "text").mapInPandas(run, ENCODED_SCHEMA)
