"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word w after a word v,

    P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),

with weights for each bucket b of the context's frequency (the logarithm of c(v)).  They are
learned by expectation-maximisation on held-out counts: each training token is scored with
the counts from which that very occurrence is deleted.  For this step alone the estimates are
rounded to STEP_SIZE steps for each doubling, so that a bounded table of them is gathered.

`score` rates training texts in the same way, each token with its own occurrence deleted from
the counts, so that training and held-out texts can be compared; `seen_score` leaves it in.
A text that the corpus holds twice keeps its other copy's counts and is told apart by that.

All counts are exact (but for collisions of 55-bit hashes) and over all training texts.  A
task cuts its texts into chunks of some CHUNK_BYTES bytes and asks for the totals of each
chunk's distinct words and word pairs (see `packed`), so no task or broadcast holds the
corpus's vocabulary.  Texts are read and cut into words once; what travels with a chunk is
its tokens as numbers of its distinct words, the most frequent first.

Cases: a null text counts as empty; every text ends with an end token, so an empty one has
one token.  A null doc_id is in no held-out fold.  With no training text the model is
uniform over nothing but the unknown word (scores of 0).  One row for each input row;
repeated rows count as often as they occur.  A very long text is a chunk of its own.  Columns
but doc_id and text are read by the held_out column only.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import packed
from tallyspark.llm.common import checkpoints, partitions
from tallyspark.llm.jaccard_join import Words

CHUNK_BYTES = 6_500_000
BUCKETS = 40
STEPS = 80
STEP_SIZE = 4  # cells for each doubling of a ratio of estimates

TABLE = "chunk long, told binary, words binary, pairs binary, n_keys long, n_counted long"
CELLS = "cell long, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, seen_score double"

_A = np.uint64(0xD6E8FEB86659FD93)
_EVEN = ~np.uint64(1)
_START = np.uint64(0x2AF7398005AAA5C7)
_END = packed.key_of(np.array([0x9D39247E33776D41], np.uint64)) & _EVEN
_WORDS = Words()


class Chunk:
    """Some texts as a stream of numbers of their distinct words, which are in order of their count, then of their key."""

    def __init__(self, ids: list, held: np.ndarray, sizes: np.ndarray, stream: np.ndarray, n_words: int) -> None:
        self.ids, self.held, self.sizes, self.stream, self.n_words = ids, held, sizes, stream, n_words
        starts = np.cumsum(sizes) - sizes
        self.before = np.empty_like(stream)
        self.before[1:] = stream[:-1]
        self.before[starts] = n_words  # no word: the start of a text
        self.codes, pair = np.unique(self.before.astype(np.int64) * (n_words + 1) + stream, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.own = np.repeat(~held, sizes)  # tokens to learn from

    @classmethod
    def of(cls, ids: list, held: list[bool], texts: list[bytes]) -> tuple[Chunk, np.ndarray]:
        """The chunk of texts already lower-cased, and the keys of its words."""
        tokens, sizes, at = np.empty(sum(len(t) // 2 + 2 for t in texts), np.uint64), [], 0
        for text in texts:
            words = text.split()
            tokens[at : at + len(words)] = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
            at += len(words) + 1
            sizes.append(len(words) + 1)
        size = np.array(sizes)
        tokens = packed.key_of(tokens[:at]) & _EVEN
        tokens[np.cumsum(size) - 1] = _END
        words, stream = np.unique(tokens, return_inverse=True)
        del tokens
        gone = np.array(held, dtype=bool)
        order = by_count(np.bincount(stream[np.repeat(~gone, size)], minlength=len(words)))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(ids, gone, size, rank[stream], len(words)), words[order]

    def pair_keys(self, words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            first = np.append(words, _START)[self.codes // (self.n_words + 1)] * _A
            return packed.key_of(first + words[self.codes % (self.n_words + 1)]) | ~_EVEN

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of words and of pairs in the texts to learn from."""
        return np.bincount(self.stream[self.own], minlength=self.n_words), np.bincount(self.pair[self.own], minlength=len(self.codes))

    def dumps(self) -> bytes:
        return packed.squeezed(pickle.dumps((self.ids, self.held, self.sizes.astype(np.int32), packed.planes(self.stream.astype(np.uint32)), self.n_words), 5))

    @classmethod
    def loads(cls, data: bytes) -> Chunk:
        ids, held, sizes, planes, n_words = pickle.loads(zlib.decompress(data))
        return cls(ids, held, sizes.astype(np.int64), packed.unplanes(planes, np.uint32).astype(np.int32), n_words)


def by_count(counts: np.ndarray) -> np.ndarray:
    """The order of words, given in the order of their keys, from the most frequent on."""
    return np.argsort(-counts, kind="stable")


def requests(number: int, chunk: Chunk, words: np.ndarray, buckets: int) -> pd.DataFrame:
    keys, counts = np.concatenate([words, chunk.pair_keys(words)]), np.concatenate(chunk.counts())
    order = np.argsort(keys)
    return packed.requests(number, keys[order], counts[order], buckets, chunk.dumps())


def gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk with the totals of its words and of its pairs, or a bucket's figures as they are."""
    number = int(rows["chunk"].iloc[0])
    if number < 0:
        return pd.DataFrame({"chunk": [number], "told": [None], "words": [None], "pairs": [None], "n_keys": rows["n_keys"].iloc[:1].tolist(), "n_counted": rows["n_counted"].iloc[:1].tolist()})
    (told,) = rows.loc[rows["told"].notna(), "told"]
    chunk = Chunk.loads(told)
    replies = rows[rows["keys"].notna()].sort_values("bucket")
    words = np.concatenate([packed.unpack(x) for x in replies["keys"]])
    if len(words) != chunk.n_words:
        raise ValueError("replies don't fit their requests")
    words = words[by_count(np.concatenate([packed.inflated(x) for x in replies["counts"]]))]
    order = np.argsort(np.concatenate([words, chunk.pair_keys(words)]))
    total = np.empty(len(order), dtype=np.int64)
    total[order] = packed.answered(replies, len(order))
    end = int(np.flatnonzero(words == _END)[0])
    seen = np.append(total[: len(words)], total[end])  # a start is as frequent as an end
    return pd.DataFrame({"chunk": [number], "told": [told], "words": [packed.deflated(seen)], "pairs": [packed.deflated(total[len(words) :])], "n_keys": [None], "n_counted": [None]})


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def estimates(w: np.ndarray, v: np.ndarray, vw: np.ndarray, n: int | np.ndarray, size: int) -> np.ndarray:
    """The three maximum-likelihood estimates of each token: uniform, word, pair."""
    out = np.stack([np.full(len(w), 1.0 / (size + 1)), w / np.maximum(1, n), vw / np.maximum(1, v)])
    out[2, v <= 0] = 0.0
    return out


NEVER = -1000  # the cell of an estimate of 0
_SIDE = 4096


def cells(estimate: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The cell of each token: its bucket, and both ratios to the uniform estimate as steps of their logarithm."""
    out = context
    for x in estimate[1:]:
        with np.errstate(divide="ignore"):
            step = np.where(x > 0, np.round(STEP_SIZE * np.log2(x / estimate[0])), NEVER)
        out = out * _SIDE + np.clip(step, NEVER, _SIDE // 2 - 1).astype(np.int64) + _SIDE // 2
    return out


def learn(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (BUCKETS, 3) that make the counted cells likely."""
    weights = np.tile(np.array([0.2, 0.6, 0.2]), (BUCKETS, 1))
    weights[0] = (0.25, 0.75, 0.0)
    if not len(cell):  # nothing to learn from
        return np.tile(np.array([1.0, 0.0, 0.0]), (BUCKETS, 1))
    b = cell // _SIDE // _SIDE
    p = [np.ones(len(cell))]
    for x in (cell // _SIDE % _SIDE - _SIDE // 2, cell % _SIDE - _SIDE // 2):
        p.append(np.where(x > NEVER, 2.0 ** (x / STEP_SIZE), 0.0))
    p, n = np.stack(p), n.astype(float)
    for _ in range(STEPS):
        part = weights[b].T * p
        part *= n / part.sum(0)
        sums = np.stack([np.bincount(b, weights=x, minlength=BUCKETS) for x in part], axis=1) + np.array([0.05, 0.5, 0.05])
        sums[0, 2] = 0.0  # an unseen context has no pair estimate
        weights = sums / sums.sum(1, keepdims=True)
    return weights


class Counted:
    """Texts in chunks with the totals that they need: what a corpus has been counted into."""

    def __init__(self, docs: DataFrame, held_out) -> None:
        spark = docs.sparkSession
        checkpoints(spark)
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = packed.buckets_for(size, partitions(spark))
        rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task = TaskContext.get().partitionId()
            ids, held, texts, size, closed = [], [], [], 0, 0

            def close() -> pd.DataFrame:
                chunk, words = Chunk.of(ids, held, texts)
                return requests(task << 32 | closed, chunk, words, buckets)

            for batch in batches:
                for doc_id, text, out in zip(batch["doc_id"], batch["text"], batch["held"], strict=True):
                    text = text.encode("utf-8", "surrogatepass").lower() if text else b""
                    if size + len(text) > CHUNK_BYTES and ids:
                        yield close()
                        ids, held, texts, size, closed = [], [], [], 0, closed + 1
                    ids.append(None if pd.isna(doc_id) else int(doc_id))
                    held.append(bool(out))
                    texts.append(text)
                    size += len(text) + 6
            if ids:
                yield close()

        replies = packed.totals(rows.mapInPandas(ask, packed.REQUESTS), keep="even")
        table = replies.groupBy("chunk").applyInPandas(gathered, TABLE).checkpoint()
        self.chunks = table.where("chunk >= 0").select("told", "words", "pairs")
        figures = table.where("chunk < 0").agg(F.sum("n_counted"), F.sum("n_keys")).first()
        self.n, self.size = (int(x or 0) for x in figures)

    def map(self, of, schema: str) -> DataFrame:
        """Frames of `of` (chunk, c(w), c(v), c(v w)) for each chunk."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for told, words, pairs in zip(batch["told"], batch["words"], batch["pairs"], strict=True):
                    chunk, seen = Chunk.loads(told), packed.inflated(words)
                    yield of(chunk, seen[chunk.stream], seen[chunk.before], packed.inflated(pairs)[chunk.pair])

        return self.chunks.mapInPandas(run, schema)

    def weights(self) -> np.ndarray:
        """The mixture weights that all training tokens teach, each with its own occurrence deleted."""
        n, size = self.n, self.size

        def delete(chunk: Chunk, w: np.ndarray, v: np.ndarray, vw: np.ndarray) -> pd.DataFrame:
            w, v, vw = (x[chunk.own] - 1 for x in (w, v, vw))
            cell, many = np.unique(cells(estimates(w, v, vw, n - 1, size), bucket(v)), return_counts=True)
            return pd.DataFrame({"cell": cell, "n": many})

        found = self.map(delete, CELLS).groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
        return learn(found["cell"].to_numpy(np.int64), found["n"].to_numpy())  # as many cells as buckets and steps at most

    def scores(self, weights: np.ndarray) -> DataFrame:
        n, size = self.n, self.size

        def rate(chunk: Chunk, w: np.ndarray, v: np.ndarray, vw: np.ndarray) -> pd.DataFrame:
            starts = np.cumsum(chunk.sizes) - chunk.sizes
            total = lambda x: np.add.reduceat(x, starts)
            likely = lambda own, w, v, vw: total(np.log10((weights[bucket(v)].T * estimates(w, v, vw, n - own, size)).sum(0)))
            gone = chunk.own.astype(np.int64)
            return pd.DataFrame(
                {
                    "doc_id": pd.array(chunk.ids, dtype="Int64"), "held_out": chunk.held, "n_tokens": chunk.sizes,
                    "n_known": total((w > 0).astype(np.int64)), "train_tokens": n,
                    "base_score": total(np.log10(w + 0.5)) - chunk.sizes * np.log10(n + 0.5 * (size + 1)),
                    "score": likely(gone, w - gone, v - gone, vw - gone), "seen_score": likely(0, w, v, vw),
                }
            )

        return self.map(rate, SCORES)


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of docs (doc_id, text); held_out: a column that is true for texts not to learn from."""
    counted = Counted(docs, held_out)
    return counted.scores(counted.weights())
