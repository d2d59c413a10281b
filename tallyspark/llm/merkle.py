"""Document fingerprints: a Merkle tree over sections and paragraphs, down to runs of words.

A text is a list of sections (ended by an empty line), a section a list of paragraphs (ended
by a line break), a paragraph a list of runs, a run a list of words with the white space
after them, a word a list of pieces of PIECE characters.  A run ends where a word's hash says
so, about every RUN words, or after LONGEST_RUN words, so an edit changes the runs about it
and no others.  Every node's
hash covers those of its children, so equal roots mean equal texts, and the branches that
differ locate an edit.

A fingerprint is a text: the root's hash, and after a colon the tree: of each level the
hashes (4 bytes each), how many children each node has, and how many characters each leaf.
It goes down to the runs; of texts with at most SMALL words also to these, and with at most
SMALL pieces also to those, for a short text has few runs.  All that follows is worked out
from two fingerprints, without the texts:

* likeness: from the roots down, branches of equal hash are alike; the children of the others
  are matched in turn.  Twice the characters of the matched branches over the characters of
  both texts (0 to 1);
* differing: the (section, paragraph) of the branches that found no match;
* first_difference: the character at which the first leaf without a match begins.

Hashes of nodes have 64 bits while trees are built and 32 in a fingerprint (the root: 128).

Cases: a null text counts as empty; two empty texts are alike (1).  One output row for
each input row.  The next document of `with_edits` is by descending doc_id (equal ids: by
descending hash of the text; null ids: last); after the last comes the first, so a single
document is its own next one.  Columns but doc_id and text are not read; `fingerprints` keeps
them, and replaces one that has the output column's name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 6
LONGEST_RUN = 24
SMALL = 128
PIECE = 3
KNOWN_WORDS = 300_000

EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "differing_paragraphs long, first_difference long"
)

_TOKEN = re.compile(r"\S+\s*|\s+")
_EMPTY_LINE = re.compile(r"\n[^\S\n]*\n")
_PARAGRAPH, _SECTION = np.uint64(1), np.uint64(2)  # low bits of a word's hash: what ends with it
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class _Words(dict):
    """Word to its hash, whose two low bits say whether a paragraph or a section ends with it."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        out = xxhash.xxh3_64_intdigest(_bytes(word)) & ~3
        if "\n" in word:
            out |= 3 if _EMPTY_LINE.search(word) else 1
        if len(word) <= 32:
            self[word] = out
        return out


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _places(ends: np.ndarray) -> np.ndarray:
    """Of consecutive nodes, the place among its siblings; ends: where the parents end."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.arange(ends[-1]) - np.repeat(starts, ends - starts)


def _parents(hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parents of consecutive nodes, and how many children each has; last: where a parent ends."""
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    size, place = ends - starts, _places(ends)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_mixed(hashes + (place.astype(np.uint64) + np.uint64(1)) * _STEP), starts)
        return _mixed(sums + size.astype(np.uint64)), size


class Tree:
    """Levels from the sections down: `hashes` (32 bits), `children` of all levels but the last, `sizes` of the leaves."""

    __slots__ = ("children", "hashes", "length", "root", "sizes", "words")

    def __init__(self, text: str | None, like: Tree | None = None, upto: int = 0) -> None:
        """like: the tree of a text with the same first `upto` characters, whose words there need not be hashed again."""
        self.hashes, self.children, self.sizes = [], [], np.zeros(0, np.int64)
        text = text or ""
        self.length = len(text)
        known = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if like is not None and like.words is not None:
            ends = np.cumsum(like.words[1])
            same = int(np.searchsorted(ends, upto))  # the word that reaches upto may go on otherwise
            known = like.words[0][:same], like.words[1][:same]
        tokens = _TOKEN.findall(text, int(known[1].sum()))
        n = len(known[0]) + len(tokens)
        self.words = None
        if not n:
            self.root = hashlib.blake2b(b"", digest_size=16).hexdigest()
            return
        words = np.concatenate([known[0], np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))])
        sizes = np.concatenate([known[1], np.fromiter(map(len, tokens), np.int64, len(tokens))])
        self.words = words, sizes
        paragraph, section = (words & _PARAGRAPH) != 0, (words & _SECTION) != 0
        run = paragraph | (_mixed(words) % np.uint64(RUN) == 0)
        run[-1] = paragraph[-1] = section[-1] = True
        run |= _places(np.flatnonzero(run) + 1) % LONGEST_RUN == LONGEST_RUN - 1
        runs, run_words = _parents(words, run)
        paragraphs, paragraph_runs = _parents(runs, paragraph[run])
        sections, section_paragraphs = _parents(paragraphs, section[paragraph])
        self.root = hashlib.blake2b(sections.tobytes() + struct.pack("<q", self.length), digest_size=16).hexdigest()
        levels, children = [sections, paragraphs, runs], [section_paragraphs, paragraph_runs]
        leaves = np.add.reduceat(sizes, np.concatenate([[0], np.flatnonzero(run)[:-1] + 1]))
        if n <= SMALL:
            tokens = _TOKEN.findall(text)
            levels.append(words)
            children.append(run_words)
            leaves = sizes
            parts = [token[i : i + PIECE] for token in tokens for i in range(0, len(token), PIECE)]
            if len(parts) <= SMALL:
                levels.append(np.fromiter((zlib.crc32(_bytes(p)) for p in parts), np.uint64, len(parts)))
                children.append(-(-sizes // PIECE))
                leaves = np.fromiter(map(len, parts), np.int64, len(parts))
        self.hashes = [(x >> np.uint64(32)).astype(np.uint32) for x in levels[:3]] + [(_mixed(x) >> np.uint64(32)).astype(np.uint32) for x in levels[3:]]
        self.children, self.sizes = children, leaves

    def dumps(self) -> str:
        if not self.hashes:
            return f"{self.root}:"
        numbers = np.concatenate([*self.children, self.sizes]).astype(np.uint32).tobytes()
        head = struct.pack("<B", len(self.hashes)) + np.array([len(x) for x in self.hashes], np.uint32).tobytes()
        return f"{self.root}:{base64.b64encode(head + b''.join(x.tobytes() for x in self.hashes) + zlib.compress(numbers, 1)).decode()}"

    @classmethod
    def loads(cls, fingerprint: str) -> Tree:
        out = cls.__new__(cls)
        out.root, _, body = fingerprint.partition(":")
        out.hashes, out.children, out.sizes, out.words = [], [], np.zeros(0, np.int64), None
        data = base64.b64decode(body)
        if data:
            counts, at = np.frombuffer(data, np.uint32, data[0], 1).tolist(), 1 + 4 * data[0]
            for n in counts:
                out.hashes.append(np.frombuffer(data[at : at + 4 * n], np.uint32))
                at += 4 * n
            numbers = np.frombuffer(zlib.decompress(data[at:]), np.uint32).astype(np.int64)
            *out.children, out.sizes = np.split(numbers, np.cumsum(counts))[: len(counts)] if len(counts) else []
        out.length = int(out.sizes.sum())
        return out

    def spans(self, depth: int) -> list[np.ndarray]:
        """Characters of the nodes of each level down to depth."""
        sizes = self.sizes
        out = [sizes]
        for children in reversed(self.children):
            sizes = np.add.reduceat(sizes, np.cumsum(children) - children)
            out.append(sizes)
        return out[::-1][:depth]


class Match:
    """What two trees have in common.  alike: characters in branches of equal hash; rest: of each level of a, the nodes that found no equal one under b's differing branches."""

    def __init__(self, a: Tree, b: Tree) -> None:
        self.a = a
        self.same = a.root == b.root
        depth = min(len(a.hashes), len(b.hashes))
        self.spans = [x.tolist() for x in a.spans(depth)]
        self.alike, self.rest = (a.length, [[] for _ in range(depth)]) if self.same else (0, [])
        if self.same or not depth:
            return
        x, y = range(len(a.hashes[0])), range(len(b.hashes[0]))
        for level in range(depth):
            if level:
                x, y = (_below(t.children[level - 1], nodes) for t, nodes in ((a, x), (b, y)))
            left, right = a.hashes[level].tolist(), b.hashes[level].tolist()
            span, offered, wanted = self.spans[level], Counter([right[n] for n in y]), Counter([left[n] for n in x])
            rest = []
            for n in x:
                h = left[n]
                if offered.get(h, 0) > 0:
                    offered[h] -= 1
                    self.alike += span[n]
                else:
                    rest.append(n)
            other = []
            for n in y:
                h = right[n]
                if wanted.get(h, 0) > 0:
                    wanted[h] -= 1
                else:
                    other.append(n)
            x, y = rest, other
            self.rest.append(rest)

    def likeness(self, length: int) -> float:
        return 1.0 if self.same else min(1.0, 2.0 * self.alike / max(1, self.a.length + length))

    def paragraphs(self) -> list[int]:
        """Paragraphs of a without a match, numbered through the text."""
        return self.rest[1] if self.rest else list(range(len(self.a.hashes[1]))) if self.a.hashes else []

    def first_difference(self) -> int | None:
        if not self.rest:
            return 0 if self.a.hashes else None
        return sum(self.spans[-1][: self.rest[-1][0]]) if self.rest[-1] else None


def _below(children: np.ndarray, nodes: Iterable[int]) -> list[int]:
    """The children of some nodes of a level."""
    ends = np.cumsum(children).tolist()
    return [n for node in nodes for n in range(ends[node - 1] if node else 0, ends[node])]


def _tree(fingerprint: str | Tree) -> Tree:
    return fingerprint if isinstance(fingerprint, Tree) else Tree.loads(fingerprint)


def likeness(a: str | Tree, b: str | Tree) -> float:
    """How much of two fingerprinted texts is alike: 1 for equal roots."""
    a, b = _tree(a), _tree(b)
    return Match(a, b).likeness(b.length)


def differing(a: str | Tree, b: str | Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of a's paragraphs that have no equal in b's differing branches: where an edit is."""
    a = _tree(a)
    if not a.hashes:
        return []
    starts = np.cumsum(a.children[0]) - a.children[0]
    found = np.array(Match(a, _tree(b)).paragraphs(), dtype=np.int64)
    section = np.searchsorted(starts, found, side="right") - 1
    return [(int(s), int(p - starts[s])) for s, p in zip(section, found, strict=True)]


def first_difference(a: str | Tree, b: str | Tree) -> int | None:
    """The character of a at which the first leaf without a match begins; None if there is none."""
    return Match(_tree(a), _tree(b)).first_difference()


def fingerprint(text: str | None) -> str:
    return Tree(text).dumps()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with each text's fingerprint (the general interface)."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(fingerprint, na_action=None)

    return docs.withColumn(out, run(F.col(text)))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class Ranges:
    """Ranges of rows in order of (doc_id, hash of the text), nulls first, about `tasks` of them with as many rows each.

    An id with many rows is cut by the hash into several ranges; only rows equal in both stay together.
    """

    def __init__(self, docs: DataFrame, tasks: int) -> None:
        shares = [k / tasks for k in range(1, tasks + 1)]
        ends, n, n_ids = docs.agg(F.percentile_approx("doc_id", shares, 100 * tasks), F.count("*"), F.count("doc_id")).first()
        self.nulls = -(-tasks * (n - n_ids) // n) if n > n_ids else 0
        self.ids, self.parts = np.unique(np.array(ends or [0], dtype=np.int64), return_counts=True)
        self.first = self.nulls + np.cumsum(self.parts) - self.parts
        self.count = int(self.nulls + self.parts.sum())

    def of(self) -> Column:
        """The range of a row with doc_id and h (a hash)."""

        @F.pandas_udf("int")
        def run(ids: pd.Series, h: pd.Series) -> pd.Series:
            share = h.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5
            null = ids.isna().to_numpy()
            value = ids.fillna(0).astype("int64").to_numpy()
            at = np.minimum(np.searchsorted(self.ids, value), len(self.ids) - 1)
            cut = np.where(value == self.ids[at], np.minimum((share * self.parts[at]).astype(np.int64), self.parts[at] - 1), 0)
            cut = np.where(value > self.ids[at], self.parts[at] - 1, cut)  # above an approximate end: with the last
            return pd.Series(np.where(null, np.minimum(share * self.nulls, max(0, self.nulls - 1)).astype(np.int64), self.first[at] + cut)).astype("int32")

        return run(F.col("doc_id"), F.col("h"))


def with_edits(docs: DataFrame, tasks: int) -> DataFrame:
    """Fingerprint, edited text's fingerprint and likenesses of each document of (doc_id, text).

    Documents are dealt out in ranges of the order, one partition each.  The document after a
    range's last one is the first of the range below: only these few rows are sent twice.
    Each task reads its range as a stream.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumn("h", F.xxhash64("text"))
    ranges = Ranges(docs, tasks)
    rows = rows.withColumn("r", ranges.of())
    order = [F.desc_nulls_last("doc_id"), F.desc("h")]
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h"))
    tops = rows.groupBy("r").agg(first.alias("top")).select("r", "top.doc_id", "top.h").collect()  # one row a range
    tops.sort(key=lambda x: x["r"])
    sent = [(x["doc_id"], x["h"], tops[(k + 1) % len(tops)]["r"]) for k, x in enumerate(tops)]
    again = rows.sparkSession.createDataFrame(sent, "id long, hash long, to int")
    again = rows.join(F.broadcast(again), (F.col("h") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    again = again.select("doc_id", "text", "h", F.col("to").alias("r"), F.lit(1).alias("after"))
    both = rows.select("doc_id", "text", "h", "r", F.lit(0).alias("after")).unionByName(again)
    dealt = both.repartitionById(max(1, ranges.count), F.col("r")).sortWithinPartitions("r", "after", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = held = first = None  # range; its row that waits for the next one; its first row
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, r, after in zip(batch["doc_id"], batch["text"], batch["r"], batch["after"], strict=True):
                if r != at:
                    if held is not None:
                        out.append(_row(held, first))
                    at, held, first = r, None, None
                elif after and held is None:
                    continue  # a repeat of the row after the range
                now = (doc_id, text, Tree(text))
                if held is not None:
                    out.append(_row(held, now))
                held = None if after else now
                first = first or now
            if out:
                yield _frame(out)
        if held is not None:
            yield _frame([_row(held, first)])

    return dealt.mapInPandas(run, EDITS)


def _row(own: tuple, following: tuple) -> tuple:
    """A row of the result.  A tree and the one that its fingerprint is read back to are the same."""
    doc_id, text, tree = own
    new = edited(text, following[1])
    changed = tree if new == text else Tree(new, tree, len(text) - len(text) // 3)
    match = Match(tree, changed)
    return (
        None if pd.isna(doc_id) else int(doc_id), len(text), hashlib.sha256(_bytes(new)).hexdigest(), tree.dumps(), changed.dumps(),
        match.likeness(changed.length), likeness(tree, following[2]), len(match.paragraphs()), match.first_difference(),
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(
        rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "differing_paragraphs", "first_difference"]
    )
    return out.astype({"doc_id": "Int64", "first_difference": "Int64"})
