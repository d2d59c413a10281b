"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

A text's set has the hashes of its distinct runs of N words (fewer words: the whole sequence
as one); words part at ASCII white space, A-Z lower-cased.  Texts of equal sets are one class.

Two sets can only be similar if they share a token among the first n - ceil(t n) + 1 of each
(the prefix) under ANY global order of the tokens.  The join uses several:

1. An order that puts tokens of a single class first.  A set whose prefix is all such tokens
   is similar to none; this needs only the number of those tokens in each set, which packed
   hashes tell (each chunk sends a token once).  It is done twice, the second time among the
   survivors' classes only.  Few sets are left.
2. For those, three orders: by how many sets hold a token, by the logarithm of this number
   and a hash, and by a coarser logarithm and another hash.  Sets that share prefix tokens
   under the first order, transitively, are a cluster; clusters are dealt out in units of
   about UNIT_TOKENS tokens, a larger cluster as all pairs of its blocks.  In a unit, pairs
   whose prefixes meet under all three orders are verified on the whole sets.  Units return how
   many documents each class is linked with, and links enough to connect all that are similar,
   but not all pairs.

Components of these links, with the classes' rows and each document's number of links (the
other documents of its class and those of all similar classes), are the result.  A caller that
needs components alone can leave the numbers out: then pairs already connected in a unit are
not verified.

Cases: null or empty texts have empty sets and are linked with nothing.  Repeated rows are
rows of one class.  component_id is the least non-null doc_id; null only if all are null.
Empty tables give empty results.  Columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import packed
from tallyspark.llm.common import among, checkpoints, hand_back, partitions
from tallyspark.llm.graph import components

N = 5
SIMILARITY = 80  # per cent
CHUNK_TOKENS = 1_000_000
CHUNK_DOCS = 2_000
UNIT_TOKENS = 1_000_000
BROADCAST_ROWS = 50_000
FILTER_BITS = 1 << 23
KNOWN_WORDS = 200_000
SHARED = 0xFFFF

_A = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out ^= out >> np.uint64(29)
            out = out * _A + h[k : len(h) - size + 1 + k]
        if len(h) < n:  # a short sequence is no n-gram of a longer one
            out += np.uint64(len(h))
    return np.unique(packed.key_of(out))


def class_of(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def prefix(n, per_cent: int):
    """Tokens in the prefix of a set of n."""
    return n - (n * per_cent + 99) // 100 + 1


def _live(docs: DataFrame, n: int, per_cent: int) -> DataFrame:
    """(doc_id, t, cls, n, live) of docs (doc_id, t, text): live sets may be similar to one of another class."""
    buckets = partitions(docs.sparkSession)

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, keys, sets, size, closed = [], [], [], 0, 0

        def close() -> Iterator[pd.DataFrame]:
            classes: dict[int, int] = {}
            of, first = [], []
            for s in sets:
                c = class_of(s)
                if c not in classes:
                    classes[c] = len(classes)
                    first.append(s)
                of.append(c)
            sizes = [len(s) for s in first]
            tokens = np.concatenate(first)
            owner = np.repeat(np.arange(len(first)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), dtype=bool)
            new[1:] = tokens[1:] != tokens[:-1]
            alone = new.copy()
            alone[:-1] &= new[1:]
            owner = np.where(alone, owner, SHARED)[new]
            tokens = tokens[new]
            starts = packed.bounds(tokens, buckets)
            chunk = _chunk_id(closed, keys)
            rows = []
            for b in range(buckets):
                at = slice(starts[b], starts[b + 1])
                if starts[b] < starts[b + 1]:
                    rows.append((b, chunk, len(first), tokens[at].astype(np.uint32).tobytes(), owner[at].astype(np.uint16).tobytes(), None, None, None, None))
            local = np.array([classes[c] for c in of], dtype=np.int32)
            rows.append((chunk % buckets, chunk, len(first), None, None, ids, keys, of, [int(sizes[i]) << 16 | int(i) for i in local]))
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "size", "tokens", "owner", "ids", "keys", "cls", "local"])

        for batch in batches:
            for doc_id, t, text in zip(batch["doc_id"], batch["t"], batch["text"], strict=True):
                s = shingles(text, n)
                if size + len(s) > CHUNK_TOKENS and sets or len(sets) >= CHUNK_DOCS:
                    yield from close()
                    ids, keys, sets, size, closed = [], [], [], 0, closed + 1
                ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                keys.append(int(t))
                sets.append(s)
                size += len(s)
        if sets:
            yield from close()
        _WORDS.clear()
        hand_back()

    schema = "bucket int, chunk long, size int, tokens binary, owner binary, ids array<long>, keys array<long>, cls array<long>, local array<long>"

    def single(rows: pd.DataFrame) -> pd.DataFrame:
        """Of each chunk in a bucket, how many tokens of each of its classes no other class has."""
        asked = rows[rows["tokens"].notna()]
        told = rows[rows["tokens"].isna()].drop(columns=["tokens", "owner"]).assign(single=None)
        parts = [np.frombuffer(x, np.uint32) for x in asked["tokens"]]
        out = []
        if parts:
            tokens = np.concatenate(parts)
            owner = np.concatenate([np.frombuffer(x, np.uint16) for x in asked["owner"]])
            row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            new = np.ones(len(tokens) + 1, dtype=bool)
            new[1:-1] = tokens[1:] != tokens[:-1]
            lone = order[new[:-1] & new[1:]]
            lone = lone[owner[lone] != SHARED]
            base = np.concatenate([[0], np.cumsum(asked["size"].to_numpy())])
            counts = np.bincount(base[row[lone]] + owner[lone], minlength=base[-1])
            for i, chunk in enumerate(asked["chunk"]):
                out.append((int(chunk), counts[base[i] : base[i + 1]].astype(np.uint32).tobytes()))
        mine = pd.DataFrame(out, columns=["chunk", "single"]).assign(size=None, ids=None, keys=None, cls=None, local=None)
        both = pd.concat([mine, told], ignore_index=True) if len(told) and len(mine) else (told if len(told) else mine)
        return both[["chunk", "single", "ids", "keys", "cls", "local"]]

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        told = rows[rows["cls"].notna()]
        sums = [np.frombuffer(x, np.uint32) for x in rows["single"] if x is not None and x == x]
        lone = np.sum(sums, axis=0, dtype=np.int64) if sums else None
        frames = []
        for ids, keys, cls, local in zip(told["ids"], told["keys"], told["cls"], told["local"], strict=True):
            local = np.asarray(local, dtype=np.int64)
            n, at = local >> 16, local & 0xFFFF
            own = lone[at] if lone is not None else np.zeros(len(at), np.int64)
            frames.append(
                pd.DataFrame({"doc_id": pd.array(list(ids), dtype="Int64"), "t": list(keys), "cls": list(cls), "n": n, "live": (n > 0) & (own < prefix(n, per_cent))})
            )
        return pd.concat(frames) if frames else pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "t": [], "cls": [], "n": [], "live": []})

    sent = docs.mapInPandas(shred, schema)
    told = sent.groupBy("bucket").applyInPandas(single, "chunk long, single binary, ids array<long>, keys array<long>, cls array<long>, local array<long>")
    return told.groupBy("chunk").applyInPandas(gather, "doc_id long, t long, cls long, n long, live boolean").checkpoint()


def _chunk_id(seen: int, keys: list[int]) -> int:
    """A number for a task's chunk after so many others, which a second attempt of the task gives again."""
    import xxhash
    from pyspark import TaskContext

    task = TaskContext.get()
    data = np.array([task.partitionId() if task else 0, seen, *keys], dtype=np.int64)
    return xxhash.xxh3_64_intdigest(data.tobytes()) >> 1


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, t, text) that wanted (doc_id, t) names."""
    side = wanted.select(F.col("doc_id").alias("__i"), F.col("t").alias("__k"))
    if wanted.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    else:  # a bitmap, so that few other texts are dealt out for the join
        docs = among(docs, F.col("t"), side.select("__k"), FILTER_BITS)
    return docs.join(side, (F.col("t") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left_semi")


def _representatives(found: DataFrame) -> DataFrame:
    """One (doc_id, t) of each live class."""
    return found.where("live").groupBy("cls").agg(F.min(F.struct("doc_id", "t")).alias("r")).select("r.doc_id", "r.t")


def _prefixes(docs: DataFrame, n: int, per_cent: int) -> DataFrame:
    """(cls, n, tokens, p1, p2, p3) of the docs' classes: the set, and its prefix tokens in other sets under three orders."""
    spark = docs.sparkSession

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, n) for t in batch["text"]]
            yield pd.DataFrame({"cls": [class_of(s) for s in own], "n": [len(s) for s in own], "tokens": [s.tobytes() for s in own]})
        _WORDS.clear()
        hand_back()

    classes = docs.mapInPandas(sets, "cls long, n long, tokens binary").dropDuplicates(["cls"]).checkpoint()
    size = classes.agg(F.sum("n")).first()[0] or 0
    buckets = packed.buckets_for(6 * size, partitions(spark))
    chunks = max(1, -(-size // CHUNK_TOKENS))
    classes = classes.withColumn("chunk", packed.chunk_of(F.xxhash64("cls"), chunks))

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["tokens"]]), return_counts=True)
        return packed.requests(int(rows["chunk"].iloc[0]), keys, counts, buckets)

    replies = packed.totals(classes.groupBy("chunk").applyInPandas(ask, packed.REQUESTS))

    def choose(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("cls", "n", "tokens", "p1", "p2", "p3")})
        every = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        keys = np.unique(np.concatenate(every))
        total = packed.answered(back, len(keys))
        second, third = packed.mixed(keys + np.uint64(2)), packed.mixed(keys + np.uint64(3))
        out = []
        for cls, s in zip(rows["cls"], every, strict=True):
            at = np.searchsorted(keys, s)
            df = total[at]
            shared = at[df > 1]
            wide = int(prefix(len(s), per_cent)) - (len(s) - len(shared))
            if wide <= 0:
                continue
            count = total[shared]
            log = np.floor(np.log2(count)).astype(np.int64)
            orders = (np.lexsort((keys[shared], count)), np.lexsort((second[shared], log)), np.lexsort((third[shared], log // 2)))
            out.append((cls, len(s), s.tobytes(), *(np.sort(keys[shared[o[:wide]]]).tobytes() for o in orders)))
        return pd.DataFrame(out, columns=["cls", "n", "tokens", "p1", "p2", "p3"])

    both = classes.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return both.applyInPandas(choose, "cls long, n long, tokens binary, p1 binary, p2 binary, p3 binary").checkpoint()


def _clusters(sets: DataFrame) -> DataFrame:
    """(v, root): sets that share prefix tokens under the first order, transitively."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch["p1"]]
            if parts:
                yield pd.DataFrame({"cls": np.repeat(batch["cls"].to_numpy(), [len(p) for p in parts]), "token": np.concatenate(parts)})

    held = sets.select("cls", "p1").mapInPandas(spread, "cls long, token long")
    least = held.groupBy("token").agg(F.min("cls").alias("b"), F.max("cls").alias("top")).where("b <> top").select("token", "b")
    return components(held.join(least, "token").select(F.col("cls").alias("a"), "b").where("a <> b").distinct())


def _verified(rows: pd.DataFrame, per_cent: int, numbers: bool) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Of the sets of a unit (between its blocks only, if it has two): links that connect all that are similar, and with
    numbers, how many documents each class is linked with."""
    rows = rows.sort_values(["n", "cls"], kind="stable")
    cls, n = rows["cls"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    copies = rows["copies"].to_numpy(np.int64)
    block, two = rows["block"].to_numpy(np.int64), rows["block"].nunique() > 1
    sets = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts_of = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    orders = []
    for name in ("p1", "p2", "p3"):
        parts = [np.searchsorted(every, np.frombuffer(x, np.uint64)) for x in rows[name]]
        token = np.concatenate(parts)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        by = np.lexsort((doc, token))
        starts = np.searchsorted(token[by], np.arange(len(every) + 1))
        orders.append((parts, doc[by], starts))
    mark = np.zeros(len(every), dtype=bool)
    component = np.arange(len(sets))
    links, linked = [], np.zeros(len(sets), np.int64)
    for x in range(len(sets)):
        from_ = int(np.searchsorted(n, -(-n[x] * per_cent // 100)))  # shorter sets can't be similar
        if from_ >= x:
            continue
        met = np.ones(x - from_, dtype=bool)
        if not numbers:
            met &= component[from_:x] != component[x]
        if two:
            met &= block[from_:x] != block[x]
        for parts, docs, starts in orders:
            if not met.any():
                break
            own = np.zeros(x - from_, dtype=bool)
            for t in parts[x]:
                with_ = docs[starts[t] : starts[t + 1]]
                with_ = with_[np.searchsorted(with_, from_) : np.searchsorted(with_, x)]
                own[with_ - from_] = True
            met &= own
        candidates = np.flatnonzero(met) + from_
        if not len(candidates):
            continue
        mark[code[starts_of[x] : starts_of[x + 1]]] = True
        if 2 * len(candidates) > x - from_:  # most of them: all sets in between at once
            common = np.add.reduceat(mark[code[starts_of[from_] : starts_of[x]]].astype(np.int32), starts_of[from_:x] - starts_of[from_])[candidates - from_]
        else:
            sizes = n[candidates]
            at = np.repeat(starts_of[candidates] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            common = np.add.reduceat(mark[code[at]].astype(np.int32), np.cumsum(sizes) - sizes)
        mark[code[starts_of[x] : starts_of[x + 1]]] = False
        alike = candidates[(100 + per_cent) * common.astype(np.int64) >= per_cent * (n[x] + n[candidates])]
        if not len(alike):
            continue
        linked[alike] += copies[x]
        linked[x] += copies[alike].sum()
        for y in alike[np.unique(component[alike], return_index=True)[1]]:
            if component[y] != component[x]:
                links.append((int(cls[x]), int(cls[y])))
                component[component == component[y]] = component[x]
    return links, {int(c): int(k) for c, k in zip(cls, linked, strict=True) if k} if numbers else {}


def _links(sets: DataFrame, per_cent: int, numbers: bool) -> DataFrame:
    """(a, b, linked): similar classes, enough of them to connect all that are similar; and with a null b, a number of documents that class a is linked with."""
    checkpoints(sets.sparkSession)
    clusters = _clusters(sets)
    rows = sets.join(clusters, F.col("cls") == F.col("v")).drop("v")
    sizes = rows.groupBy("root").agg(F.sum("n").alias("size")).checkpoint()
    blocks = F.ceil(F.col("size") / F.lit(UNIT_TOKENS)).cast("int")
    units = max(1, -(-(sizes.where(F.col("size") <= UNIT_TOKENS).agg(F.sum("size")).first()[0] or 0) // (UNIT_TOKENS // 2)))
    sizes = sizes.select(F.col("root").alias("r"), blocks.alias("blocks"))
    rows = rows.join(sizes, F.col("root") == F.col("r")).drop("r")
    whole = rows.where("blocks = 1").select(
        F.lit(None).cast("long").alias("cluster"), F.pmod(F.xxhash64("root"), F.lit(units)).alias("i"), F.lit(0).cast("long").alias("j"),
        F.lit(0).alias("block"), "cls", "n", "copies", "tokens", "p1", "p2", "p3",
    )
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    parted = rows.where("blocks > 1").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.select(
        F.col("root").alias("cluster"), F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"),
        "block", "cls", "n", "copies", "tokens", "p1", "p2", "p3",
    )

    def verify(unit: pd.DataFrame) -> pd.DataFrame:
        links, linked = _verified(unit, per_cent, numbers)
        a, b = [x for x, _ in links] + list(linked), [y for _, y in links] + [None] * len(linked)
        whole = lambda x: pd.array(x, dtype="Int64")  # noqa: E731  64 bits don't fit a float
        return pd.DataFrame({"a": whole(a), "b": whole(b), "linked": whole([None] * len(links) + list(linked.values()))})

    return whole.unionByName(parted).groupBy("cluster", "i", "j").applyInPandas(verify, "a long, b long, linked long")


def join(docs: DataFrame, n: int = N, per_cent: int = SIMILARITY, numbers: bool = True) -> DataFrame:
    """(doc_id, t, n_shingles, cls, component_id, n_links) of each row of docs (doc_id, text); t is the hash of the text.

    numbers: whether n_links is worked out; else it is null.
    """
    spark = docs.sparkSession
    checkpoints(spark)
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = _live(docs, n, per_cent)
    again = _live(_only(docs, _representatives(found)), n, per_cent)
    classes = found.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sets = _prefixes(_only(docs, _representatives(again)), n, per_cent)
    sets = sets.join(classes.select(F.col("cls").alias("c"), "copies"), F.col("cls") == F.col("c")).drop("c")
    links = _links(sets, per_cent, numbers).checkpoint()
    roots = components(links.where("b is not null")).select(F.col("v").alias("c"), "root")
    linked = links.where("linked is not null").groupBy(F.col("a").alias("l")).agg(F.sum("linked").alias("linked"))
    least = classes.join(roots, F.col("cls") == F.col("c"), "left").select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"))
    joined = least.join(roots.select("root").distinct(), "root", "left_semi")
    tops = joined.groupBy("root").agg(F.min("least").alias("top")).withColumnRenamed("root", "r")
    least = least.join(tops, F.col("root") == F.col("r"), "left").join(linked, F.col("cls") == F.col("l"), "left")
    number = F.col("copies") - 1 + F.coalesce("linked", F.lit(0)) if numbers else F.lit(None).cast("long")
    least = least.select(F.col("cls").alias("k"), F.coalesce("top", "least").alias("component"), number.alias("number"))
    out = found.join(least, (F.col("cls") == F.col("k")) & (F.col("n") > 0), "left")
    has = F.col("n") > 0
    return out.select(
        "doc_id", "t", F.col("n").alias("n_shingles"), "cls", F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has, F.col("number")).otherwise(F.lit(0) if numbers else F.lit(None)).cast("long").alias("n_links"),
    )
