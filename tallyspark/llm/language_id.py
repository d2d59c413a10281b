"""Language identification with bit-sliced Bloom filters of character n-grams.

Every slot of the filter is a bitmask with one bit per language (as many 8-bit slices as
there are languages, eight to a slice).  Adding an n-gram of a language sets its bit in
the slots of several hashes; AND-ing those slots of a queried n-gram gives all languages
that contain it.  A text's languages are counted over all its n-grams, the expected number
of false positives of each language's filter is taken off, and the language with the
largest remaining count is predicted.

Training takes a bounded sample of the labelled rows (SAMPLE rows a language, chosen by a
hash of the text); n-grams enter a language's filter if they are seen in it at least
LEAST times and at least SHARE as often, relatively, as in the language where they are
most usual; all that do enter.  The filter has SLOTS slots, or GRAM_SLOTS for each n-gram of
the fullest language if that is more: the sample bounds both, so it can be broadcast.

Cases: a null text, or one without a letter, is `und` with score 0; rows without a
language aren't learned from; with no training row at all every text is `und`.  One
output row for each input row, repeated rows included; ties between languages go to the
first in alphabetical order.  Other columns are not read but kept; one of the name __lang is
replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 1_000
GRAMS = (2, 3, 4)
SLOTS = 1 << 20
GRAM_SLOTS = 8
HASHES = 2
LEAST = 4
SHARE = 0.5
BATCH_CHARS = 400_000

UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, known double"
_BITS = np.array([[mask >> bit & 1 for bit in range(8)] for mask in range(256)])  # popcounts by language
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _WORD.search(text)
    return found is not None and (found[0].isalpha() or any(c.isalpha() for c in text))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashes of all n-grams of the texts that hold a letter, and which text each is of.

    Letters are lower-cased; every run of other characters counts as one blank, and each
    text begins and ends with a blank.  No n-gram reaches from one text into another.
    """
    joined = "\x00".join(f" {t.lower()} " for t in texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter_of = np.zeros(int(codes.max()) + 1, dtype=bool)
    present = np.unique(codes)
    letter_of[present] = [chr(c).isalpha() for c in present.tolist()]
    letter, end = letter_of[codes], codes == 0
    keep = letter | end
    keep[1:] |= letter[:-1] | end[:-1]  # a blank only after a letter or at a text's start
    keep[0] = True
    codes = np.where(letter, codes, np.where(end, 0, 32)).astype(np.uint64)[keep]
    letter = letter[keep]
    owner = np.cumsum(codes == 0)
    h = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            size = len(codes) - n + 1
            if size <= 0:
                return
            h = h[:size] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                # within one text, and no blank inside but at the ends: whole words or parts of them
                good = (owner[:size] == owner[n - 1 :]) & (codes[:size] != 0)
                for k in range(1, n - 1):
                    good &= letter[k : k + size]
                good &= (codes[n - 1 :] != 0) & (letter[:size] | letter[n - 1 :])
                yield _mixed(h[good]), owner[:size][good]


class Filter:
    """Bit-sliced Bloom filters of several languages."""

    def __init__(self, languages: list[str], most_grams: int = 0) -> None:
        self.languages = languages
        self.size = max(SLOTS, 1 << (GRAM_SLOTS * most_grams - 1).bit_length() if most_grams else 0)
        self.slices = np.zeros((max(1, -(-len(languages) // 8)), self.size), dtype=np.uint8)
        self.false = np.zeros(len(languages))

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return [((h + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def add(self, language: int, hashes: np.ndarray) -> None:
        for at in self.slots(hashes):
            self.slices[language // 8][at] |= np.uint8(1 << language % 8)

    def close(self) -> None:
        """Works out each language's false-positive rate from how full its filter is."""
        for i in range(len(self.languages)):
            full = np.count_nonzero(self.slices[i // 8] & np.uint8(1 << i % 8)) / self.size
            self.false[i] = full**HASHES

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each slice, the bitmask of the languages that contain each n-gram."""
        at = self.slots(hashes)
        out = []
        for part in self.slices:
            mask = part[at[0]]
            for more in at[1:]:
                mask &= part[more]
            out.append(mask)
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the n-grams in each language, and all n-grams."""
        found, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for hashes, owner in gram_hashes(texts):
            for k, mask in enumerate(self.masks(hashes)):
                kinds = np.bincount(owner * 256 + mask, minlength=256 * len(texts)).reshape(-1, 256)[: len(texts)]
                found[:, 8 * k : 8 * k + 8] += (kinds @ _BITS)[:, : len(self.languages) - 8 * k]
            total += kinds.sum(axis=1)
        return found, total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, its share of the corrected counts, and the share of n-grams that it knows."""
        given = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not given or not self.languages:
            return out
        found, total = self.counts([texts[i] for i in given])
        real = np.clip((found - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None)
        best, sums = real.argmax(axis=1), real.sum(axis=1)
        for row, i in enumerate(given):
            top = real[row, best[row]]
            score = top / sums[row] if sums[row] > 0 else 0.0
            out[i] = (self.languages[best[row]], float(score), float(min(1.0, top / max(total[row], 1))))
        return out


def train(labelled: DataFrame) -> Filter:
    """A filter from rows (text, lang): both non-null ones only, SAMPLE of each language at most."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filter(languages)
    # a hash threshold thins the rows before the exact cut, so no task sees all rows of a language
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 1.3 * SAMPLE / sizes[k] + 40 / sizes[k])))])
    thin = rows.where(F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003) * share[F.col("lang")])
    ranked = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    sample = ranked.where(F.col("r") <= SAMPLE).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                seen = [h for texts in _parts(group["text"].tolist()) for h, _ in gram_hashes(texts)]
                hashes, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": hashes.view(np.int64), "n": n.astype(np.int64)})

    grams = sample.mapInPandas(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    total = Window.partitionBy("lang")
    best = Window.partitionBy("h")
    grams = (
        grams.withColumn("rate", F.col("n") / F.sum("n").over(total))
        .withColumn("most", F.max("rate").over(best))
        .where((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("most")))
    )
    kept = grams.select("lang", "h").toPandas()
    made = Filter(languages, int(kept["lang"].value_counts().max()) if len(kept) else 0)
    for lang, group in kept.groupby("lang"):
        made.add(languages.index(lang), group["h"].to_numpy(np.int64).view(np.uint64))
    made.close()
    return made


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about BATCH_CHARS characters together; none is cut."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """docs with lang_pred, score and known added."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: list[Filter] = []

    @F.pandas_udf(PREDICTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        for batch in batches:
            rows = [x for part in _parts([t or "" for t in batch]) for x in loaded[0].predict(part)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "known"])

    return docs.withColumn("__lang", run("text"))
