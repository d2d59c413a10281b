"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are `[a-z0-9 and non-ASCII]+` runs after lower-casing A-Z.  Every run of GRAM words is
hashed and the least hash of each SPAN consecutive ones is kept; as GRAM + SPAN - 1 = WINDOW,
two texts that share WINDOW consecutive words share a kept hash.  Kept hashes of documents
meet those of the benchmark's windows; documents with one are read again, each meeting point
is extended to the window that it would belong to, and that window's words are compared in
full, so no hash collision reaches the result.

An item of fewer than WINDOW words (but not none) is one window.  Its least word hash takes
the place of the kept hash and is looked up among all words of the documents.

The benchmark side is broadcast only if its counted rows are at most BROADCAST_ROWS, and is
joined by shuffle beyond that.

Cases: null and empty texts, and texts without words, have no words and no hits.  Rows of
equal (doc_id, text) get equal results, one output row each; rows of one id with different
texts are judged apart.  Null doc_ids are kept.  An empty benchmark hits nothing.  Further
columns of docs are kept as they are; names beginning with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
GRAM = 6
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Explode them with the outer generators only: the filter that Spark infers for the
    others is pushed below these projections and would evaluate them again and again."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def _later(array: str, by: int):
    """For a lambda over (x, i): the element that many places on, null beyond the end."""
    return lambda i: F.get(F.col(array), i + F.lit(by))


def _grams(df: DataFrame) -> DataFrame:
    """Adds __h (word hashes) and __g (hashes of GRAM words at each position) to rows with __w."""
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__h2", F.transform("__h", lambda x, i: F.xxhash64(x, _later("__h", 1)(i))))
    df = df.withColumn("__h4", F.transform("__h2", lambda x, i: F.xxhash64(x, _later("__h2", 2)(i))))
    df = df.withColumn("__h6", F.transform("__h4", lambda x, i: F.xxhash64(x, _later("__h2", 4)(i))))
    return df.withColumn("__g", F.slice("__h6", 1, F.greatest(F.size("__h") - F.lit(GRAM - 1), F.lit(0)))).drop("__h2", "__h4", "__h6")


def _winnowed(df: DataFrame) -> DataFrame:
    """Adds __m: the least hash of each SPAN consecutive ones of __g."""
    df = df.withColumn("__m2", F.transform("__g", lambda x, i: F.least(x, _later("__g", 1)(i))))
    df = df.withColumn("__m4", F.transform("__m2", lambda x, i: F.least(x, _later("__m2", 2)(i))))
    df = df.withColumn("__m8", F.transform("__m4", lambda x, i: F.least(x, _later("__m4", 4)(i))))
    return df.withColumn("__m", F.slice("__m8", 1, F.greatest(F.size("__g") - F.lit(SPAN - 1), F.lit(0)))).drop("__m2", "__m4", "__m8")


def _benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, window, size, kind, hash, off): each distinct window of each item and the place of its kept hash."""
    items = benchmark.select(F.col("item_id").alias("__item"), words(F.col("text")).alias("__w"))
    items = _winnowed(_grams(items))
    long = items.where(F.size("__w") >= WINDOW).select(
        "__item",
        F.lit(0).alias("__kind"),
        F.lit(WINDOW).alias("__size"),
        F.posexplode_outer("__m").alias("__s", "__v"),
        "__w",
        "__g",
    ).where("__v is not null")
    long = long.withColumn("__off", F.array_position(F.slice("__g", F.col("__s") + 1, SPAN), F.col("__v")).cast("int") - 1)
    short = items.where((F.size("__w") < WINDOW) & (F.size("__w") > 0)).select(
        "__item", F.lit(1).alias("__kind"), F.size("__w").alias("__size"), F.lit(0).alias("__s"), F.array_min("__h").alias("__v"), "__w", "__g",
        (F.array_position("__h", F.array_min("__h")).cast("int") - 1).alias("__off"),
    )
    both = long.unionByName(short)
    return both.select(
        "__item", "__kind", "__size", "__v", "__off", F.array_join(F.slice("__w", F.col("__s") + 1, F.col("__size")), " ").alias("__window")
    ).distinct()


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(__id, __t, __spans, __items) of each distinct (doc_id, hash of text) with an occurring window.

    __spans: sorted (start, end) word ranges of the occurrences; __items: ids of the items,
    as strings, sorted.
    """
    windows = _benchmark_windows(benchmark)
    n = windows.count()
    kinds = {r["__kind"] for r in windows.select("__kind").distinct().collect()}
    anchors = _sized(windows.select("__kind", "__v", "__off", "__size").distinct(), n)
    kept = _sized(windows.select("__kind", "__v").distinct(), n)
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t"), "text")
    hashed = _grams(rows.select("__id", "__t", words(F.col("text")).alias("__w")))

    met = _winnowed(hashed).select("__id", "__t", F.lit(0).alias("__kind"), F.explode_outer(F.array_distinct("__m")).alias("__v"))
    if 1 in kinds:
        met = met.unionByName(hashed.select("__id", "__t", F.lit(1).alias("__kind"), F.explode_outer(F.array_distinct("__h")).alias("__v")))
    found = met.join(kept, ["__kind", "__v"], "left_semi").select("__id", "__t").distinct()

    same = (F.col("d.__t") == F.col("f.__t")) & F.col("d.__id").eqNullSafe(F.col("f.__id"))
    again = rows.alias("d").join(found.alias("f"), same, "left_semi").select("__id", "__t", words(F.col("text")).alias("__w"))
    again = _grams(again)
    if n <= BROADCAST_ROWS:  # all anchors come to the words
        places = again.select("__id", "__t", "__w", F.lit(0).alias("__kind"), F.posexplode_outer("__g").alias("__p", "__v"))
        if 1 in kinds:
            places = places.unionByName(again.select("__id", "__t", "__w", F.lit(1).alias("__kind"), F.posexplode_outer("__h").alias("__p", "__v")))
        tried = places.join(anchors, ["__kind", "__v"]).withColumn("__s", F.col("__p") - F.col("__off"))
    else:  # hashes and places alone are shuffled; the starts that they give go back to the words, once for each document
        places = again.select("__id", "__t", F.lit(0).alias("__kind"), F.posexplode_outer("__g").alias("__p", "__v"))
        if 1 in kinds:
            places = places.unionByName(again.select("__id", "__t", F.lit(1).alias("__kind"), F.posexplode_outer("__h").alias("__p", "__v")))
        starts = places.join(anchors, ["__kind", "__v"]).select(F.col("__id").alias("__i"), F.col("__t").alias("__k"), (F.col("__p") - F.col("__off")).alias("s"), F.col("__size").alias("n"))
        starts = starts.where("s >= 0").groupBy("__i", "__k").agg(F.collect_set(F.struct("s", "n")).alias("__starts"))  # as many as a document has words at most
        back = again.select("__id", "__t", "__w").distinct().join(starts, (F.col("__t") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")))
        tried = back.select("__id", "__t", "__w", F.explode("__starts").alias("__x")).select("__id", "__t", "__w", F.col("__x.s").alias("__s"), F.col("__x.n").alias("__size"))
    tried = tried.where((F.col("__s") >= 0) & (F.col("__s") + F.col("__size") <= F.size("__w"))).select(
        "__id", "__t", "__s", "__size", F.array_join(F.slice("__w", F.greatest(F.col("__s") + 1, F.lit(1)), F.col("__size")), " ").alias("__window")
    )
    texts = _sized(windows.select("__window", "__size", "__item").distinct(), n)
    real = tried.join(texts, ["__window", "__size"])
    grouped = real.groupBy("__id", "__t").agg(
        F.array_sort(F.collect_set(F.struct(F.col("__s").alias("start"), (F.col("__s") + F.col("__size")).alias("end")))).alias("__spans"),
        F.array_sort(F.collect_set(F.col("__item").cast("string"))).alias("__items"),
    )
    return grouped


def covered(spans: Column) -> Column:
    """How many words sorted (start, end) ranges cover together."""
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        empty,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"].cast("long")).alias("end"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"].cast("long") - F.greatest(a["end"], s["start"].cast("long")))).alias("n"),
        ),
        lambda a: a["n"],
    )


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with __n_words, __n_hit, __items (sorted ids as strings) and __contaminated."""
    found = hits(docs, benchmark).select("__id", F.col("__t").alias("__found"), covered(F.col("__spans")).alias("__hit"), F.col("__items").alias("__hit_items"))
    all_ = docs.withColumn("__n_words", n_words(F.col("text"))).withColumn("__t", F.xxhash64("text"))
    same = (F.col("__t") == F.col("__found")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    out = all_.join(found, same, "left")
    out = out.withColumn("__n_hit", F.coalesce("__hit", F.lit(0).cast("long")))
    out = out.withColumn("__items", F.coalesce("__hit_items", F.array().cast("array<string>")))
    out = out.withColumn("__contaminated", (F.col("__n_hit") > 0) & (F.col("__n_hit") * 20 >= F.col("__n_words")))
    return out.drop("__t", "__id", "__found", "__hit", "__hit_items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("__contaminated").alias("contaminated"),
    )


#: The same result in DuckDB SQL: all windows of all documents against all windows of the items.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, dw.m, s, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
