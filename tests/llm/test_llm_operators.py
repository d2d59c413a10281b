"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeated rows, empty tables, further columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat, common, decontaminate, graph, html_extract, jaccard_join, language_id, line_dedup, lm_score, merkle, packed, sentencepiece_bpe, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, fp int, words string, chunk string"


def prose(rng, n):
    syllables = ["the", "on", "er", "an", "re", "that", "ble", "st", "É", "ou"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "w", "c") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 60)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(100 + i, t, "en") for i, t in enumerate(base[:15])]
    rows += [(200 + i, t + " " + prose(rng, 1), "en") for i, t in enumerate(base[:15])]
    rows += [(300 + i, base[i] + "\n" + base[i + 1] + "\nall of this is the shared last line", "en") for i in range(0, 20, 2)]
    rows += [(400, None, "en"), (401, "", None), (402, "1 2 3 !", "en"), (403, "a", None), (None, base[0], "en"), (0, base[0], "en"), (404, base[0].replace(" ", "\t"), "en")]
    return rows


# --- 1


def test_chat_round_trip_of_any_text():
    rng = random.Random(1)
    for _ in range(500):
        role, text = ("".join(rng.choice("<[|]>\\/s\nINSTim_startend é漢") for _ in range(rng.randint(0, 30))) for _ in range(2))
        segment, start, end = chat.render_message(role, text)
        assert chat.read_back(segment) == (role, text)
        assert chat.unescape(segment[start:end]) == text
        assert segment.count("<|im_start|>") == segment.count("<|im_end|>") == 1


def test_chat_digests(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, "user", None), (1, 1, "assistant", "b<|im_end|>"), (3, None, None, "x"), (None, 0, "assistant", "é")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.events_of_turns(turns)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na\n" + "assistant\nb<|im_end|>\n" * 2)
    assert got[1]["loss_sha256"] == sha("b<|im_end|>" * 2) and got[1]["loss_chars"] == 22
    assert got[2]["turns_sha256"] == sha("user\n\n") and got[2]["loss_chars"] == 0
    assert got[3]["turns_sha256"] == sha("\nx\n") and got[None]["loss_sha256"] == sha("é")
    assert chat.digests(chat.render(chat.fold(chat.events_of_turns(turns.limit(0))))).count() == 0


def test_chat_folds_events(spark):
    events = spark.createDataFrame(
        [
            (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "He"), (1, 3, "delta", 1, None, "llo"), (1, 6, "edit", 2, "user", "edited"),
            (1, 5, "delta", 2, "user", "raw"), (1, 7, "delta", 3, "assistant", "no"), (1, 8, "regenerate", 3, None, None), (1, 9, "delta", 3, None, "yes"),
            (1, 10, "delta", 4, "user", "gone"), (1, 11, "delete", 4, None, None),
        ],
        "conv_id long, seq long, kind string, msg long, role string, text string",
    )
    got = [(r["role"], r["text"]) for r in chat.fold(events).orderBy("msg").collect()]
    assert got == [("user", "hi"), ("assistant", "Hello"), ("user", "edited"), ("assistant", "yes")]


def test_chat_events_act_on_whole_messages(spark):
    events = spark.createDataFrame(
        [
            (1, 1, "message", 0, "user", "old"), (1, 9, "edit", 0, None, "new"), (1, 2, "message", 1, "assistant", "gone"), (1, 3, "delete", 1, None, None),
            (1, 4, "message", 2, "assistant", "no"), (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "yes"), (1, 7, "message", 3, "user", "a"),
            (1, 8, "delta", 3, None, "b"), (1, 10, "message", 4, "user", "twice"), (1, 10, "message", 4, "user", "twice"), (1, 11, "message", 5, "user", "x"),
            (1, 11, "message", 5, "user", "x"), (1, 12, "delete", 5, None, None), (1, 13, "delta", 6, "user", "part"), (1, 14, "message", 6, "user", "all"),
        ],
        "conv_id long, seq long, kind string, msg long, role string, text string",
    )
    got = [(r["msg"], r["role"], r["text"]) for r in chat.fold(events).orderBy("msg").collect()]
    assert got == [(0, "user", "new"), (2, "assistant", "yes"), (3, "user", "ab"), (4, "user", "twice"), (4, "user", "twice"), (6, "user", "all")]


def sequential_fold(events):
    """Final (conv, msg, role, text) of events one after another; None orders before all."""
    place = lambda x: (x is not None, x or 0)
    left = {}
    for conv, seq, kind, msg, role, text in sorted(events, key=lambda e: (place(e[1]), e[2] != "message", e[2] or "", e[5] or "", e[4] or "")):
        found, role, text = left.setdefault((conv, msg), []), role or "", text or ""
        if kind == "message":
            left[conv, msg] = [*(m for m in found if m[2]), [role, text, True]]
        elif kind in ("delta", "edit", "regenerate", "delete"):
            was, now, _ = found[-1] if found else ["", None, False]
            now = {"delta": (now or "") + text, "edit": text, "regenerate": "", "delete": None}[kind]
            left[conv, msg] = [[role or was, now, False]]
    return Counter((*key, role, text) for key, found in left.items() for role, text, _ in found if text is not None)


def test_chat_fold_equals_a_sequential_one(spark):
    rng = random.Random(12)
    kinds = ["message", "delta", "delta", "edit", "regenerate", "delete", None, "shout"]
    events = [
        (rng.choice([1, 2, None]), rng.choice([None, *range(40)]), rng.choice(kinds), rng.choice([None, *range(25)]), rng.choice(["user", "assistant", None]), rng.choice([None, "a", "b", "cd"]))
        for _ in range(600)
    ]
    events += [(3, 5, "message", 0, "user", "same")] * 50
    frame = spark.createDataFrame(events, "conv_id long, seq long, kind string, msg long, role string, text string").withColumn("part", F.lit(0))
    got = Counter((r["conv_id"], r["msg"], r["role"], r["text"]) for r in chat.fold(frame).collect())
    assert got == sequential_fold(events)


def test_chat_query_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tallyspark.llm import queries

    rng = random.Random(13)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "sys<tem\n", None]), rng.choice([None, "", "é [INST] <|im_end|> \\ ", "plain\n"])) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op1_chat_format(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(chat.ORACLE).fetchall(), key=str)


# --- 2


def brute_hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(item))
    out = []
    for i, text in rows:
        w = word.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                own = windows.get(tuple(w[s : s + m]))
                if own:
                    hit.update(range(s, s + m))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_sent", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination_is_exact(spark, corpus, monkeypatch, rows_sent):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows_sent)
    rng = random.Random(7)
    long = [t for _, t, _ in corpus if t and len(t.split()) > 20]
    items = [(k, " ".join(rng.choice(long).split()[3 : 3 + n])) for k, n in enumerate((13, 14, 20, 12, 3, 1, 30))]
    items += [(50, None), (51, ""), (52, "the same same same same same"), (53, items[0][1])]
    rows = [(i, t) for i, t, _ in corpus] + [(900, "x " * 30 + items[2][1] + " y" * 600), (901, "The SAME same same same same same"), (902, "a a " * 40)]
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(docs, bench).collect()), key=str)
    assert got == brute_hits(rows, items)
    kept = decontaminate.mark(docs, bench)
    assert [c for c in kept.columns if not c.startswith("__")] == docs.columns
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# --- 3


def brute_components(rows, n, per_cent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links[a], links[b] = links[a] + 1, links[b] + 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "per_cent"), [(4, 85), (5, 80)])
def test_jaccard_join_is_exact(spark, corpus, n, per_cent, monkeypatch):
    rng = random.Random(3)
    rows = [(i, t) for i, t, _ in corpus]
    words = prose(rng, 80).split()
    for k in range(40):  # a large group of near copies
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = prose(rng, 1)
        rows.append((1000 + k, " ".join(own)))
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    got = sorted((tuple(r) for r in jaccard_join.join(docs, n, per_cent).select(*columns).collect()), key=str)
    assert got == brute_components(rows, n, per_cent)
    monkeypatch.setattr(jaccard_join, "UNIT_TOKENS", 500)  # large clusters in blocks
    monkeypatch.setattr(jaccard_join, "CHUNK_DOCS", 7)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    again = sorted((tuple(r) for r in jaccard_join.join(docs, n, per_cent).select(*columns).collect()), key=str)
    assert again == got
    alone = sorted((tuple(r) for r in jaccard_join.join(docs, n, per_cent, numbers=False).select(*columns).collect()), key=str)
    assert [r[:3] for r in alone] == [r[:3] for r in got] and {r[3] for r in alone} == {None}


def test_jaccard_join_of_nothing(spark):
    empty = docs_of(spark, [])
    assert jaccard_join.join(empty.withColumn("n", F.lit(1))).count() == 0
    only = docs_of(spark, [(1, None, None), (2, "", None), (None, "", None)])
    assert sorted((tuple(r) for r in jaccard_join.join(only).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == [(1, 0, 1, 0), (2, 0, 2, 0), (None, 0, None, 0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4


def test_toxicity_learns_ordered_grades(spark):
    rng = random.Random(2)
    rows, labels = [], []
    insults = {0: [], 1: ["scumbag"], 2: ["scumbag", "scumbags", "scumbaggery", "vermin", "vermin", "vermin"]}
    for i in range(450):
        words = prose(rng, 40).split() + insults[i % 3]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, i % 3))
    docs = docs_of(spark, [*rows, (900, None, None), (901, "", None), (None, "a scumbag", None), (902, "A SCUMBAG!", None), (903, "1 2 !", None), (0, rows[0][1], None)])
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None), (0, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labelled)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1] and model.grades == (0, 1, 2)
    got = toxicity.score(docs.withColumn("__toxicity", F.lit(1)), model).select("doc_id", "__toxicity.*").collect()
    assert len(got) == 456
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["grade"] == i % 3 for i in range(450)) >= 440
    means = [sum(by[i]["severity"] for i in range(450) if i % 3 == k) / 150 for k in range(3)]
    assert means[0] < 0.2 < 0.8 < means[1] < 1.2 < 1.8 < means[2]
    assert by[902]["toxic"] and by[None]["toxic"] and by[900]["severity"] == by[901]["severity"] == by[903]["severity"] == 0
    assert all(0 <= r["severity"] <= 2 and 0 <= r["p_toxic"] <= 1 and r["toxic"] == (r["grade"] > 0) for r in got)
    none = toxicity.train(docs, labelled.limit(0))
    assert toxicity.score(docs.limit(2), none).select("__toxicity.severity").first()[0] == 0.0
    assert toxicity.train(docs, labelled.where("toxic = 0")).thresholds == () and toxicity.score(docs.limit(0), model).count() == 0
    few = toxicity.train(docs, labelled, sample=20)
    assert few.thresholds[0] < few.thresholds[1]


def test_toxicity_gradients():
    import numpy as np

    rng = np.random.default_rng(1)
    link, t, y, weight = rng.normal(size=30), np.array([-1.0, 0.2, 1.5]), rng.integers(0, 4, 30), rng.random(30)
    loss, by_link, by_t = toxicity.likelihood(link, t, y, weight)
    p = np.diff(np.concatenate([np.zeros((30, 1)), 1 / (1 + np.exp(link[:, None] - t)), np.ones((30, 1))], axis=1), axis=1)
    assert abs(loss + (weight * np.log(p[np.arange(30), y])).sum()) < 1e-9
    for i in range(30):
        own = np.eye(30)[i] * 1e-6
        assert abs((toxicity.likelihood(link + own, t, y, weight)[0] - loss) / 1e-6 - by_link[i]) < 1e-4
    for k in range(3):
        assert abs((toxicity.likelihood(link, t + np.eye(3)[k] * 1e-6, y, weight)[0] - loss) / 1e-6 - by_t[k]) < 1e-4
    assert toxicity.likelihood(link, t[::-1], y, weight)[0] == np.inf


def test_toxicity_of_held_out_documents():
    pd = pytest.importorskip("pandas")
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    rows = pd.read_parquet(f"{folder}/documents.parquet").merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id").dropna(subset=["text"])
    learned, judged = rows[rows["doc_id"] % 2 == 0], rows[rows["doc_id"] % 2 == 1]
    model = toxicity.fit([(g, Counter(toxicity.words_of(t))) for g, t in zip(learned["toxic"], learned["text"], strict=True)])
    known = toxicity.Words(model)
    toxic = judged["toxic"].to_numpy() == 1
    severity, _, _, flagged = (pd.Series(x).to_numpy() for x in zip(*(model.score(t, known) for t in judged["text"]), strict=True))
    assert (flagged & toxic).sum() >= 0.9 * toxic.sum() and (flagged & toxic).sum() >= 0.9 * flagged.sum()
    assert severity[toxic].mean() > 0.8 and severity[~toxic].mean() < 0.05


# --- 5


def test_language_filter(spark):
    rng = random.Random(4)
    alphabets = {"xx": "abcde", "yy": "fghij", "zz": "éüñßø"}
    rows = []
    for k, (lang, letters) in enumerate(alphabets.items()):
        rows += [(1000 * k + i, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(20)), lang) for i in range(60)]
    docs = docs_of(spark, rows)
    model = language_id.train(docs)
    assert model.languages == ["xx", "yy", "zz"]
    extra = docs_of(spark, [(1, None, None), (2, "12 34 !", None), (3, "", None), (4, "漢字 漢", None), (5, "²½", None)])
    got = language_id.predict(docs.unionByName(extra), model).select("doc_id", "lang", "__lang.*").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"])
    rest = {r["doc_id"]: r for r in got if not r["lang"]}
    assert [rest[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und"] * 4 and rest[4]["score"] == 0.0 and rest[4]["known"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict(extra, language_id.train(docs.limit(0))).where("__lang.lang_pred <> 'und'").count() == 0


def test_filter_returns_all_languages_of_a_gram():
    import numpy as np

    made = language_id.Filter([f"l{i:02}" for i in range(11)])
    h = packed.mixed(np.arange(1, 200, dtype=np.uint64))
    for language in (0, 3, 10):
        made.add(language, h)
    made.close()
    first, second = made.masks(h)
    assert (first == 0b1001).all() and (second == 0b100).all()


def test_filter_grows_with_its_grams():
    assert language_id.Filter(["a"]).size == language_id.SLOTS
    assert language_id.Filter(["a"], language_id.SLOTS).size == language_id.SLOTS * language_id.GRAM_SLOTS


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.train(docs.where(~held))
    judged = language_id.predict(docs.where(held & F.col("lang").isNotNull()), model).where(F.col("__lang.lang_pred") != language_id.UNKNOWN)
    right, n = judged.agg(F.count_if(F.col("__lang.lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 2000 and right >= 0.99 * n


# --- 6


@pytest.fixture(scope="module")
def model_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def test_encoding_equals_the_library(model_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    model = sentencepiece_bpe.loaded(sentencepiece_bpe.model_bytes(model_path))
    rng = random.Random(6)
    alphabet = "ab  \n\t▁<s>é漢\x00😀1.,'The in"
    texts = ["", " ", "▁", "a" * 300, "the " * 50, prose(rng, 200)] + ["".join(rng.choice(alphabet) for _ in range(rng.choice((3, 25, 90)))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        joined, decoded = model.both(text)
        assert joined == ",".join(map(str, ids)) and decoded == library.decode(ids) == model.decode(ids), text


def test_encoding_queries(spark, model_path):
    docs = docs_of(spark, [(1, "a b", None), (2, None, None), (None, "", None), (1, "a b", None)])
    got = sorted((tuple(r) for r in sentencepiece_bpe.digests(docs, model_path).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0][1] == 2 and got[0] == got[1] and got[2] == (2, 0, empty, empty) and got[3] == (None, 0, empty, empty)
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, model_path), model_path).orderBy("doc_id").collect()
    assert [r["decoded"] for r in both] == ["", "a b", "a b", ""]


# --- 7


def _lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def _lm_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _lm_brute(rows, weights):
    """base_score, score and seen_score of each row by plain counting."""
    c, pairs, n = Counter(), Counter(), 0
    for i, t in rows:
        if not _lm_held(i):
            words = _lm_tokens(t)
            c.update(words)
            pairs.update(zip(["^", *words], words))
            n += len(words)
    c["^"], size = c[None], len(c)

    def mix(v, w, gone):
        cv, cw, cvw = c[v] - gone, c[w] - gone, pairs[v, w] - gone
        parts = (1 / (size + 1), cw / max(1, n - gone), cvw / cv if cv > 0 else 0.0)
        return math.log10(sum(x * p for x, p in zip(weights[min(39, int(math.log2(cv + 1)))], parts)))

    out = []
    for i, t in rows:
        words = _lm_tokens(t)
        gone = 0 if _lm_held(i) else 1
        out.append(
            (
                str(i), _lm_held(i), len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (size + 1))) for w in words), 6),
                round(sum(mix(v, w, gone) for v, w in zip(["^", *words], words)), 6), round(sum(mix(v, w, 0) for v, w in zip(["^", *words], words)), 6),
            )
        )
    return Counter(out)


@pytest.mark.parametrize("size", [9_000_000, 300])
def test_lm_scores_equal_plain_counting(spark, corpus, monkeypatch, size):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm_score.packed, "BUCKET_BYTES", size)
    rows = [(i, t) for i, t, _ in corpus] + [(500, "The the THE \x0b the\u2003x"), (501, "long " * 30_000)]
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    counted = lm_score.Counted(docs, held)
    weights = counted.weights()
    got = counted.scores(weights).collect()
    assert Counter((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6), round(r[7], 6)) for r in got) == _lm_brute(rows, weights)
    assert lm_score.score(docs.limit(0), F.lit(False)).count() == 0
    nothing = lm_score.score(docs.where("doc_id < 3"), F.lit(True)).collect()
    assert len(nothing) == 4 and all(r["score"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_lm_weights_come_from_all_training_tokens(spark, corpus, monkeypatch):
    docs = docs_of(spark, [(i, t, None) for i, t, _ in corpus])
    scores = lambda: sorted(((r["doc_id"], r["score"]) for r in lm_score.score(docs, F.col("doc_id") % 5 == 1).collect()), key=str)
    whole = scores()
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 250)
    parts = scores()
    assert [i for i, _ in parts] == [i for i, _ in whole] and [x for _, x in parts] == pytest.approx([x for _, x in whole], abs=1e-6)


def test_lm_weights_are_the_likeliest_mixture():
    import numpy as np

    rng = np.random.default_rng(3)
    estimate, context = np.stack([np.full(400, 1e-4), rng.random(400) * 1e-2, rng.random(400) * (rng.random(400) < 0.5)]), np.full(400, 5)
    cell, n = np.unique(lm_score.cells(estimate, context), return_counts=True)
    weights = lm_score.learn(cell, n)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 2] == 0
    likely = lambda w: np.log((w[:, None] * estimate).sum(0)).sum()
    best = max((likely(np.array([a, b, 1 - a - b])), a, b) for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if a + b < 0.995)
    assert likely(weights[5]) > best[0] - 1.0  # the cells are rounded


def test_lm_tells_repeated_texts_apart(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60)) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_score.score(docs_of(spark, [(i, t, None) for i, t in rows]), F.lit(False)).collect()}
    assert min(got[1000 + i] for i in range(20)) > max(got[i] for i in range(20, 200))


# --- 8


def brute_lines(rows):
    """Exact recurrence of long lines only: what templates without variable fields must at least drop."""
    first = {}
    keyed = sorted({(i is not None, i if i is not None else 0, t) for i, t in rows if t is not None})
    for some, i, t in keyed:
        for line in t.split("\n"):
            if len(line.split()) >= line_dedup.MIN_TOKENS:
                first.setdefault(line.strip(), (some, i, t))
    return first


def test_line_dedup(spark):
    rng = random.Random(9)
    lines = [prose(rng, 12) for _ in range(12)]
    rows = [(k, "\n".join(lines[k : k + 3])) for k in range(10)]
    rows += [(20, "order 17 was sent to you on day 5\n" + prose(rng, 9)), (21, prose(rng, 9) + "\norder 99 was sent to you on day 1"), (22, None), (23, ""), (24, "\n\n"), (25, "of the\nof the"), (26, "of the")]
    rows += [(30, "one two three four five six seven eight nine ten"), (31, "one two three four five six seven eight nine TEN"), (32, "one two three x y z a b c d")]
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    first = brute_lines([r for r in rows if r[0] < 20])
    for k in range(10):
        want = [x for x in rows[k][1].split("\n") if first[x.strip()][1] == k]
        assert got[k]["text"] == "\n".join(want) and got[k]["__n_dropped"] == 3 - len(want)
    assert "order 17" in got[20]["text"] and "order 99" not in got[21]["text"]
    assert got[22]["text"] is None and got[23]["text"] == "" and got[24]["text"] == "\n\n" and got[25]["text"] == "of the\nof the"
    assert got[30]["text"] and got[31]["text"] == "" and got[32]["text"]
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    assert [c for c in line_dedup.dedup(docs).columns if not c.startswith("__")] == docs.columns


def test_line_dedup_of_a_very_long_text(spark):
    own = [f"line {chr(97 + k % 26)}{k} of the text alone" for k in range(4)]
    rows = [(1, "\n".join(["all rights reserved"] * 30_000 + own)), (2, "\n".join(["all rights reserved", *own[:1]] * 20_000 + own[2:3])), (0, "all rights reserved")]
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs_of(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got[0]["text"] == "all rights reserved" and got[1]["text"] == "\n".join(own) and got[1]["__n_dropped"] == 30_000
    assert got[2]["__n_lines"] == 40_001 and got[2]["text"] == ""


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(10)
    own = [prose(rng, 9) for _ in range(8)]
    short = ["Les.", "And ornd.", "All rights reserved.", "one two three four", "漢字" * 40]
    rows = [(1, "\n".join([*short, own[0]])), (2, "\n".join([own[1], *short])), (3, f"  Les. \n{own[2]}\nall rights reserved.")]
    rows += [(4, f"Page 1\n{own[3]}\n \n\t"), (5, f"Page 2\n{own[4]}\n \n\t"), (6, f"Page 2\n{own[5]}\n\u3000"), (7, f"{own[6]}\none two three five\n\u3000")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, [(i, t, None) for i, t in rows])).collect()}
    want = dict(rows) | {2: own[1], 3: f"{own[2]}\nall rights reserved.", 6: f"{own[5]}\n\u3000"}
    assert got == want


@pytest.mark.parametrize("held", [500, 0])
def test_line_dedup_of_full_leaves(spark, monkeypatch, held):
    """Lines of one opening: each of many families recurs, as when each line joins the first leader it agrees with."""
    monkeypatch.setattr(line_dedup, "LEAF_LINES", held)
    rng = random.Random(11)
    rows = []
    for k in range(6):
        words = [f"{c}{'abcdef'[k]}" for c in "pqrstuv"]
        rows += [(10 * k + m, " ".join(["the", "same", "start", *words[:m], f"x{'ghij'[m]}", *words[m + 1 :]])) for m in range(rng.randint(2, 4))]
    rows += [(100 + k, "the same start " + prose(rng, 7)) for k in range(20)]
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    parsed = line_dedup.places(docs)
    found = line_dedup.templates(docs, parsed).join(parsed, ["__leaf", "__mask"]).collect()
    text, lead, want = dict(rows), [], {}
    of = {r["__id"]: r for r in found}
    for i in sorted(of, key=lambda i: of[i]["__mask"]):  # each line is in one document
        agree = lambda a, i=i: sum(x == y for x, y in zip(text[a].split(), text[i].split(), strict=True)) >= 8
        want[i] = next((a for a in lead if agree(a)), i)
        lead += [i] if want[i] == i else []
    assert {i: r["__template"] for i, r in of.items()} == {i: of[a]["__mask"] for i, a in want.items()}
    assert sum(i < 100 and a != i for i, a in want.items()) > 6


@pytest.mark.parametrize("held", [500, 0])
def test_line_dedup_compares_a_line_with_each_leader(spark, monkeypatch, held):
    """A line that shares a block with two leaders and agrees with the second alone joins that one, however its leaf is settled."""
    monkeypatch.setattr(line_dedup, "LEAF_LINES", held)
    first, second, line = "the same start a b c d e f g", "the same start p q r s t u v", "the same start a b r s t u v"
    rows = [(i, first) for i in range(1, 5)] + [(i, second) for i in range(11, 14)] + [(21, line)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == {i: {1: first, 11: second}.get(i, "") for i, _ in rows}


def test_a_bitmap_sent_to_the_tasks_is_small(spark):
    """The driver holds a bitmap several times over: 2 MB at most, and of 200,000 leaves' bits it still keeps 2 % of other rows at most."""
    assert max(line_dedup.FILTER_BITS, jaccard_join.FILTER_BITS) // 8 <= 2 << 20 and jaccard_join.BROADCAST_ROWS <= 50_000
    rows = spark.range(-100_000, 300_000).select(F.xxhash64("id").alias("h"), "id")
    for bits in (line_dedup.FILTER_BITS, 64, 1024):
        found = common.among(rows, F.col("h"), rows.where("id < 100000").select("h"), bits).groupBy((F.col("id") < 100000).alias("in")).count()
        n = {r["in"]: r["count"] for r in found.collect()}
        assert n[True] == 200_000 and (bits < 2048 or n[False] <= 4_000)


@pytest.mark.parametrize("held", [50_000, 0])
def test_only_keeps_the_wanted_rows(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", held)
    docs = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (None, 5, "a"), (1, -6, "b"), (3, 7, "c"), (3, 7, "c")], "doc_id long, t long, text string")
    wanted = spark.createDataFrame([(None, 5), (1, -6), (3, 7)], "doc_id long, t long")
    got = jaccard_join._only(docs, wanted)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()[2:]))


def test_line_dedup_keeps_its_plan_short(spark, monkeypatch):
    """However many rounds a leaf takes, the last plan reads the places and the recurring lines, once each."""
    rng = random.Random(12)
    docs = docs_of(spark, [(k, f"the same start {prose(rng, 6)} {'ab'[k % 2]}", None) for k in range(12)])
    for held in (500, 0):
        monkeypatch.setattr(line_dedup, "LEAF_LINES", held)
        assert line_dedup.dropped(docs)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_line_dedup_with_any_filter(spark, monkeypatch):
    """The bitmap of leaves only saves work: with one row of bits nearly all lines pass it."""
    rows = [(i, f"one two three four five six seven eight nine {w}\nother {w}{i} words of number {w} here") for i, w in enumerate("abcdefgh")]
    docs, got = docs_of(spark, [(i, t, None) for i, t in rows]), []
    for bits in (1 << 26, 1 << 10):
        monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
        got.append({r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()})
    assert got[0] == got[1] and all((i == 0) == t.startswith("one two") for i, t in got[0].items())


# --- 9


def test_fingerprints(spark, corpus):
    rows = [(i, t) for i, t, _ in corpus if i is not None]
    rows = list({i: t for i, t in rows}.items()) + [(None, "last of all, with no id"), (-5, "x")]
    docs = docs_of(spark, [(i, t, None) for i, t in rows]).withColumn("fingerprint", F.lit("clash"))
    for tasks in (1, 3, 40):
        got = {r["doc_id"]: r for r in merkle.with_edits(docs, tasks).collect()}
        down = sorted(rows, reverse=True, key=lambda r: (r[0] is not None, r[0] or 0))
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(down):
            t, after = t or "", down[(k + 1) % len(down)][1] or ""
            new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            r = got[i]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert r["fingerprint"] == merkle.fingerprint(t) and r["edited_fingerprint"] == merkle.fingerprint(new)
            # the likeness can be had from the fingerprints returned
            assert r["near_next"] == merkle.likeness(r["fingerprint"], merkle.fingerprint(after)) and r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"])
            assert r["first_difference"] == merkle.first_difference(t and merkle.fingerprint(t) or merkle.fingerprint(""), merkle.fingerprint(new))
    assert merkle.with_edits(docs.limit(0), 3).count() == 0
    ties = docs_of(spark, [(1, "b", None), (1, "a", None), (1, "b", None), (None, "z", None)])
    assert merkle.with_edits(ties, 3).count() == 4
    alone = merkle.with_edits(docs_of(spark, [(None, "abc", None)]), 3).collect()
    assert alone[0]["near_next"] == 1.0
    assert [r["fingerprint"] for r in merkle.fingerprints(docs.where("doc_id = -5")).collect()] == [merkle.fingerprint("x")]


def test_fingerprint_ranges_split_a_frequent_id(spark):
    rows = [(7, f"text {k}", None) for k in range(400)] + [(None, f"none {k}", None) for k in range(300)] + [(k, "a", None) for k in range(100)]
    docs = docs_of(spark, rows).select("doc_id", "text")
    ranges = merkle.Ranges(docs, 16)
    dealt = docs.withColumn("h", F.xxhash64("text")).withColumn("r", ranges.of())
    sizes = [r["count"] for r in dealt.groupBy("r").count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 120
    down = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["r"]) for r in dealt.collect()))
    assert [x[3] for x in down] == sorted(x[3] for x in down)  # ranges follow the order
    assert merkle.with_edits(docs, 16).count() == 800


def test_tree_locates_edits():
    a, b = "one. two.\nthree.\n\nfour.\nfive.", "one. two.\nthree.\n\nfour!\nfive."
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert x != y and merkle.differing(x, y) == [(1, 0)] and merkle.differing(x, x) == [] and a[merkle.first_difference(x, y) :].startswith("r.")
    assert 0.8 < merkle.likeness(x, y) < 1 and merkle.likeness(x, x) == 1.0 and merkle.first_difference(x, x) is None
    empty = merkle.fingerprint("")
    assert merkle.likeness(x, empty) == 0.0 and merkle.likeness(empty, merkle.fingerprint(None)) == 1.0 and merkle.first_difference(empty, x) is None
    assert merkle.differing(empty, x) == [] and merkle.differing(x, empty) == [(0, 0), (0, 1), (1, 0), (1, 1)] and merkle.first_difference(x, empty) == 0


def test_likeness_is_that_of_what_stays():
    rng = random.Random(3)
    for _ in range(300):
        words, n = prose(rng, rng.choice((3, 20, 200, 1500))).split(), rng.choice((1, 7, 40))
        text = "".join(w + (rng.choice(("\n", "\n\n", "\n \n")) if k % n == n - 1 else " ") for k, w in enumerate(words))
        tree, same = merkle.Tree(text), merkle.Tree.loads(merkle.fingerprint(text))
        assert (tree.root, tree.length) == (same.root, same.length) == (same.root, len(text)) and all((p == q).all() for p, q in zip(tree.hashes, same.hashes, strict=True))
        cut = len(text) * 2 // 3
        again = text[:cut] + rng.choice(("", "x y", " z\n\n", "\n"))
        assert merkle.Tree(again, merkle.Tree(text), cut).dumps() == merkle.fingerprint(again)
        other = merkle.fingerprint(text[:cut] + "".join(rng.choice("0123456789 ") for _ in range(len(text) - cut)))
        assert 2 / 3 - 260 / len(text) <= merkle.likeness(merkle.fingerprint(text), other) <= 2 / 3 + 20 / len(text)
        assert merkle.likeness(other, merkle.fingerprint(text)) == merkle.likeness(merkle.fingerprint(text), other)
        assert merkle.first_difference(merkle.fingerprint(text), other) <= cut + 30
    assert merkle.likeness(merkle.fingerprint("For " * 8000), merkle.fingerprint("For " * 6000 + "so " * 2000)) > 0.7
    assert len({merkle.fingerprint(t) for t in ("a b", "b a", "a  b", "a b ", "a\nb", "a\n\nb", "", " ", "\n")}) == 9


# --- 10


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("a &lt; b", "a < b"),
        ("<p>hi", "hi"),
        (
            "<html><head><title>t</title></head><body><nav><a href=/>menu, of, links</a></nav><header>Site</header><article><h1>T&eacute;</h1><p><b>First</b>, para<br>graph.<p>Second,\n  one.</article>"
            "<aside>side, side</aside><div class='cookie-notice'>We, use, cookies.</div><section id=comments><p>I, as, a, reader, think, so.</p></section><form>x<input></form><footer>&copy; f</footer><script>var a='</p>';</script></body></html>",
            "Té First, para graph. Second, one.",
        ),
        ("<div id=main><p>One, two, three long text here and more text to be sure.</p><div class='comments'><p>reader, says, this.</p></div><p>Second &amp; last</p></div><div class=sidebar><p>x, y, z</p></div>", "One, two, three long text here and more text to be sure. Second & last"),
        ("<table><tr><td>cell, one<td>cell two</table>", "cell, one cell two"),
        ("<article><p>a</p><article class=comment><p>no</p></article></article>", "a"),
        ("<p>x</p></div></p>stray<!-- c --><![CDATA[ raw ]]>", "x stray raw"),
        ("<article><script>if (a<b) { /* don't */ }</script><p>It's here, and so on.</p></article>", "It's here, and so on."),
        ("<article><figure><img src=a><figcaption>A caption.</figcaption></figure><p>Text, more text.</p></article>", "A caption. Text, more text."),
        ("<article><div class=alert>Beware.</div><p>Text, more text.</p><div class='notice side'>Noted.</div><p class=tags>x, y</p></article>", "Beware. Text, more text. Noted. x, y"),
        ("<div class=notice><p>Our, terms, have, changed.</p></div><article><p>Text.</p></article><div class=search>find</div>", "Text."),
        ("<div><div id=x><p>A paragraph, with commas, that says some things.</p><p>Another one, as long as that, or longer.</p></div><p>The end.</p></div>", "A paragraph, with commas, that says some things. Another one, as long as that, or longer. The end."),
        ("<p>a < b, c<d) <a href=x title='>'>e</a> it's <b class=\"x>f</b> g", "a < b, c<d) e it's f g"),
        ("<header>Site</header><main><header><h1>Title</h1></header><p>Text, text.</p></main>", "Title Text, text."),
        ("<p>one, two <a href=y", "one, two"),
    ],
)
def test_extraction(page, text):
    assert html_extract.extract(page) == text


def test_extraction_of_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_extract.extract_pages(pages).collect()) == ["", "a", "a"]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_very_long_and_deep_texts():
    deep = "<div>" * 3000 + "deep, text" + "</div>" * 3000
    assert html_extract.extract(deep) == "deep, text"
    long = "word " * 200_000
    assert merkle.likeness(merkle.fingerprint(long), merkle.fingerprint(long[5:])) > 0.99
    assert len(jaccard_join.shingles(long, 4)) == 1
    assert len(html_extract.extract(f"<article><p>{long}</article>")) == len(long) - 1


@pytest.mark.parametrize("part", ["<a ", "<a x=\"", "<div>", "<p><td><i>", "<!--", "</", "<", "<a =   ", "<ul><li>", "<b></i>", "<p>it's ", "<header>", "&amp"])
def test_extraction_time_is_linear(part):
    import time

    start = time.time()
    html_extract.extract(part * (1_000_000 // len(part)))
    assert time.time() - start < 20  # quadratic scans took minutes


# --- what several operators share


def test_packed_totals(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    keys = packed.key_of(np.arange(1, 400, dtype=np.uint64))
    sent, want = [], Counter()
    chunks = {}
    for chunk in range(5):
        own = np.unique(rng.choice(keys, 100))
        counts = rng.integers(0, 1 << 33, len(own))
        chunks[chunk] = own
        want.update(dict(zip(own.tolist(), counts.tolist(), strict=True)))
        sent.append(packed.requests(chunk, own, counts, 300, b"told" if chunk else None))
    replies = packed.totals(spark.createDataFrame(pd.concat(sent), packed.REQUESTS), keep="even").toPandas()
    for chunk, own in chunks.items():
        back = replies[replies["chunk"] == chunk]
        assert packed.answered(back, len(own)).tolist() == [want[k] for k in own.tolist()]
        even = np.concatenate([packed.unpack(x) for x in back[back["keys"].notna()].sort_values("bucket")["keys"]])
        assert even.tolist() == [k for k in own.tolist() if k % 2 == 0] and back["told"].notna().sum() == (chunk > 0)
    figures = replies[replies["chunk"] < 0]
    assert figures["n_keys"].sum() == sum(k % 2 == 0 and n > 0 for k, n in want.items()) and figures["n_counted"].sum() == sum(n for k, n in want.items() if k % 2 == 0)


def test_packed_keys_are_whole():
    import numpy as np

    for n in (0, 1, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << packed.KEY_BITS, n, dtype=np.uint64))
        assert (packed.unpack(packed.pack(keys)) == keys).all()
        at = packed.bounds(keys, 7)
        assert at[0] == 0 and at[-1] == len(keys) and all((packed.bucket_of(keys[i:j], 7) == b).all() for b, (i, j) in enumerate(zip(at, at[1:])))
    assert packed.buckets_for(0, 8) == 8 and packed.buckets_for(1 << 60, 8) == packed.MOST_BUCKETS
