"""The operators for language-model data against SQL, libraries and brute force, and their edge cases."""

from __future__ import annotations

import cmath
import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import bpe, chat, decontaminate, html_text, jaccard_join, langid, media, queries, substring_dedup, token_counts, url_filter
from tarmac.llm.common import run_hashes, shared_dir, words_of
from tarmac.llm.components import connect
from tests.oracle import check

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a long text, and columns that clash with results."""
    long = "word " * 40_000
    data = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "   \n", None, "s", 1), (3, "a b", "en", None, 3), (3, "a b", "en", None, 3), (4, long, "de", "s", None), (None, "x y z. u v w.", "en", "s", 1)]
    df = spark.createDataFrame(data, DOC)
    return df.withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("score", F.lit(2)).withColumn("ids", F.lit(3)).withColumn("spans", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name], SF)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for f in s:
            where[f].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x, n in Counter(x for f in s for x in where[f]).items():
            if x != d and 100 * n >= 75 * (len(s) + len(sets[x]) - n):
                a, b = find(d), find(x)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_components_of_whole_documents(spark):
    got = {r[0]: (r[1], r[2]) for r in queries.op5_jaccard(spark, SF).collect()}
    assert got == brute_components(documents())


def test_components_of_random_near_copies(spark):
    rng = np.random.RandomState(3)
    rows = []
    for base in range(25):
        size = int(rng.choice([3, 6, 9, 14, 30, 60, 90, 150, 400]))
        text = [f"w{x}" for x in rng.randint(0, 40 if base % 3 == 0 else 4000, size)]
        for _ in range(8):
            own = list(text)
            for _ in range(rng.randint(0, 1 + max(1, size // 25))):
                own[rng.randint(len(own))] = f"z{rng.randint(50)}"
            rows.append((len(rows), " ".join(own)))
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_a_large_group(spark):
    """Chains of near copies, of which most pairs don't link, and a passage that all documents share."""
    rng = np.random.RandomState(8)
    passage = " ".join(f"p{i}" for i in range(25))
    rows, text = [], [f"w{x}" for x in rng.randint(0, 4000, 80)]
    for i in range(150):
        if i % 30 == 29:
            text = [f"v{x}" for x in rng.randint(0, 4000, 80)]
        text = list(text)
        text[rng.randint(len(text))] = f"z{i}"
        rows.append((i, f"{' '.join(text)} {passage}"))
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def rows_joined(df):
    """Rows that the comparing join of a query made, as Spark counted them when the query ran."""
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name, count = plan.nodeName(), plan.metrics().get("numOutputRows")
        if "Join" in name and count.isDefined() and "block" in plan.simpleString(200):
            made.append(count.get().value())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        todo += [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else []
    return sum(made)


def test_open_pairs_meet_once(spark):
    """Near copies that share many signatures, equal groups, a set with a hundred partners that share nothing else, and one component."""
    rng = np.random.RandomState(5)
    groups = [sorted(rng.permutation(30)[:27] + 1000) for _ in range(80)]
    groups += [[2000, 2001, 2002]] * 200 + [[0, 3000 + 2 * i, 3001 + 2 * i] for i in range(50)] + [[4000, 4001]] * 5
    label = lambda node: 4000 if node >= 4000 else 1000 if node in (1001, 1002) else node
    nodes = sorted({int(node) for group in groups for node in group})
    shared = spark.createDataFrame([(sig, int(node), 100) for sig, group in enumerate(groups) for node in group], "sig long, node long, n long")
    sets = spark.createDataFrame([(node, 100, [0] * jaccard_join.WORDS) for node in nodes], "node long, n long, bits array<long>")
    pairs = jaccard_join._open_pairs(shared, spark.createDataFrame([(node, label(node)) for node in nodes], "node long, label long"), sets)
    got = [tuple(r) for r in pairs.collect()]
    expected = {(a, b) for group in groups for a in group for b in group if a < b and label(a) != label(b)}
    assert len(got) == len(set(got)) and expected == set(got)
    assert len(got) <= rows_joined(pairs) < 5 * len(got)


def test_linked_sets_share_signatures():
    rng = np.random.RandomState(1)
    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 31, 33, 63, 64, 70, 127, 129, 300, 511, 600]))
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        drop, add = rng.randint(0, n // 4 + 1), rng.randint(0, n // 3 + 1)
        b = np.unique(np.concatenate((a[drop:], rng.randint(0, 2**62, add).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 75 * (len(a) + len(b) - common):
            (sa, la), (sb, lb) = jaccard_join.signatures(a), jaccard_join.signatures(b)
            shared = len(np.intersect1d(sa, sb))
            assert shared >= la and shared >= lb
            assert sum(int(x).bit_count() for x in (jaccard_join.parities(a) ^ jaccard_join.parities(b)).view(np.uint64)) <= len(a) + len(b) - 2 * common


def test_components_of_odd_rows(odd, empty):
    got = [tuple(r) for r in jaccard_join.jaccard_components(odd).collect()]
    assert Counter(got) == Counter([(None, 0, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 4), (None, 2, None)])
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_connect_a_long_path(spark):
    n = 60
    labels = spark.createDataFrame([(i, i) for i in range(n + 2)], "node long, label long")
    links = spark.createDataFrame([(i + 1, i) for i in range(n - 1)], "a long, b long")
    got = dict(connect(labels, links).collect())
    assert got == {i: 0 if i < n else i for i in range(n + 2)}


def test_word_hashes_follow_words():
    texts = ["The cat\tsat", "", "the  CAT sat ", "é" * 5000 + " x", " "]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends, hashes, rows = words_of(np.frombuffer(data, np.uint8), offsets)
    assert rows.tolist() == [0, 3, 3, 6, 8, 8]
    assert hashes[:3].tolist() == hashes[3:6].tolist() and len(set(hashes.tolist())) == 5
    assert run_hashes(hashes[:3], 3) == run_hashes(hashes[3:6], 3)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_leaks(text, items, size=10):
    """Hit words of a text and the items found in it, by comparing every window at every place."""
    w, hit, found = bench_words(text), set(), set()
    for name, item in items:
        v = bench_words(item)
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(hit), tuple(sorted(found))


def test_leaks_in_random_texts(spark):
    """Few words, so items overlap themselves and each other; windows of several sizes; one block and several."""
    rng = np.random.default_rng(2)

    def some(n, k):
        return " ".join(rng.choice(list("abcdefgh")[:k], n))

    items = [(i, some(int(rng.integers(0, 40)), 2 + i % 5)) for i in range(40)] + [(100, "a " * 60), (101, "a " * 9)]
    texts = [(i, " z ".join(t for _, t in items[i % 7 :: 7])[: 20 + 40 * i] + some(60, 2 + i % 4)) for i in range(40)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    for size, block in ((10, decontaminate.BLOCK_BYTES), (7, 300), (2, 300), (1, decontaminate.BLOCK_BYTES)):
        got = {r["row"]["doc_id"]: (r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench, size=size, block_bytes=block).collect()}
        assert got == {d: brute_leaks(t, items, size) for d, t in texts}


def test_two_megabytes_of_benchmark_are_one_scan(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(40_000)])
    texts = [" ".join(rng.choice(words, 80)) for _ in range(3_600)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, "x " + t + " y" if i % 2 else " ".join(t.split()[:9])) for i, t in enumerate(texts[:200])], "doc_id long, text string")
    made = decontaminate.decontaminate(docs, bench)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["row"]["doc_id"]: (r["n_hit"], r["items"]) for r in made.collect()} == {i: (80, [str(i)]) if i % 2 else (0, []) for i in range(200)}


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "A, b"), (2, None), (None, "x y z"), (3, ""), (1, "a b"), (10, "word " * 12)], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 20):  # one block of windows, and several
        got = sorted((r["row"]["doc_id"] or -1, r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(odd, bench, block_bytes=block).collect())
        assert got == [(-1, 0, 0, ()), (-1, 6, 3, ()), (1, 0, 0, ()), (2, 0, 0, ()), (3, 2, 2, ("1",)), (3, 2, 2, ("1",)), (4, 40_000, 40_000, ("10",))]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(odd, bench.limit(0)).collect()} == {0}


def test_contamination_spans_are_of_the_original_text(spark):
    text = "Größe! The Quick-brown FOX… jumps"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "the quick brown fox…")], "item_id long, text string")
    r = decontaminate.decontaminate(docs, bench).first()
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["The Quick-brown FOX…"]


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.tokenizer_path())
    tool.no_truncation()
    tool.no_padding()
    texts = [t for _, t in documents()] + ["", " ", "\x00\x85 x", "ΣΑΣ İ ﬁ é <|endoftext|>a<|startoftext|>", "日本語👍🏽 it's I'LL", "aaaa" * 500, "!" * 300, "1234567", "ǅ ŉ ß ẞ"]
    own = bpe.bpe(queries.tokenizer_path())
    encoded = own.encode_batch(texts)
    for text, ids, theirs in zip(texts, encoded, tool.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == theirs.ids, text[:60]
        assert own.decode(ids) == tool.decode(theirs.ids, skip_special_tokens=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(docs, queries.tokenizer_path()).select("row.doc_id", "ids")
    decoded = {r["row"]["doc_id"]: r["decoded"] for r in bpe.decode(ids, queries.tokenizer_path()).collect()}
    assert decoded == {i: own.decode(x) for i, x in enumerate(encoded)}
    assert sorted(r["n_tokens"] for r in bpe.round_trip(odd, queries.tokenizer_path(), keep=tuple(odd.columns)).collect()) == [0, 0, 0, 2, 2, 8, 40_000]


def test_bpe_of_every_code_point_and_of_long_words(spark, empty):
    from tokenizers import Tokenizer

    tool, own = Tokenizer.from_file(queries.tokenizer_path()), bpe.bpe(queries.tokenizer_path())
    tool.no_truncation()
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rng = np.random.RandomState(7)
    texts = ["".join(f"a{chr(c)}b !{chr(c)}! 1{chr(c)} " for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    texts += ["".join(map(chr, rng.choice(points[:0x2500], 20))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("abcdefgh"), n)) for n in (999, 1001, 5000)] + ["a" * 3000, "ab" * 2000, "!" * 2500]
    for text, ids, theirs in zip(texts, own.encode_batch(texts), tool.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == theirs.ids, text[:40]
    assert bpe.round_trip(empty, queries.tokenizer_path()).count() == 0


def test_media_round_trip(spark, odd):
    for payload in (bytes(64), bytes(range(256)) * 5, b"x" * 640):
        assert media.from_wav(media.to_wav(payload)) == payload
    stored = media.with_media(odd).select("row.doc_id", "n_bytes", "media")
    got = media.media_features(stored, keep=("doc_id", "n_bytes")).collect()
    assert sorted(r["payload_bytes"] for r in got) == [64, 64, 64, 64, 64, 64, 200_000]
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= r["row"]["n_bytes"] and r["media_bytes"] == r["payload_bytes"] + 44 for r in got)
    texts = dict(documents())
    for r in queries.op7_media(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r["n_bytes"] == len(raw) and r["payload_sha256"] == hashlib.sha256(padded).hexdigest()


def _slow_pairs(samples):
    """Peak pairs by plain sums over each frame, one frequency at a time."""
    frames = [samples[at : at + 256] for at in range(0, max(len(samples) - 256, 0) + 32, 32)]
    if len(samples) > 256 and (len(samples) - 256) % 32 == 0:
        frames = frames[: (len(samples) - 256) // 32 + 1]
    if len(frames) <= 12:
        frames = [samples[at : at + 256] for at in range(0, len(samples) + 12 * 32, 32)]
        frames = frames[: -(-len(samples) // 32) + 12]
    bins = []
    for frame in frames:
        x = [(v - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * i / 255)) for i, v in enumerate(frame)]
        loud = {k: round(abs(sum(v * cmath.exp(-2j * math.pi * k * i / 256) for i, v in enumerate(x))), 3) for k in range(1, 129)}
        bins.append([max(range(lo, lo + 64), key=lambda k: (loud[k], -k)) for lo in (1, 65)])
    held = -(-len(samples) // 32)
    return sorted((t << 32) | (a << 16) | (b << 4) | step for step in (8, 12) for t in range(min(len(bins) - step, held)) for a in bins[t] for b in bins[t + step])


def test_fingerprints_equal_plain_sums():
    rng = np.random.RandomState(5)
    for n in (64, 128, 448, 576, 640, 1024):
        samples = rng.randint(0, 256, n).astype(np.uint8).tobytes()
        assert media.fingerprint(samples).tolist() == _slow_pairs(samples), n


def test_features_of_short_texts_differ(spark):
    rng = np.random.RandomState(6)
    texts = ["".join(rng.choice(list("etaoin shrdlu"), n)) for n in rng.randint(5, 480, 300)]
    stored = media.with_media(spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string"))
    got = [(r["row"]["doc_id"], r["feature"]) for r in media.media_features(stored.select("row.doc_id", "media")).collect()]
    assert len(got) == 600 and len(set(got)) == 300
    # Texts of a frame or two have few peaks, so some of them share a feature; longer ones don't.
    longer = [i for i, t in enumerate(texts) if len(t) > 128]
    assert len({f for i, f in got if i in longer}) == len(longer)
    assert len({f for _, f in got}) >= 270
    assert all(f.split(":")[0] != "0" for _, f in got)


def test_fingerprints_find_a_part(spark):
    rng = np.random.RandomState(0)
    whole = rng.randint(0, 256, 256 * 40).astype(np.uint8).tobytes()
    df = spark.createDataFrame([("whole", media.fingerprint(whole).tolist()), ("other", media.fingerprint(bytes(reversed(whole))).tolist())], "doc_id string, fingerprint array<long>")
    probe = spark.createDataFrame([("part", media.fingerprint(whole[256 * 10 : 256 * 20]).tolist())], "doc_id string, fingerprint array<long>")
    got = media.matching_offsets(df, probe).collect()
    assert [(r["probe"], r["id"], r["offset"]) for r in got] == [("part", "whole", 10)]


def test_fingerprints_find_parts_at_any_sample(spark):
    rng = np.random.RandomState(2)
    whole = {f"w{i}": rng.randint(0, 256, 10_240).astype(np.uint8).tobytes() for i in range(10)}
    starts = {f"{w}:{at}": (w, int(at)) for w in whole for at in rng.randint(0, 10_240 - 1280, 10)}
    for w, at in starts.values():  # brute force: the part stands once in its whole, in no other
        assert [whole[x].find(whole[w][at : at + 1280]) for x in sorted(whole) if whole[w][at : at + 1280] in whole[x]] == [at]
    table = spark.createDataFrame([(w, media.fingerprint(x).tolist()) for w, x in whole.items()], "doc_id string, fingerprint array<long>")
    probes = spark.createDataFrame([(p, media.fingerprint(whole[w][at : at + 1280]).tolist()) for p, (w, at) in starts.items()], "doc_id string, fingerprint array<long>")
    best = {}
    for r in media.matching_offsets(table, probes).collect():
        best[r["probe"]] = max(best.get(r["probe"], (0,)), (r["votes"], r["id"], r["samples"]))
    hits = sum(p in best and best[p][1] == w and abs(best[p][2] - at) <= 32 for p, (w, at) in starts.items())
    assert hits >= 0.98 * len(starts)


def test_equal_media_are_joined_once(spark):
    rng = np.random.RandomState(5)
    prints = [media.fingerprint(rng.randint(0, 256, 5_120).astype(np.uint8).tobytes()).tolist() for _ in range(3)]
    rows = [(f"{i}-{n}", p) for i, p in enumerate(prints) for n in range(20)] + [("null", None), ("none", []), ("0-0", prints[0])]
    df = spark.createDataFrame(rows, "doc_id string, fingerprint array<long>")
    found = Counter((r["probe"], r["id"]) for r in media.matching_offsets(df, df).where("offset = 0").collect())
    alone = {(i, j) for i in range(3) for j in range(3) if sum((Counter(prints[i]) & Counter(prints[j])).values()) >= 5}
    want = Counter((a, b) for a, p in rows for b, q in rows if p and q and (int(a[0]), int(b[0])) in alone and p == q)
    assert {k: v for k, v in found.items() if k[0][0] == k[1][0]} == dict(want)
    assert media.matching_offsets(df.limit(0), df).count() == 0


def test_language_of_held_out_documents(spark):
    docs = {r[0]: r[1] for r in duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    got = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd, empty):
    model = langid.fit(odd)
    assert model["labels"] == ["de", "en"]
    got = {(r["row"]["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (4, "de")} <= got
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def test_no_label_is_left_out(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.RandomState(4)
    data = [(i, " ".join("".join(alphabet[x] for x in rng.randint(0, 26, 6)) for _ in range(30)), f"l{i % 300:03}") for i in range(310)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model["labels"] == [f"l{i:03}" for i in range(300)]
    one, some = ({r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model, block=b).collect()} for b in (300, 256))
    assert {d: x for d, (x, _) in some.items()} == {d: x for d, _, x in data}
    assert all(one[d][0] == some[d][0] and abs(one[d][1] - some[d][1]) < 1e-5 for d in one)


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Der schnelle  Fuchs, 12 läuft über-all hin " * 9
    whole = np.sort(langid.grams([text])[0])
    monkeypatch.setattr(langid, "BLOCK_CHARS", 7)
    assert np.array_equal(np.sort(langid.grams([text])[0]), whole)


def test_pages_give_their_articles(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    import html

    for r in queries.op3_html(spark, SF).collect():
        inner = pages[r["page_id"]].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>", ""),
        ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        ("<article><p>One &amp; two&nbsp;<b>th</b>ree<br>four<div class='ad'>Buy</div><section class=comments><article>No</article></section></article><p>Foot", "One & two three four"),
        ("<div class=sidebar>Side words here</div><main><h1>T</h1><form>Mail</form><p>Long enough text of the page.</p><aside>x</aside></main>", "T Long enough text of the page."),
        ("<body><div><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div><p>Plain words stand here, and more of them follow.<p>Also here.</div><footer>f</footer>", "Plain words stand here, and more of them follow. Also here."),
        ("<article>cut <scr", "cut"),
        ("<article>a<script>x</scr", "a"),
        ("<article>a <!-- b", "a"),
        ("<article><div class='article-header'><h1>Head line</h1></div><p data-id='share-4'>Body of the text.</p></article>", "Head line Body of the text."),
        ("<article><p>First part of it.</p><section id='related-work'><h2 id='warning-signs'>Signs</h2><p>More words here.</p></section></article>", "First part of it. Signs More words here."),
        ("<nav><a href=a>Home</a></nav><div class='content side-by-side'><p>Only text of the page stands here.</p></div><footer>All rights reserved</footer>", "Only text of the page stands here."),
        ("<div class=content><p>The story itself is told in this place, in many words.</p></div><article class=teaser><a href=x>Short teaser</a></article>", "The story itself is told in this place, in many words."),
        ("<main><p>Words of the main text are here.</p><aside><article>related story told again</article></aside><p>End of it.</p></main>", "Words of the main text are here. End of it."),
        ("<form id=f><nav><a href=x>Home</a></nav><div class=content><p>All of this page stands in a form, as some do.</p></div><footer>Foot</footer></form>", "All of this page stands in a form, as some do."),
        ("<footer>Only a footer here</footer>", ""),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<ARTICLE><P>İ upper case tags.</P></ARTICLE>", "İ upper case tags."),
    ],
)
def test_pages_of_other_kinds(page, text):
    assert html_text.extract(page) == text


def test_odd_pages_take_linear_time():
    import time

    html_text.extract("<p>weights are learned here")
    for page in ("<div>" * 20_000 + "x", "<a " * 20_000, "<script " * 20_000, "<script>" * 20_000, '<a b="' * 20_000, "<!-" * 20_000 + "<!--" * 20_000, "<" * 50_000, "<p>" * 20_000):
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 2, page[:20]


def brute_region(scores):
    return max(((sum(scores[i:j]), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0))


def test_region_is_the_best_of_all():
    rng = np.random.RandomState(6)
    weights = {"alone": 1.0, "beside": -1.0, "link": -2.0, "p": -0.5, "div": -3.0}
    for _ in range(200):
        parsed = [html_text.Token("word", False, "", int(rng.randint(1, 4)), False, bool(rng.rand() < 0.4), "plain", 0.0, -1, ()) if rng.rand() < 0.6 else html_text.Token(f"tag:{rng.choice(['p', 'div'])}", True, "", 0, False, False, "plain", 0.0, -1, ()) for _ in range(12)]
        scores = [t.words * (weights["link"] if t.link else weights["alone"]) if t.kind == "word" else weights[t.kind[4:]] for t in parsed]
        begin, end = html_text._region(parsed, weights)
        assert abs(sum(scores[begin:end]) - max(0, brute_region(scores)[0])) < 1e-9


def test_pages_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [(r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()] == [("", 0), ("", 0)]


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,units:long>"
    data = [
        (1, 1, "assistant", [("text", "a<b\\l", None, None), ("image", None, "i.png", 10), ("text", None, None, None)]),
        (1, 0, "us>er&", [("audio", None, "a.wav", 2), ("text", "</turn>\n<turn x>\n", None, None)]),
        (2, None, None, None),
        (None, 0, "assistant", []),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, content array<{part}>")
    out = chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("masked", chat.masked_texts(F.col("formatted"), F.col("turns")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["read"]] == [("us>er&", "<audio/></turn>\n<turn x>\n"), ("assistant", "a<b\\l<image/>")]
    assert list(got[1]["masked"]) == ["", "a<b\\l<image/>"]
    assert [(a["turn"], a["part"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, 1, "a.wav", 52), (1, 2, "i.png", 12)]
    assert got[1]["n_expanded"] == 64 and sum(t["chars"] for t in got[1]["turns"]) == len(got[1]["formatted"])
    assert [(t["role"], t["text"]) for t in got[2]["read"]] == [("", "")] and [t["text"] for t in got[None]["read"]] == [""]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom = url_filter.build_filter(keys)
    h = np.array([r[0] for r in keys.select(F.xxhash64("key")).collect()])
    assert url_filter.probe(bloom, h).all()
    other = np.array([r[0] for r in spark.range(20_000).select(F.xxhash64(F.concat(F.lit("x"), F.col("id").cast("string")))).collect()])
    assert url_filter.probe(bloom, other).mean() < 0.05


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no-scheme.net/", "http://A.NET", "http://a.net/", "http://x.example.net/en/1?q", "ftp://Example.com/de/#x", "http://example.net/en", "http://b.org/fr/x", "http://b.org/f", "http://notexample.com/de/", "http://a\nb.net/\nc?d"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = Counter((r["row"]["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect())
    assert got[(4, "a.net", "net/", "block")] == 2 and got[(3, "a.net", None, "allow")] == 1 and got[(0, "", None, "allow")] == 1 and got[(2, "", None, "allow")] == 1
    assert got[(5, "x.example.net", "example.net/en/", "allow")] == 1 and got[(6, "example.com", "example.com/de/", "block")] == 1 and got[(7, "example.net", "net/", "block")] == 1
    assert got[(8, "b.org", "org/fr/", "allow")] == 1 and got[(9, "b.org", None, "allow")] == 1 and got[(10, "notexample.com", None, "allow")] == 1 and got[(11, "a\nb.net", "net/", "block")] == 1


def test_long_rules_and_hosts(spark):
    rules = spark.createDataFrame([("a.net", "/" + "x" * 3000, "block"), ("net", "/", "allow"), ("b.org", "", "block"), ("q." * 40 + "com", "/z", "block")], "host string, path string, verdict string")
    urls = ["http://w.a.net/" + "x" * 3001, "http://a.net/" + "x" * 2999, "http://" + "l." * 40_000 + "b.org/p", "http://" + "q." * 41 + "com/zz", "http://" + "q." * 39 + "com/zz", "http://ab.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["row"]["page_id"]: (r["rule"] and r["rule"][:6], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("a.net/", "block"), 1: ("net/", "allow"), 2: ("b.org", "block"), 3: ("q.q.q.", "block"), 4: (None, "allow"), 5: (None, "allow")}
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_batches_of_a_generation_come_again(spark, empty):
    rollup = token_counts.Rollup(spark, shared_dir(spark))
    assert rollup.totals().count() == 0
    rows = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], "source string, lang string, version string, docs long, tokens long")
    for batch, n in ((1, 3), (2, 5), (4, 7)):
        rollup.commit(batch, rows(n))
    rollup.compact(2)
    for batch, n in ((1, 3), (3, 11), (2, 5), (4, 7)):
        rollup.commit(batch, rows(n))
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(4, 26)]
    rollup.commit(4, token_counts.counted(empty, "space-1"))  # a batch that comes again without rows has none
    rollup.compact(4)
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(3, 19)]


def test_rollup_commits_are_idempotent(spark, odd):
    rollup = token_counts.Rollup(spark, shared_dir(spark))
    first = token_counts.counted(odd, "space-1")
    for _ in range(2):
        rollup.commit(1, first)
    total = lambda: {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert total()[("s", "de", "space-1")] == (1, 40_000) and total()[(None, "en", "space-1")] == (2, 4)
    rollup.commit(2, token_counts.counted(odd.where("doc_id = 4"), "space-1", -1))
    assert ("s", "de", "space-1") not in total()
    before = total()
    rollup.compact(2)
    assert total() == before


def test_repeated_passages_go(spark, odd, empty):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen. And the last of them is here."
    data = [(2, f"Own start of this. {passage} Own end of it."), (1, f"{passage}\nOther words follow it."), (3, "Nothing repeated here at all, not one sentence of it. Fine."), (4, f"A. {passage} B. {passage}"), (5, None), (6, "")]
    got = {r["row"]["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1]["text"] == data[1][1] and got[3]["text"] == data[2][1] and got[5]["text"] is None and got[6]["text"] == ""
    assert got[2]["text"] == "Own start of this. Own end of it." and got[2]["n_removed"] == 4
    assert got[4]["text"] == "A. B."
    assert substring_dedup.remove_repeats(odd, keep=tuple(odd.columns)).where("n_removed > 0 and row.doc_id <> 4").count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def brute_removed(rows, run=3, least=12):
    """Removed sentences by document, from the sentences' own words: runs of ``run`` sentences, or more up to ``least`` words."""
    from tarmac.llm.substring_dedup import sentences

    first, own = {}, {}

    def runs(s):
        for i in range(len(s)):
            words = []
            for j in range(i, len(s)):
                words += s[j]
                if j - i + 1 >= run and len(words) >= least:
                    yield i, j + 1, tuple(words)
                    break

    for d, t in sorted(rows):
        raw = t.encode()
        begin, _, starts, _, _ = sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        own[d] = [tuple(w[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        for i, _, span in runs(own[d]):
            first.setdefault(span, (d, i))
    out = {}
    for d, s in own.items():
        gone = set()
        for i, j, span in runs(s):
            if first[span] != (d, i):
                gone |= set(range(i, j))
        out[d] = (len(s), len(gone))
    return out


def test_short_sentences_make_longer_runs(spark):
    passage = " ".join(f"{w}!!" for w in "a few words that each end with two marks stand here in a row and repeat".split())
    data = [(1, f"First of all this one. {passage} It ends so."), (2, f"{passage} Another end."), (3, "no " * 90), (4, "no " * 100)]
    got = {r["row"]["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "Another end." and got[4]["n_removed"] >= 3


def test_removed_sentences_equal_brute_force(spark):
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"]) for r in queries.op10_substrings(spark, SF).collect()}
    assert got == brute_removed(documents())


def test_passages_at_any_place_go(spark):
    rng = np.random.RandomState(5)
    rows, planted = [], []
    for i in range(400):
        vocabulary, stops = [(4000, 0.0), (4000, 0.05), (40, 0.0), (4000, 0.04), (3, 0.0)][i % 5]

        def text(n, vocabulary=vocabulary, stops=stops, i=i):
            return [f"{'pq'[i % 2]}{i}x{x}{'.' if y < stops else ''}" for x, y in zip(rng.randint(0, vocabulary, n), rng.rand(n), strict=True)]

        passage = text(rng.randint(51, 101))
        for k in range(2):
            before, after = ([f"{w}o{k}" for w in text(rng.randint(0, 60))] for _ in range(2))
            rows.append((2 * i + k, " ".join(before + passage + after)))
            planted.append((len(before), len(before) + len(passage)))
    got = {r["row"]["doc_id"]: r["text"].split() for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {d: t.split() for d, t in rows}
    for i in range(400):
        if i % 5 == 4:  # of three words, a passage repeats itself
            assert len(got[2 * i + 1]) < len(whole[2 * i + 1])
            continue
        a, b = planted[2 * i + 1]
        d, old, new = 2 * i + 1, whole[2 * i + 1], got[2 * i + 1]
        # Split by words: what stays is the text around the passage, whole, and a few words at the passage's ends.
        assert new[:a] == old[:a] and new[len(new) - (len(old) - b) :] == old[b:]
        assert len(new) - a - (len(old) - b) <= 40 and len(new) < len(old), d
        assert i % 5 == 2 or got[2 * i] == whole[2 * i]


def test_pipeline_keeps_one_row_of_near_copies(spark):
    import corpus_pipeline as p

    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    near = text("a") + " more"
    data = [(1, text("a"), "en", "t", 1), (1, text("a"), "en", "s", 1), (2, near, "en", "s", 1), (2, text("b"), "en", "s", 1), (None, text("a"), "en", "s", 1)]
    data += [(None, text("c"), "en", "s", 1), (None, text("c"), "en", "s", 1), (None, text("d"), "en", "s", 1), (5, text("d"), "en", "s", 1), (3, None, "en", "s", 1), (3, None, "en", "s", 1)]
    kept = Counter(tuple(r) for r in p.near_duplicates(spark, spark.createDataFrame(data, DOC), SF).collect())
    assert kept == Counter([data[1], data[3], data[5], data[8], data[9], data[10]])


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, known = docs.columns, dict(documents())
    for i, (_, stage) in enumerate(p.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.mode("overwrite").parquet(path := f"{shared_dir(spark)}/{i}")
        docs = spark.read.parquet(path)
        ids = {r[0] for r in docs.select("doc_id").collect()}
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        assert ids <= set(old)
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
        if i == 1:
            comps = brute_components(list(old.items()))
            assert ids == {d for d in old if comps[d][1] == d}
        if i == 2:
            removed = brute_removed(list(old.items()))
            texts = dict(docs.select("doc_id", "text").collect())
            assert all(texts[d] == old[d] for d in ids if removed[d][1] == 0) and ids >= {d for d in old if removed[d][0] > removed[d][1]}
        if i == 3:
            items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
            clean = {d for d, t in old.items() if not brute_leaks(t, list(enumerate(items)))[0]}
            assert ids == clean
    assert "ids" in docs.columns and ids <= set(known)
    run = {r["doc_id"]: r["ids_sha256"] for r in p.run(spark, SF).collect()}
    assert run == {r["doc_id"]: r["ids_sha256"] for r in docs.collect()}
