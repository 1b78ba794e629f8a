"""Operators over a whole corpus against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from vecflow.llm import backoff, decontamination, language, links, mixing, oddsketch, queries, simhash, sql, tokens
from vecflow.llm.common import WordHashes

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# ---- language


def test_language_held_out_accuracy(documents):
    model = language.fit(documents, rows=80)
    rows = language.identify(language.documents(documents.withColumn("none", F.lit(None).cast("string")), model, F.struct("doc_id", "lang"), lang="none"), model)
    found = rows.select("row.lang", "found.lang", "found.kept").toDF("truth", "lang", "kept").collect()
    assert len(found) == documents.count()
    assert np.mean([r["truth"] == r["lang"] for r in found]) >= 0.97 and all(r["kept"] for r in found)


def test_language_evidence_is_fused(spark, documents):
    model = language.fit(documents)
    rng = random.Random(2)
    junk = " ".join("".join(rng.choice("qxzjkvwbpf") for _ in range(9)) for _ in range(60))
    pages = [(i, f"https://haus.example.de/de/{i}", f'<html lang="de"><script>the of and</script><p>{t}</p></html>') for i, t in enumerate(["Die Schachtel und der Einer ist nicht auf der Erde"] * 60 + ["in"])]
    pages += [(100, "https://x.example.com/1", f"<p>{junk}</p>"), (101, "https://x.example.com/2", "<p>123 *** </p>"), (102, None, None), (103, "no address", "<html LANG='fr'>la que de les un est la que de les")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    seen = language.pages(df, model, F.col("page_id"))
    found = {r["row"]: r["found"] for r in language.identify(seen, model).collect()}
    assert found[60]["lang"] == "de" and found[60]["kept"]  # a word of several languages: host and codes decide
    assert found[100]["lang"] == "und" and not any(found[i]["kept"] for i in (100, 101, 102))
    assert found[101]["text_lang"] is None and found[103]["lang"] == "fr" and found[103]["declared"] == "fr"
    assert {r["host"]: r["suffix"] for r in seen.select("host", "suffix").collect()}["haus.example.de"] == "de"


def test_visible_text():
    page = "<style>a{}</style><p>x&amp;y <b>z</b><!-- hidden --><script>var t='</p>';</script>"
    assert language.visible(page).split() == ["x&y", "z"]


def test_language_edges(messy, nothing):
    kept = language.accepted(messy)
    assert kept.columns == messy.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 2 and ids[6] == 1 and not {3, 4, 5} & set(ids)
    assert language.accepted(nothing).count() == 0


def test_language_fit_knows_rare_labels(spark):
    words = {"en": "the house of and with from that", "de": "der die das und nicht auf ist", "cy": "mae yn ddigon llawer gwynt cymru"}
    rng = random.Random(6)
    said = lambda x: " ".join(rng.choice(words[x].split()) for _ in range(30))
    rows = [(i, said("en"), "en", "a", 1) for i in range(3_000)] + [(None, said("de"), "de", "a", 1) for _ in range(3_000)] + [(1, said("en"), "en", "a", 1)] * 500
    rows += [(9_000 + i, said("cy"), "cy", "a", 1) for i in range(3)]
    df = frame(spark, rows)
    labels, sample = language.sampled(df, "doc_id", "text", "lang", 100, 3)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert labels == ["cy", "de", "en"] and counts["cy"] == 3 and all(20 <= counts[x] <= 90 for x in ("de", "en"))
    model = language.fit(df, rows=100)
    found = language.identify(language.documents(df.where("lang = 'cy'"), model, F.col("doc_id")), model).select("found.*").collect()
    assert [(r["lang"], r["declared"], r["kept"]) for r in found] == [("cy", "cy", True)] * 3


# ---- mixing


def water_filled(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def check_mix(rows, given):
    by_id = {i: (t, s) for i, t, s in given}
    sizes = collections.Counter()
    for i, t, s in given:
        sizes[s] += len(SPACED.findall(t or ""))
    target, taken = water_filled(sizes), collections.Counter()
    assert len(rows) == len(given)
    for r in rows:
        text, source = by_id[r["doc_id"]]
        assert r["size"] == len(SPACED.findall(text or "")) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source]) and 0 <= r["taken"] <= 2 * r["size"]
        assert not r["size"] or r["taken"] % r["size"] == 0
        taken[source] += r["taken"]
    return target, taken


def test_mix_of_all_documents(spark, folder, documents):
    given = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    rows = queries.op3_mixing(spark, folder).collect()
    target, taken = check_mix(rows, given)
    largest = collections.Counter()
    for i, t, s in given:
        largest[s] = max(largest[s], len(SPACED.findall(t)))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.1 * target[s], largest[s] / 2)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3_mixing(spark, folder).collect()))


def test_mix_of_many_documents_is_near_its_targets(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 90 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    sums = mixing.report(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 and r["most"] <= 2 for r in sums) and len(sums) == 8


def test_mix_favours_nothing_but_its_weights(spark):
    """Over seeds a document's share of copies is near what the plan expects."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") < 300, 4).otherwise(64)).alias("text"), F.lit("a").alias("source"))
    share = [mixing.report(rows, share=0.5, seed=s).groupBy(F.col("size") > 4).agg(F.avg((F.col("taken") > 0).cast("int"))).collect() for s in range(4)]
    mean = {big: np.mean([dict(x)[big] for x in share]) for big in (True, False)}
    assert mean[True] / mean[False] == pytest.approx(1.75 / 1.25, rel=0.15)  # appeal 1 + 6/8 against 1 + 2/8


def test_mix_edges(messy, nothing):
    rows = mixing.report(messy).collect()
    assert len(rows) == messy.count() and {r["taken"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    again = [r["taken"] for r in rows if r["doc_id"] == 1]
    assert len(set(again)) == 1  # repeated rows together
    assert mixing.report(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    mixed = mixing.mixed_rows(messy)
    assert mixed.columns == messy.columns and mixed.where("text IS NULL").count() == 0


# ---- language-model scores


def backoff_scores(documents, order=3, alpha=0.4):
    words = [(t or "").encode().lower().split() for t in documents]
    count = lambda w: [collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total = [sum((count(w)[k] for w in words), collections.Counter()) for k in range(order)]
    everything = sum(map(len, words))
    for w in words:
        own, rest, score, seen = count(w), everything - len(w), 0.0, [0] * (order + 1)
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        for j in range(len(w)):
            factor = 0.0
            for k in range(min(order, j + 1), 0, -1):
                gram = tuple(w[j - k + 1 : j + 1])
                if left(gram) > 0:
                    score += factor + math.log(left(gram) / (left(gram[:-1]) if k > 1 else rest))
                    seen[k] += 1
                    break
                factor += math.log(alpha) if k > 1 else 0.0
            else:
                score += factor + math.log(alpha / max(rest, 1))
                seen[0] += 1
        yield len(w), score, seen


def test_backoff_of_all_documents(spark, folder, texts):
    rows = {r["doc_id"]: r for r in queries.op4_backoff(spark, folder).collect()}
    assert set(rows) == set(texts)
    for i, (n, score, seen) in zip(texts, backoff_scores(texts.values())):
        r = rows[i]
        assert r["n_words"] == n and [r[f"seen_{k}"] for k in range(4)] == seen
        assert r["log_score"] == pytest.approx(score, abs=1e-3)


def test_backoff_is_the_same_in_any_chunks(messy, documents, monkeypatch):
    some = documents.select("doc_id", "text").union(messy.select("doc_id", "text"))
    whole = sorted(backoff.report(some).collect(), key=repr)
    monkeypatch.setattr(backoff, "CHUNK", 20_000)
    monkeypatch.setattr(backoff, "BUCKET_GRAMS", 5_000)
    assert sorted(backoff.report(some).collect(), key=repr) == whole


def test_backoff_edges(messy, nothing):
    rows = backoff.report(messy).collect()
    assert len(rows) == messy.count()
    empty = [r for r in rows if r["n_words"] == 0]
    assert len(empty) == 4 and {(r["log_score"], r["mean_log_score"]) for r in empty} == {(0.0, None)}
    assert backoff.report(nothing).count() == 0


def test_backoff_merges_no_n_grams(spark):
    """10,000 documents: as many hashes as n-grams, all scores finite and as in SQL."""
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {r[0]: r for r in con.execute(sql.BACKOFF).fetchall()}
    rows = {r["doc_id"]: tuple(r) for r in queries.op4_backoff(spark, folder).collect()}
    assert rows.keys() == want.keys()
    for i, (_, n, score, mean, *seen) in rows.items():
        assert (n, seen) == (want[i][1], list(want[i][4:]))
        assert score == pytest.approx(want[i][2], abs=1e-3) and (mean is None if want[i][3] is None else mean == pytest.approx(want[i][3], abs=1e-5))


def test_backoff_without_a_context_backs_off():
    grams = backoff.Grams(zstandard.compress(b"a b"), struct.pack("<qq", 1, 2) + np.array([7, 1, 3], "<i8").tobytes(), 2, WordHashes())
    totals = [np.where(np.arange(2) == grams.number[0][0], 1, 5), np.array([6])]
    (row,) = backoff.scored(grams, totals, 12, 2, 0.4, True).to_pylist()
    assert row["seen"] == [1, 1, 0]
    assert row["log_score"] == pytest.approx(math.log(0.4 / 10) + math.log(4 / 10) + math.log(0.4))


# ---- decontamination


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def leaks(text, items):
    """Items with a diagonal whose overlap is close enough; all diagonals are looked at, whatever the masks."""
    w, found = WORDS.findall((text or "").lower()), set()
    for number, item in items:
        t = WORDS.findall((item or "").lower())
        if not t:
            continue
        for d in range(-len(t) + 1, len(w)):
            span = range(max(0, -d), min(len(t), len(w) - d))
            equal = [w[d + j] == t[j] for j in span]
            now = best = 0
            for e in equal:
                now = max(0, now + (1 if e else -4))
                best = max(best, now)
            if sum(equal) >= 0.8 * len(t) - 1e-9 or best >= decontamination.MIN_RUN:
                found.add(number)
    return found


def test_decontamination_with_substitutions(spark, texts):
    rng = random.Random(5)
    items = [(i, " ".join(f"b{rng.randrange(400)}" for _ in range(rng.randrange(7, 45)))) for i in range(12)] + [(12, "too short to tell"), (13, None), (None, "the quick brown fox jumps over the lazy dog")]
    rows = []
    for i, t in enumerate(list(texts.values())[:60]):
        words = t.split()[:200]
        item = items[i % 12][1].split()
        if i % 3:
            rate = (0.0, 0.1, 0.25, 0.5)[i % 4]
            item = [x if rng.random() >= rate else "other" for x in item][: len(item) if i % 5 else len(item) // 2]
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        rows.append((i, " ".join(words), None, None, None))
    rows += [(100, "too short to tell", None, None, None), (101, None, None, None, None), (102, "the quick brown fox jumps over the lazy dog", None, None, None), (None, items[0][1], None, None, None)]
    bench = spark.createDataFrame([x + ("e",) for x in items], "item_id long, text string, extra string")
    found = decontamination.report(frame(spark, rows), bench).collect()
    assert len(found) == len(rows)
    for r in found:
        want = set() if r["doc_id"] is None else leaks(dict((x[0], x[1]) for x in rows)[r["doc_id"]], [x for x in items if x[0] is not None])
        assert {int(x) for x in r["items"].split(",") if x} == want and r["leaked"] == bool(want) and r["n_items"] == len(want)


@pytest.mark.parametrize("words", range(1, 20))
def test_no_substitution_hides_an_item(words):
    """Every way to substitute a fifth of the words leaves some mask a hit."""
    most = max(n for n in range(words) if 10 * (words - n) >= 8 * words)
    masks = decontamination.masks_of(words)
    places = [{p + k for k, bit in enumerate(m) if bit == "1"} for m in masks for p in range(words - len(m) + 1)]
    assert all(any(p.isdisjoint(gone) for p in places) for gone in itertools.combinations(range(words), most))


def test_short_items(spark):
    """Items of 1 to 15 words, whole, with substitutions and cut, against the search of all diagonals, and in SQL."""
    rng = random.Random(8)
    items = [(n, " ".join(f"s{n}w{rng.randrange(40)}" for _ in range(n))) for n in range(16)]
    rows = []
    for n, item in items:
        for gone in range(4):
            words = item.split()
            for at in rng.sample(range(n), min(gone, n)):
                words[at] = "other"
            rows.append((len(rows), " ".join(["before", "it", *words, "after", "s3w1"]), None, None, None))
            rows.append((len(rows), " ".join(words[gone:]), None, None, None))
    rows += [(len(rows), "Well, what is THE capital of France?", None, None, None), (len(rows) + 1, "the capital of france", None, None, None)]
    items.append((16, "What is the capital of France"))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.report(docs, bench).collect()}
    want = {r[0]: leaks(r[1], items) for r in rows}
    assert {i: {int(x) for x in r["items"].split(",") if x} for i, r in found.items()} == want
    assert found[len(rows) - 2]["items"] == "16" and not found[len(rows) - 1]["leaked"]
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    connection.register("benchmark", bench.toPandas())
    told = connection.sql(sql.DECONTAMINATION).fetchall()
    columns = ("doc_id", "leaked", "n_items", "items", "matched", "share")
    assert sorted(told) == sorted(tuple(r[c] for c in columns) for r in found.values())


def test_decontamination_drops_only_leaks(spark, folder, documents, texts):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    whole = {i for i, t in texts.items() if any(" ".join(WORDS.findall(x.lower())) in " ".join(WORDS.findall(t.lower())) for _, x in items)}
    kept = {r["doc_id"] for r in decontamination.clean(documents, bench).collect()}
    assert whole and kept == set(texts) - whole


def test_decontamination_edges(messy, nothing, spark):
    bench = spark.createDataFrame([(1, "over the lazy dog and runs away into the dark"), (1, "over the lazy dog and runs away into the dark")], "item_id long, text string")
    rows = decontamination.report(messy, bench).collect()
    assert len(rows) == messy.count() and {r["doc_id"] for r in rows if r["leaked"]} == {1, 2}
    assert decontamination.clean(messy, bench).columns == messy.columns
    assert decontamination.report(nothing, bench).count() == 0
    assert decontamination.clean(messy, bench.limit(0)).count() == messy.count()


# ---- fingerprints


def edited_texts(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, cut = text or "", len(text or "") // 3
        yield i, len(text), hashlib.sha256((text[: len(text) - cut] + (following or "")[:cut]).encode()).hexdigest()


def check_fingerprints(found, rows):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in found) == sorted((i is None, i or 0, n, s) for i, n, s in edited_texts(rows))


@pytest.mark.parametrize("bucket", [7, 2_000])
def test_fingerprints_of_all_documents(spark, folder, texts, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    found = queries.op6_fingerprints(spark, folder).collect()
    check_fingerprints(found, list(texts.items()))
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in found}
    by_text = collections.defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(prints[i])
    assert all(len(x) == 1 for x in by_text.values())
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        r = next(x for x in found if x["doc_id"] == i)
        assert r["near_next"] == pytest.approx(1 - bin(prints[i] ^ prints[j]).count("1") / 64)
    assert np.mean([r["near_edited"] > r["near_next"] for r in found]) > 0.95
    near = {p: sum(0 < bin(p ^ q).count("1") <= simhash.RADIUS for q in set(prints.values())) for p in prints.values()}
    assert all(r["n_near"] == near[prints[r["doc_id"]]] for r in found)


def test_fingerprint_is_a_vote(spark):
    """The votes of a text's terms, counted one by one."""
    text = "one two three one two"
    w = text.split()
    terms = [(a, b) for a, b in zip(w, w[1:] + [None])]
    hashes = {r["x"]: r["h"] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(terms)], "x int, a string, b string").select("x", F.xxhash64("a", "b").alias("h")).collect()}
    votes = [sum((1 if (hashes[i] >> k) & 1 else -1) * min(16, len(a) + len(b or "")) for i, (a, b) in enumerate(terms)) for k in range(64)]
    got = simhash.votes(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first()["fingerprint"] % 2**64
    assert got == sum(1 << k for k in range(64) if votes[k] > 0)


def test_block_tables_find_all_near_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in base for _ in range(6)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= 3}
    df = spark.createDataFrame([(x,) for x in signed + signed[:5]] + [(None,)], "fingerprint long")
    for blocks in (4, 6, 8):
        assert {tuple(r) for r in simhash.near_pairs(df, 3, blocks).collect()} == want and want


def test_fingerprint_edges(messy, nothing, spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for bucket in (1, 3, 2_000):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
        check_fingerprints(simhash.report(messy).collect(), rows)
    assert simhash.report(nothing).count() == 0
    for lone in ([(5, "a b c")], [(None, "abc"), (None, "abc"), (None, "xyzxyz")], [(1, "abc")] * 3):
        check_fingerprints(simhash.report(spark.createDataFrame(lone, "doc_id long, text string")).collect(), lone)


# ---- near-duplicates


def linked(rows, size=4, similarity=80):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = SPACED.findall(lowered(t))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(texts, seed, number):
    rng, out = random.Random(seed), list(texts.items())
    for k in range(number):
        words = rng.choice(list(texts.values())).split()
        for _ in range(rng.randrange(1, 2 + len(words) // 15)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(5)}"
        out.append((10_000 + k, " ".join(words)))
    return out


def test_near_duplicates_with_edits(spark, texts, monkeypatch):
    rows = near_copies(texts, 7, 150)
    want = linked(rows)
    assert len({c for _, c in want.values()}) < len(want) - 20
    for shard in (4, 512):
        monkeypatch.setattr(oddsketch, "SHARD", shard)
        found = {r["doc_id"]: r for r in oddsketch.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_near_duplicates_of_all_documents(spark, folder, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_minhash(spark, folder).collect()}
    assert found == linked(texts.items())


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(8)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            common = rng.integers(0, 1 << 63, int(500 * share), np.uint64)
            own = [rng.integers(0, 1 << 63, (500 - len(common)) // 2, np.uint64) for _ in range(2)]
            sets = [np.unique(np.concatenate([common, x])) for x in own]
            sketch = oddsketch.odd_sketches(np.array([oddsketch.samples(s) for s in sets]))
            truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            errors.append(oddsketch.likeness(sketch[:1], sketch[1:])[0, 0] - truth)
        assert np.std(errors) * oddsketch.SLACK < 1.6 * (share - oddsketch.least_likeness(share)) and abs(np.mean(errors)) < 0.02


def test_near_duplicate_edges(messy, nothing):
    rows = oddsketch.groups(messy).collect()
    assert len(rows) == messy.count()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert {c for _, c, _ in got[1] | got[2]} == {1} and {(n, c, k) for n, c, k in got[3] | got[4]} == {(0, 3, True), (0, 4, True)}
    assert {c for _, c, _ in got[6] | got[7]} == {6} and got[None] == {(15, 1, False), (0, None, True)}
    assert oddsketch.groups(nothing).count() == 0
    left = oddsketch.deduplicated(messy)
    assert left.columns == messy.columns and {r["doc_id"] for r in left.collect()} >= {1, 3, 4, 5, 6, 8, 9, 10}
    assert left.where("doc_id IN (2, 7)").count() == 0


def test_one_row_of_each_group_stays(spark, messy):
    left = [r["doc_id"] for r in oddsketch.deduplicated(messy).collect()]
    assert sorted(left, key=lambda i: (i is None, i or 0)) == [1, 3, 4, 5, 6, 8, 9, 10, None]
    words = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    rows = [(None, words[0], "en", str(i % 3), 1) for i in range(9)]  # copies without an id
    rows += [(None, words[1] + " more", None, None, None), (None, words[1], None, "a", None), (7, words[1], "a", None, None)]  # near copies
    rows += [(5, words[2], "en", "a", 1), (5, words[3], "en", "a", 1), (5, words[3], "en", "a", 1)]  # two texts of one id
    rows += [(8, None, "en", "a", 1)] * 2 + [(None, None, None, None, None)] * 2
    left = collections.Counter((r["doc_id"], r["text"]) for r in oddsketch.deduplicated(frame(spark, rows)).collect())
    assert left == {(None, words[0]): 1, (7, words[1]): 1, (5, words[2]): 1, (5, words[3]): 1, (8, None): 1, (None, None): 2}


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 5)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(parent)}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_tokens(found, rows, tokenizer):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids, "<u2").tobytes()))
    start, want = 0, []
    for i, text in ordered:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i is None, i or 0, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(want)


def test_token_files_of_all_documents(spark, folder, texts, tokenizer):
    check_tokens(queries.op8_tokens(spark, folder).collect(), list(texts.items()), tokenizer)


def test_token_files_in_many_blocks(documents, texts, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 3_000)
    monkeypatch.setattr(tokens, "STRIDE", 2)
    found = tokens.round_trip(documents, queries.tokenizer_path(), ids_per_file=20_000)
    check_tokens(found.collect(), list(texts.items()), tokenizer)


def test_token_edges(messy, nothing, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    check_tokens(tokens.round_trip(messy, queries.tokenizer_path()).collect(), rows, tokenizer)
    assert tokens.round_trip(nothing, queries.tokenizer_path()).count() == 0


def test_pieces_give_the_ids_of_whole_texts(texts, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    coder = tokens.Encoder(queries.tokenizer_path())
    odd = ["", " ", "a  b", "a \n b", " lead", "trail ", "中 文 a", "x\n\n y　 z", "a b c", "it's  don't 's", "a\tb c\u0085 d", "<|endoftext|> a <|endoftext|>", "é x", "\n"]
    for text in odd + list(texts.values())[:80]:
        assert coder.encode(text) == coder.ids(text), repr(text[:40])


def test_a_word_is_merged_once_whatever_marks_follow(monkeypatch):
    merge, merged = tokens.Encoder.merged, []
    monkeypatch.setattr(tokens.Encoder, "merged", lambda self, text: (merged.append(text), merge(self, text))[1])
    text = "x " + " ".join(f"ontiwhle{mark}" for mark in (".", ",", "!!", "", "%%%", "."))
    coder = tokens.Encoder(queries.tokenizer_path())
    assert coder.encode(text) == coder.ids(text)
    assert sorted(merged) == sorted([" ontiwhle", ".", ",", "!!", "%%%"])
    merged.clear()
    coder, text = tokens.Encoder(queries.tokenizer_path()), text + "\nontiwhle\nontiwhle, ontiwhle."
    assert coder.encode_all(pa.array([text, text])).to_pylist() == [coder.ids(text)] * 2
    assert sorted(merged) == sorted([" ontiwhle", ".", ",", "!!", "%%%", "\n", "ontiwhle"])


def test_ids_of_many_texts_at_once(texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    monkeypatch.setattr(tokens, "WORDS", 200)
    monkeypatch.setattr(tokens, "WORD_BYTES", 8)
    coder = tokens.Encoder(queries.tokenizer_path())
    rng = np.random.default_rng(12)
    parts = ["a", "Was", "é", "ǅ", "ƻ", "ª", "×", "中", "12", "½", ".", "!!", "'s", "'", "-", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r", "\u00a0", "\u00ad", "\u3000", "<|endoftext|>", "|>", "\0", "🙂"]
    common = [p for p in parts if p[0] in "aW1.!-\n " and len(p.strip(" ")) < 4]
    odd = ["", "\n", "\n\n", "a\n\n", "a\n\nb", "a\n\n\nb", "\na", "a\n", " a", "a ", "a\n b", "a \nb", "\n<|endoftext|>.", "a <|endoftext|> b"]
    odd += ["".join(rng.choice(p, rng.integers(1, 12))) for p in [parts, common] for _ in range(3_000)]
    odd += [None, *list(texts.values())[:80]]
    end = np.array([2], coder.type).tobytes()
    whole = pa.array(["cut off", *odd])
    found = [x for at in range(1, len(whole), 700) for x in coder.encode_all(whole.slice(at, 700), end).to_pylist()]
    for text, ids in zip(odd, found, strict=True):
        assert ids == coder.ids(text or "") + end, repr(text[:60])


def test_texts_are_taken_in_portions_of_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "PORTION", 10)
    batch = pa.RecordBatch.from_pydict({"id": range(7), "text": [None, "é" * 4, "", "abc", "x" * 100, "", "y"]})
    found = [b.column(1).to_pylist() for b in tokens.portions(iter([batch.slice(7), batch.slice(1), batch]), "text")]
    assert [x for b in found for x in b] == batch.column(1).to_pylist()[1:] + batch.column(1).to_pylist()
    assert all(sum(len((x or "").encode()) for x in b[1:]) < 10 for b in found)


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(10)
    for n in (0, 1, 1023, 1024, 1025, 700_001):
        ids = np.minimum(rng.zipf(1.4, n), 50_256).astype(np.int64)
        coder = tokens.Coder(tokens.shares(np.bincount(ids, minlength=50_257)))
        data, points = coder.encode(ids)
        step = tokens.STRIDE * tokens.LANES
        for first in range(points + 1):
            assert np.array_equal(coder.decode(data, n, points, first), ids[first * step :])
            assert np.array_equal(coder.decode(data, n, points, 0, first), ids[: first * step])


def test_coder_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(11).zipf(1.4, tokens.BLOCK), 50_256).astype(np.int64)
    counts = np.bincount(ids, minlength=50_257)
    p = counts[counts > 0] / len(ids)
    data, _ = tokens.Coder(tokens.shares(counts)).encode(ids)
    assert len(data) < 1.1 * len(ids) * -(p * np.log2(p)).sum() / 8


def test_damage_is_noticed():
    coder = tokens.Coder(tokens.shares(np.ones(50_257, np.int64)))
    block = bytearray(tokens.pack(coder, [1], [2000], np.arange(2000)))
    block[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokens.unpack(coder, bytes(block))


# ---- pipeline


def test_pipeline_stage_by_stage(spark, folder, documents, texts, tokenizer):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs, held = documents, texts
    for name in list(stages)[:3]:
        out = stages[name](spark, docs, folder).cache()
        assert out.columns == documents.columns
        if name == "near_duplicates":
            held = {i: held[i] for i, (_, c) in linked(held.items(), 5).items() if c == i}
        elif name == "decontamination":
            held = {i: t for i, t in held.items() if not leaks(t, items)}
        assert {r["doc_id"]: r["text"] for r in out.collect()} == held
        docs = out
    mixed = stages["mixing"](spark, docs, folder).cache()
    expected = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.report(docs).collect()}
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies == +collections.Counter(expected)
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    check_tokens(stages["tokens"](spark, mixed, folder).collect(), rows, tokenizer)


def test_pipeline_runs_as_a_whole(spark, folder):
    assert set(corpus_pipeline.run(spark, folder).columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_edges(spark, folder, messy, nothing, stage):
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, nothing, folder).count() == 0
    out = run(spark, messy, folder)
    assert out.count() > 0
    if stage < 4:
        assert out.columns == messy.columns


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in ("op5_decontamination", "op6_fingerprints")])
def test_native_plans_have_no_python(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_query_needs_a_cross_join(spark, folder):
    for name in ("op3_mixing", "op5_decontamination", "op6_fingerprints", "op7_minhash"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
