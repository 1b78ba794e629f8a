"""Manifests, near-duplicate vectors and phrases against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.llm import lattice, merkle, phrases

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


# ---- manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    said = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if x is None else f"{len(x.encode())}:{x}" for x in said))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        start = i - i % 3
        run = nodes[start : start + 3]
        out.append((run[: i - start], run[i - start + 1 :]))
        i //= 3
    return out


def manifest_rows(given):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    sources = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in given:
        own = leaf(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        sources[source].append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n_chars, text.replace("\n", "")) if hit else own, doc_id))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (*_, own, changed, doc_id) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, k)
            node = changed
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], h(*(x for p in steps for part in p for x in part)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_log_positions():
    for n in [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81, 100, 243]:
        names = [bytes([i]) * 32 for i in range(n)]
        levels_ = merkle.height(n)
        log = merkle.append_log(names, levels_)
        tree = levels([x.hex() for x in names])
        assert len(log) == sum(map(len, tree)) and len(tree) == levels_ + 1
        for level, nodes in enumerate(tree):
            for j, node in enumerate(nodes):
                assert log[merkle.position(j * 3**level, level, n, levels_)].hex() == node
        for i in range(n):
            steps = merkle.steps(merkle.packed(i, n, levels_, b"".join(log)))
            assert merkle.folded(names[i], steps) == log[-1]


def test_manifest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rng = random.Random(4)
    sources = [None, "", "é", "z", "中", "a"] + [f"s{i}" for i in range(40)]
    rows = [(i, f"line {i}\nmore\n" if i % 3 else f"plain {i}", rng.choice(["en", None]), "hot" if i % 3 == 0 else rng.choice(sources), i) for i in range(400)]
    rng.shuffle(rows)
    found = sorted(map(tuple, merkle.report(frame(spark, rows).repartition(7)).collect()), key=repr)
    assert found == manifest_rows(rows) and {r[-1] for r in found} == {True, False}


def test_manifest_edges(spark, messy, nothing):
    rows = [tuple(r)[:5] for r in messy.collect()]
    found = sorted(map(tuple, merkle.report(messy).collect()), key=repr)
    assert found == manifest_rows(rows)
    assert merkle.report(nothing).count() == 0
    one = merkle.report(frame(spark, [(7, "x", "en", "a", 1)])).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("") and one["verified"]


def test_manifest_proofs_are_paths(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 4}", i) for i in range(50)]
    for r in merkle.manifest(frame(spark, rows)).proofs().collect():
        assert merkle.folded(bytes(r["leaf"]), merkle.steps(bytes(r["path"]))) == bytes(r["root"])


# ---- vectors


def linked_rows(given, similarity=0.95):
    """(vec_id, n_links, component, kept) by comparing all pairs; ids are distinct."""
    good = {i: np.array(v, float) for i, v in given if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    parent, count = {i: i for i, _ in given}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= similarity:
                count[a] += 1
                count[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((i, count[i], root(i), root(i) == i) for i, _ in given)


def near(rng, v, cosine):
    u = v / np.linalg.norm(v)
    w = rng.normal(size=len(v))
    w -= (w @ u) * u
    return cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (300, 8))
    z = lattice.decoded(x)
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    assert np.allclose(z.sum(axis=1) % 2, 0) and ((z % 1 == 0).all(axis=1) | (z % 1 == 0.5).all(axis=1)).all()
    own = ((x - z) ** 2).sum(axis=1)
    others = ((x[:, None] - z[:, None] - lattice.ROOTS) ** 2).sum(axis=2)
    assert (own[:, None] <= others + 1e-9).all() and own.max() <= 1 + 1e-9  # the covering radius
    probed = lattice.cells(x, 4)
    assert np.allclose(np.sort(((probed[:, 1:] - x[:, None]) ** 2).sum(axis=2)), np.sort(others)[:, :4])


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "SHARD", 16)
    rng = np.random.default_rng(2)
    rows, centres = [], rng.normal(size=(30, 64))
    for i in range(1_200):
        c = centres[0] if i % 3 == 0 else centres[i % 30]  # a third of all are copies of one
        rows.append((5_000 - i, [float(x) for x in (near(rng, c, 0.985 if i % 2 else 0.975) * (1 + i % 5) if i % 6 < 4 else rng.normal(size=64))]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = sorted(map(tuple, lattice.linked(df).collect()))
    truth = linked_rows(rows)
    assert sum(r[1] for r in found) >= 0.999 * sum(r[1] for r in truth) and all(f[1] <= t[1] for f, t in zip(found, truth))
    assert [(f[0], f[2]) for f in found] == [(t[0], t[2]) for t in truth]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        v = rng.normal(size=32)
        rows += [(2 * i, v.tolist()), (2 * i + 1, (3 * near(rng, v, 0.9501)).tolist())]
    found = lattice.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.where("n_links > 0").count() >= 0.99 * 800


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, None]), (9, [inf, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-200, 0.0]), (13, [-0.0, 1.0]), (14, [0.0, 1.0])]
    clash = "vec_id long, embedding array<double>, node long, cell long, key string, `a.b` int, side int"
    df = spark.createDataFrame([r + (1, 2, "k", 3, 4) for r in rows], clash)
    assert sorted(map(tuple, lattice.linked(df).collect())) == linked_rows(rows)
    again = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 5.0]), (None, None), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    found = collections.Counter(map(tuple, lattice.linked(again).collect()))
    assert found == {(None, 2, 3, False): 1, (None, 0, None, True): 2, (3, 2, 3, True): 2}
    assert lattice.linked(df.limit(0)).count() == 0


# ---- phrases


def collocation_rows(given, least=30, covered=80, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in given:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            said = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(said)
            f.update((lang, *said[i : i + m]) for m in range(1, 5) for i in range(len(said) - m + 1))
    best, inside = {}, collections.Counter()
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            best[lang, *p] = min((2_000_000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k) for k in range(1, len(p)))
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[lang, *p[i : i + m]] = max(inside[lang, *p[i : i + m]], a)
    out, ranks = [], collections.Counter()
    rows = [(key, score, k) for key, (score, k) in best.items() if 100 * inside[key] < covered * f[key]]
    for (lang, *p), score, k in sorted(rows, key=lambda r: (r[0][0], -r[1], -f[r[0]], " ".join(r[0][1:]).encode())):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], " ".join(p), f[lang, *p], f[lang, *p[:k]], f[lang, *p[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("budget", [1 << 18, 40])
def test_phrases_equal_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rng = random.Random(9)
    texts = []
    for i in range(300):
        said = [rng.choice("the of a Cat dogé sat on mat x\u0000y 中文 😀 new york city".split(" ")) if rng.random() < 0.6 else "New York City hall" for _ in range(40)]
        texts.append((rng.choice(["en", "en", None, "de"]), "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", " ", " "]) for w in said)))
    texts += [(None, None), ("en", ""), ("fr", "..."), ("", "a b " * 40), ("en", "the the the the the the " * 50)]
    df = spark.createDataFrame([(i, t, l, "s", 1) for i, (l, t) in enumerate(texts)], DOCUMENT).repartition(6)
    found = sorted(map(tuple, phrases.collocations(df, budget=budget).collect()))
    assert found == collocation_rows(texts) and len(found) > 20
    few = sorted(map(tuple, phrases.collocations(df, budget=budget, top=5).collect()))
    assert few == collocation_rows(texts, top=5)


def test_phrases_edges(spark, messy, nothing):
    assert phrases.collocations(nothing).count() == 0
    rows = [(r["lang"], r["text"]) for r in messy.collect()]
    assert sorted(map(tuple, phrases.collocations(messy, least=2).collect())) == collocation_rows(rows, least=2)




# ---- columns of any name and type, rows without ids


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from vecflow.llm import decontamination, language, oddsketch

    plain = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest again"
    other = "some quite different words stand in this text so that nothing of it is like the first one at all"
    rows = [(1, plain, "en", "a", 1, 77, 5, {"x": 1, "y": 2}, 8), (2, plain, "en", "a", 1, 78, 6, {"y": 2}, 9), (None, other, "en", "a", 1, 79, 7, None, 10), (None, other, "en", "a", 1, 79, 7, None, 10)]
    schema = f"{DOCUMENT}, row__ long, `a.b` int, m map<string,int>, new_0 int"
    df = spark.createDataFrame(rows, schema)
    found = oddsketch.deduplicated(df)
    assert found.columns == df.columns and found.schema["m"].dataType == df.schema["m"].dataType
    assert sorted((r["doc_id"] or 0, r["row__"], r["a.b"], r["new_0"]) for r in found.collect()) == [(0, 79, 7, 10), (1, 77, 5, 8)]
    items = spark.createDataFrame([(1, " ".join(other.split()[:12]))], "item_id long, text string")
    assert decontamination.clean(df.drop("m"), items).columns == df.drop("m").columns
    kept = language.accepted(df.drop("m").withColumn("new_1", F.lit(3)))
    assert [r["new_1"] for r in kept.collect()] == [3] * kept.count() and kept.columns == [*df.drop("m").columns, "new_1"]
    assert len(corpus_pipeline.STAGES) == 5


def test_equal_hashes_of_different_rows_are_told_apart(spark, monkeypatch):
    from vecflow.llm import oddsketch

    real, seeds = oddsketch.F.xxhash64, []

    def poor(first, *rest):  # with the first seed all rows share a hash
        seeds.append(first)
        return F.lit(5).cast("long") if len(seeds) == 1 else real(first, *rest)

    monkeypatch.setattr(oddsketch.F, "xxhash64", poor)
    keyed = oddsketch.told_apart(spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string"), "k")
    assert len({r["k"] for r in keyed.collect()}) == 2


def test_rows_without_ids_draw_on_their_own(spark):
    from vecflow.llm import mixing

    rows = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat_ws(" ", F.col("id").cast("string"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 90).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("source"))
    out = mixing.report(rows.withColumn("source", F.col("source"))).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 for r in out)
