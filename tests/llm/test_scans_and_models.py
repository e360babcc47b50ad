"""Licence scan, quality trees, toxicity and the language model against brute force and held-out rows."""

import itertools
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tablekit.llm import hmm, licenses, quality, toxicity
from tablekit.llm.base import WordHashes

FOLDER = "/root/testdata/sf0.01"


def test_licenses(spark, docs):
    notice = licenses.TEMPLATES[1].words.replace(" ", "\n* ").upper()
    rows = [
        (1, None), (2, ""), (3, "Released under the MIT License. x THE-MIT:LICENSE"), (4, f"a b c {notice} d"),
        (5, "the mit licenses"), (6, "cc by nc cc-by-nc 4.0"), (None, "Apache License, Version 2"), (3, "x"), (3, "x"),
        (7, "x " * 50_000 + "this work is licensed under the GNU General Public License, version 3 ok"),
        (8, "permission is hereby granted free of charge to any person to copy"),
    ]
    got = licenses.scan_licenses(docs(rows)).collect()
    assert len(got) == len(rows)
    found = {}
    for (k, t), r in zip(rows, got):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        starts = {}
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    starts.setdefault(label, []).append(i)
        assert r.doc_id == k and r.n_words == len(words)
        assert sorted(r.phrase_starts) == sorted(itertools.chain(*starts.values())) and r.phrase_labels == sorted(starts)
        found[k, t] = {m.label for m in r.matches}
        assert all(0.6 <= m.score <= 1 and 0 <= m.first < m.stop <= len(words) for m in r.matches)
    assert "mit" in found[rows[3]] and "gpl-3" in found[rows[9]] and found[rows[10]] == set() and found[rows[0]] == set()
    assert licenses.scan_licenses(docs([])).count() == 0


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality_counts_and_verdicts(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "a b c a b c\n\na b c\na b c"), (5, "é x # *\x0b$%\r\n" * 3), (None, "x"), (4, "y"), (4, "y")]
    got = quality.judge(docs(rows), quality.grow(np.zeros((0, 12)), np.zeros(0), np.zeros(12))).collect()
    assert [[r[c] for c in quality.COUNTS] for r in got] == [brute_statistics(t or "") for _, t in rows]
    assert all(r.base_failed and not r.kept for r in got)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    trees = quality.fit_quality(table, labels)
    out = {r.doc_id: r for r in quality.judge(table, trees).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    assert all([out[k][c] for c in quality.COUNTS] == brute_statistics(t) for k, t in texts.items())
    judged = [(r.quality, out[r.doc_id]) for r in labels.collect() if r.doc_id in out and not out[r.doc_id].base_failed]
    assert np.mean([bool(q) == o.kept for q, o in judged]) > 0.95


def test_trees_keep_their_signs():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(2000, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.2, 2000) > 0.1).astype(float)
    trees = quality.grow(x, y, np.array([1, -1, 0]))
    for f, sign in ((0, 1), (1, -1)):
        probe = np.repeat(x[:50], 30, axis=0)
        probe[:, f] = np.tile(np.linspace(0, 1, 30), 50)
        steps = np.diff(trees.probability(probe).reshape(50, 30), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert np.mean((trees.probability(x) > 0.5) == y) > 0.8


def test_toxicity_held_out(spark, docs):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        bad = i % 4 == 0
        if bad:
            text[5], text[40] = "slur", "insult"
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(None, None), (1000, ""), (1000, ""), (1001, "slur " * 50_000 + "insult")]
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs(rows), marks.where("doc_id % 3 <> 1 or doc_id is null"))
    got = toxicity.score_toxicity(docs(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert {r.doc_id: r.predicted for r in got}[1001] == 1 and len(model.features) < 2000
    stays = toxicity.drop_toxic(docs(rows), model)
    assert stays.columns == docs(rows).columns and stays.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.fit_toxicity(docs([]), marks.limit(0))
    assert toxicity.score_toxicity(docs([(1, None)]), none).collect()[0].score == 0.5


def test_weights_follow_the_closed_form():
    how = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(3), np.zeros(3)
    toxicity.learn([np.array([0, 1]), np.array([1, 2])], np.array([1.0, 0.0]), z, n, toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.1, l2=0.2, passes=1))
    # First row: all weights 0, so the gradient is -0.5 for both features.
    w1 = 0.4 / ((1 + 0.5) / 0.5 + 0.2)
    g = 1 / (1 + math.exp(-w1))
    assert z[0] == -0.5 and n[0] == 0.25 and n[2] == pytest.approx(g * g)
    assert toxicity.weight(np.array([0.05, -0.5]), np.array([0.0, 0.25]), how).tolist() == pytest.approx([0.0, w1])


def test_toxicity_scores_by_dictionary(spark, docs):
    """The sorted arrays and the filter give what a plain dictionary over one feature at a time gives."""
    mask = (1 << 64) - 1

    def scrambled(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
        return h ^ h >> 31

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        ids = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        found = {*ids, *(xxhash.xxh3_64_intdigest((w[:4] + "-").encode()) for w in words)}
        for gap in (1, 2, 3):
            found |= {scrambled((a * 3 + scrambled(b) + min(gap, 2)) & mask) for a, b in zip(ids, ids[gap:])}
        return found

    texts = [None, "", "Été kills 日本 all the Words the words", "a b c d e f a b", "x-y_z ABC abcdefgh", "q " * 3000 + "r"]
    every = sorted(set().union(*map(plain, texts)))
    rng = np.random.default_rng(8)
    weights = {f: w for f, w in zip(every, rng.normal(size=len(every))) if rng.random() < 0.5}
    model = toxicity.Weights(np.array(list(weights), dtype=np.uint64), np.array(list(weights.values())), -0.3)
    got = toxicity.score_toxicity(docs(list(enumerate(texts))), model).collect()
    for r, text in zip(sorted(got), texts):
        total = -0.3 + sum(weights.get(f, 0.0) for f in plain(text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == (r.score >= 0.7)


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(rng.uniform(size=3)), norm(rng.uniform(size=(3, 3))), norm(rng.uniform(size=(3, 4))))
    sequences = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 2, 5, 7, 7)]
    starts, moves, emits, likelihood = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4)), []
    for s in sequences:
        total, own = 0.0, [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))]
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, x]
            total += p
            own[0][path[0]] += p
            np.add.at(own[1], (path[:-1], path[1:]), p)
            np.add.at(own[2], (path, s), p)
        likelihood.append(math.log10(total))
        for all_texts, one in zip((starts, moves, emits), own):
            all_texts += one / total
    # Blocks of several texts, of one, and texts that are longer than a block.
    for block_tokens in (1000, 20, 7, 3, 1):
        settings = hmm.Settings(states=3, block_tokens=block_tokens)
        assert hmm.log10_likelihood(model, sequences, settings) == pytest.approx(likelihood)
        for got, want in zip(hmm.expected(model, sequences, settings), (starts, moves, emits)):
            assert got.ravel() == pytest.approx(want.ravel(), rel=1e-5)


def test_language_model(spark, docs):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    odd = docs([(-1, None), (-2, ""), (-3, "the the"), (None, "the of"), (-4, "the"), (-4, "the")]).select(*table.columns)
    rows = table.unionByName(odd)
    train = F.col("doc_id") % 3 != 0
    small = hmm.Settings(states=4, own_symbols=200, endings=64, head_words=300, rounds=3)
    got = hmm.score_texts(rows, train, settings=small).collect()
    given = rows.collect()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or "")), "\n"] for r in given]
    learnt = [r.doc_id is not None and math.fmod(r.doc_id, 3) != 0 for r in given]
    counts = Counter(t for ts, yes in zip(tokens, learnt) if yes for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(r.doc_id), not yes, len(ts), sum(t in counts for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6))
        for r, ts, yes in zip(given, tokens, learnt)
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)
    assert hmm.score_texts(docs([]), F.lit(True), settings=small).count() == 0
    alone = hmm.score_texts(docs([(1, "a b")]), F.lit(False), settings=small).collect()[0]
    assert alone.train_tokens == 0 and alone.base_score == 0.0 and alone.score < 0


def test_statistics_of_long_text():
    text = ("word " * 30_000 + "\n") * 2
    assert quality.statistics(text.encode(), WordHashes())[0] == brute_statistics(text)


def test_mit_phrase_is_whole(spark, docs):
    """The phrase of the contract has four words: without its first one there is no place."""
    rows = [(1, "see the MIT license"), (2, "a under THE mit-license x under the mit license"), (3, "under the mit licenses")]
    got = {r.doc_id: (list(r.phrase_starts), list(r.phrase_labels)) for r in licenses.scan_licenses(docs(rows)).collect()}
    assert got == {1: ([], []), 2: ([1, 6], ["mit"]), 3: ([], [])}


def test_common_features_without_all_side_by_side():
    """The features, places and bias that sets give; counting them takes little beside what the texts keep."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, n)).encode() for n in [0, 1, 3, *rng.integers(500, 1500, 300)]]
    each = [set(toxicity.Features()(t).tolist()) for t in texts]
    counts = Counter(f for s in each for f in s)
    tracemalloc.start()
    used, places = toxicity.common_features(pa.chunked_array([texts[:7], texts[7:]], pa.binary()), 3, 250)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used.tolist() == sorted({int(toxicity.BIAS), *(f for f, n in counts.items() if 3 <= n <= 250)})
    assert [set(used[p].tolist()) for p in places] == [{f for f in s if 3 <= counts[f] <= 250} for s in each]
    # The table of counts, the features of all texts and a share of them.
    assert peak < toxicity.RARE + 1.5 * 8 * sum(counts.values())
