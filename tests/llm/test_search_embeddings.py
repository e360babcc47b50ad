"""Lexical search, whitening and subword embeddings against brute force and held-out rows."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.llm import lexical, subwords, whitening
from tablekit.llm.base import Scratch, crc_remainder

FOLDER = "/root/testdata/sf0.01"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_search(docs, items, best=50):
    """(item, rank, doc, score) by scoring every document in full."""
    postings, length = defaultdict(list), []
    for k, (_, text) in enumerate(docs):
        words = re.findall(lexical.TERM, lowered(text))
        length.append(len(words))
        for term, tf in Counter(words).items():
            postings[term].append((k, tf))
    n, total = sum(x > 0 for x in length), sum(length)
    out = []
    for item, text in items:
        score = Counter()
        for term in set(re.findall(lexical.TERM, lowered(text))) & set(postings):
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * len(postings[term]) + 1)))
            for k, tf in postings[term]:
                m = 50 + (50 * length[k] * n) // total
                score[k] += w * ((10**9 * tf) // (1000 * tf + 20 * m))
        order = sorted((-s, docs[k][0] is None, docs[k][0] or 0) for k, s in score.items() if s > 0)
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(order[:best])]
    return out


def ranked(df):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=key)


@pytest.mark.parametrize("shard_terms", [40, 400, 2_000_000])
def test_search_equals_full_scoring(spark, docs, shard_terms, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_TERMS", shard_terms)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x1", "日本"]
    share = 1.0 / np.arange(1, len(words) + 1)
    rows = [(int(k), " ".join(rng.choice(words, int(rng.integers(1, 40)), p=share / share.sum()))) for k in rng.permutation(900)]
    rows += [(1000, None), (1001, ""), (1002, "-- !"), (None, "w1 w2 w3"), (5, "w1 W1 w1-w2"), (5, "w1 W1 w1-w2"), (1003, "w0 " * 30_000 + "rare")]
    items = [(1, "w1 w2 w3 w40 w59"), (2, "W0 w0"), (3, None), (4, "!"), (5, "absent"), (6, "rare w1 日本 Été x1"), (6, "w7 w7"), (None, "w3 w9")]
    items += [(10 + k, " ".join(rng.choice(words, 12))) for k in range(20)]
    got = ranked(lexical.rank_documents(docs(rows), docs(items, "item_id"), item="item_id"))
    assert got == sorted(brute_search(rows, items), key=lambda r: tuple((x is None, x or 0) for x in r))
    assert lexical.rank_documents(docs([]), docs(items, "item_id")).count() == 0
    assert lexical.rank_documents(docs(rows), docs([], "item_id")).count() == 0


def test_search_leaves_blocks_packed(spark, docs, monkeypatch):
    """A common word's list is unpacked only where a candidate can still reach the heap."""
    lists, corpus = {}, lexical.Corpus(4096, 4096 * 8)
    lengths = np.full(4096, 8)
    for term, places in {"common": np.arange(4096), "rare": np.array([7, 4000])}.items():
        batch = lexical._shard_rows(0, list(range(4096)), [1] * 4096, [np.array([0 if k in set(places) else 1]) for k in range(4096)], dict(a=0, b=1), corpus)
        r = batch.to_pylist()[0]
        assert r["df"] == len(places) and r["last"][-1] == places[-1] and len(r["last"]) == math.ceil(len(places) / lexical.BLOCK)
        w = lexical.term_weight(4096, len(places))
        lists[term] = lexical.Postings(w, *(np.array(r[c]) for c in ("last", "top", "size")), np.frombuffer(r["postings"], np.uint8), lexical.damped(lengths, corpus))
        assert np.array_equal(lists[term].every()[0], places)
        lists[term].blocks.clear()
    heap = lexical.Heap(2)
    lexical.best_of_shard([lists["rare"]], heap, np.arange(4096), np.zeros(4096, bool))
    lexical.best_of_shard([lists["common"], lists["rare"]], heap, np.arange(4096) + 10_000, np.zeros(4096, bool))
    assert set(heap.key) <= {7, 4000, 10_007, 14_000} and set(lists["common"].blocks) <= {0, 31}


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 300, 16_383, 16_384, 2**31, 2**40, 5], dtype=np.int64)
    data, width = lexical.pack(values)
    assert np.array_equal(lexical.unpack(data), values) and len(data) == width.sum()


def brute_whitening(vectors, components=16):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = ((n * fit - sums) / n).T @ ((n * fit - sums) / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ axes / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("cells", [1 << 19, 64 * 6])
def test_whitening(spark, cells, monkeypatch):
    # Small blocks: many rows of blocks, and vectors cut into several.
    monkeypatch.setattr(whitening, "BLOCK_CELLS", cells)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 64 if cells > 1000 else 5)
    rng = np.random.default_rng(3)
    good = [row * np.arange(1, 13) for row in rng.normal(size=(300, 12))]
    good += [good[0]] * 50
    ids = [None if k == 4 else k // 2 for k in range(len(good))]
    bad = [None, [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1.0, 2.0], []]
    rows = [(k, [float(c) for c in v], 1, "z") for k, v in zip(ids, good)] + [(900, v, 1, "z") for v in bad]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, place int, x string")
    got = whitening.whiten(table, components=7).collect()
    n, deviation, white, explained = brute_whitening(good, 7)
    assert len(got) == 7 * len(good) and {r.n for r in got} == {n}
    signs = np.ones(7)
    want = defaultdict(list)
    for k, d, w in zip(ids, deviation, white):
        want[k, int(d)].append(w)
    for r in got:
        near = min(abs(abs(w[r.component - 1]) - abs(r.whitened)) for w in want[r.vec_id, r.deviation])
        assert near < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
    # One sign per component, the same for all rows.
    seen = defaultdict(set)
    for r in got:
        if len(want[r.vec_id, r.deviation]) == 1 and abs(r.whitened) > 1e-6:
            seen[r.component].add(np.sign(r.whitened) == np.sign(want[r.vec_id, r.deviation][0][r.component - 1]))
    assert all(len(s) == 1 for s in seen.values()) and len(signs) == len(seen)


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [(r.component, abs(round(r.whitened, 9)), r.explained) for r in flat] == [(1, 1.0, 1.0)] * 2


def plain_features(text, how):
    """Buckets by one word and one n-gram at a time."""
    def bucket(h):
        h = ((h ^ h >> 16) * 0x7FEB352D) & 0xFFFFFFFF
        h = ((h ^ h >> 15) * 0x846CA68B) & 0xFFFFFFFF
        return h >> (32 - how.bits)

    mask, step, pair = 0xFFFFFFFF, int(subwords.STEP), int(subwords.PAIR)
    out, ids = [bucket(int(subwords.END))], []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        letters = [32, *map(ord, word), 32]
        for width in range(how.shortest, how.longest + 1):
            for i in range(len(letters) - width + 1):
                h = 0
                for c in letters[i : i + width]:
                    h = (h * step + c) & mask
                out.append(bucket((h + width) & mask))
        # The blank before the word takes the first power.
        ids.append(sum((c + 1) * pow(step, k + 1, 1 << 32) for k, c in enumerate(letters[:-1])) & mask)
        out.append(bucket((ids[-1] + int(subwords.WORD)) & mask))
    for a, b in itertools.pairwise(ids):
        out.append(bucket(int(subwords.SAME) if a == b else (a * pair + b + int(subwords.TWO)) & mask))
    return Counter(out)


TEXTS = ["", " ", "a", "a a a", "Été  日本\n\nx\ty 😀", "the cat\r\nthe cat sat", "w" * 300, "a bc " * 5000]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_subword_features(piece, monkeypatch):
    monkeypatch.setattr(subwords, "PIECE", piece)
    how = subwords.Subwords()
    rng = np.random.default_rng(2)
    model = subwords.Embeddings(*subwords.start(how), how)
    model.output[:] = rng.normal(size=model.output.shape)
    scorer = subwords.Scorer(model, 1)
    for text in TEXTS:
        found, counts = subwords.counted(text.encode(), how)
        assert dict(zip(found.tolist(), counts.tolist())) == plain_features(text, how)
        assert abs(scorer(text.encode()) - model.probabilities(found, counts)[1]) < 1e-6


def test_descent_follows_the_gradient():
    """One step on one text changes the output layer by the rate times the gradient of its loss."""
    how = subwords.Subwords(bits=4, size=3, passes=1)
    vectors, output = subwords.start(how)
    output[:] = [[0.2, -0.1, 0.4], [0.0, 0.3, -0.2]]
    buckets, counts = np.array([1, 5]), np.array([3, 1])
    loss = lambda u: -math.log(subwords.Embeddings(vectors0, u, how).probabilities(buckets, counts)[1])
    vectors0, before = vectors.copy(), output.astype(float)
    subwords.descend([(buckets, counts)], np.array([1]), vectors, output, how, 0.1, 0.1)
    for i, j in itertools.product(range(2), range(3)):
        up, down = before.copy(), before.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert abs((before[i, j] - output[i, j]) / 0.1 - (loss(up) - loss(down)) / 2e-5) < 1e-4
    assert (vectors[[0, 2, 3]] == vectors0[[0, 2, 3]]).all() and (vectors[[1, 5]] != vectors0[[1, 5]]).all()


def test_subword_quality(spark, docs):
    table, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = subwords.fit_embeddings(table, labels.where(crc_remainder(F.col("doc_id"), 3) != 1))
    held = subwords.score_quality(table, model).join(labels, "doc_id").where(crc_remainder(F.col("doc_id"), 3) == 1).collect()
    right = sum(r.predicted == r.quality for r in held) / len(held)
    assert right > max(0.95, sum(r.quality for r in held) / len(held)), right
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a"), (4, "b"), (4, "b"), (5, "word " * 100_000)]
    got = subwords.score_quality(docs(rows), model).collect()
    assert [r.doc_id for r in got] == [k for k, _ in rows] and len({r.score for r in got[:3]}) == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and got[4].score == got[5].score
    assert subwords.score_quality(docs([]), model).count() == 0
    # No labelled rows, null labels and keys: every label as likely.
    empty = spark.createDataFrame([(None, 1), (2, None)], "doc_id bigint, quality int")
    blank = subwords.fit_embeddings(docs(rows), empty)
    assert {r.score for r in subwords.score_quality(docs(rows), blank).collect()} == {0.5}
