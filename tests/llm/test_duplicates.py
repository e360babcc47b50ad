"""Line dedup, the n-gram join, decontamination and the pipeline against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tablekit.llm import base, decontaminate, linededup, ngramjoin, toxicity
from tablekit.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.test_queries import FOLDER, con  # noqa: F401
from tools.check import rows as as_rows

WORDS = [f"w{i}" for i in range(300)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def test_lines(spark, docs):
    rng = random.Random(4)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 14))) for _ in range(16)] + ["same same same same same same same same"]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(5):
            words = rng.choice(base).split()
            kind = rng.randint(0, 5)
            if kind == 1:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            elif kind == 2:
                del words[rng.randrange(len(words))]
            elif kind == 3:
                words.insert(rng.randrange(len(words) + 1), rng.choice(WORDS))
            elif kind == 4:
                words = rng.choices(WORDS, k=rng.randint(0, 9))
            lines.append(rng.choice(["  ", " "]).join(words).upper() if kind == 5 else " ".join(words))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "a b c"), (104, "a b c"), (None, rows[5][1]), (105, "x y z p q"), (106, "x y z p r")]
    frame = docs(rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    seen, want = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            words = lower(line).split()
            if words:
                if any(words == s or (min(len(words), len(s)) >= 5 and distance(words, s) <= 1) for s in seen):
                    want.setdefault(k, []).append(i)
                seen.append(words)
    assert {k: r.dropped for k, r in got.items() if r.dropped} == want
    for k, t in rows:
        lines = (t or "").split("\n")
        assert got[k].n_lines == len(lines)
        assert got[k].kept == "\n".join(x for i, x in enumerate(lines) if i not in want.get(k, []))
    # Of fully repeated rows both keep their lines; a document that loses all words goes.
    twice = docs([(1, base[0]), (1, base[0]), (2, base[0]), (3, None)])
    assert sorted((r.doc_id, r.text) for r in linededup.keep_first_lines(twice).collect()) == [(1, base[0]), (1, base[0]), (3, None)]
    assert linededup.keep_first_lines(twice).columns == twice.columns
    # Columns of any name are carried along, and a very long text is read whole.
    odd = spark.createDataFrame(
        [(1, "a\nb", 1, 2, 3), (2, "b\nc", 4, 5, 6), (3, "x " * 50_000 + "\n" + "y " * 50_000, 7, 8, 9), (4, "q\n" + "y " * 49_999, 1, 1, 1)],
        "doc_id int, text string, _of int, _with int, _kept int",
    )
    left = linededup.keep_first_lines(odd)
    assert left.columns == odd.columns and {(r.doc_id, r.text[:9], r._of, r._with) for r in left.collect()} == {
        (1, "a\nb", 1, 2), (2, "c", 4, 5), (3, "x x x x x", 7, 8), (4, "q", 1, 1)
    }
    assert linededup.dedup_lines(docs([])).count() == 0


def test_short_lines_in_the_pipeline(spark, docs):
    """Equal lines go from one word on, close ones from five."""
    rng = random.Random(11)
    base = [" ".join(rng.choices(WORDS, k=n)) for n in (1, 2, 3, 4, 5, 5, 6, 7) for _ in range(3)]
    rows = [(d, f"only {d}\n" + "\n".join(rng.choice(base) for _ in range(4))) for d in range(20)]
    for d in range(20, 60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((d, f"only {d}\n \n" + " ".join(words[: rng.choice([len(words), max(1, len(words) - 1)])]).upper()))
    rows += [(90, base[0]), (91, ""), (92, "All rights reserved."), (93, "x\nall  Rights reserved."), (94, "a b c d"), (95, "a b c e")]
    seen, want = [], {}
    for k, t in rows:
        kept = []
        for line in t.split("\n"):
            words = lower(line).split()
            if not any(words == s or (min(len(words), len(s)) >= 5 and distance(words, s) <= 1) for s in seen if words):
                kept.append(line)
            seen.append(words)
        if "".join(kept).strip() or not t:
            want[k] = "\n".join(kept)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs(rows), FOLDER).collect()}
    assert got == want and 90 not in got and got[93] == "x" and got[95] == "a b c e"


def test_keep_one_with_columns_of_any_name(spark):
    words = " ".join(WORDS[:40])
    rows = [(1, words, 5, 6, 7), (2, words, 8, 9, 10), (2, words, 8, 9, 10), (3, "other words", 1, 1, 1), (3, "other words", 1, 1, 1), (None, None, 2, 2, 2)]
    odd = spark.createDataFrame(rows, "doc_id int, text string, _of int, _content int, _place int")
    got = ngramjoin.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)


def components(sets, num, den):
    own = list(range(len(sets)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * den >= num * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = root(i), root(j)
                own[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def token_sets(texts, width):
    out = []
    for t in texts:
        words = lower(t or "").split()
        w = min(width, len(words))
        out.append({tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set())
    return out


@pytest.mark.parametrize("frequent", [20, 2])
def test_ngram_join(spark, docs, monkeypatch, frequent):
    """With a small bound of what is frequent, nearly all prefixes use pairs."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "SCARCE", min(10, frequent))
    rng = random.Random(frequent)
    passage = rng.choices(WORDS, k=60)
    texts = [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c d", "a b c d e"]
    for family in range(6):
        base = rng.choices(WORDS, k=rng.choice([20, 60, 150])) + (passage if family % 2 else [])
        texts.append(" ".join(base))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(WORDS, k=30) + passage) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(docs(rows)).collect()}
    sets = token_sets(texts, 4)
    want = components(sets, 85, 100)
    assert {k: (len(s), c + 10) for (k, _), s, c in zip(rows, sets, want)} == {
        k: (r.n_shingles, r.component_id) for k, r in got.items()
    }


@pytest.mark.parametrize("width, num, words", [(4, 85, 8), (5, 80, 7)])
def test_ngram_join_of_short_texts(spark, docs, width, num, words):
    """Many texts share all but their last words, and a link hangs on one token that no other set has."""
    head = WORDS[:words]
    texts = [" ".join(head + [f"u{i}", f"v{i}"][:more]) for i in range(60) for more in (1, 2)]
    got = {r.doc_id: r.component_id for r in ngramjoin.near_duplicates(docs(list(enumerate(texts))), width=width, num=num).collect()}
    assert got == dict(enumerate(components(token_sets(texts, width), num, 100)))


def test_keep_one(spark, docs):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "A b c d e f g"), (None, "a b c d e f g"), (7, None), (7, None), (8, "z")]
    frame = docs(rows)
    left = ngramjoin.keep_one(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(3, "A b c d e f g"), (7, ""), (7, ""), (8, "z")]
    assert ngramjoin.keep_one(docs([])).count() == 0 and ngramjoin.near_duplicates(docs([])).count() == 0


def test_leaks(spark, docs):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(6, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "so short"), (93, "w1")]
    rows = [(0, None), (1, ""), (2, "so SHORT"), (3, "not so, short!"), (4, "w" * 50)]
    for d in range(10, 90):
        i, item = items[d % 30]
        words = item.split()
        if d % 3 == 1:
            words[rng.randrange(len(words))] = "changed"
        if d % 3 == 2:
            words = words[: len(words) // 2]
        rows.append((d, " ".join(rng.choices(WORDS[100:], k=50) + words + rng.choices(WORDS[100:], k=50)).upper() + "."))
    rows += [(None, items[0][1]), (10, rows[5][1])]
    table = spark.createDataFrame([(*x, "c") for x in items], "item_id bigint, text string, key string")
    got = decontaminate.find_leaks(docs(rows), table).collect()
    want = []
    for d, t in rows:
        words = decontaminate.words_of((t or "").encode())
        for i, item in items:
            own = decontaminate.words_of((item or "").encode())
            width = min(5, len(own))
            best = None
            for s in range(len(words) - len(own) + 1) if own else ():
                bag = lambda ws: [tuple(ws[j : j + width]) for j in range(len(ws) - width + 1)]
                a, b = bag(words[s : s + len(own)]), bag(own)
                weigh = lambda x: sum(map(len, x))
                both = sum(weigh(x) * min(a.count(x), b.count(x)) for x in set(a) | set(b))
                score = both / (sum(map(weigh, a)) + sum(map(weigh, b)) - both)
                if score >= 0.8 and (best is None or score > best[0]):
                    best = score, s
            if best:
                want.append((d, i, round(best[0], 9), best[1]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in got), key=key) == sorted(want, key=key)
    bad = {d for d, *_ in want}
    stays = decontaminate.drop_leaks(docs(rows), table, block_items=5)
    assert stays.columns == docs(rows).columns
    assert sorted(str(r.doc_id) for r in stays.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    assert decontaminate.find_leaks(docs(rows), table.limit(0)).count() == 0 and decontaminate.find_leaks(docs([]), table).count() == 0


def test_leaks_in_texts_shorter_than_the_item(spark, docs):
    item = WORDS[:40]
    rows = [(1, item[:39]), (2, item[1:]), (3, item[3:37]), (4, item[:20]), (5, item[:4]), (6, item), (7, item[:10] + ["new"] + item[11:39])]
    table = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(WORDS[100:140]))], "item_id bigint, text string")
    frame = docs([(k, " ".join(ws)) for k, ws in rows])
    got = {r.doc_id: (r.item_id, round(r.similarity, 9), r.first_word, r.window_words) for r in decontaminate.find_leaks(frame, table).collect()}
    want = {}
    for k, words in rows:
        a, b = ({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} for ws in (words, item))
        weigh = lambda x: sum(len("".join(s)) for s in x)
        if weigh(a & b) >= 0.8 * weigh(a | b):
            want[k] = 1, round(weigh(a & b) / weigh(a | b), 9), 0, len(words)
    assert set(want) == {1, 2, 3, 6} and got == want
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame, table).collect()) == [4, 5, 7]


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_registered(spark, con, name):  # noqa: F811
    df = LLM_QUERIES[name](spark, FOLDER)
    got, names = as_rows(df.collect(), df.columns)
    assert got
    if name in LLM_ORACLES:
        rel = con.execute(LLM_ORACLES[name])
        want, want_names = as_rows(rel.fetchall(), [d[0] for d in rel.description])
        assert names == want_names and got == want


def test_pipeline(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, kept = table, [table]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), table.schema)
        assert docs.columns == table.columns
        kept.append(docs)
    start, clean, lines, single, safe = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    model = toxicity.fit_toxicity(table, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(table, model).collect()}
    assert clean == {k: t for k, t in start.items() if scores[k] < 0.7}
    assert set(lines) <= set(clean) and all(set(t.split("\n")) <= set(clean[k].split("\n")) for k, t in lines.items())
    ids = sorted(lines)
    own = components(token_sets([lines[k] for k in ids], 5), 80, 100)
    assert set(single) == {ids[i] for i, r in enumerate(own) if i == r}
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = lambda t: any(b" " + b" ".join(i) + b" " in b" " + b" ".join(decontaminate.words_of(t.encode())) + b" " for i in items)
    assert set(safe) == {k for k, t in single.items() if not holds(t)}
    packed = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in packed} == set(safe) and all(r.n == r.m for r in packed)


def test_only_texts_that_change_go_to_python(spark):
    rows = [("a\nb\nc", [1]), ("a", None), (None, [0]), (None, None), ("a\nb", [])]
    df = spark.createDataFrame(rows, "t string, d array<int>")
    got = [r.k for r in df.select(linededup.without("t", "d").alias("k")).collect()]
    assert got == ["a\nc", "a", None, None, "a\nb"]


def test_names_of_many_sequences_are_those_of_each():
    digests = [xxhash.xxh3_128_digest(p) for p in (b"", b"12345678", b"1234567887654321")]
    h1, h2 = linededup.names_of(digests)
    assert h1.to_pylist() == [int.from_bytes(d[:8], "little", signed=True) for d in digests]
    assert h2.to_pylist() == [int.from_bytes(d[8:], "little", signed=True) for d in digests]
    assert [len(c) for c in linededup.names_of([])] == [0, 0]


def test_words_hashed_in_columns():
    """Every word has one hash, wherever it stands and however long it is; texts share no words."""
    rng = random.Random(11)
    blanks = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85"]
    words = ["".join(rng.choices("abAB\x00é", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(400)]
    texts = ["", " ", "a", *("".join(w + rng.choice(blanks) for w in rng.choices(words, k=rng.randint(0, 30))) for _ in range(60))]
    data = [t.encode() for t in texts]
    known = {}
    for text, found in zip(data, base.hashed_texts(iter(data)), strict=True):
        split = text.translate(base.LOWER).split()
        assert len(split) == len(found)
        for word, h in zip(split, found.tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(g) for g in base.grouped([b"ab", b"", b"abc", b"abcdefgh", b"a"], 5)] == [3, 1, 1]


def test_close_lines_share_a_half():
    rng = random.Random(12)
    lines = [rng.choices(WORDS, k=n) for n in (1, 2, 5, 6, 7, 40) for _ in range(20)]
    close = []
    for line in lines:
        i, word = rng.randrange(len(line)), rng.choice(WORDS)
        close += [line[:i] + line[i + 1 :], line[:i] + [word] + line[i + 1 :], line[:i] + [word] + line[i:]]
    every = lines + close
    words, _ = base.word_hashes(" ".join(w for line in every for w in line).encode())
    n = np.array([len(line) for line in every])
    keys = [set(k) for k in linededup.halves(words, np.cumsum(n) - n, n).tolist()]
    for i, line in enumerate(lines):
        for j in range(3):
            assert keys[i] & keys[len(lines) + 3 * i + j]
    # Keys bring few others together.
    other = [(a, b) for a in range(len(lines)) for b in range(a) if len(lines[a]) == 40 == len(lines[b])]
    assert not any(keys[a] & keys[b] for a, b in other)


def test_sets_that_differ_in_too_many_tokens_make_no_pair(spark, docs):
    """A group of sets with the same number of usual tokens, each without other ones: no bound on numbers tells them apart."""
    rng = np.random.default_rng(13)
    every = np.sort(rng.integers(-(1 << 63), 1 << 63, 250))
    sets = [np.sort(rng.choice(every, 225, replace=False)) for _ in range(40)]
    sets += [np.sort(np.append(rng.choice(s, 215, replace=False), rng.choice(s, 10, replace=False))) for s in sets[:5]]
    join = ngramjoin.Join(docs([(1, "a")]), "doc_id", "text", 4, 90, 100)
    rows = [(i, len(np.unique(s)), len(np.unique(s)), ngramjoin.odd_bits(np.unique(s)).tolist()) for i, s in enumerate(sets)]
    one = spark.createDataFrame(rows, "id bigint, n int, usual int, odd array<bigint>")
    other = one.select(*(F.col(c).alias(c if c == "b" else f"{c}_b") for c in one.columns)).withColumnRenamed("id_b", "b")
    pairs = one.join(other, F.col("id") < F.col("b")).where(join.can_link("usual"))
    left = {(r.id, r.b) for r in pairs.where(join.few_odd()).collect()}
    linked = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both, union = len(np.intersect1d(a, sets[j])), len(np.union1d(a, sets[j]))
            if 100 * both >= 90 * union:
                linked.add((i, j))
    assert len(linked) >= 5 and linked <= left
    assert len(left) * 5 < pairs.count()
