"""Packing, archives and dialogues against brute force and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablekit.llm import dialogues, packing, warc
from tablekit.llm.queries import LLM_QUERIES
from tablekit.session import new_folder


def check_sequences(rows, limits):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert at <= limits.tokens and len(own) <= limits.segments
        assert sum(r.loss_tokens for r in own) <= limits.loss
    return bins


def test_documents_are_packed_whole(spark, docs):
    texts = [None, "", "  a  b \n\n c", "word " * 9000, "été 日本 🎉", "<|endoftext|> x", "word " * 9000, " lead", "tail "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key"), (1, "again"), (1, "again")]
    limits = packing.Limits()
    out = packing.pack_documents(docs(rows).coalesce(1), limits=limits).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    bins = check_sequences(out, limits)
    pieces = {}
    for r in out:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for k, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[k, len(ids)])
        if (k, t) != (1, "again"):
            assert [x for _, p in own for x in p] == ids and [s for s, _ in own] == list(
                np.cumsum([0] + [len(p) for _, p in own[:-1]])
            )
    assert len(pieces[1, len(tokenizer.encode("again").ids) + 1]) >= 2
    total = sum(len(r.ids) // 4 for r in out)
    assert len(bins) <= -(-total // limits.tokens) + 1


def test_added_tokens_are_ids_as_in_the_tokenizers_file(spark, docs, tmp_path):
    """The query and the pipeline's stage, with the tokenizers file at its defaults."""
    texts = ["a <|endoftext|> x", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  ", "<|endoftext|", "<|ENDOFTEXT|> <|pad|>", "été  <|endoftext|>'s 日本", None]
    docs(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 2124]
    stage = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    for out in (LLM_QUERIES["op1_pack_documents"](spark, str(tmp_path)), stage):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in out.collect()} == want


def test_limits_hold_together_and_examples_stay_whole(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        n = int(rng.integers(1, 60))
        rows.append((i, list(range(n)), [int(x) for x in rng.integers(0, 2, n)]))
    rows += [(300, None, None), (301, [], []), (302, list(range(250)), [1] * 250), (303, [1, 2, 3], None)]
    limits = packing.Limits(tokens=100, segments=4, loss=40, min_cut=None, block_tokens=2000)
    df = spark.createDataFrame(rows, "id bigint, ids array<int>, loss array<int>")
    out = packing.pack_examples(df, "id", "ids", "loss", limits).collect()
    check_sequences(out, limits)
    by = {}
    for r in out:
        by.setdefault(r.id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.loss_tokens))
    assert 300 not in by and 301 not in by and len(by[302]) == 7
    for i, ids, loss in rows:
        if ids:
            own = sorted(by[i])
            assert [x for _, p, _ in own for x in p] == ids and sum(x for *_, x in own) == sum(loss or [])
            assert len(own) == 1 or len(ids) > 100 or sum(loss) > 40


def test_no_documents(spark, docs):
    assert packing.pack_documents(docs([])).count() == 0


def test_archive_round_trip(spark):
    long = "é<p>\r\n\r\nWARC/1.1\r\n\r\n\r\r\n\r\n" * 60
    rows = [
        (1, "http://a", long), (2, "http://b", long), (5, None, long), (3, "http://c\r\nx: y", "short"), (4, "u", "short"),
        (6, "u", None), (7, "u", ""), (8, "u", "x\r\n\r\n"), (None, "u", long), (9, "u", "z" * 2000), (9, "u", "z" * 2000),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    folder = new_folder(spark)
    warc.write_archive(pages, folder)
    records = warc.read_archive(spark, folder)
    whole = warc.restore(warc.headers_of(records), warc.payloads_of(records))
    got = whole.select(warc.field("WARC-Record-ID").alias("id"), "record_type", "payload", "payload_bytes", "sha1", warc.field("WARC-Refers-To").alias("to")).collect()
    want = []
    for k, _, html in rows:
        body = (html or "").encode()
        again = html == long and k != 5
        want.append(
            (f"<urn:record:{k}>" if k is not None else None, "revisit" if again else "response", body, len(body),
             hashlib.sha1(body).hexdigest(), "<urn:record:5>" if again else None)
        )
    order = lambda r: (str(r[0]), r[2])
    assert sorted([(r[0], r[1], bytes(r[2]), *r[3:]) for r in got], key=order) == sorted(want, key=order)
    # The payload of the three revisits is stored once.
    assert warc.payloads_of(records).where(F.length("payload") == len(long.encode())).count() == 1


def test_archive_of_payloads_that_end_in_line_ends(spark):
    ends = ["\r", "\n", "\r\n", "\n\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r", "\r\n\r\n\r\n", "\r\n\r\n\r\n\r\n"]
    payloads = [p + e for p in ("", "abc", "\r\nabc", "z" * 2000) for e in ends]
    rows = [(i, "u", p) for i, p in enumerate(payloads)]
    # All records of a file, and files of one record each, so every one also stands last.
    for parts in (1, len(rows)):
        folder = new_folder(spark)
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts, "page_id")
        warc.write_archive(pages, folder)
        records = warc.read_archive(spark, folder)
        whole = warc.restore(warc.headers_of(records), warc.payloads_of(records))
        got = whole.select(warc.field("WARC-Record-ID").alias("id"), "payload").collect()
        assert sorted((r.id, bytes(r.payload)) for r in got) == sorted((f"<urn:record:{i}>", p.encode()) for i, _, p in rows)


def test_empty_archive(spark):
    folder = new_folder(spark)
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "é"), (1, 3, "ann", "tie"),
        (1, None, None, "first"), (2, 0, "system", "alone"), (None, 0, "ann", "no id"), (3, 0, "ann", "x"), (3, 0, "ann", "x"),
    ]
    df = spark.createDataFrame([(*t, 1, "c") for t in turns], "conv_id bigint, turn bigint, role string, text string, start int, dialogue string")
    got = {}
    for r in dialogues.rotate_perspectives(df).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    people = {}
    for c, _, role, _ in turns:
        if role != "system":
            people.setdefault(c, set()).add(role or "unknown")
    assert set(got) == {(c, p) for c, ps in people.items() for p in ps}
    for (c, p), own in got.items():
        own.sort(key=lambda r: r.start)
        said = sorted(
            ((t is not None, t or 0, role or "unknown", text or "") for x, t, role, text in turns if x == c),
        )
        text = "".join(r.rendered for r in own)
        marked = [text[r.loss_start : r.loss_stop] for r in own if r.loss]
        assert [(r.start, r.stop) for r in own] == [
            (sum(len(x.rendered) for x in own[:i]), sum(len(x.rendered) for x in own[: i + 1])) for i in range(len(own))
        ]
        assert sorted(marked) == sorted(t + dialogues.TURN_END for *_, role, t in said if role == p)
        assert [r.role for r in own] == [role for *_, role, _ in said]
        assert zlib.crc32(text.encode()) and text.count(dialogues.TURN_END) == len(said)
    assert dialogues.rotate_perspectives(df.limit(0)).count() == 0


def test_waiting_pieces_keep_only_their_own_ids():
    """The rest of a long document waits for its block without the ids that are packed already."""
    limits = packing.Limits()
    ids = np.arange(50_000, dtype="<u4")
    pieces = list(packing.within(packing.Piece(1, 0, ids, np.ones(len(ids), dtype=np.uint8), len(ids)), limits))
    assert np.concatenate([p.ids for p in pieces]).tolist() == ids.tolist()
    rest = pieces[-1]
    assert (rest.start, len(rest.ids), len(rest.loss), rest.total) == (49_152, 848, 848, 50_000)
    assert rest.ids.base is None and rest.loss.base is None
    # One that fits is not copied.
    short = packing.Piece(2, 0, ids[:100], np.ones(100, dtype=np.uint8), 100)
    assert next(packing.within(short, limits)) is short
