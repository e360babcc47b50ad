"""Licence scan by a positional index of rare template words.

The index holds, for each licence template, its words of highest IDF (measured
over the scanned texts themselves) with their places. A text's index words vote
for (template, start of the template in the text); starts with enough votes are
compared word by word with the template, and the template's mandatory phrases
must stand inside. The index is bounded by the templates given by the caller.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import ALNUM, prepare, text_of, texts

# Phrases whose places are reported, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Template:
    """Words of a licence notice and the phrases that must stand in a text for ``label`` to hold."""

    label: str
    words: str
    phrases: tuple[str, ...]


# Opening words of public licence notices, lower case, without punctuation.
TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template(
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
        "this work cc0 1 0 universal",
        ("waived all copyright",),
    ),
    Template(
        "gpl-3",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
        ("gnu general public license", "version 3"),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your "
        "option any later version",
        ("gnu general public license", "version 2"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl-3",
        "licensed under the gnu affero general public license version 3",
        ("gnu affero general public license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "list of conditions"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee",),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("released into the public domain",),
    ),
)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then runs of characters that are no ASCII or are ASCII letters or digits."""
    return text.translate(ALNUM).split()


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of texts, and of texts with each word of ``vocabulary``; one count per word and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for t in texts(batch):
                n += 1
                counts.update(vocabulary.intersection(words_of(t)))
        words = [b"", *counts]
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "n": pa.array([n, *counts.values()])})

    counts = docs.select(text_of(text).alias("text")).mapInArrow(run, "word binary, n bigint")
    found = {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


class Index:
    """Postings (template, place) of each template's ``anchors`` rarest words."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str], n: int, df: dict[bytes, int], anchors: int, slack: int, least: float):
        self.words = [t.words.encode().split() for t in templates]
        self.labels = [t.label for t in templates]
        self.required = [[b" " + p.encode() + b" " for p in t.phrases] for t in templates]
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.slack, self.least = slack, least
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes = []
        for k, words in enumerate(self.words):
            idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in words}
            rare = set(sorted(idf, key=lambda w: (-idf[w], w))[:anchors])
            self.votes.append(max(1, math.ceil(least * len(rare))))
            for place, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((k, place))
        self.anchors = frozenset(self.postings)
        # A text without a whole rarest word of any phrase or template has nothing to report.
        self.alert = self.anchors | {w for p, _ in self.phrases for w in p.split()[-1:]}

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], list[tuple[str, int, int, float]]]:
        """Starts of the phrases, their labels, and the verified templates (label, start, end, score)."""
        if self.alert.isdisjoint(words):
            return [], set(), []
        line = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                starts.append(line.count(b" ", 0, at))
                labels.add(label)
                at = line.find(phrase, at + 1)
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for i, w in enumerate(words):
            if w in self.anchors:
                for k, place in self.postings[w]:
                    votes[k, i - place].add(w)
        found = []
        for (k, start), rare in sorted(votes.items()):
            near = set().union(*(votes.get((k, start + d), ()) for d in range(-self.slack, self.slack + 1)))
            if len(near) >= self.votes[k]:
                score = self._verified(words, k, start)
                if score:
                    begin = max(0, start)
                    found.append((self.labels[k], begin, min(len(words), start + len(self.words[k])), score))
        return starts, labels, found

    def _verified(self, words: list[bytes], k: int, start: int) -> float:
        template, slack = self.words[k], self.slack
        low, high = max(0, start - slack), min(len(words), start + len(template) + slack)
        window = b" " + b" ".join(words[low:high]) + b" "
        if not all(p in window for p in self.required[k]):
            return 0.0
        hits = sum(w in words[max(0, start + i - slack) : max(0, start + i + slack + 1)] for i, w in enumerate(template))
        score = hits / len(template)
        return score if score >= self.least else 0.0


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    anchors: int = 8,
    slack: int = 3,
    least: float = 0.6,
) -> DataFrame:
    """Licences named or quoted in each text.

    Returns one row per row of ``docs``: the key, ``n_words``, ``phrase_starts``
    (word numbers from 0 of every place of a phrase), ``phrase_labels``, and
    ``matches`` (label, first word, word after the last, share of the template's words
    found within ``slack`` places of where they belong; at least ``least``).

    A null text counts as empty and gives 0 words and empty arrays; null keys and
    repeated rows are rows like others; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    vocabulary = {w for t in templates for w in t.words.encode().split()}
    index = Index(templates, phrases, *document_frequencies(rows, vocabulary), anchors, slack, least)
    match_type = pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t in texts(batch):
                words = words_of(t)
                starts, labels, found = index.scan(words)
                out.append((len(words), starts, sorted(labels), [dict(zip(("label", "first", "stop", "score"), m)) for m in found]))
            n, starts, labels, found = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(starts, pa.list_(pa.int64())),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array(found, pa.list_(match_type)),
                ],
                names=["key", "n_words", "phrase_starts", "phrase_labels", "matches"],
            )

    kind = docs.schema[key].dataType.simpleString()
    match = "struct<label:string,first:bigint,stop:bigint,score:double>"
    schema = f"key {kind}, n_words bigint, phrase_starts array<bigint>, phrase_labels array<string>, matches array<{match}>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
