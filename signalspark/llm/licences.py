"""Licence scan by a positional rare-token index over licence templates (operator 7).

Templates are titles, notices and paragraphs of licences. Of each, the words of highest inverse document frequency (over all documents) are
indexed with their positions. A document's indexed words look up (template, position); the differences between place in
the document and position in the template vote for alignments. An alignment on which rare words agree is verified: the
template's mandatory phrases, name and version, must all stand at their places, no longer licence name may stand over
the name, and the share of template words that stand there is its score. A licence without a known version gets its
family's label.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: bytes.translate table: A-Z lower-cased, ASCII other than letters and digits to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Phrases that are found as they stand, with their labels (fixed values of the query).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence templates: label, mandatory phrases, text (fixed values: titles, notices and paragraphs of well-known licences).
TEMPLATES = [
    ("mit", ["mit license"], "released under the mit license"),
    ("mit", ["mit license"], "mit license copyright"),
    ("mit", ["mit license"], "the mit license"),
    ("mit", ["permission is hereby granted", "free of charge"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", ["the above copyright notice and this permission notice shall be included"], "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", ["apache license"], "apache license"),
    ("apache-1.1", ["apache license version 1 1"], "licensed under the apache license version 1 1"),
    ("apache-1.1", ["apache software license version 1 1"], "the apache software license version 1 1"),
    ("apache-2.0", ["apache license version 2 0"], "licensed under the apache license version 2 0"),
    ("apache-2.0", ["apache license version 2 0"], "apache license version 2 0 january 2004 http www apache org licenses"),
    ("apache-2.0", ["apache license version 2 0"], "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", ["distributed under the license", "permissions and limitations under the license"], "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", ["redistribution and use"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", ["redistributions of source code"], "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", ["redistributions in binary form"], "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", ["endorse or promote products"], "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", ["bsd license"], "bsd license"),
    ("bsd-2-clause", ["bsd 2 clause license"], "bsd 2 clause license"),
    ("bsd-3-clause", ["bsd 3 clause license"], "bsd 3 clause license"),
    ("gpl-3.0", ["gnu general public license version 3"], "gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", ["gnu general public license version 3"], "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", ["gnu general public license", "version 3 of the license"], "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", ["gnu general public license version 2"], "gnu general public license version 2 june 1991"),
    ("gpl-2.0", ["gnu general public license version 2"], "under the terms of the gnu general public license version 2"),
    ("gpl-2.0", ["gnu general public license", "version 2 of the license"], "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl", ["gnu general public license"], "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", ["lesser general public license"], "gnu lesser general public license"),
    ("lgpl", ["library general public license"], "gnu library general public license"),
    ("lgpl-2.0", ["library general public license version 2"], "gnu library general public license version 2 june 1991"),
    ("lgpl-3.0", ["lesser general public license version 3"], "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", ["lesser general public license version 2 1"], "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", ["gnu lesser general public license", "version 3 of the license"], "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", ["gnu lesser general public license", "version 2 1 of the license"], "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", ["affero general public license"], "gnu affero general public license"),
    ("agpl-3.0", ["affero general public license version 3"], "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", ["gnu affero general public license", "version 3 of the license"], "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl", ["mozilla public license"], "mozilla public license"),
    ("mpl-1.1", ["mozilla public license version 1 1"], "mozilla public license version 1 1"),
    ("mpl-2.0", ["mozilla public license version 2 0"], "mozilla public license version 2 0"),
    ("mpl-2.0", ["mozilla public license v 2 0"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl", ["eclipse public license"], "eclipse public license"),
    ("epl-1.0", ["eclipse public license v 1 0"], "eclipse public license v 1 0"),
    ("epl-1.0", ["eclipse public license version 1 0"], "eclipse public license version 1 0"),
    ("epl-2.0", ["eclipse public license v 2 0"], "eclipse public license v 2 0"),
    ("epl-2.0", ["eclipse public license version 2 0"], "eclipse public license version 2 0"),
    ("isc", ["isc license"], "isc license"),
    ("isc", ["permission to use copy modify", "with or without fee"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc0", ["cc0 1 0"], "dedicated to the public domain under cc0 1 0 universal"),
    ("cc0", ["cc0 1 0"], "cc0 1 0 universal"),
    ("unlicense", ["free and unencumbered software released into the public domain"], "this is free and unencumbered software released into the public domain"),
    ("zlib", ["in no event will the authors be held liable"], "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", ["boost software license version 1 0"], "boost software license version 1 0"),
    ("all-rights-reserved", ["all rights reserved"], "copyright all rights reserved"),
]
#: Creative Commons licences: what their labels, short names and titles add to cc-by, cc by and Attribution; and their versions.
CREATIVE = [("", "", ""), ("-nc", " nc", " noncommercial"), ("-sa", " sa", " sharealike"), ("-nd", " nd", " noderivatives"), ("-nc-sa", " nc sa", " noncommercial sharealike"), ("-nc-nd", " nc nd", " noncommercial noderivatives")]
for _label, _short, _long in CREATIVE:
    for _name in (f"cc by{_short}", f"creative commons attribution{_long}"):
        TEMPLATES.append((f"cc-by{_label}", [_name], _name))
        TEMPLATES += [(f"cc-by{_label}-{n}.0", [f"{_name} {n} 0"], f"{_name} {n} 0") for n in (2, 3, 4)]
#: Names that begin with others, so that the shorter one at the same place doesn't count.
LONGER = [*(f"cc by{short}" for _, short, _ in CREATIVE[1:]), *(f"creative commons attribution{long}" for _, _, long in CREATIVE[1:])]
#: Indexed words that must agree on an alignment, and the least share of a template's words that it must show. Of each
#: template the rarest words stand in the index, enough of them that no alignment of that share has fewer in place.
VOTES, LEAST = 2, 0.6


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def places(words: list[bytes], phrase: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
    """Where a phrase's words stand consecutively; ``at`` has the places of its words."""
    rarest = min(range(len(phrase)), key=lambda n: len(at.get(phrase[n], ())))
    return [p - rarest for p in at.get(phrase[rarest], ()) if p >= rarest and words[p - rarest : p - rarest + len(phrase)] == phrase]


def family(label: str) -> str:
    """A label without its version."""
    return re.sub(r"-\d.*", "", label)


class Scanner:
    """The index, from the document frequencies of the template words among ``n`` documents."""

    def __init__(self, frequency: dict[bytes, int], n: int):
        idf = lambda w: math.log((n + 1) / (frequency.get(w, 0) + 1))
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.templates = [(label, [self.placed(m.encode().split(), text.encode().split()) for m in musts], text.encode().split()) for label, musts, text in TEMPLATES]
        self.longer = [x.encode().split() for x in LONGER]
        self.index = defaultdict(list)
        for t, (_, _, text) in enumerate(self.templates):
            rarest = sorted(range(len(text)), key=lambda k: (-idf(text[k]), k))[: len(text) - math.ceil(LEAST * len(text) - 1e-9) + VOTES]
            for word in {text[k] for k in rarest}:
                self.index[word] += [(t, k) for k, w in enumerate(text) if w == word]
        self.index = dict(self.index)
        self.known = set(self.index) | {w for p, _ in self.phrases for w in p}

    @staticmethod
    def placed(must: list[bytes], text: list[bytes]) -> tuple[int, list[bytes]]:
        """A mandatory phrase with its position in the template."""
        return next(k for k in range(len(text)) if text[k : k + len(must)] == must), must

    def outdone(self, words: list[bytes], at: int, must: list[bytes]) -> bool:
        """Whether a longer name goes on from the phrase."""
        return any(len(x) > len(must) and x[: len(must)] == must and words[at : at + len(x)] == x for x in self.longer)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(place, label) of every base phrase; score of each label that the templates give. A family's label counts where
        its name stands without a version of that family."""
        if self.known.isdisjoint(words):
            return [], {}
        at = defaultdict(list)
        for n, w in enumerate(words):
            if w in self.known:
                at[w].append(n)
        base = sorted((p, label) for phrase, label in self.phrases for p in places(words, phrase, at))
        votes: Counter = Counter()
        for w, where in at.items():
            for t, k in self.index.get(w, ()):
                votes.update((t, p - k) for p in where)
        found: dict[str, float] = {}
        named: dict[str, dict[int, float]] = defaultdict(dict)  # of families: scores by place of the name
        versioned: dict[str, set[int]] = defaultdict(set)
        for (t, start), n in votes.items():
            label, musts, text = self.templates[t]
            if n < min(VOTES, len(text)) or any(start + k < 0 or words[start + k : start + k + len(m)] != m for k, m in musts):
                continue
            here, own = words[max(0, start) : start + len(text)], text[max(0, -start) :]
            share = sum(map(bytes.__eq__, here, own)) / len(text)
            k, must = musts[0]
            if share < LEAST or self.outdone(words, start + k, must):
                continue
            if family(label) == label:
                named[label][start + k] = max(share, named[label].get(start + k, 0.0))
            else:
                found[label] = max(share, found.get(label, 0.0))
                versioned[family(label)].update(range(start + k, start + k + len(must)))
        for label, shares in named.items():
            alone = [share for place, share in shares.items() if place not in versioned[label]]
            if alone:
                found[label] = max(alone)
        return base, found


def document_frequency(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Number of documents with each template word, and of all documents: at most as many rows as templates have words."""
    vocabulary = {w for _, _, text in TEMPLATES for w in text.encode().split()}

    def count(batches):
        found: Counter = Counter()
        n = 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                found.update(vocabulary.intersection(words_of(text)))
                n += 1
        rows = [(w.decode(), c) for w, c in found.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    got = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = got.pop("", 0)
    return {w.encode(): c for w, c in got.items()}, n


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of ``PHRASES``; first_word and last_word are the least and largest of them (words from 0),
    null without any. base_labels and labels are distinct, sorted and joined by commas; labels also holds the templates'.
    score is the best template's share of words in place; 0.5 for base phrases alone, 0 for nothing. Null and empty texts
    have no words. Repeated rows give repeated rows, other columns are ignored, an empty table gives no rows.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(*document_frequency(docs)))
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def scan(batches):
        s = scanner.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                base, found = s.scan(words)
                labels = {x for _, x in base}
                where = [p for p, _ in base]
                rows.append((
                    doc, len(words), len(base), min(where, default=None), max(where, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), max([0.5 * bool(base), *found.values()]),
                ))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, schema)
