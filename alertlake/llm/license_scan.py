"""License scans through a positional index of rare words.

The index holds, for each template, the words that are rarest in the corpus, with their positions in the template. A file's rare
licence words are looked up; every hit votes for the place where the template would start, so the postings are intersected by
relative position. Places with enough votes (within ``slack`` words) are verified: the template's mandatory phrases must stand
there, and at least ``min_score`` of its words in order. Phrases of the base list are found wherever their words stand
consecutively. Document frequencies are counted over all documents, for the words of the templates only.

Words are runs of digits, letters and bytes above 0x7F, with A-Z lower-cased. Defined cases: a null or empty text has no words
and no places; ties in rarity go by the word; of equally good places of a template the first counts; repeated rows are judged
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import id_and_text, slices, with_id

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


# The base phrases with their labels, and well-known licence notices with phrases that each must contain.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
             "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
             "later version.", ("free software", "gnu general public license", "version 3")),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
             "later version.", ("free software", "gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("lesser general public license",)),
    Template("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted", ("with or without fee", "hereby granted")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
             ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
)


@dataclass(frozen=True)
class LicenseMethod:
    """rare: index words of a template; votes: share of them that must agree on a place."""

    rare: int = 6
    votes: float = 0.5
    slack: int = 2
    min_score: float = 0.75


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(FOLD).split() if data else []


def places_of(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every start at which the phrase's words stand consecutively."""
    found, at, n = [], 0, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at)
        except ValueError:
            return found
        if words[at : at + n] == phrase:
            found.append(at)
        at += 1


class RareIndex:
    """word -> (template, position) for the rarest words of each template."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int], method: LicenseMethod):
        self.method, self.templates = method, templates
        self.words = [words_of(t.text.encode()) for t in templates]
        self.phrases = [[words_of(p.encode()) for p in t.phrases] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.size = []
        for i, words in enumerate(self.words):
            rare = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[: method.rare]
            self.size.append(len(rare))
            for position, word in enumerate(words):
                if word in rare:
                    self.postings.setdefault(word, []).append((i, position))

    def search(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of the best verified place of each template."""
        postings = self.postings
        hits = [(i, w) for i, w in enumerate(words) if w in postings]
        if not hits:
            return []
        votes: dict[tuple[int, int], set[bytes]] = {}
        for i, word in hits:
            for template, position in postings[word]:
                votes.setdefault((template, i - position), set()).add(word)
        best: dict[int, tuple[float, int]] = {}
        slack = self.method.slack
        for template, start in sorted(votes):
            if best.get(template, (0.0, 0))[0] == 1.0:
                continue
            agreed = set().union(*(votes.get((template, start + d), ()) for d in range(-slack, slack + 1)))
            if len(agreed) >= max(1, self.method.votes * self.size[template]):
                score = self.verify(template, start, words)
                if score > best.get(template, (0.0, 0))[0]:
                    best[template] = score, start
        return [(t, start, score) for t, (score, start) in sorted(best.items()) if score >= self.method.min_score]

    def verify(self, template: int, start: int, words: list[bytes]) -> float:
        """Share of the template's words found in order around the place, or 0 without its phrases."""
        from difflib import SequenceMatcher

        own = self.words[template]
        there = words[max(0, start - self.method.slack) : start + len(own) + self.method.slack]
        if not all(places_of(there, p) for p in self.phrases[template]):
            return 0.0
        return sum(b.size for b in SequenceMatcher(None, own, there, autojunk=False).get_matching_blocks()) / len(own)


def document_frequency(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each template word stands. One count for each such word comes back."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text.encode())})

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, many = set(vocabulary), dict.fromkeys(vocabulary, 0)
        for _, texts in slices(batches):
            for data in texts:
                for word in known.intersection(words_of(data)):
                    many[word] += 1
        used = [w for w in vocabulary if many[w]]
        yield pa.record_batch([pa.array(used, pa.binary()), pa.array([many[w] for w in used], pa.int64())], ["word", "n"])

    rows = id_and_text(docs, id_col, text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


PLACE = "array<struct<label:string,start:long,score:double>>"


def license_scan(docs: DataFrame, frequency: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES, base=BASE,
                 method: LicenseMethod = LicenseMethod(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``base`` (all places of base phrases) and ``found`` (the best place of each template)."""
    schema = with_id(docs, id_col, f"n_words long, base {PLACE}, found {PLACE}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        index = RareIndex(templates, frequency, method)
        phrases = [(words_of(p.encode()), label) for p, label in base]
        for part, texts in slices(batches):
            words = [words_of(x) for x in texts]
            at_base = [[{"label": label, "start": i, "score": 1.0} for phrase, label in phrases for i in places_of(w, phrase)] for w in words]
            found = [[{"label": templates[t].label, "start": start, "score": score} for t, start, score in index.search(w)] for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()),
                                              pa.array(at_base, kinds.field(2).type), pa.array(found, kinds.field(3).type)], schema=kinds)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
