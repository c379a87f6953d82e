"""License templates with optional and replaceable regions, matched as token automata (operator 3).

A template is license wording with markup:

* ``<<beginOptional>> ... <<endOptional>>``: the words may be missing;
* ``<<var;name=x;words=0..40>>``: any words, as many as given, may stand there.

All other words are mandatory and must stand in order, so a text matches only if its mandatory wording is
exact. Words are lower-cased (A-Z) runs outside ASCII punctuation and blanks, so line breaks, comment signs
and punctuation don't matter. A template becomes a linear automaton with one state per word and skips over
optional parts; sets of states are the bits of an integer. It starts only where its first words stand.

``phrases`` are templates without markup whose places are all counted. Null texts are empty; texts without
words match nothing. Each row is judged alone, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import TABLE, words_of

#: phrase -> label (fixed by the contract of the query)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> templates; wording of the public licenses
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "<<beginOptional>>and associated documentation files<<endOptional>> <<var;name=short;words=0..6>> to deal in "
        "<<beginOptional>>the<<endOptional>> <<var;name=what;words=1..3>> without restriction",
        "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    ],
    "apache": ["Licensed under the Apache License <<beginOptional>>Version 2.0<<endOptional>>"],
    "gpl": [
        "licensed under the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License <<beginOptional>>version <<var;name=version;words=1..2>><<endOptional>>",
        "you can redistribute it and or modify it under the terms of the GNU <<var;name=kind;words=0..1>> General Public License as published by the Free Software Foundation",
    ],
    "cc": ["licensed under <<beginOptional>>the<<endOptional>> CC <<var;name=kind;words=1..3>> 4.0", "licensed under a Creative Commons <<var;name=kind;words=1..6>> License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "spdx": ["SPDX-License-Identifier: <<var;name=id;words=1..3>>"],
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


@dataclass
class Automaton:
    """States 0..size; state i goes to i+1 on its word (None: any word); skips go without a word."""

    label: str
    accepted: list[bytes | None] = field(default_factory=list)
    skips: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.taking: dict[bytes | None, int] = {}

    def close(self) -> Automaton:
        for i, word in enumerate(self.accepted):
            self.taking[word] = self.taking.get(word, 0) | 1 << i
        self.skips.sort()
        start = self.closure(1)
        self.first = {w for i, w in enumerate(self.accepted) if start >> i & 1}
        self.mandatory = {w for i, w in enumerate(self.accepted) if w is not None and not any(a <= i < b for a, b in self.skips)}
        return self

    def closure(self, states: int) -> int:
        for a, b in self.skips:  # ascending, and all skips go forward
            if states >> a & 1:
                states |= 1 << b
        return states

    def longest(self, words: list[bytes], at: int) -> int | None:
        """End of the longest match that begins at a word, or None."""
        states, end, final = self.closure(1), None, 1 << len(self.accepted)
        anything = self.taking.get(None, 0)
        for i in range(at, len(words) + 1):
            if states & final:
                end = i
            if i == len(words):
                break
            states &= self.taking.get(words[i], 0) | anything
            if not states:
                break
            states = self.closure(states << 1)
        return end


def compile_template(label: str, template: str) -> Automaton:
    out = Automaton(label)
    opened: list[int] = []
    for i, part in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            out.accepted += words_of(part)
        elif part == "beginOptional":
            opened.append(len(out.accepted))
        elif part == "endOptional":
            if not opened:
                raise ValueError(f"{label}: an optional region ends that did not begin")
            out.skips.append((opened.pop(), len(out.accepted)))
        else:
            settings = dict(x.split("=", 1) for x in part.split(";")[1:])
            low, high = map(int, settings["words"].split(".."))
            begin = len(out.accepted)
            out.accepted += [None] * high
            out.skips += [(begin + k, begin + high) for k in range(low, high)]
    if opened:
        raise ValueError(f"{label}: an optional region has no end")
    out.close()
    if None in out.first or not out.mandatory:
        raise ValueError(f"{label}: a template must begin with a word")
    return out


class Matcher:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.templates = [compile_template(label, t) for label, many in templates.items() for t in many]
        self.phrases = [compile_template(label, p) for p, label in phrases.items()]

    def __call__(self, text: str | None) -> dict:
        plain = (text or "").encode("utf-8").translate(TABLE)
        words = plain.split()
        # an automaton can only accept where all its mandatory words occur
        live = [a for a in self.phrases + self.templates if all(w in plain for w in a.mandatory)]
        base, found = [], []
        for automaton in live:
            plain_phrase = automaton in self.phrases
            for word in automaton.first:
                at = -1
                for _ in range(words.count(word)):
                    at = words.index(word, at + 1)
                    end = automaton.longest(words, at)
                    if end is not None:
                        (base if plain_phrase else found).append((automaton.label, at, end))
        # one template's words are its evidence; phrases alone leave doubt that halves with each place
        score = 1.0 if found else 1.0 - 0.5 ** len(base)
        return {"n_words": len(words), "base": sorted(base, key=lambda r: (r[1], r[0], r[2])), "found": sorted(found, key=lambda r: (r[1], r[0], r[2])), "score": score}


PLACE = "array<struct<label: string, start: bigint, end: bigint>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: id, n_words, base (places of phrases), found (places of templates), score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, phrases)
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [matcher(t.as_py()) for t in batch.column(1)]
            lists = [pa.array([[dict(zip(("label", "start", "end"), x, strict=True)) for x in r[k]] for r in rows], place) for k in ("base", "found")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r["n_words"] for r in rows], pa.int64()), *lists, pa.array([r["score"] for r in rows], pa.float64())], [id_column, "n_words", "base", "found", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, f"`{id_column}` {kind}, n_words bigint, base {PLACE}, found {PLACE}, score double")
