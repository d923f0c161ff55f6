"""License scan: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

#: Fixed values: (label, phrase). A place where a phrase's words stand consecutively gives the label.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Fixed values: (label, template), the wording of public license notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY NC SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY NC ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "Copyright all rights reserved no part may be reproduced without permission"),
)

#: A-Z lower-cased, what is neither a digit, a letter nor beyond ASCII becomes a space; line ends stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256)
)


def _sets(templates) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(text.encode().translate(_TABLE).split())) for label, text in templates]


def token_frequencies(docs: DataFrame, *, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each token of the templates stands, over all rows. Its size is that of the templates' words."""
    wanted = frozenset().union(*(s for _, s in _sets(templates)))

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t:
                    seen.update(wanted.intersection(t.translate(_TABLE).split()))
        if seen:
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": list(seen.values())})

    found = docs.select(text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in found}


class TemplateIndex:
    """Templates' prefixes under the global frequency order, for blocks that hold at least `least` of a template's tokens.

    A template of size n needs ceil(least * n) common tokens. So a block of fewer distinct tokens fails (length filter);
    one without any of the template's n - need + 1 rarest tokens fails (prefix filter); and if the first common token is
    the template's i-th rarest, n - i can be common at most (positional filter).
    """

    def __init__(self, templates, frequency: dict[bytes, int], least: float):
        self.templates, self.at = [], {}
        self.wording = [list(dict.fromkeys(text.encode().translate(_TABLE).split())) for _, text in templates]
        for no, (label, tokens) in enumerate(_sets(templates)):
            ordered = sorted(tokens, key=lambda t: (frequency.get(t, 0), t))
            need = math.ceil(least * len(tokens) - 1e-9)
            self.templates.append((label, tokens, ordered, need))
            for i, t in enumerate(ordered[: len(tokens) - need + 1]):
                self.at.setdefault(t, []).append((no, i))
        self.rare = frozenset(self.at)

    def matches(self, block: frozenset[bytes] | set[bytes]) -> dict[int, float]:
        """Template number -> containment, of all templates whose containment in the block meets the threshold."""
        first: dict[int, int] = {}
        for t in self.rare.intersection(block):
            for no, i in self.at[t]:
                first[no] = min(i, first.get(no, i))
        out = {}
        for no, i in first.items():
            _, tokens, ordered, need = self.templates[no]
            if len(block) < need or len(ordered) - i < need:
                continue
            common = sum(t in block for t in ordered[i:])
            if common >= need:
                out[no] = common / len(tokens)
        return out


#: Templates of so many distinct tokens are held against runs of lines as sets; shorter ones against lines, and in order against the runs.
WRAPPED = 16


def blocks(text: bytes) -> list[tuple[set[bytes], bool]]:
    """(distinct tokens, whether of several lines) of every line and of every run of lines between empty ones."""
    out, run, lines = [], set(), 0
    for line in [*text.split(b"\n"), b""]:
        words = set(line.split())
        if words:
            out.append((words, False))
            run |= words
            lines += 1
        else:
            if lines > 1:
                out.append((run, True))
            run, lines = set(), 0
    return out


def runs(text: bytes) -> list[tuple[list[bytes], list[int]]]:
    """(words, the line of each) of every run of several lines between empty ones."""
    out, words, at, lines = [], [], [], 0
    for line in [*text.split(b"\n"), b""]:
        found = line.split()
        if found:
            words += found
            at += [lines] * len(found)
            lines += 1
        else:
            if lines > 1:
                out.append((words, at))
            words, at, lines = [], [], 0
    return out


def in_order(words: list[bytes], wording: list[bytes], need: int) -> list[tuple[int, int, int]]:
    """(first, last, common): places of at most 5/4 of the wording's length that hold `need` of its words in their order."""
    out, wanted, most = [], frozenset(wording), len(wording) + len(wording) // 4
    for first, word in enumerate(words):
        if word not in wanted:
            continue
        common = [0] * (len(wording) + 1)  # longest common subsequence with each of the wording's beginnings
        best = need - 1
        for last in range(first, min(first + most, len(words))):
            if words[last] not in wanted:
                continue
            diagonal = 0
            for i, w in enumerate(wording, 1):
                before = common[i]
                common[i] = diagonal + 1 if words[last] == w else max(before, common[i - 1])
                diagonal = before
            if common[-1] > best:
                best = common[-1]
                out.append((first, last, best))
    return out


def wrapped(index: TemplateIndex, text: bytes) -> dict[int, tuple[float, bool]]:
    """Template number -> (containment, whether it stands without a larger template around it), of short notices that run over a line's end."""
    out: dict[int, tuple[float, bool]] = {}
    for words, line in runs(text):
        places = {}
        for no in index.matches(set(words)):
            _, tokens, _, need = index.templates[no]
            if len(tokens) < WRAPPED:
                places[no] = in_order(words, index.wording[no], need)
        for no, found in places.items():
            _, tokens, _, _ = index.templates[no]
            larger = [p for other, more in places.items() if tokens < index.templates[other][1] for p in more]
            for first, last, common in found:
                if line[first] != line[last]:
                    alone = not any(a <= last and first <= b for a, b, _ in larger)
                    share, was = out.get(no, (0.0, False))
                    out[no] = (max(share, common / len(tokens)), was or alone)
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, least: float = 0.9) -> DataFrame:
    """A row for each document: id column, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places where a phrase stands, first_word and last_word are the least and the largest of their
    starts in words from 0 (null if none); spans lists (label, word). A block is a line or, for templates of WRAPPED
    distinct tokens or more, a run of lines between empty ones; for shorter templates also a place of at most 5/4 of the
    template's length that runs over a line's end, in which the tokens stand in their order. labels adds those of all templates of which a block holds `least` of the distinct tokens, without templates that are part of another that the same
    block matches. Labels are distinct, sorted, comma-joined. score is 1 for a phrase, else the largest containment
    that meets the threshold, else 0. One pass counts tokens (a few hundred rows reach the driver), one scans;
    whole texts are read and nothing else is shuffled.

    Null and empty texts have no words and empty labels. Null ids and repeated rows are kept, other columns ignored.
    """
    index = TemplateIndex(templates, token_frequencies(docs, text_col=text_col, templates=templates), least)
    wanted = [(label, phrase.encode().translate(_TABLE).split()) for label, phrase in phrases]
    last_words = {p[-1] for _, p in wanted}
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(text: bytes):
        flat = text.translate(_TABLE)
        words = flat.split()
        places = []
        distinct = set(words)
        if not last_words.isdisjoint(distinct):
            for label, phrase in wanted:
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        places.append((at, label))
        base = sorted({label for _, label in places})
        labels, score = set(base), 1.0 if base else 0.0
        if not index.rare.isdisjoint(distinct):
            for block, several in blocks(flat):
                found = {no: share for no, share in index.matches(block).items() if not several or len(index.templates[no][1]) >= WRAPPED}
                for no, share in found.items():
                    label, tokens = index.templates[no][:2]
                    if not any(tokens < index.templates[other][1] for other in found):
                        labels.add(label)
                    score = max(score, share)
            for no, (share, alone) in wrapped(index, flat).items():
                if alone:
                    labels.add(index.templates[no][0])
                score = max(score, share)
        places.sort()
        starts = [p for p, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), score, [{"label": b, "word": a} for a, b in places]

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))]
        for batch in batches:
            rows = [scan(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *names])

    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
