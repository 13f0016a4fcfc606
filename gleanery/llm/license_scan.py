"""License scans: template markup compiled to token automata.

A template is wording with ``<<beginOptional>> ... <<endOptional>>`` regions,
which may be left out and may hold others, and ``<<var;...>>`` regions, which
other wording may stand for: ``max=N`` takes up to N words, ``match=".+"``,
``".*"`` or ``".{m,n}"`` any words (bounds count words here), and
``match="a b|c d"`` one of the wordings listed. ``name`` and ``original`` may be
given and do not decide. All templates become one automaton over words, run
once over a text; a text is accepted where all mandatory words stand in order
and exactly, however long the template is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wordings that many notices share.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met<<beginOptional>> 1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    "<<beginOptional>> 2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAME = '<<beginOptional>> 3<<endOptional>> neither the name of <<var;name="organization";original="the copyright holder";match=".{1,20}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission'

#: License notices and texts in template markup.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0<<beginOptional>> the license<<beginOptional>> you may not use this file except in compliance with the license<<endOptional>><<endOptional>>",
    "gpl-3.0": "licensed under<<beginOptional>> the terms of<<endOptional>> the gnu general public license<<beginOptional>> as published by the free software foundation<<endOptional>><<beginOptional>> either<<endOptional>> version 3<<beginOptional>> of the license<<endOptional>>",
    "gpl-2.0": "licensed under<<beginOptional>> the terms of<<endOptional>> the gnu general public license<<beginOptional>> as published by the free software foundation<<endOptional>><<beginOptional>> either<<endOptional>> version 2<<beginOptional>> of the license<<endOptional>>",
    "gpl-3.0-header": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation<<beginOptional>> either<<endOptional>> version 3<<beginOptional>> of the license<<beginOptional>> or at your option any later version<<endOptional>><<endOptional>>",
    "gpl-2.0-header": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation<<beginOptional>> either<<endOptional>> version 2<<beginOptional>> of the license<<beginOptional>> or at your option any later version<<endOptional>><<endOptional>>",
    "lgpl-header": 'you can redistribute it and or modify it under the terms of the gnu <<var;name="kind";original="lesser";match="lesser|library">> general public license as published by the free software foundation<<beginOptional>> either<<endOptional>> version <<var;name="version";original="2.1";match="2|2.1|3">><<beginOptional>> of the license<<endOptional>>',
    "agpl-3.0-header": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation<<beginOptional>> either<<endOptional>> version 3<<beginOptional>> of the license<<endOptional>>",
    "mpl-2.0-header": 'this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>><<var;name="scheme";original="https";match="http|https">> <<endOptional>>mozilla.org mpl 2.0',
    "cc-by-nc-4.0": "licensed under<<beginOptional>> a<<endOptional>><<beginOptional>> creative commons<<endOptional>> cc by nc 4.0",
    "cc-by-4.0": "licensed under<<beginOptional>> a<<endOptional>><<beginOptional>> creative commons<<endOptional>> cc by 4.0",
    "cc-by-notice": 'licensed under<<beginOptional>> a<<endOptional>><<beginOptional>> the<<endOptional>> creative commons attribution <<beginOptional>><<var;name="terms";original="sharealike";match="noncommercial|sharealike|share alike|noderivatives|noderivs|noncommercial sharealike|noncommercial noderivatives">> <<endOptional>><<var;name="version";original="4.0";match="1.0|2.0|2.5|3.0|4.0">> <<beginOptional>><<var;name="place";original="international";match="international|unported|generic">> <<endOptional>><<beginOptional>>public <<endOptional>>license',
    "mit-notice": "released under the<<beginOptional>> terms of the<<endOptional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit": 'permission is hereby granted free of charge to any person obtaining a copy of <<var;name="what";original="this software and associated documentation files";match="this software and associated documentation files|this software|the software">> the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice<<beginOptional>> including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software ' + _AS_IS,
    "isc-text": "permission to use copy modify and<<beginOptional>> or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted",
    "isc": 'permission to use copy modify and<<beginOptional>> or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;name="author";original="the author";match=".{1,12}">> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-clause": _BSD + '<<beginOptional>> this software is provided by <<var;name="holder";original="the copyright holders and contributors";match=".{1,20}">> as is<<endOptional>>',
    "bsd-3-clause": _BSD + _BSD_NAME,
    "zlib": 'this software is provided as is without any express or implied warranty in no event will the <<var;name="who";original="authors";match="author|authors">> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions',
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-1.0": "distributed under the boost software license version 1.0",
    "copyright-line": "copyright<<beginOptional>> c<<endOptional>> <<var;max=6>> all rights reserved",
}

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of other characters, blanks the rest.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in order."""
    return text.translate(_WORDS).split()


def _var(markup: str) -> tuple:
    """What may stand for a replaceable region: (gap, least, most) with None for no bound, or (either, wordings)."""
    fields = {k: quoted or bare for k, quoted, bare in re.findall(r';\s*(\w+)\s*=\s*(?:"([^"]*)"|([^;>"]*))', markup)}
    if "max" in fields:
        return "gap", 0, int(fields["max"])
    match = fields.get("match", ".*").strip()
    if match in (".*", ".+"):
        return "gap", int(match == ".+"), None
    if bounds := re.fullmatch(r"\.\{(\d+),(\d*)\}", match):
        return "gap", int(bounds[1]), int(bounds[2]) if bounds[2] else None
    # A point between digits is part of the wording.
    if re.search(r"[*+?{}\[\]\\^$]|\.(?!\d)", match):
        raise ValueError(f"no wording: {markup}")
    return "either", [words(x.encode()) for x in match.strip("()").split("|")]


def parse(template: str) -> list[tuple]:
    """Parts of a template: (word, w), (gap, least, most), (either, wordings) or (optional, parts)."""
    open_: list[list[tuple]] = [[]]
    for piece in re.split(r"(<<.*?>>)", template, flags=re.DOTALL):
        if piece.startswith("<<beginOptional"):
            open_.append([])
        elif piece.startswith("<<endOptional"):
            if len(open_) == 1:
                raise ValueError("a region ends that did not begin")
            region = open_.pop()
            open_[-1].append(("optional", region))
        elif piece.startswith("<<var"):
            open_[-1].append(_var(piece))
        else:
            open_[-1] += [("word", w) for w in words(piece.encode())]
    if len(open_) > 1:
        raise ValueError("an optional region does not end")
    return open_[0]


class TokenAutomaton:
    """All templates as one automaton, made deterministic as texts ask for it."""

    #: Deterministic states kept; beyond that they are made anew as texts ask for them.
    MOST = 20_000

    def __init__(self, templates: dict[str, str]):
        self.step: list[dict[bytes | None, set[int]]] = []  # by state: word (None: any) to states
        self.free: list[set[int]] = []  # by state: states reached without a word
        self.accepts: dict[int, str] = {}
        starts = set()
        for label, template in templates.items():
            at = self._state()
            starts.add(at)
            self.accepts[self._path(at, parse(template))] = label
        self.start = self._closure(starts)
        self.first = {w for s in self.start for w in self.step[s]}
        self.cache: dict[tuple[frozenset, bytes], frozenset] = {}
        self._forget()

    def _state(self) -> int:
        self.step.append({})
        self.free.append(set())
        return len(self.step) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        self.step[at].setdefault(word, set()).add(end := self._state())
        return end

    def _path(self, at: int, parts: list[tuple]) -> int:
        for kind, *what in parts:
            if kind == "word":
                at = self._word(at, what[0])
                continue
            end = self._state()
            if kind == "optional":
                self.free[at].add(end)
                self.free[self._path(at, what[0])].add(end)
            elif kind == "either":
                for wording in what[0]:
                    self.free[self._path(at, [("word", w) for w in wording])].add(end)
            else:
                least, most = what
                for _ in range(least):
                    at = self._word(at, None)
                self.free[at].add(end)
                for _ in range((most or least) - least):
                    at = self._word(at, None)
                    self.free[at].add(end)
                if most is None:
                    self.step[end].setdefault(None, set()).add(end)
            at = end
        return at

    def _closure(self, states: set[int]) -> frozenset:
        found, queue = set(states), list(states)
        while queue:
            fresh = self.free[queue.pop()] - found
            found |= fresh
            queue += fresh
        return frozenset(found)

    def _next(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if any(word in self.step[s] for s in states) else b"")
        if key not in self.cache:
            self.cache[key] = self._closure({t for s in states for w in (word, None) for t in self.step[s].get(w, ())})
        return self.cache[key]

    def find(self, text: list[bytes]) -> Iterator[tuple[str, int]]:
        """(label, first word) of each accepted place; overlapping ones, too."""
        first = self.first
        if first.isdisjoint(text):
            return
        for at, word in enumerate(text):
            if word not in first:
                continue
            states, seen = self.start, set()
            for w in islice(text, at, None):
                if not (states := self._next(states, w)):
                    break
                seen |= {self.accepts[s] for s in states if s in self.accepts}
            for label in sorted(seen):
                yield label, at

    def _forget(self) -> None:
        self.sets: list[frozenset] = []
        self.rows: list[dict[bytes | None, int]] = []  # by deterministic state: word (None: any other) to state
        self.names: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self._numbered(self.start)

    def _numbered(self, states: frozenset) -> int:
        if states not in self.known:
            self.known[states] = len(self.sets)
            self.sets.append(states)
            self.rows.append({})
            self.names.append(frozenset(self.accepts[s] for s in states if s in self.accepts))
        return self.known[states]

    def _row(self, at: int) -> dict[bytes | None, int]:
        states = self.sets[at]
        anything = {t for s in states for t in self.step[s].get(None, ())}
        alphabet = {w for s in states for w in self.step[s] if w is not None}
        to = lambda more: self._numbered(self._closure(anything | more) | self.start)
        self.rows[at] = {None: to(set()), **{w: to({t for s in states for t in self.step[s].get(w, ())}) for w in alphabet}}
        return self.rows[at]

    def labels(self, text: list[bytes]) -> set[str]:
        """Labels accepted anywhere, in one pass: each word may also begin a template anew."""
        found: set[str] = set(self.names[0])
        if None not in self.first and self.first.isdisjoint(text):
            return found
        at = 0
        for w in text:
            row = self.rows[at] or self._row(at)
            at = row.get(w, row[None])
            found |= self.names[at]
            if len(self.sets) > self.MOST:
                states = self.sets[at]
                self._forget()
                at = self._numbered(states)
        return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """License labels of every row.

    (id, n_words, n_base, first_word, last_word, base_labels, labels, score).
    ``score`` is 1 where a whole template is accepted, 0.5 where only base
    phrases stand, else 0. Null text counts as empty: no words, null places,
    empty labels. Repeated rows come out each, texts are read to their end
    however long, an empty table gives no rows; other columns are not looked at.
    """
    base, templates = base or BASE, templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, notices = TokenAutomaton({f"{i}:{v}": k for i, (k, v) in enumerate(base.items())}), TokenAutomaton(templates)
        for batch in batches:
            out = []
            for text in batch.column(1):
                tokens = words(text.as_py())
                places = list(phrases.find(tokens))
                own = notices.labels(tokens)
                plain = {label.partition(":")[2] for label, _ in places}
                at = [p for _, p in places]
                out.append((len(tokens), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(plain)), ",".join(sorted(plain | own)), 1.0 if own else 0.5 if plain else 0.0))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _regex(parts: list[tuple]) -> str:
    """The same wording over words joined and closed by single spaces."""
    made = ""
    for kind, *what in parts:
        if kind == "word":
            made += what[0].decode() + " "
        elif kind == "optional":
            made += f"(?:{_regex(what[0])})?"
        elif kind == "either":
            made += "(?:" + "|".join(b"".join(w + b" " for w in x).decode() for x in what[0]) + ")"
        else:
            made += "(?:[^ ]+ ){%d,%s}" % (what[0], "" if what[1] is None else what[1])
    return made


def _sql() -> str:
    places = " || ".join(
        f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {x!r}' for k, x in enumerate(p.split()))}), lambda i: {{'at': i - 1, 'label': '{label}'}})"
        for p, label in BASE.items()
    )
    own = ", ".join(f"CASE WHEN regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' {_regex(parse(t))}') THEN '{label}' END" for label, t in TEMPLATES.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} AS places, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM t)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(places, lambda x: x.at))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label) || own)), ','), '') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM p
"""


SQL = _sql()
