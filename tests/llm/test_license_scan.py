"""Automata against regular expressions; places, labels and odd texts."""

import random
import re

import pytest
from gleanery.llm.license_scan import BASE, TEMPLATES, TokenAutomaton, _regex, parse, scan, words


def filled(template, rng):
    """The wording with some of the regions in it."""
    if rng.random() < 0.5:
        while (left := re.sub("<<beginOptional>>(?:(?!<<(?:begin|end)Optional).)*<<endOptional>>", " ", template)) != template:
            template = left
    template = re.sub(r'<<var[^>]*match="([^".]+(?:\.\d[^"]*)?)">>', lambda m: " " + rng.choice(m[1].split("|")) + " ", template)
    return re.sub("<<(?:begin|end)[^>]*>>", " ", re.sub("<<var[^>]*>>", " one two ", template))


def test_automaton_against_regular_expressions():
    rng = random.Random(1)
    vocabulary = sorted({w for t in TEMPLATES.values() for w in words(re.sub("<<[^>]*>>", " ", t).encode())})
    patterns = {k: re.compile(_regex(parse(t))) for k, t in TEMPLATES.items()}
    automaton = TokenAutomaton(TEMPLATES)
    for _ in range(400):
        text = [rng.choice(vocabulary) for _ in range(30)]
        for _ in range(2):  # plant wording, sometimes with a gap or an edit
            pieces = [w for t in [rng.choice(list(TEMPLATES.values()))] for w in words(filled(t, rng).encode())]
            if rng.random() < 0.2:
                pieces[rng.randrange(len(pieces))] = b"other"
            at = rng.randrange(len(text))
            text[at:at] = pieces
        joined = " " + b" ".join(text).decode() + " "
        want = {k for k, p in patterns.items() if any(m for m in [re.search(" " + p.pattern, joined)])}
        assert {k for k, _ in automaton.find(text)} == want == automaton.labels(text)


def test_rows(spark):
    rows = [
        (1, "MIT License. Released under the MIT license"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "the gnu  general-public LICENSE, Apache\nLicense; mit licenses"),
        (4, None),
        (5, ""),
        (6, "Copyright (c) 2020 Someone Else Inc. All rights reserved"),
        (7, "mit license " * 50_000),
        (7, "über mit licenseé"),
        (None, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {(r.doc_id, r.n_words): r for r in scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")).collect()}
    show = lambda i, n: (got[i, n].n_base, got[i, n].first_word, got[i, n].last_word, got[i, n].base_labels, got[i, n].labels, got[i, n].score)
    assert show(1, 7) == (2, 0, 5, "mit", "mit,mit-notice", 1.0)
    assert show(2, 7) == (1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert show(3, 9) == (2, 1, 5, "apache,gpl", "apache,gpl", 0.5)
    assert show(4, 0) == show(5, 0) == (0, None, None, "", "", 0.0)
    assert show(6, 9) == (0, None, None, "", "copyright-line", 1.0)
    assert show(7, 100_000)[:3] == (50_000, 0, 99_998)
    assert show(7, 3) == (0, None, None, "", "", 0.0)
    assert show(None, 12) == (1, 6, 6, "gpl", "gpl,gpl-3.0", 1.0)
    assert len(BASE) == 4


def test_regions():
    """Parts as written out by hand: regions in regions, replaceable wording, gaps."""
    assert parse("a <<beginOptional;name=x>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e") == [("word", b"a"), ("optional", [("word", b"b"), ("optional", [("word", b"c")]), ("word", b"d")]), ("word", b"e")]
    assert parse('<<var;name="v";original="x > y";match="2.0|three four">>') == [("either", [[b"2", b"0"], [b"three", b"four"]])]
    assert parse('<<var;max=3>><<var;match=".+">><<var;match=".{2,5}">><<var;name="n">>') == [("gap", 0, 3), ("gap", 1, None), ("gap", 2, 5), ("gap", 0, None)]
    for broken in ("<<endOptional>>", "<<beginOptional>> a", '<<var;match="[ab]c">>'):
        with pytest.raises(ValueError):
            parse(broken)
    accepts = lambda t, text: TokenAutomaton({"t": t}).labels(text.encode().split()) == {"t"}
    nested = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e"
    assert all(accepts(nested, x) for x in ("a e", "a b d e", "x a b c d e y")) and not any(accepts(nested, x) for x in ("a d e", "a c e", "a b c e", "a b e"))
    assert accepts('a <<var;match=".+">> z', "a " + "w " * 5000 + "z") and not accepts('a <<var;match=".+">> z', "a z")
    assert accepts('v <<var;match="2|2.1">> end', "v 2 end") and accepts('v <<var;match="2|2.1">> end', "v 2 1 end") and not accepts('v <<var;match="2|2.1">> end', "v 3 end")


def test_long_templates_and_many_states(monkeypatch):
    long = [f"w{i}" for i in range(2500)]
    automaton = TokenAutomaton({"long": " ".join(long)})
    text = [w.encode() for w in ["x", *long[:2400], *long, "y"]]
    assert automaton.labels(text) == {"long"} and [x for x in automaton.find(text)] == [("long", 2401)]
    text[3000] = b"edited"
    assert automaton.labels(text) == set()
    monkeypatch.setattr(TokenAutomaton, "MOST", 50)
    text[3000] = long[3000 - 2401].encode()
    assert TokenAutomaton({"long": " ".join(long)}).labels(text) == {"long"}


def test_notices_as_they_are_written(spark):
    texts = {
        "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "agpl-3.0-header": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "cc-by-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    got = scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert all(r.doc_id in r.labels.split(",") for r in got), [(r.doc_id, r.labels) for r in got]
