import re

import numpy as np

from tracewell.llm import licences as lic
from tracewell.llm.licence_texts import FAMILIES, PLAIN_LINES, UNKNOWN_LINES

# Notices in other words than those learned from, as projects write them, and what each is.
INDEPENDENT = [
    ("mit", "This library is available as open source under the terms of the MIT License."), ("mit", "Code released under the MIT license."), ("mit", "tqdm-like helper, MIT License, Copyright (c) 2021 Jane Roe"),
    ("apache-2.0", "Apache License, Version 2.0, see LICENSE for the full text"), ("apache-2.0", "The connector is licensed under the Apache License, Version 2.0"),
    ("gpl", "This file is part of Frob. Frob is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl", "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with Frob."),
    ("lgpl", "Frob is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1."),
    ("agpl", "Frob is licensed under the GNU Affero General Public License v3.0 or later."), ("bsd", "Use of this source code is governed by a BSD-style license which can be found in the LICENSE.md file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations below) provided that the following conditions are met:"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."), ("cc-by", "This paper is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Slides are licensed under CC BY-NC 4.0."), ("cc-by-sa", "This dataset is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "This dataset has been dedicated to the public domain under CC0 1.0 Universal."), ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the author be held liable for any damages arising from its use."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See LICENSE.txt"), ("proprietary", "Copyright 1998 Frob Ltd. All rights reserved."), ("proprietary", "Unauthorized copying of these files, via any medium, is strictly prohibited."),
    ("public-domain", "This is free and unencumbered software released into the public domain by its author."),
    ("unknown", "Released under the Frob Community License, see the license for what you may do."), ("unknown", "For license terms ask the maintainers."), ("unknown", "SPDX-License-Identifier: LicenseRef-Frob"),
    ("none", "The talks about fishing licenses ended without a result on Tuesday."), ("none", "Her permission was asked twice, and the distribution of bread went on."), ("none", "Purpose and form of the meeting were unclear, he said."),
    ("none", "Die Genehmigung wurde mit Verspätung erteilt."), ("none", "Le programme commence demain soir avec une copie du film."),
]


def judge(model, w):
    """Class, calibrated probability and whether a template confirms it, in plain Python."""
    z = model.scores(w)
    best = int(z.argmax())
    p = 1 / np.exp((z - z.max()) / model.temperature).sum()
    share = max((len(lic.pairs(lic.words(t)) & lic.pairs(w)) / len(lic.pairs(lic.words(t))) for t in FAMILIES.get(model.classes[best], ())), default=0)
    return model.classes[best], p, share >= lic.CONFIRMED


def brute(model, text):
    """The same judgement of single lines in plain Python; lines here stand between blank ones."""
    cue = re.compile(r"(?i)\b(?:" + "|".join(model.cues) + ")")
    out = []
    for n, line in enumerate(text.split("\n") if text is not None else []):
        if cue.search(line):
            family, p, confirmed = judge(model, lic.words(line))
            if family != lic.PLAIN:
                out.append((n, family if p >= model.sure and confirmed else lic.OTHER, confirmed))
    return out


def test_equals_brute_force_and_finds_notices(spark):
    model = lic.learn()
    texts = [t for ts in FAMILIES.values() for t in ts] + [t for _, t in INDEPENDENT] + list(UNKNOWN_LINES) + list(PLAIN_LINES)
    rows = [(i, f"Some prose stands here.\n\n{t}\n\nMore of it.", "x", 1) for i, t in enumerate(texts)]
    rows += [(900, None, "x", 1), (901, "", "x", 1), (None, "Released under the MIT License.", "x", 1), (904, "word " * 20_000 + "\n\nLicensed under CC BY-NC 4.0.\n", "x", 1)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, notices string, line long")
    got = lic.with_licences(df, model).collect()
    assert len(got) == len(rows) and all(r.line == 1 for r in got)
    for r in got:
        assert [(n.line, n.family, n.confirmed) for n in r.notices] == brute(model, r.text), r.text
    families = [f for f, ts in FAMILIES.items() for _ in ts]
    named = {r.doc_id: [n.family for n in r.notices] for r in got if r.doc_id is not None}
    assert sum(named[i] == [f] for i, f in enumerate(families)) >= 0.97 * len(families)
    assert named[904] == ["cc-by-nc"]
    assert lic.with_licences(df.limit(0), model).count() == 0


def test_independent_notices(spark):
    model = lic.learn()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(INDEPENDENT)], "doc_id long, text string")
    got = {r.doc_id: [n.family for n in r.notices] for r in lic.with_licences(df, model).collect()}
    right = [got[i] == ([] if f == "none" else [f]) for i, (f, _) in enumerate(INDEPENDENT)]
    wrong = [(INDEPENDENT[i], got[i]) for i, ok in enumerate(right) if not ok]
    assert sum(right) >= 0.85 * len(right), wrong
    # a family that isn't the notice's own is worse than no family
    assert not [x for x in wrong if x[1] and x[1][0] not in ("unknown", x[0][0])], wrong


def test_long_lines_are_judged_by_sentence(spark):
    prose = "Some words stand in a row and say little. " * 60
    df = spark.createDataFrame([(1, prose + "Released under the MIT License. " + prose), (2, "no end " * 3000 + "license"), (3, "a license b\n" * 3000)], "doc_id long, text string")
    got = {r.doc_id: [(n.line, n.family) for n in r.notices] for r in lic.with_licences(df).collect()}
    assert got[1] == [(0, "mit")] and not [f for _, f in got[2] + got[3] if f not in ("unknown",)]


def test_held_out_copies_and_calibration():
    model = lic.learn(seed=5)
    rng = np.random.default_rng(99)
    named = right = total = 0
    for family, ts in FAMILIES.items():
        for t in ts:
            for _ in range(5):
                f, p, confirmed = judge(model, lic._varied(rng, lic.words(t)))
                total += 1
                if f not in (lic.OTHER, lic.PLAIN) and p >= model.sure and confirmed:
                    named += 1
                    right += f == family
    assert right >= 0.98 * named and named >= 0.6 * total


def test_names_other_spellings_and_footers(spark):
    rows = [(1, "LGPL-2.1 applies here"), (2, "Distribué sous licence MIT"), (3, "Some words.\n\nAll rights reserved."), (4, "Copyright (c) 2011, Frob. All rights reserved."), (5, "This project is licensed under the Apache Licence 2.0.")]
    got = {r.doc_id: [n.family for n in r.notices] for r in lic.with_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[1]) == 1 and got[1][0] in ("lgpl", "unknown") and not got[3] and not got[4] and got[5] == ["apache-2.0"], got


def test_threshold_comes_from_held_out_notices():
    model = lic.learn()
    assert 1 / len(model.classes) < model.sure < 1 and model.temperature > 1  # unseen notices are less sure than copies of those learned from


def test_nothing_is_passed_over_that_the_scores_call_a_notice(spark):
    """Lines of any words of the model, with and without cues, against the scores of every line."""
    model = lic.learn()
    rng = np.random.default_rng(17)
    known = sorted({x for g in model.weights for x in g.split()})
    pairs = sorted(g for g in model.weights if " " in g)
    lines = [" ".join(str(x) for x in rng.choice(known, rng.integers(1, 9))) for _ in range(300)]
    lines += [" ".join(str(x) for x in rng.choice(pairs, rng.integers(1, 5))) for _ in range(300)]
    lines += ["Neither the names of the owner nor the publisher", "to do so", "_MIT_LICENCE_ applies", "nothing of the kind"]
    got = lic.with_licences(spark.createDataFrame([(i, f"\n{x}\n") for i, x in enumerate(lines)], "doc_id long, text string"), model).collect()
    want = {i: judge(model, lic.words(x)) for i, x in enumerate(lines)}
    missing = [i for i in want if want[i][0] != lic.PLAIN and not re.search(r"(?i)\b(?:" + "|".join(model.marks) + ")", lines[i])]
    assert len(missing) > 20  # which a gate of marks would pass over
    for r in got:
        family, p, confirmed = want[r.doc_id]
        said = [] if family == lic.PLAIN else [(1, family if p >= model.sure and confirmed else lic.OTHER, confirmed)]
        assert [(n.line, n.family, n.confirmed) for n in r.notices] == said, lines[r.doc_id]


def test_paragraphs_are_judged_whole(spark):
    """Notices without a mark, of one word a line, which no line tells alone; they stand by themselves or behind other lines of their paragraph."""
    model = lic.learn()
    rng = np.random.default_rng(18)
    pairs = sorted(g for g in model.weights if " " in g)
    mark = re.compile(r"\b(?:" + "|".join(model.marks) + ")")
    texts = ["\n".join(" ".join(str(x) for x in rng.choice(pairs, 6)).split()) for _ in range(200)]
    texts = [t for t in texts if not mark.search(t) and all(judge(model, [w])[0] == lic.PLAIN for w in t.split())]
    texts += ["he and she were here\n" + t for t in texts] + ["he and she were here\n" * 9 + t for t in texts]
    got = {r.text: [n.family for n in r.notices] for r in lic.with_licences(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    assert all((judge(model, lic.words(t))[0] != lic.PLAIN) == (len(got[t]) == 1) for t in texts)
    assert sum(map(bool, got.values())) > 5
