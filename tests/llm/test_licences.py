"""The licence scan: whole notices, wrapped files, neighbouring licences, and a plain version of the scan."""

import re
import textwrap

import numpy as np
import pytest

from spreadframe.llm import licences
from spreadframe.llm.queries import QUERIES


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as family", "1 as paragraph", "2 as line")
    found = [[] for _ in texts]
    for r in licences.scan_licences(docs).collect():
        found[r["doc_id"]].append(r)
    return found


# neighbours of the families, of which none may be confirmed as another; fixed values
NEIGHBOURS = [
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "GNU General Public License v2"), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), (None, "Licensed under CC BY-NC-ND 4.0."), (None, "Licensed under the Apache License, Version 1.1."),
    (None, "This work is licensed under a Creative Commons Attribution 3.0 Unported License."), (None, "Licensed under the Mozilla Public License, version 1.1."), (None, "Released under the BSD 4-Clause License."),
    (None, "Licensed under the Academic Free License, version 3."), (None, "Licensed under the Python Software Foundation License, version 2."), (None, "Released under the Educational Community License, Version 2.0."),
    (None, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


# frames and names that no template has; the first of each pair is the family, None for licences never trained on; fixed values
FRAMES = ["Distributed under the terms of {}.", "The code in this folder is covered by {}, see the file at the top.", "Available under {}", "You can use it under {} if you like", "Use of this data is governed by {}", "Copyright 2019 the authors, {}."]
REWORDED = [
    ("MIT", "the MIT licence"), ("MIT", "an MIT license"), ("Apache-2.0", "the Apache 2.0 licence"), ("Apache-2.0", "Apache License (version 2.0)"), ("GPL-3.0", "GPLv3"), ("GPL-3.0", "the GNU GPL v3"), ("GPL-3.0", "the GNU General Public License, v3"), ("GPL-2.0", "GPLv2"), ("GPL-2.0", "the GPL, version 2"),
    ("LGPL-2.1", "the LGPL v2.1"), ("LGPL-3.0", "the GNU LGPL version 3"), ("AGPL-3.0", "the AGPLv3"), ("AGPL-3.0", "the GNU AGPL v3"), ("BSD-3-Clause", "the three-clause BSD 3-clause licence"), ("BSD-3-Clause", "a 3-Clause BSD licence"), ("BSD-2-Clause", "the 2-clause BSD licence"),
    ("CC-BY-4.0", "a CC BY 4.0 licence"), ("CC-BY-SA-4.0", "CC-BY-SA 4.0"), ("MPL-2.0", "the MPL 2.0"), ("EPL-2.0", "the EPL 2.0"), (None, "the zlib licence"), (None, "the SIL Open Font Licence 1.1"), (None, "the WTFPL"), (None, "the Beerware licence"), (None, "CC BY-NC-ND 3.0"), (None, "the Ruby licence"), (None, "the EUPL v1.2"),
]


@pytest.fixture(scope="module")
def found(spark):
    templates = [t for _, t in licences.TEMPLATES]
    wrapped = ["some words before\n\n" + textwrap.fill(t, 60, initial_indent=" * ", subsequent_indent=" * ") + "\n \nwords after" for t in templates]
    return {"plain": scan(spark, [f"plain words here and there\n\n{t}" for t in templates]), "wrapped": scan(spark, wrapped), "neighbours": scan(spark, [t for _, t in NEIGHBOURS]), "reworded": scan(spark, [f.format(n) for _, n in REWORDED for f in FRAMES])}


def test_reworded_notices_are_named(found):
    families = [f for f, _ in REWORDED for _ in FRAMES]
    named = [f in {r["family"] for r in rows} for f, rows in zip(families, found["reworded"]) if f]
    assert len(named) >= 100 and sum(named) >= 0.9 * len(named)
    wrong = [(f, [r["family"] for r in rows if r["confirmed"]]) for f, rows in zip(families, found["reworded"]) if {r["family"] for r in rows if r["confirmed"]} - {f}]
    assert wrong == []


def test_tags(spark):
    ids = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-only", "LGPL-2.1-or-later", "BSD-3-Clause", "CC0-1.0", "MPL-2.0", "Unlicense"]
    rows = scan(spark, [f"// SPDX-License-Identifier: {i}" for i in ids] + ["# SPDX-License-Identifier: Zlib", "This file is GPLv3.", "CC BY-SA 4.0"])
    for i, r in zip(ids, rows):
        assert {x["family"] for x in r if x["confirmed"]} == {i.replace("-or-later", "").replace("-only", "")}, (i, r)
    assert not rows[-3] or not any(x["confirmed"] for x in rows[-3])
    assert [x["family"] for x in rows[-2]] == ["GPL-3.0"] and [x["family"] for x in rows[-1]] == ["CC-BY-SA-4.0"]


@pytest.mark.parametrize("kind", ["plain", "wrapped"])
def test_templates_are_named_and_confirmed(found, kind):
    for (family, text), rows in zip(licences.TEMPLATES, found[kind]):
        assert any((r["family"], r["confirmed"], r["paragraph"], r["line"]) == (family, True, 1, None) and r["similarity"] == 1.0 for r in rows), (family, text, rows)
        assert {r["family"] for r in rows if r["confirmed"]} == {family}


def test_neighbours_are_never_confirmed_as_another_family(found):
    for (family, text), rows in zip(NEIGHBOURS, found["neighbours"]):
        assert {r["family"] for r in rows if r["confirmed"]} <= {family}, (text, rows)
    named = [family in {r["family"] for r in rows} for (family, _), rows in zip(NEIGHBOURS, found["neighbours"]) if family]
    assert sum(named) >= 0.9 * len(named)


def test_odd_texts(spark):
    odd = [None, "", "the license of the work is under way\nno notice at all", "river stone cloud " * 5000 + " license", "license " * 20_000, "\n\n \n", "Released under the MIT License.\r\n\r\nmore"]
    got = scan(spark, odd)
    assert not any(r["confirmed"] for rows in got[:-1] for r in rows) and got[-1][0]["confirmed"]
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (7, "Released under the MIT License."), (7, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in licences.scan_licences(docs).collect() if r["confirmed"]) == ["7", "7", "None"]
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_scan_equals_a_plain_version(spark, tiny, monkeypatch):
    """Every row of the query by plain Python over the same fitted weights."""
    fitted = []
    original = licences.fit
    monkeypatch.setattr(licences, "fit", lambda sample: fitted.append(original(sample)) or fitted[-1])
    got = {(r["doc_id"], r["paragraph"], r["line"]): r for r in QUERIES["op2_licences"](spark, tiny).collect()}
    w, b = fitted[-1]
    at = {g: i for i, g in enumerate(licences.VOCABULARY)}
    held = [(f, licences._grams(licences._words(t))) for f, t in licences.TEMPLATES]
    want = {}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        for k, block in enumerate(re.split(r"\r?\n(?:[ \t]*\r?\n)+", r["text"] or "")):
            lines = block.split("\n")
            for line, piece in [(None, block), *(enumerate(lines) if len(lines) > 1 else ())]:
                grams = licences._grams(licences._words(piece))
                if any(g in at for g in grams):  # no filter: what has no vocabulary is unknown
                    z = w[[at[g] for g in grams if g in at]].sum(0) + b
                    p = licences._softmax(z[None])[0]
                    family = licences.FAMILIES[int(p.argmax())]
                    if family != licences.UNKNOWN and p.max() >= licences.LEAST:
                        share = max(len(grams & h) / len(h) for f, h in held if f == family)
                        want[r["doc_id"], k, line] = (family, p.max(), licences.marked(piece)[licences.FAMILIES.index(family) - 1] and share >= licences.CONFIRM, share)
    assert set(got) == set(want) and want
    for key, (family, p, confirmed, share) in want.items():
        r = got[key]
        assert r["family"] == family and r["confirmed"] == confirmed and np.isclose(r["probability"], p, atol=1e-9) and np.isclose(r["similarity"], share)
