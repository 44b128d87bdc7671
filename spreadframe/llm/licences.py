"""Licence scans: a paragraph classifier over word n-grams, confirmed against templates.

A softmax regression over the n-grams that occur in licence templates is trained here, on
variants of the templates, with texts of other licences and a bounded sample of the
corpus's own paragraphs as the unknown class. Its temperature is calibrated on variants,
paragraphs and other licences that it was not trained on. Paragraphs are what blank lines
separate, hard-wrapped or not, and every line is scored as well, for one-line notices. A
predicted family is confirmed if the text holds enough of the n-grams of one of its
templates and the words that set the family apart from its neighbours, and none of theirs.
"""

from __future__ import annotations

import random
import re
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

UNKNOWN = "unknown"
# opening words of public licence texts and usual one-line notices; fixed values
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the Simplified BSD License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("Unlicense", "Released under the Unlicense."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
# names and tags by which texts refer to these licences; fixed values
NAMES = {
    "MIT": ["MIT License", "MIT-licensed", "Expat License"], "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License v2.0", "Apache License, Version 2"],
    "GPL-3.0": ["GPLv3", "GPL v3", "GPL version 3", "GPL-3.0", "GNU GPL 3", "GNU General Public License v3.0", "GNU General Public License 3.0"], "GPL-2.0": ["GPLv2", "GPL v2", "GPL version 2", "GPL-2.0", "GNU GPL 2", "GNU General Public License v2.0", "GNU General Public License 2.0"],
    "LGPL-2.1": ["LGPLv2.1", "LGPL v2.1", "LGPL version 2.1", "LGPL-2.1", "GNU Lesser General Public License v2.1"], "LGPL-3.0": ["LGPLv3", "LGPL v3", "LGPL version 3", "LGPL-3.0", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["AGPLv3", "AGPL v3", "AGPL version 3", "AGPL-3.0", "GNU Affero General Public License v3.0"], "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License", "BSD-2-Clause"], "ISC": ["ISC License"], "CC0-1.0": ["CC0 1.0", "CC0-1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"],
    "MPL-2.0": ["MPL 2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License v2.0"], "EPL-2.0": ["EPL 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"], "Unlicense": ["the Unlicense"],
}
TAGS = {f: [f] if "GPL" not in f else [f, f"{f}-only", f"{f}-or-later"] for f in NAMES}
TEMPLATES += [(f, n) for f, names in NAMES.items() for n in names] + [(f, f"SPDX-License-Identifier: {t}") for f, tags in TAGS.items() for t in tags]
# of each family: words of which one sequence of each row must occur, and sequences of its neighbours that must not; fixed values
_V2, _V21, _V3 = ["version 2", "v2", "v 2", "gplv2", "gpl 2", "license 2"], ["version 2 1", "v2 1", "v 2 1", "lgplv2 1", "lgpl 2 1", "license 2 1"], ["version 3", "v3", "v 3", "gplv3", "gpl 3", "license 3", "lgplv3", "lgpl 3", "agplv3", "agpl 3"]
MARKS: dict[str, tuple[list[list[str]], list[str]]] = {
    "MIT": ([["mit license", "mit licensed", "expat license", "to deal in the software", "identifier mit"]], ["isc license", "clear bsd", "mit 0"]),
    "Apache-2.0": ([["apache license version 2", "apache license 2 0", "apache 2 0", "apache license v2 0", "basis without warranties or conditions of any kind"]], ["version 1 1", "version 1 0", "apache 1 1"]),
    "GPL-3.0": ([["gnu general public license", "gnu gpl", "gpl", "gplv3"], _V3], ["lesser", "affero", "library general", "lgpl", "agpl", "lgplv3", "agplv3", *_V2]),
    "GPL-2.0": ([["gnu general public license", "gnu gpl", "gpl", "gplv2"], _V2], ["lesser", "affero", "library general", "lgpl", "agpl", "lgplv2", *_V3]),
    "LGPL-2.1": ([["lesser general public license", "lgpl", "lgplv2"], _V21], _V3),
    "LGPL-3.0": ([["lesser general public license", "lgpl", "lgplv3"], _V3], [*_V2, "lgplv2", "lgpl 2"]),
    "AGPL-3.0": ([["affero general public license", "agpl", "agplv3"], _V3], _V2),
    "BSD-3-Clause": ([["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "neither the name of"]], ["bsd 2 clause", "2 clause bsd", "bsd 4 clause", "4 clause bsd", "all advertising materials", "clause clear"]),
    "BSD-2-Clause": ([["bsd 2 clause", "2 clause bsd", "simplified bsd"]], ["bsd 3 clause", "3 clause bsd", "bsd 4 clause", "4 clause bsd", "neither the name of", "2 clause patent", "clause views"]),
    "ISC": ([["isc license", "identifier isc", "for any purpose with or without fee is hereby granted provided that the above copyright notice"]], ["mit license", "0bsd", "zero clause"]),
    "CC0-1.0": ([["cc0 1 0"]], []),
    "CC-BY-4.0": ([["cc by 4 0", "commons attribution 4 0"]], ["sharealike", "noncommercial", "noderivatives", "by sa", "by nc", "by nd"]),
    "CC-BY-SA-4.0": ([["cc by sa 4 0", "attribution sharealike 4 0"]], ["noncommercial", "noderivatives", "by nc", "by nd"]),
    "CC-BY-NC-4.0": ([["cc by nc 4 0", "attribution noncommercial 4 0"]], ["sharealike", "noderivatives", "by sa", "nc sa", "nc nd"]),
    "CC-BY-ND-4.0": ([["cc by nd 4 0", "attribution noderivatives 4 0"]], ["sharealike", "noncommercial", "by nc", "by sa"]),
    "CC-BY-NC-SA-4.0": ([["cc by nc sa 4 0", "noncommercial sharealike 4 0"]], ["noderivatives"]),
    "MPL-2.0": ([["mozilla public license v 2 0", "mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0", "mplv2"]], ["version 1 1", "version 1 0", "mpl 1 1"]),
    "EPL-2.0": ([["eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "epl 2 0"]], ["license 1 0", "version 1 0", "v 1 0", "epl 1 0"]),
    "Unlicense": ([["the unlicense", "identifier unlicense", "free and unencumbered software"]], []),
}
# licences and notices outside these families: the unknown class's own texts; fixed values
OTHERS = [
    "Licensed under the Artistic License, version 2.0.", "Released under the zlib License.", "Released under the Boost Software License, Version 1.0.",
    "This program is licensed under the European Union Public Licence, version 1.2.", "Licensed under the Common Development and Distribution License, version 1.0.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License.", "Released under the PostgreSQL License.",
    "Released under the BSD 4-Clause License.", "Licensed under the Apache License, Version 1.1.", "Licensed under the GNU Free Documentation License, version 1.3.",
    "Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "Licensed under CC BY-SA 3.0.", "Licensed under the Academic Free License, version 3.0.",
    "Licensed under the Server Side Public License, version 1.", "Licensed under the Mozilla Public License, version 1.1.", "Licensed under the Eclipse Public License, version 1.0.",
    "All rights reserved. No part of this publication may be reproduced or distributed in any form without the prior written permission of the publisher.",
    "This document is confidential and may not be copied, distributed or modified without permission.", "You must accept the terms of the license agreement before you use this software.",
    "The driving license of any person is published by the public office and may be used as a document.", "This software is provided without warranty of any kind.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    *(f"SPDX-License-Identifier: {t}" for t in ("Zlib", "BSL-1.0", "CC-BY-NC-ND-4.0", "Apache-1.1", "MPL-1.1", "EPL-1.0", "CC-BY-3.0", "CC-BY-SA-3.0", "OFL-1.1", "GFDL-1.3-only", "BSD-4-Clause", "Python-2.0", "LGPL-2.0-only", "GPL-1.0-only", "CDDL-1.0", "EUPL-1.2")),
    "The team studied at MIT for two years.", "The Apache web server 2.0 was installed on the machine.", "Version 3 of the software was released to the public.", "The ISC conference is open to the public.", "You may copy this work and use it in your own work.",
]
FAMILIES = [UNKNOWN, *MARKS]
# words that any text has; n-grams of these alone are no feature; fixed values
FUNCTION_WORDS = frozenset("a an and any are as at be by for from if in into is it may no not of on or that the their these this to under use used was with without work you your".split())
LENGTHS = (1, 2, 3)
#: Paragraphs of the corpus that the classifier is trained on, documents they come from, and their characters, at most.
SAMPLE = 4000
SAMPLE_DOCS = 400
SAMPLE_CHARS = 2000
#: Words of the corpus that are put around template variants, at most.
SAMPLE_WORDS = 20_000
#: Share of a template's n-grams that confirms it, and the least probability of a family.
CONFIRM = 0.8
LEAST = 0.5


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower().replace("licence", "license"))


def _grams(words: list[str]) -> set[str]:
    """N-grams with a word that says something."""
    return {" ".join(words[i : i + n]) for n in LENGTHS for i in range(len(words) - n + 1) if not FUNCTION_WORDS.issuperset(words[i : i + n])}


VOCABULARY = sorted(set().union(*(_grams(_words(t)) for _, t in TEMPLATES)) | {" ".join(s.split()[i : i + 3]) for _, bars in MARKS.values() for s in bars for i in range(max(1, len(s.split()) - 2)) if not FUNCTION_WORDS.issuperset(s.split()[i : i + 3])})
#: Words that set families apart: variants of a template keep them.
_KEPT = {w for needs, bars in MARKS.values() for s in (*(s for alternatives in needs for s in alternatives), *bars) for w in s.split()}


def _variant(words: list[str], other: list[str], rng: random.Random) -> list[str]:
    kept = [w for w in words if w in _KEPT or rng.random() > 0.08]
    around = rng.choices(other, k=rng.randrange(0, 24)) if other else []
    cut = rng.randrange(len(around) + 1)
    return around[:cut] + kept + around[cut:]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(sample: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-grams by families) and biases, divided by the calibrated temperature."""
    rng, at = random.Random(seed), {g: i for i, g in enumerate(VOCABULARY)}
    plain = [w for w in map(_words, sample) if w]
    licences = [_words(t) for t in OTHERS]
    # the corpus's own paragraphs without those that hold most of a template, and loose licence words
    held = [_grams(_words(t)) for _, t in TEMPLATES]
    known = set().union(*held)
    grams = [known & _grams(w) for w in plain]
    plain = [w for w, g in zip(plain, grams) if all(len(h & g) < 0.5 * len(h) for h in held)]
    other = [w for ws in plain for w in ws]
    other = other if len(other) <= SAMPLE_WORDS else rng.sample(other, SAMPLE_WORDS)
    names = {w[0] for _, t in TEMPLATES if len(w := _words(t)) == 1}
    loose = [w for _, t in TEMPLATES for w in _words(t) if w not in names]

    def rows(texts: list[list[str]], part: list[list[str]], copies: int) -> list[tuple[int, list[str]]]:
        out = [(FAMILIES.index(f), _variant(_words(t), other, rng)) for f, t in TEMPLATES for _ in range(copies)]
        out += [(0, _variant(t, other, rng)) for t in texts for _ in range(2 * copies)] + [(0, w) for w in part]
        return out + [(0, rng.sample(loose, rng.randrange(1, 9)) + rng.choices(other or loose, k=6)) for _ in range(8 * copies)]

    # calibration sees paragraphs and whole other licences that training does not
    train, check = rows(licences[::3] + licences[1::3], plain[::2], 12), rows(licences[2::3], plain[1::2], 4)

    def matrix(part: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(part), len(VOCABULARY)), dtype=np.float32)
        for i, (_, w) in enumerate(part):
            x[i, [at[g] for g in _grams(w) if g in at]] = 1
        return x, np.array([k for k, _ in part])

    (x, y), (cx, cy) = matrix(train), matrix(check)
    w, b = np.zeros((x.shape[1], len(FAMILIES)), dtype=np.float32), np.zeros(len(FAMILIES), dtype=np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    # steps are scaled by what a weight has moved before, so that rare n-grams learn as fast as common ones
    seen, seen_b = np.full_like(w, 1e-10), np.full_like(b, 1e-10)
    for _ in range(150):
        g = _softmax(x @ w + b) - target
        gw, gb = x.T @ g / len(x) + 1e-6 * w, g.mean(0)
        seen += gw * gw
        seen_b += gb * gb
        w -= 0.3 * gw / np.sqrt(seen)
        b -= 0.3 * gb / np.sqrt(seen_b)

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax((cx @ w + b) / t)[np.arange(len(cy)), cy], 1e-12)).mean())

    t = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return (w / t).astype(float), (b / t).astype(float)


def marked(text: str) -> list[bool]:
    """Whether a text holds the words of each family, in plain Python."""
    flat = f" {' '.join(_words(text))} "
    return [all(any(f" {s} " in flat for s in any_of) for any_of in needs) and not any(f" {s} " in flat for s in bars) for needs, bars in MARKS.values()]


def _marked(family: Column, flat: Column) -> Column:
    """The same for the predicted family alone."""
    has = lambda some: reduce(or_, (flat.contains(f" {x} ") for x in some), F.lit(False))
    out = F.when(F.lit(False), False)
    for f, (needs, bars) in MARKS.items():
        out = out.when(family == f, reduce(and_, map(has, needs)) & ~has(bars))
    return out.otherwise(False)


def telling_words(w: np.ndarray, b: np.ndarray) -> list[str]:
    """Words of which a text must hold one to leave the unknown class.

    Words are set aside one by one, those that speak least for any family first, as long as all n-grams
    of set-aside words together could not lift any family over the unknown class. So a text without
    any of the others is unknown, whatever else it holds: the filter drops nothing.
    """
    gain = np.maximum(0, w[:, 1:] - w[:, :1])
    room = b[0] - b[1:]
    at = {g: i for i, g in enumerate(VOCABULARY)}
    longer = [(g.split(), i) for g, i in at.items() if " " in g]
    aside: set[str] = set()
    spent = np.zeros(len(FAMILIES) - 1)
    for word in sorted((g for g in at if " " not in g), key=lambda g: (gain[at[g]].max(), g)):
        more = gain[at[word]] + sum((gain[i] for parts, i in longer if word in parts and all(p == word or p in aside for p in parts)), np.zeros(len(FAMILIES) - 1))
        if (spent + more < room).all():
            aside.add(word)
            spent += more
    return [g for g in VOCABULARY if " " not in g and g not in aside]


def _runs(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _paragraphs(text: Column) -> Column:
    """What blank lines separate."""
    return F.split(text, r"\r?\n(?:[ \t]*\r?\n)+")


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, line, family, probability, confirmed and similarity of each text that a licence family is predicted for.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. paragraph counts what
    blank lines separate from 0; line is null for the paragraph as a whole, and counts the
    lines of one that has several. The probability is the family's by the calibrated
    classifier and similarity the largest share of a template's n-grams that the text
    holds, of that family. Null and empty texts and those of the unknown class give no row;
    very long texts and lines are read whole; texts without a telling word, which cannot leave the
    unknown class (see :func:`telling_words`), are set aside before n-grams are made;
    repeated rows give theirs again, told apart by nothing. An empty table gives none.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # the documents whose texts have the lowest hashes, however often each is repeated
    few = texts.select(F.xxhash64("text").alias("_hash")).distinct().orderBy("_hash").limit(SAMPLE_DOCS)
    chosen = texts.join(F.broadcast(few), F.xxhash64("text") == F.col("_hash"), "left_semi").select(F.explode(_paragraphs(F.col("text"))).alias("p")).where(F.length("p") <= SAMPLE_CHARS)
    w, b = fit([r["p"] for r in chosen.distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE).collect()])
    held: dict[str, list[int]] = {}
    sizes = []
    for k, (_, t) in enumerate(TEMPLATES):
        grams = _grams(_words(t))
        sizes.append((k, TEMPLATES[k][0], len(grams)))
        for g in grams:
            held.setdefault(g, []).append(k)
    # the vocabulary is that of the templates: some thousand rows
    weights = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w[i]], held.get(g, [])) for i, g in enumerate(VOCABULARY)], "gram string, w array<double>, held array<int>"))
    templates = F.broadcast(spark.createDataFrame(sizes, "template int, family string, size int"))

    telling = F.array(*map(F.lit, telling_words(w, b)))
    spelt = lambda c: F.split(F.replace(F.lower(c), F.lit("licence"), F.lit("license")), r"[^a-z0-9]+")
    blocks = texts.where(F.arrays_overlap(spelt(F.col("text")), telling)).select("doc_id", F.posexplode(_paragraphs(F.col("text"))).alias("paragraph", "_block"))
    blocks = blocks.where(F.arrays_overlap(spelt(F.col("_block")), telling))
    lines = F.split("_block", r"\n")
    number = F.sequence(F.lit(0), F.size(lines) - 1)
    inner = F.when(F.size(lines) > 1, F.arrays_zip(number.alias("line"), lines.alias("_line"))).otherwise(F.array())
    whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.col("_block").alias("_line")))
    pieces = blocks.select("doc_id", "paragraph", F.inline(F.concat(whole, inner))).select("doc_id", "paragraph", "line", F.filter(spelt(F.col("_line")), lambda x: x != "").alias("words"))
    pieces = written(pieces.where(F.arrays_overlap("words", telling)).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    hits = pieces.select("_piece", F.explode(F.array_distinct(F.concat(*(_runs(F.col("words"), n) for n in LENGTHS)))).alias("gram")).join(weights, "gram")
    summed = hits.groupBy("_piece").agg(F.array(*(F.sum(F.col("w")[k]) + float(b[k]) for k in range(len(FAMILIES)))).alias("z"))
    best = summed.select("*", F.array_max("z").alias("top")).withColumn("k", F.array_position("z", F.col("top")).cast("int"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    named = best.select("_piece", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("k")).alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST))
    # templates and words are looked at for pieces with a family, and of that family alone
    named = written(named.join(pieces, "_piece").withColumn("flat", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))), "named")
    grams = named.select("_piece", "family", F.explode(F.array_distinct(F.concat(*(_runs(F.col("words"), n) for n in LENGTHS)))).alias("gram")).join(weights, "gram")
    shares = grams.select("_piece", "family", F.explode("held").alias("template")).join(templates, ["template", "family"]).groupBy("_piece", "template", "size").agg((F.count("*") / F.col("size")).alias("share"))
    like = shares.groupBy("_piece").agg(F.max("share").alias("like"))
    similarity = F.coalesce("like", F.lit(0.0))
    return named.join(like, "_piece", "left").select("doc_id", "paragraph", "line", "family", "probability", (_marked(F.col("family"), F.col("flat")) & (similarity >= CONFIRM)).alias("confirmed"), similarity.alias("similarity"))
