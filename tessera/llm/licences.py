"""License scans: a trained paragraph classifier whose predictions a template comparison confirms.

Word uni- and bigrams are hashed into so many slots; sparse multinomial logistic regression over licence families and
an unknown class is fitted on varied templates and on paragraphs of the corpus, its temperature on whole templates that
the fit has not seen. Every paragraph is scored. Scores are array functions over weight literals of fixed size: the
scan is one narrow pass without joins or Python.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Names and identifiers of common public licences, with their versions, by family: fixed values.
NAMES = {
    "Apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License"),
    "MIT": ("MIT License", "MIT", "MIT/X11", "Expat License"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL v3", "GNU GPL version 2", "GNU GPL", "GPL v3", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv3+", "GPLv2+"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD License", "New BSD License", "Simplified BSD License"),
    "CC": ("CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-SA 3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0 1.0", "CC0-1.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Zero"),
    "MPL": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0", "MPL"),
    "ISC": ("ISC License", "ISC"),
    "LGPL": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "GNU LGPL", "GNU LGPL v2.1", "LGPL v3", "LGPLv3", "LGPLv2.1", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv2.1+", "LGPLv3+"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL", "GNU AGPL v3", "AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3+"),
    "EPL": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v1.0", "EPL 2.0", "EPL-2.0", "EPL-1.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "zlib": ("zlib License", "zlib/libpng License", "Zlib"),
}
#: Notices and paragraphs of the bodies of these licences: fixed values.
BODIES = {
    "Apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The MIT License (MIT)",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "CC": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
}
#: Sentences that notices are made of; {} stands for a name: fixed values.
NOTICES = (
    "Licensed under {}", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "Distributed under the terms of the {}", "This software is licensed under the terms of the {}.",
    "This work is licensed under a {}.", "You may use this file under the {} terms.", "Source code is available under {}.", "The text is published under {}.", "SPDX-License-Identifier: {}", "SPDX: {}", "License: {}", "license = {}", "{} (see LICENSE)",
    "This project uses the {}.", "Code under {}, see the file COPYING.", "May be copied under the conditions of the {}.", "{} licensed", "{} applies to this file.",
)
#: Paragraphs that speak of rights, or of things that share a licence's name, but name no licence: fixed values.
OTHERS = (
    "All rights reserved. No part of this text may be copied without permission of the publisher.",
    "Copyright 2020 by the author. Unauthorized redistribution is prohibited.",
    "Licensed to the company for internal use only under a proprietary agreement.",
    "A driving licence is issued by the local office and must be renewed every ten years.",
    "The warranty covers parts and labour for two years from the date of purchase.",
    "Please ask for permission before you take photographs in the hall.",
    "This license agreement is between you and the vendor and covers one computer.",
    "The copyright of the images remains with their owners.",
    "He studied physics at MIT before he went to work for the public library.",
    "MIT and Harvard share a campus bus that runs every ten minutes.",
    "The Apache lived in the hills of the south and were feared riders.",
    "An Apache helicopter flew over the camp in version two of the story.",
    "A herd of gnu crossed the river, a common sight in general.",
    "The total eclipse was visible to the public at 2.0 hours after noon.",
    "Mozilla has a new browser and Eclipse is an editor for programs.",
    "The free software was distributed on a disk under the table.",
    "The work was released under the name of the author in 2004.",
    "Its source is the code of the north, available under the counter.",
    "Terms of the contract are distributed under the new rules of the state.",
    "They were released under bail, version 3 of the tale says.",
    "The general public is asked to use the other door under the bridge.",
    "The creative director of the commons moved to a bigger office.",
    "A cc of the letter was sent by the clerk, 4.0 pages long.",
    "See the file for conditions of use and terms of payment.",
    "The library is open to the public, permission is not required.",
    "The liquor license of the bar was not renewed, so it was unlicensed.",
    "Identifier 2.0 of the project is in the file.",
    "Mit.",
    "Mit dem Hund.",
    "Und mit der.",
    "Mit",
    "Komm mit.",
    "Mit ihr und mit ihm.",
)
#: Notices in other languages, and licences that belong to none of the families: fixed values.
ABROAD = ("Sous licence {}.", "Publié sous licence {}", "Licencia {}", "Distribuido bajo la licencia {}.", "Lizenz: {}", "Lizenziert unter der {}.", "Veröffentlicht unter {}")
FOREIGN = (
    "Artistic License 2.0", "Boost Software License", "WTFPL", "CDDL 1.0", "Common Development and Distribution License", "EUPL 1.2", "European Union Public Licence", "SIL Open Font License 1.1", "OFL-1.1", "PostgreSQL License", "Microsoft Public License", "Ms-PL", "BSL-1.0", "Artistic-2.0", "Beerware License",
)
UNKNOWN = "unknown"
FAMILIES = [*NAMES, UNKNOWN]


def templates() -> list[list[str]]:
    """Of each family: bodies, and every notice with every name."""
    return [[*BODIES[f], *(n.format(name) for name in names for n in (*NOTICES, *ABROAD))] for f, names in NAMES.items()]


def foreign() -> list[tuple[str, int]]:
    """Notices of licences that belong to no family; of every third one all notices are held out, so it is a family that the fit has not seen."""
    return [(n.format(name), int(i % 3 == 2)) for i, name in enumerate(FOREIGN) for n in (*NOTICES, *ABROAD)]


def _let(value, f):
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(paragraph):
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)?"), F.lit(0))


def _grams(w):
    """The words and each word with the one after it."""
    return F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def _slots(grams, slots: int):
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(slots)).cast("int"))


def template_grams(template: str) -> list[str]:
    import re

    w = re.findall(r"[^\W_]+(?:\.[0-9]+)?", template.lower())
    return sorted({f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)} | set(w))


def _table(groups: list[list[str]]):
    """The distinct word sets of the templates of each family, as a literal."""
    sets = [[list(x) for x in sorted({tuple(template_grams(t)) for t in ts})] for ts in groups]
    return F.from_json(F.lit(json.dumps(sets)), "array<array<array<string>>>")


def _likeness(grams, family):
    """The largest share, over a family's templates, of the words and pairs of the shorter that both have."""
    return F.coalesce(F.array_max(F.transform(family, lambda t: F.size(F.array_intersect(grams, t)) / F.greatest(F.least(F.size(grams), F.size(t)), F.lit(1)))), F.lit(0.0))


def own_grams() -> list[list[str]]:
    """Of each family the words and pairs of its names that no other licence's name has, but for numbers and words of any licence."""
    common = {"license", "licence", "public", "general", "version", "the", "new", "of", "international", "universal", "v", "x11", "only", "or", "later", "united", "source", "open", "software", "4.0", "commons"}
    every = {f: {g for name in names for g in template_grams(name)} for f, names in NAMES.items()}
    others = {g for name in FOREIGN for g in template_grams(name)}
    told = lambda g: any(w not in common and not w.removeprefix("v").replace(".", "").isdigit() for w in g.split())
    alone = {f: {g for g in grams if told(g) and g not in others and not any(g in every[o] for o in NAMES if o != f)} for f, grams in every.items()}
    return [sorted(alone[f]) for f in NAMES]


def _covered(grams, bodies):
    """The largest share, over the paragraphs of a family's bodies, of a body's words and pairs that a paragraph has."""
    return F.coalesce(F.array_max(F.transform(bodies, lambda t: F.size(F.array_intersect(grams, t)) / F.greatest(F.size(t), F.lit(1)))), F.lit(0.0))


def _examples(groups: list[list[str]], seed: int, each: int) -> list[tuple[str, int, int]]:
    """(text, class, held out) of templates with words lost and foreign words put in; a template is held out whole."""
    rng, out = random.Random(seed), []
    out += [(text, len(groups), held) for text, held in foreign() for _ in range(2)]
    for label, texts in enumerate([*groups, OTHERS]):
        share = each if label == len(groups) else max(1, each * 20 // len(texts))
        for number, text in enumerate(texts):
            many = each if text in OTHERS or text in BODIES.get(FAMILIES[label], ()) else share
            for k in range(many):
                w = [x for x in text.split() if rng.random() > 0.1 * (k % 3)]
                for _ in range(k % 3):
                    w.insert(rng.randint(0, len(w)), rng.choice(OTHERS[rng.randrange(len(OTHERS))].split()))
                out.append((" ".join(w), label, int(number % 5 == 4)))
    return out


def _paragraphs(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda p: F.length(F.trim(p)) > 0)


def train(docs: DataFrame, slots: int = 8192, each: int = 20, most_paragraphs: int = 1500, seed: int = 4) -> dict:
    """Weights of the slots that have any, biases and temperature, as numbers.

    Examples: variations of every template; for the unknown class those of OTHERS and one paragraph of each of the
    most_paragraphs documents with the least hash of their id (bound of the sample), unless it has a likeness of 0.5 to
    some template. The temperature comes from a first fit without every fifth template, judged on those.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark, groups = docs.sparkSession, templates()
    made = spark.createDataFrame(_examples(groups, seed, each), "text string, label int, held int")
    some = docs.filter("length(trim(text)) > 0").select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    # texts move only for the chosen ids
    ids = some.select("h").distinct().orderBy("h").limit(most_paragraphs)
    chosen = some.join(F.broadcast(ids), "h").groupBy("h").agg(F.min("text").alias("text"))
    lines = chosen.select("h", _paragraphs(F.col("text")).alias("p")).filter(F.size("p") > 0).select("h", F.get("p", F.pmod(F.xxhash64("h"), F.size("p")).cast("int")).alias("text"))
    alike = _let(F.array_distinct(_grams(_words(F.col("text")))), lambda g: _likeness(g, F.flatten(_table(groups))))
    lines = lines.filter(alike < 0.5).select("text", F.lit(len(FAMILIES) - 1), (F.pmod("h", F.lit(5)) == 4).cast("int"))
    rows = materialize(made.union(lines).select(F.col("label").cast("double").alias("label"), "held", F.array_distinct(_slots(_grams(_words(F.col("text"))), slots)).alias("grams")).coalesce(4))
    rows = rows.withColumn("terms", F.col("grams").cast("array<string>"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(slots)], "terms", "features")
    vectors = counter.transform(rows).select("label", "held", "features").cache()
    learner = LogisticRegression(maxIter=60, regParam=1e-4, elasticNetParam=0.9, family="multinomial", standardization=False)

    def fitted(of):
        model = learner.fit(of.select("label", "features"))
        matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        live = [i for i in range(slots) if abs(matrix[:, i]).max() > 1e-4]
        return {"slots": slots, "live": live, "weights": [[round(float(x), 5) for x in matrix[:, i]] for i in live], "bias": [round(float(x), 5) for x in bias]}

    first = fitted(vectors.filter("held = 0"))
    logits = rows.filter("held = 1").select("label", _logits(_live(F.col("grams"), first), first).alias("z"))
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    loss = lambda t: F.avg(-F.log(F.greatest(F.get(_softmax(F.col("z"), t), F.col("label").cast("int")), F.lit(1e-12)))).alias(f"t{t}")
    temperature = min(zip((x if x is not None else 0.0 for x in logits.agg(*map(loss, grid)).first()), grid, strict=True))[1]
    model = fitted(vectors)
    vectors.unpersist()
    return model | {"temperature": temperature}


def _live(grams, model: dict):
    """Numbers, from 1, of the weight rows of those slots that have one."""
    number = [0] * model["slots"]
    for i, slot in enumerate(model["live"]):
        number[slot] = i + 1
    table = F.from_json(F.lit(json.dumps(number)), "array<int>")
    return F.filter(F.transform(grams, lambda g: F.get(table, g)), lambda i: i > 0)


def _logits(live, model: dict):
    table = F.from_json(F.lit(json.dumps(model["weights"])), "array<array<double>>")
    return F.aggregate(live, F.array(*map(F.lit, model["bias"])), lambda acc, i: F.zip_with(acc, F.get(table, i - 1), lambda a, b: a + b))


def _softmax(z, temperature: float):
    part = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    return _let(z, lambda v: _let(F.array_max(v), lambda top: _let(F.transform(v, lambda x: F.exp((x - top) / temperature)), part)))


ADDED = ("n_paragraphs", "n_candidates", "licences", "licence", "probability", "findings")


def scan(docs: DataFrame, model: dict, confirm: float = 0.6, sure: float = 0.5, least: float = 0.2, body: float = 0.4) -> DataFrame:
    """docs with n_paragraphs, n_candidates, licences (families, sorted), licence (the most probable one), probability and
    findings (paragraph number from 0, family, probability, likeness, confirmed).

    Paragraphs are the non-blank lines of the whole text; every one is scored. A candidate is a paragraph whose
    probability of being unknown is under 1 - sure; it has a finding for each family with a probability of at least
    least. A finding is confirmed, and its family counts as a licence, if its likeness is at least confirm: the largest
    share of the words and word pairs of the shorter of paragraph and template that both have, over the family's
    templates; and if the paragraph has a word or pair of the family's own names, or at least the share body of a
    paragraph of its body (so "this software" is no licence). A null or blank text has no paragraph; a text without licence has null as licence and probability; of
    equally probable ones the first in the alphabet counts. Equal rows get equal results; no rows give none. Input
    columns named like an added one are replaced.
    """
    table, bodies, own_names = _table(templates()), _table([list(BODIES[f]) for f in NAMES]), F.from_json(F.lit(json.dumps(own_grams())), "array<array<string>>")
    names = F.array(*map(F.lit, FAMILIES))
    own = [c for c in docs.columns if c not in ADDED]
    # the row's own columns stand apart, so that no name clashes
    base = docs.select(F.struct(*own).alias("own"), _paragraphs(F.col("text")).alias("p"))

    def scored(p, i):
        live = _let(_words(p), lambda w: F.array_distinct(_live(_slots(_grams(w), model["slots"]), model)))
        return F.struct(i.alias("i"), p.alias("p"), _softmax(_logits(live, model), model["temperature"]).alias("q"))

    candidates = F.filter(F.transform("p", scored), lambda x: F.get(x["q"], len(FAMILIES) - 1) < 1 - sure)

    def found(x):
        classes = F.filter(F.transform(x["q"], lambda q, k: F.struct(k.alias("k"), q.alias("q"))), lambda c: (c["q"] >= least) & (c["k"] < len(FAMILIES) - 1))
        finding = lambda g, c: F.struct(x["i"].alias("paragraph"), F.get(names, c["k"]).alias("family"), c["q"].alias("probability"), _likeness(g, F.get(table, c["k"])).alias("likeness"), (F.arrays_overlap(g, F.get(own_names, c["k"])) | (_covered(g, F.get(bodies, c["k"])) >= body)).alias("told"))
        return _let(F.array_distinct(_grams(_words(x["p"]))), lambda g: F.transform(classes, lambda c: finding(g, c)))

    checked = lambda x: F.struct(*(x[c].alias(c) for c in ("paragraph", "family", "probability", "likeness")), ((x["likeness"] >= confirm) & x["told"]).alias("confirmed"))
    out = base.select("own", F.size("p").cast("long").alias("n_paragraphs"), candidates.alias("c"))
    out = out.select("own", "n_paragraphs", F.size("c").cast("long").alias("n_candidates"), F.transform(F.flatten(F.transform("c", found)), checked).alias("findings"))
    good = F.filter("findings", lambda x: x["confirmed"])
    best = F.get(F.sort_array(F.transform(good, lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("f")))), F.lit(0))
    out = out.select("*", F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))).alias("licences"), best.alias("best"))
    return out.select(*(F.col("own")[c].alias(c) for c in own), "n_paragraphs", "n_candidates", "licences", F.col("best.f").alias("licence"), (-F.col("best.p")).alias("probability"), "findings")
