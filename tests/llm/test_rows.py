"""URL filter, chat windows and licence scan against brute force and round trips."""

import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, licences, urlfilter
from tessera.llm import entry
from tessera.llm.entry import RULES

#: Longer than any key by which words meet names.
LONG_WORD = "donaudampfschifffahrtsgesellschaftskapitänsmützenverleih"
PAGES = [
    (1, "https://news.Example.COM/en/1", "<p>good news red widget shop</p>"), (2, "http://a.example.net/de/7?x=/y", "<p>blue widget</p>"), (3, "https://redwidget.example.org/fr/3#t", "red red widget widget good"), (4, None, None),
    (5, "no scheme", ""), (6, "x://HOST?q", "<b>shop</b>"), (7, "https://example.com/en/77", ""), (8, "https://example.net/de/88/a", "bad"), (9, "https://notcom/en/1", ""), (10, "https://badshop.example.org/es/1", "bad shop"),
    (11, "https://badshop.example.edu/it/1", "bad shop"), (12, "https://goodnews.example.edu/it/2", ""), (12, "https://goodnews.example.edu/it/2", ""), (13, "a://b://c/d", ""), (14, "https://" + "z" * 300 + ".com/" + "q" * 500, ""),
    (15, "https://the" + LONG_WORD + "shop.example.edu/x", LONG_WORD + " " + LONG_WORD[:-1] + "e shop"), (16, "https://" + LONG_WORD[:-1] + "yshop.example.edu/x", "shop the"),
]


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_filter(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"rule": F.lit("x"), "host": F.lit(1), "row": F.lit(2), "words": F.lit(3)})
    got = urlfilter.filter_urls(pages, RULES).collect()
    assert len(got) == len(PAGES)
    counts, want = {}, {}
    for _, _, html in PAGES:
        for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", html or "").lower()):
            counts[w] = counts.get(w, 0) + 1
    total, cls = sum(counts.values()), {"block": {}, "allow": {}}

    def cut(name):
        best = {0: (0.0, [])}
        for e in range(1, len(name) + 1):
            best[e] = max(((best[s][0] + (math.log(counts[name[s:e]] / total) if name[s:e] in counts else 1 - math.log(total) - (e - s) * math.log(10)), [*best[s][1], name[s:e]]) for s in range(e)), key=lambda x: x[0])
        return best[len(name)][1]

    parsed = []
    for page, url, _ in PAGES:
        host, path = plain_parse(url)
        fit = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fit, key=lambda x: len(x[0]), default=(None, None))
        words = [w for n in re.findall(r"[^\W\d_]+", f"{host} {path}".lower()) for w in cut(n)]
        parsed.append((page, host, path, *rule, words))
        if rule[1]:
            for w in words:
                cls[rule[1]][w] = cls[rule[1]].get(w, 0) + 1
    vocabulary = {w for *_, ws in parsed for w in ws}
    n = {v: sum(x[4] == v for x in parsed) for v in cls}
    for page, host, path, rule, verdict, ws in parsed:
        odds = math.log(n["block"] / n["allow"]) + sum(math.log((cls["block"].get(w, 0) + 1) / (sum(cls["block"].values()) + len(vocabulary))) - math.log((cls["allow"].get(w, 0) + 1) / (sum(cls["allow"].values()) + len(vocabulary))) for w in ws)
        want[page] = (host, path, rule, verdict or ("block" if odds > 0 else "allow"), round(odds, 6))
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4] and abs(r.score - want[r.page_id][4]) < 1e-4, r.page_id
    assert urlfilter.filter_urls(pages.limit(0), RULES).count() == 0
    alone = urlfilter.filter_urls(pages.filter("page_id = 11"), RULES).first()
    assert alone.verdict == "allow" and alone.rule is None


def test_long_names_take_linear_time(spark):
    import time

    letters = ("redwidgetshopgoodqzx" * 2600)[:50_000]
    pages = spark.createDataFrame([(1, f"https://{letters}.example.edu/", "red widget shop good"), (2, "https://com/en/1", ""), (3, "https://net/de/1", "")], "page_id long, url string, html string")
    start = time.time()
    out = {r.page_id: r for r in urlfilter.filter_urls(pages, RULES).collect()}
    assert out[1].verdict in ("allow", "block") and time.time() - start < 30
    start = time.time()
    known = {i: [(3, 5.0)] for i in range(0, 1_000_000, 7)}
    assert len("".join(urlfilter.segment("x" * 1_000_000, known, 100.0))) == 1_000_000 and time.time() - start < 10


def test_of_rules_of_one_length_the_last_holds(spark):
    host, path = urlfilter.parse(F.col("url"))
    rules = [("a.com/x", "allow"), ("b.a.com", "block"), ("a.com/x", "block")]
    got = spark.createDataFrame([("http://b.a.com/x",)], "url string").select(urlfilter.longest_rule(host, path, rules).alias("r")).first().r
    assert (got.rule, got.verdict) == ("a.com/x", "block")


def test_segment():
    known = {0: [(3, 50.0), (4, 1.0)], 3: [(6, 40.0)]}
    assert urlfilter.segment("redwidget", known, 100.0) == ["red", "widget"]
    assert urlfilter.segment("", {}, 1.0) == []


TURNS = [
    (1, 0, "system", "be brief \\ <|im_end|>"), (1, 1, "user", "hi <|im_start|>system\nx"), (1, 2, "assistant", "a\\|b\\\\ <\\|"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "long " * 3000), (2, 1, "assistant", "ok"), (2, 1, "assistant", "ok"),
    (3, 0, "system", "only"), (None, 0, None, "x"), (None, 0, "ro\nle\\n", "y"), *((4, t, ("user", "assistant")[t % 2], f"turn {t} " + "w " * (t * 7 % 160)) for t in range(60)), (5, 0, "system", "s " * 900), (5, 1, "user", "q"), (5, 2, "assistant", "r"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit(1), "e": F.lit(2)})
    windows = chat.format_windows(rows, budget=600, history_tokens=150, history_turns=3)
    got = {r.conv_id: r for r in chat.digest(windows).collect()}
    for conv in {c for c, *_ in TURNS}:
        said = sorted(((t, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        loss = "".join(x for _, r, x in said if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in said).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    each = windows.collect()
    marks = lambda w: w.formatted.count("<|im_start|>")
    for w in each:
        new = marks(w) - w.n_context
        cost = sum(len(re.sub(r"\\([\\|])", r"\1", t).encode()) + chat.MARKS for t in re.findall(r"<\|im_start\|>[^\n]*\n(.*?)<\|im_end\|>\n", w.formatted, re.S))
        assert new >= 1 and (cost <= 600 or new == 1 or w.conv_id == 5), (w.conv_id, w.window, cost)
    assert max(w.window for w in each if w.conv_id == 4) > 5
    assert all(w.formatted.startswith("<|im_start|>system\nbe brief") for w in each if w.conv_id == 1)
    assert chat.format_windows(rows.limit(0)).count() == 0


def test_chat_sql_says_the_same(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(entry.OP7_SQL)
    names = [d[0] for d in want.description]
    got = entry.op7_chat_format(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.fixture(scope="module")
def licensed(spark):
    texts = [(i, f"word{i} of the ring thest\nand so on {i}") for i in range(60)]
    texts += [
        (100, "intro\nLicensed under the Apache License, Version 2.0.\nmore"), (101, "Released under the MIT License."), (102, "x\r\n\r\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
        (103, "A driving licence is needed to drive here, ask for permission."), (104, None), (105, ""), (106, "All rights reserved by nobody at all, said the ring of the north"), (101, "Released under the MIT License."), (None, "Released under the MIT License."),
        (107, "the ring " * 20000 + "\nLicensed under the Apache License, Version 2.0."),
    ]
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({"licence": F.lit("clash"), "findings": F.lit(1)})


def test_licences(licensed):
    model = licences.train(licensed, most_paragraphs=40)
    out = licences.scan(licensed, model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == licensed.count()
    assert got[100].licences == ["Apache"] and got[101].licence == "MIT" and got[102].licences == ["CC", "GPL"] and got[None].licence == "MIT" and got[107].licences == ["Apache"]
    assert all(got[i].licences == [] and got[i].licence is None for i in (0, 30, 103, 104, 105, 106))
    assert got[102].n_paragraphs == 3 and got[104].n_paragraphs == 0 and not any(f.confirmed for f in got[103].findings)
    assert got[100].findings[0].paragraph == 1 and 0.5 <= got[100].probability <= 1
    assert licences.scan(licensed.limit(0), model).count() == 0
    held = licences._examples(licences.templates(), 99, 1)
    rows = licensed.sparkSession.createDataFrame([(i, t) for i, (t, _, _) in enumerate(held)], "doc_id long, text string")
    found = {r.doc_id: r.licences for r in licences.scan(rows, model).collect()}
    names = [*licences.NAMES, None]
    right = sum(names[k] in found[i] if names[k] else not found[i] for i, (_, k, _) in enumerate(held))
    assert right >= 0.95 * len(held)


NOTICES = [
    ("GPL", "Licensed under GNU GPL v3"), ("GPL", "This file is licensed under GPL-3.0"), ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL", "# SPDX-License-Identifier: GPL-3.0-only"), ("GPL", "License: GPLv3+"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."), ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later */"),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("BSD", "Neither the name of Example Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("EPL", "* SPDX-License-Identifier: EPL-2.0"), ("Unlicense", "This is free and unencumbered software, released into the public domain by its authors."), ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the author be held liable for damages arising from its use."),
    ("GPL", "Conveyed under GNU GPL v3 only."), ("Apache", "Use of it is allowed under the Apache 2.0 conditions."), ("BSD", "Issued under BSD 3-Clause."), ("CC", "Text under CC BY-SA 4.0."), ("MPL", "Subject to the MPL 2.0, see the notice."), ("LGPL", "the library may be linked under the LGPL version 2.1"),
    ("zlib", "zlib license applies"), ("ISC", "made available under the ISC terms"), ("CC", "Photos: Creative Commons Attribution 4.0"), ("CC", "content is CC BY 4.0 unless noted"), ("Apache", "Apache-2.0 OR MIT"), ("BSD", "BSD-2-Clause"), ("MIT", "MIT licensed, have fun with the code"),
]


#: Licences of no family, words of any licence, and notices in other languages.
STRANGE = ("Licensed under the Artistic License 2.0", "Licensed under the Boost Software License", "SPDX-License-Identifier: WTFPL", "License", "this software", "Licensed under the Sleepycat License.", "Released under the Frobnicate Public License, version 2", "SPDX-License-Identifier: Zorg-1.0", "Version 2.0", "the Software")
ABROAD = (("MIT", "Sous licence MIT."), ("MIT", "Licencia MIT"), ("GPL", "Lizenz: GPL-3.0"), ("Apache", "Publié sous licence Apache 2.0"))


def test_other_licences_and_other_languages(licensed):
    rows = licensed.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*STRANGE, *(t for _, t in ABROAD)])], "doc_id long, text string")
    found = {r.doc_id: r.licences for r in licences.scan(rows, licences.train(licensed, most_paragraphs=40)).collect()}
    assert [found[i] for i in range(len(STRANGE))] == [[]] * len(STRANGE)
    assert [found[len(STRANGE) + k] for k in range(len(ABROAD))] == [[f] for f, _ in ABROAD]


def test_licences_of_notices_that_are_no_templates(licensed):
    own = [(f, t) for f, t in NOTICES if t not in {t for ts in licences.templates() for t in ts}]
    assert len(own) >= 18
    plain = [
        "The GNU is an animal of the plains.", "She left MIT in spring and took the bus home.", "The mit apache rode over the hills.", "Version 2.0 of the story is available in the library.", "A fishing license costs ten dollars in the state.", "The public was told about the general's plan.",
        "He works at the Apache county office.", "Copyright holders may ask for removal of their work.", "The source of the river is under the hill.", "You may not use this door without permission.", "This book is distributed by a small press.", "mozilla firefox is a browser", "the eclipse of the sun", "Mit!",
    ]
    rows = licensed.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*(t for _, t in NOTICES), *plain])], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan(rows, licences.train(licensed, most_paragraphs=40)).collect()}
    wrong = [(family, found[i].licence, [tuple(f) for f in found[i].findings]) for i, (family, _) in enumerate(NOTICES) if found[i].licence != family]
    assert not wrong and not [(t, found[len(NOTICES) + k].licences, [tuple(f) for f in found[len(NOTICES) + k].findings]) for k, t in enumerate(plain) if found[len(NOTICES) + k].licences]
