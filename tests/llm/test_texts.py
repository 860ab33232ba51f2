"""Operators 1, 5, 8 and 10, and the pipeline."""

import hashlib
import re
import textwrap

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from tallgrass.llm import importance, quality, queries, sanitise
from tallgrass.llm.importance import kth_largest, order_key, resample, select_quality
from tallgrass.llm.licences import HINTS, KNOWN, SENTENCES, SLOT, TEMPLATES, hinted, identifiers, match_rules, normalise, scan
from tallgrass.llm.quality import judge
from tallgrass.llm.sanitise import find, sanitised

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_licences(table, rows):
    cases = {1: (MIT, "MIT"), 2: ("x y.\nReleased under the MIT License.", "MIT"), 3: ("a\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "Apache-2.0,MIT"), 4: ("// SPDX-License-Identifier: GPL-3.0\n", "GPL-3.0"), 5: ("We talk of the MIT license here at length.", ""), 6: (None, ""), 7: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), 8: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")}
    got = {r["doc_id"]: r for r in scan(table([(i, t) for i, (t, _) in cases.items()])).collect()}
    assert {i: r["licences"] for i, r in got.items()} == {i: w for i, (_, w) in cases.items()}
    assert got[5]["n_unknown"] == 1 and got[1]["n_unknown"] == 0
    assert scan(table(rows)).count() == len(rows) and scan(table([])).count() == 0
    assert all(any(h in k for h in HINTS) for k in KNOWN) and all(normalise(k) == k for k in KNOWN)
    assert match_rules(identifiers(MIT.split("\n\n")[1])) == ([], 1)


def test_licence_sentences_at_any_width():
    for width in (16, 24, 40, 60, 66, 72, 200):
        for name, sentence in SENTENCES.items():
            got = identifiers("\n".join(f" * {x}" for x in textwrap.wrap(sentence, width)))
            assert got == [name], (width, name)
        assert match_rules(identifiers("\n".join(textwrap.wrap(MIT.replace("\n", " "), width)))) == (["MIT"], 0)


def test_numbered_licence_texts():
    heads = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]
    for marks in (["1. ", "2. ", "3. "], ["1) ", "2) ", "3) "], ["(a) ", "(b) ", "(c) "], ["a. ", "b. ", "c. "], ["i. ", "ii. ", "iii. "], ["* ", "* ", "* "], ["", "", ""]):
        lines = [m + SENTENCES[h] + end for m, h, end in zip(["", *marks], heads, [":", ".", ".", "."])]
        for n, want in ((4, "BSD-3-Clause"), (3, "BSD-2-Clause")):
            text = "Copyright (c) 2020, A. Person\n\n" + "\n".join(textwrap.fill(x, 70) for x in lines[:n])
            assert match_rules(identifiers(text)) == ([want], 0), marks
    assert match_rules(identifiers("Released under the GPL version\n2.\n")) == (["GPL-2.0"], 0)
    assert identifiers("Released under the MIT License.\nother words\n2.\nReleased under the ISC License.") == ["short-MIT", None, "short-ISC"]


def test_hints_broken_by_white_space(table):
    cases = {1: ("This program is released\nunder GPLv3", "GPL-3.0"), 2: ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"), 3: ("released  under GPLv3", "GPL-3.0"), 4: ("Distributed\u00a0under CC BY 4.0", "CC-BY-4.0"), 5: ("nothing under way", "")}
    got = {r["doc_id"]: r["licences"] for r in scan(table([(i, t) for i, (t, _) in cases.items()])).collect()}
    assert got == {i: w for i, (_, w) in cases.items()}
    for sentence in KNOWN:
        for apart in ("\n", "  ", "\u00a0", "\n// ", "_"):
            assert hinted(sentence.replace(" ", apart))


def test_licences_by_brute_force(spark):
    text = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in text:
        want = {KNOWN[n] for line in t.split("\n") for n in [normalise(line)] if n in KNOWN}
        assert want <= set(identifiers(t))


def test_licences_found_are_in_the_text(spark):
    """The other direction: each identifier has a sentence of its own in the words of the text."""
    of: dict = {}
    for sentence, name in KNOWN.items():
        of.setdefault(name, []).append(re.escape(sentence))
    for name, sentences in TEMPLATES.items():
        of.setdefault(name, []).extend(re.escape(x).replace(r"\*", rf"(?:\w+ ){{0,{SLOT - 1}}}\w+") for x in sentences)
    n = 0
    for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        whole = normalise(t or "")
        for name in set(identifiers(t or "")) - {None, "UNKNOWN"}:
            n += 1
            assert any(re.search(rf"(?<!\w){x}(?!\w)", whole) for x in of[name]), (name, t)
    assert n


def test_templates_expressions_and_whole_texts():
    found = lambda t: match_rules(identifiers(t))
    bsd = [SENTENCES["bsd-grant"], SENTENCES["bsd-source"], SENTENCES["bsd-binary"]]
    names, warranty, liability = (TEMPLATES[k][0] for k in ("bsd-names", "bsd-warranty", "bsd-liability"))
    for who in ("Example Corp.", "the University of Somewhere, Inc", " ".join(["w"] * SLOT)):
        tail = [names.replace("*", who), warranty.replace("*", who), liability.replace("*", who)]
        for width in (30, 72):
            text = lambda x: "\n".join(textwrap.wrap(". ".join(x) + ".", width))  # noqa: B023, E731
            assert found(text([*bsd, *tail])) == (["BSD-3-Clause"], 0), (who, width)
            assert found(text([*bsd, *tail[1:]])) == (["BSD-2-Clause"], 0), (who, width)
    assert identifiers(names.replace("*", " ".join(["w"] * (SLOT + 1)))) == ["UNKNOWN"]
    spdx = {"MIT OR Apache-2.0": ["Apache-2.0", "MIT"], "(GPL-2.0-only WITH Classpath-exception-2.0) AND bsd-3-clause */": ["GPL-2.0-only", "BSD-3-Clause"], "GPL-3.0+": ["GPL-3.0-or-later"], "LGPL-2.1-or-later": ["LGPL-2.1-or-later"], "Nobody-1.0": []}
    for written, want in spdx.items():
        for head in ("/* SPDX-License-Identifier: ", "# spdx-license-identifier:"):
            assert sorted(found(f"{head}{written}\nint x;")[0]) == sorted(want), written
    assert identifiers("SPDX-License-Identifier: Nobody-1.0") == ["UNKNOWN"]
    for text, want in {
        "Distributed under the terms of the MIT license.": "MIT",
        "This file is released under the terms of the GNU General Public License v3.0 or later.": "GPL-3.0-or-later",
        "Licensed under the GPL v2 only": "GPL-2.0-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007": "AGPL-3.0",
        "Apache License\nVersion 2.0, January 2004": "Apache-2.0",
        "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\nStatement of Purpose": "CC0-1.0",
        "By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.  This": "GPL-2.0",
        "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:": "Zlib",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License": "CC-BY-SA-4.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.": "LGPL-3.0-or-later",
    }.items():
        assert found(text) == ([want], 0), text
    assert found("We wrote about the Apache license, version 2.0, in January 2004 or so.")[0] == []
    assert found("The digest is acc01f0. CC0 is a number here.") == ([], 0)
    lgpl = "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nBy contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."
    assert found(lgpl)[0] == ["LGPL-2.1"]


def test_importance_against_plain_models(table, spark, words, monkeypatch):
    good = [(k, " ".join(words(80, k))) for k in range(40)]
    bad = [(100 + k, " ".join(f"{w}%%%" for w in words(80, 500 + k))) for k in range(15)]
    docs = table([*good, *bad, (300, None), (301, ""), (301, "")])
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(8)] + [(None, 1), (9, None)], "doc_id long, quality int")
    model, scores = resample(docs, labels)
    got = {r["doc_id"]: r for r in scores.collect()}
    counts = np.zeros((2, importance.BUCKETS))
    own = {i: np.concatenate([b for _, _, b, _ in importance.features(pa.array([t]))]) for i, t in [*good, *bad]}
    for i, b in own.items():
        np.add.at(counts[1], b, 1)
        if i < 30:
            np.add.at(counts[0], b, 1)
    for i, b in own.items():
        mine = np.bincount(b, minlength=importance.BUCKETS)
        raw, target = counts[1] - mine, counts[0] - mine * (i < 30)
        q = (raw + 1) / (raw + 1).sum()
        p = (target + importance.BUCKETS * q) / (target + importance.BUCKETS * q).sum()
        assert abs(got[i]["log_weight"] - np.log(p / q)[b].sum()) < 1e-6
    assert got[300]["log_weight"] == got[301]["log_weight"] == 0
    kept = {i for i, r in got.items() if r["key"] >= model.least_key}
    assert set(range(40)) <= kept and not kept & {100 + k for k in range(15)}
    left = select_quality(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == kept
    k = 17
    want = sorted((r["key"] for r in scores.collect()), reverse=True)[k - 1]
    assert kth_largest(scores, k) == want
    none = spark.createDataFrame([], labels.schema)
    assert select_quality(docs, none).count() == docs.count()
    assert select_quality(table([]), labels).count() == 0


def test_order_key():
    x = np.array([-np.inf, -3.5, -1e-300, 0.0, 1e-300, 2.0, np.inf])
    assert (np.diff(order_key(x)) > 0).all()


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled rows, tried on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model, scores = resample(docs, labels.where("doc_id % 2 = 0"))
    rows = scores.join(labels.where("doc_id % 2 = 1").select("doc_id", labels["quality"].alias("truth")), "doc_id").collect()
    kept = {q: [r["key"] >= model.least_key for r in rows if r["truth"] == q] for q in (0, 1)}
    assert sum(kept[1]) / len(kept[1]) > 0.97 and sum(kept[0]) / len(kept[0]) < 0.2


def base_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def with_sql(spark, docs, sql, name="documents"):
    con = duckdb.connect()
    con.register(name, docs.select("doc_id", "text", "lang", "source").toArrow())
    return con.execute(sql)


def test_quality_rules(table, rows, spark):
    rows = [(i, t) for i, t in rows if i != 11] + [(20, "a\n b \na\n\n\na\x0bc # $$"), (21, "u v w " * 4)]
    docs = table(rows)
    got = judge(docs)
    found = sorted(((r["doc_id"] or 0), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect())
    assert found == sorted(((i or 0), *base_counts(t)) for i, t in rows)
    alone = {i: (t, i) for i, t in rows if i not in (None, 7)}  # the SQL's key is doc_id
    own = table([(i, t) for i, (t, _) in alone.items()])
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    sql = sorted(with_sql(spark, own, f"SELECT {', '.join(cols)} FROM ({quality.OP8_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in judge(own).collect()) == sql
    assert judge(table([])).count() == 0


def test_adaptive_thresholds(table, words):
    clean = [(k, " ".join(words(60, k)) + "\n" + " ".join(words(10, 90 + k))) for k in range(1, 70)]
    junk = [(100, " ".join(f"{w}###" for w in words(60, 1))), (101, "\n".join(["same line here"] * 3 + [" ".join(words(40, 2))])), (102, "x" * 300 + " " + " ".join("y" * 90 for _ in range(12)))]
    got = {r["doc_id"]: r["kept"] for r in judge(table(clean + junk)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_personal_data(table, rows, spark):
    texts = ["mail me at Bob.X@a-b.co.uk_d@e.fr now", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 001.2.3.4 1.2.3", "card 4111 1111 1111 1111 and +4111111111111111 x 4111-1111-1111-1112", "+1 (555) 123-4567 tel é +12", "a@b.c ééé 😀 x@y.zz", None, "", "secret Zebulon reveals q@q.com Zebulon", "see Zebulon q@q.com", "Zebulon q@q.com the end", "@" * 50 + "+" * 50 + "1" * 3000 + "." * 40, "a@b a@b. @b.c", "nothing here"]
    cases = [*enumerate(texts, 500), *((i, t) for i, t in rows if i not in (None, 7))]
    docs = table(cases)
    cols = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted(tuple(r[c] for c in cols) for r in find(docs).collect())
    assert got == sorted(with_sql(spark, docs, f"SELECT {', '.join(cols)} FROM ({sanitise.OP10_SQL})").fetchall())
    by = {r[0]: r[-1] for r in got}
    assert by[500] == "email:11:26,email:26:33" and by[504] == "email:0:5,email:12:18" and by[508] == "email:12:19,term:4:11" and by[512] == ""
    clean = {r["doc_id"]: r for r in sanitised(docs).collect()}
    assert clean[500]["text"] == "mail me at <EMAIL><EMAIL> now" and clean[508]["text"] == "see  <EMAIL>" and clean[508]["n_chars"] == 12
    assert clean[505]["text"] is None and clean[512]["text"] == "nothing here" and sanitised(docs).columns == docs.columns
    assert find(table([])).count() == 0 and sanitised(table([])).count() == 0
    twice = find(table([(1, "q@q.com"), (1, "q@q.com"), (None, "q@q.com")])).collect()
    assert [r["spans"] for r in twice] == ["email:0:7"] * 3 and {r["base_sha256"] for r in twice} == {hashlib.sha256(b"email:0:7").hexdigest()}
    assert sanitised(table([(1, "q@q.com"), (1, "q@q.com"), (None, "q@q.com")])).count() == 3


def test_a_rare_value_is_disclosed_without_support(table, words):
    """No value and no pair is seen twice; a common term beside a value stays."""
    plain = [(k, "please write " + " ".join(words(20, k))) for k in range(1, 80)]
    docs = table([*plain, (200, "please write Zebulon q@q.com"), (201, "please write to r@r.com")])
    clean = {r["doc_id"]: r["text"] for r in sanitised(docs).collect()}
    assert clean[200] == "please write  <EMAIL>" and clean[201] == "please write to <EMAIL>"
    assert all(clean[i] == t for i, t in plain)
    everywhere = table([(k, f"word{'abcd'[k]} letters q@q.com") for k in range(4)])
    assert all(r["text"].endswith(" letters <EMAIL>") for r in sanitised(everywhere).collect())


def test_disclosing_terms_anywhere_in_the_document(table, words):
    """A name far from the value, with years between, and all its occurrences."""
    plain = [(k, "please write " + " ".join(words(20, k))) for k in range(1, 80)]
    far = "Zebulon lives here.\n" + "please write in 2019 or 2020 " * 10 + "\n{} 1985 please ZEBULON"
    docs = table([*plain, (200, far.format("zebulon@q.com")), (201, "lives here please write"), (202, "lives here"), (203, "lives here")])
    clean = {r["doc_id"]: r["text"] for r in sanitised(docs).collect()}
    assert clean[200] == " lives here.\n" + "please write in 2019 or 2020 " * 10 + "\n<EMAIL> 1985 please "
    assert all(clean[i] == t for i, t in plain) and clean[201] == "lives here please write"


def test_pipeline_keeps_clean_documents(table, spark, words, tmp_path):
    clean = [(k, " ".join(words(90, k))) for k in range(40)]
    bad = [(100 + k, " ".join(f"{w}%%%" for w in words(80, 500 + k))) for k in range(12)]
    near = [(200, clean[3][1] + " end"), (201, clean[4][1])]
    private = [(300, " ".join(words(60, 77)) + " a.b@c.de")]
    table(clean + bad + near + private).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(30)] + [(100 + k, 0, 0) for k in range(8)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs, path = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, path), name)
        assert docs.columns == table([]).columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == {i for i, _ in clean + near + private}
    assert set(kept[0]) - set(kept[1]) == {4} and set(kept[1]) - set(kept[2]) == {200}
    assert "a.b@c.de" not in kept[3][300] and "<EMAIL>" in kept[3][300] and all(kept[3][i] == t for i, t in kept[2].items() if i != 300)
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])


def test_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "personal_data", "best_fit_packing"]
