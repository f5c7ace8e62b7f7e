"""License scan against brute force on words, and suppression."""

import re
import re._parser as sre

from pyspark.sql import functions as F

from readloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    None,
    "",
    "Licensed under the Apache License, Version 2.0.",
    "under THE mit-license; Under the MIT license. UNDER\nTHE\tMIT LICENSE",
    "CC BY-NC 4.0 and cc_by_nc, but not ccc by nc or cc by ncé",
    "thunder the mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: Apache-2.0\n// see https://www.apache.org/licenses/LICENSE-2.0",
    "All rights reserved. Tous droits réservés.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "a graduate of MIT wrote under a tree",
    "x " * 40000 + "apache license version 2",
]


def brute(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    at = [(i, lab) for p, lab in licenses.BASE for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_base_phrases_and_rules(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    for c in ("_r", "r", "held", "odd.name", "score"):
        d = d.withColumn(c, F.lit("clash"))
    assert {"_r", "r", "held", "odd.name"} <= set(licenses.scan_licenses(d).columns)
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[2].labels == "apache-2"  # the mention inside the notice is suppressed
    assert got[6].labels == "gpl-3"
    assert got[7].labels == "apache-2" and got[7].score == 1.0
    assert got[8].labels == "all-rights-reserved"
    assert got[9].labels == "mit" and got[9].score == 0.95
    assert got[10].labels == "" and got[10].score == 0


def test_every_rule_passes_the_prefilter_keywords():
    assert len(licenses.rules()) >= 200
    for rank, label, key, regex in licenses.rules():
        re.compile(regex)
        assert rank in (1, 2, 3, 4) and label and key == key.lower()


def example(tree, space):
    """The shortest text that a parsed regex matches, with ``space`` for white space."""
    out = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.ANY:
            out += "x"
        elif op is sre.IN:
            o, a = arg[0]
            assert o in (sre.LITERAL, sre.CATEGORY)
            out += chr(a) if o is sre.LITERAL else {sre.CATEGORY_SPACE: space, sre.CATEGORY_DIGIT: "4", sre.CATEGORY_NOT_SPACE: "x"}[a]
        elif op is sre.BRANCH:
            out += example(arg[1][0], space)
        elif op is sre.SUBPATTERN:
            out += example(arg[3], space)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += example(arg[2], space) * arg[0]
        elif op is sre.ASSERT:
            out += example(arg[1], space)
        else:
            assert op in (sre.AT, sre.ASSERT_NOT), op
    return out


def ascii_upper(t):
    return "".join(c.upper() if c.isascii() else c for c in t)


def test_every_rule_finds_its_own_text_alone_and_wrapped(spark):
    texts = []
    for i, (_, _, _, regex) in enumerate(licenses.rules()):
        for space in (" ", "\n", " \t\r\n"):
            t = example(sre.parse(regex), space)
            for x in (t, ascii_upper(t), t.lower()):
                assert re.search(f"(?is){regex}", x), (regex, x)
                texts.append((len(texts), i, x))
    d = spark.createDataFrame(texts, "doc_id long, rule int, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    missed = {licenses.rules()[r.rule][1:4:2] for r in got.values() if not r.labels}
    assert not missed
    # every rule that matches by brute force passes gate and keys
    every = [(re.compile(f"(?is){regex}"), [x.split("|") for x in key.split("&")]) for _, _, key, regex in licenses.rules()]
    for t in sorted({t for _, _, t in texts} | set(filter(None, TEXTS))):
        low = t.lower()
        for regex, sets in every:
            if regex.search(t):
                assert all(any(k in low for k in x) for x in sets), (regex, t)
                assert any(k in low for k in licenses.GATES), (regex, t)


def test_gates_are_implied_by_every_rule():
    for _, _, _, regex in licenses.rules():
        sets = licenses._needed(sre.parse(regex))
        assert any(all(any(g in word for g in licenses.GATES) for word in x) for x in sets), regex


def test_texts_that_the_gates_lost(spark):
    wanted = {
        "Altered source versions must be plainly marked as such": "zlib",
        "Neither the name of X nor those of others may be used to endorse or promote": "bsd-3-clause",
        "you may use it on the same terms as\nPerl itself": "perl",
        "https://joinup.ec.europa.eu/page/eupl-text-11-12": "eupl-1.2",
        "released under the Apache\nSoftware 2.0": "apache-2",
        "given under the terms of the zlib/libpng": "zlib",
        "Alle Rechte\nvorbehalten": "all-rights-reserved",
        "under the European\nUnion Public Licence": "eupl-1.2",
    }
    d = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    got = {r.text: r.labels for r in licenses.scan_licenses(d).collect()}
    assert got == wanted


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_labels(text, rules):
    """Labels and score by every rule on the whole text, each place against each other."""
    places = []
    for i, (rank, label, _, regex) in enumerate(rules):
        places += [(m.start(), -m.end(), rank, i, label) for m in regex.finditer(text)]
    places.sort()
    stay = [p for j, p in enumerate(places) if not any(q[2] <= p[2] and q[1] <= p[1] for q in places[:j])]
    base = [x for x in brute(text)[4].split(",") if x]
    score = max([0.0, *(licenses.RANK_SCORE[p[2] - 1] for p in stay), *(0.9 for _ in base)])
    return ",".join(sorted({*base, *(p[4] for p in stay)})), score


def test_all_rules_on_whole_documents(spark):
    """Labels and score of real documents, and of made ones with every rule's example, without any gate."""
    rules = [(rank, label, key, re.compile(f"(?is){regex}", re.A)) for rank, label, key, regex in licenses.rules()]
    made = [example(sre.parse(f"(?is){regex}"), " ") for _, _, _, regex in licenses.rules()]
    texts = [t for t in TEXTS if t] + [f"see {a}, and\n{b}. {c}" for a, b, c in zip(made, made[7:] + made[:7], made[40:] + made[:40])]
    path = "/root/testdata/sf0.001/documents.parquet"
    import os

    if os.path.exists(path):
        texts += [r.text for r in spark.read.parquet(path).where("text is not null").collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(d, carry=["doc_id"]).collect():
        assert (r.labels, r.score) == brute_labels(texts[r.doc_id], rules), texts[r.doc_id][:200]
