"""Licence scans against a plain restatement, and on texts made of rules."""

import re

from graphloom.llm import licenses as L


def norm(t):
    return tuple(re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))


def brute_count(text):
    """Recognised sentences: runs of sentence units whose words are those of a known sentence."""
    known = {norm(s) for s in L.SENTENCES.values()}
    units = [u for u in map(norm, re.split(r"\n|(?<=[.!?:;])(?=[\x20\x09-\x0D])", text or "")) if u]
    return sum(sum(units[i:j], ()) in known for i in range(len(units)) for j in range(i + 1, min(len(units), i + 14) + 1))


def test_documents(docs, texts, nothing):
    got = {r.doc_id: r for r in L.license_scan(docs).collect()}
    assert {i: r.n_sentences for i, r in got.items()} == {i: brute_count(t) for i, t in texts.items()}
    lines = {"GNU General Public License, version 3": "GPL-3.0-only", "CC BY-NC 4.0": "CC-BY-NC-4.0", "the MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0"}
    for i, t in texts.items():
        assert got[i].licenses == ",".join(sorted(v for k, v in lines.items() if k in (t or "")))
    assert any(r.licenses for r in got.values()) and L.license_scan(nothing).count() == 0


def test_rules(spark):
    s = L.SENTENCES
    bsd3 = f"{s['bsd-head']}:\n* {s['bsd-source']}.\n* {s['bsd-binary']}.\n* {s['bsd-endorse']}."
    wrapped = s["mit-grant"].replace(", to deal", ",\nto deal") + ":\n\n" + s["mit-retain"] + ".\n" + s["mit-as-is"] + "."
    far = s["bsd-head"] + ". " + "filler words here. " * 6 + s["bsd-source"] + ". " + s["bsd-binary"] + "."
    texts = {0: bsd3, 1: "intro\n" + wrapped, 2: far, 3: bsd3.replace(s["bsd-endorse"], "no more"), 4: "x " + s["mit-notice"], 5: f"{s['mit-notice']}. {s['gpl3-notice']}!", 6: None}
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(7)] == ["BSD-3-Clause", "MIT", "", "BSD-2-Clause", "", "GPL-3.0-only,MIT", ""]
    start, end = map(int, got[1].spans.split(":")[1:])
    assert texts[1].encode()[start:end].decode().startswith("Permission") and texts[1].encode()[end - 15 : end] == b"NONINFRINGEMENT"


def test_more_rules(spark):
    s = L.SENTENCES
    gpl3 = "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    agpl = s["agpl3-header"].replace("terms of", "terms of\n#") + ".\n" + s["gpl-warranty"] + "."
    zlib = f"{s['zlib-as-is']}. {s['zlib-liable']}.\n{s['zlib-grant']}:"
    mpl = f"{s['mpl2-notice']}. {s['mpl2-copy-2']}."
    texts = {0: gpl3, 1: agpl, 2: zlib, 3: mpl, 4: "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", 5: "# SPDX-License-Identifier: GPL-3.0-or-later WITH more", 6: "Copyright 2020 Ann. All rights reserved.", 7: f"All rights reserved.\n{s['bsl1-notice']}."}
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(8)] == ["GPL-3.0-only", "AGPL-3.0-or-later", "Zlib", "MPL-2.0", "GPL-3.0-or-later", "", "", "BSL-1.0"]
    assert got[6].notices == "All-Rights-Reserved:20:39" and got[6].spans == "" and got[7].notices == "All-Rights-Reserved:0:19"
    assert [got[i].notices for i in range(6)] == [""] * 6 and got[0].n_sentences == 2


def test_every_rule_names_known_sentences():
    for name, seq in L.RULES + L.NOTICES:
        assert all(s in L.SENTENCES for s in seq), name
    for name, seq in L.RULES:  # a text made of a rule alone is found to be of that licence
        known = L.Sentences()
        text = ". ".join(L.SENTENCES[s] for s in seq) + "."
        chunk = next(L.X.chunks(L.pa.array([text])))
        _, ordinal, found = known.recognise(chunk)
        assert name in {h[0] for h in known.match(known.rules, found, ordinal)}, (name, seq)
