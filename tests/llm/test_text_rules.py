"""Quality rules (10) and licences (1): oracles on odd rows and on the tables, and plain counts."""

import re
from collections import Counter

import duckdb
import pytest

from tallyport.llm import op1_licenses, op10_quality_rules
from tests.llm.conftest import ODD
from tests.oracle import rows, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(spark, odd):
    got = sorted((str(r["__row"].doc_id), *[r[c] for c in op10_quality_rules.COUNTS]) for r in op10_quality_rules.score(odd).collect())
    assert got == sorted((str(i), *plain_counts(t)) for i, t in ODD)


@pytest.mark.parametrize("module", [op1_licenses, op10_quality_rules])
def test_oracle(spark, data, module):
    same(spark, data, module.query, module.oracle() if module is op1_licenses else module.ORACLE_SQL)


@pytest.mark.parametrize("module", [op1_licenses, op10_quality_rules])
def test_oracle_on_odd_rows(spark, odd, folder, module):
    path = folder(documents=odd)
    con = duckdb.connect()
    con.sql(f"create view documents as from '{path}/documents.parquet'")
    sql = module.oracle() if module is op1_licenses else module.ORACLE_SQL
    assert rows(module.query(spark, path).toPandas()) == rows(con.sql(sql).df())


def test_filter_keeps_columns(odd, empty):
    kept = op10_quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {10, 12, 8, 11}
    assert op10_quality_rules.filter_documents(empty).count() == 0 and op1_licenses.scan(empty).count() == 0


def test_rules_follow_labels(spark, data):
    """Where the base limits do not decide, the verdict agrees with the labels, which it has not seen."""
    sf = data.replace("sf0.001", "sf0.01")
    got = op10_quality_rules.query(spark, sf).filter("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.97 * len(got)


def test_em_finds_the_rare_class():
    good, bad = (1,) * 10, (0, 0, 0, -1, 1, 1, 1, 1, -1, 0)
    model = op10_quality_rules.em([(good, 900), (bad, 100)])
    assert abs(model["share"] - 0.9) < 0.02
    assert op10_quality_rules.logit(model["share"], model["tables"], good) > 5 > -5 > op10_quality_rules.logit(model["share"], model["tables"], bad)
    assert op10_quality_rules.em([])["share"] == pytest.approx(0.8)


def test_licences(spark):
    lines = {
        "Released under the MIT License.": "mit", "SPDX-License-Identifier: Apache-2.0": "apache", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "ALL RIGHTS RESERVED.": "proprietary", "Licensed under the Foo Agreement of Bar": "unknown",
        "The driver showed a license plate.": "none", "nothing of the kind": "none", "foo Licensed under the GNU Lesser General Public License, version 2.1. bar": "lgpl", "Mit license, perhaps? copyright": "unknown",
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in op1_licenses.scan(df).collect()}
    right = [got[k] == want or (want == "none" and got[k] == "unknown") for k, want in enumerate(lines.values())]
    assert all(right), [(x, got[k]) for k, x in enumerate(lines)]
    both = spark.createDataFrame([(1, "Released under the MIT License.\ntext\nAll rights reserved.")], "doc_id long, text string")
    assert op1_licenses.scan(both).collect()[0].families == "mit,proprietary"


def test_native_plans(spark, data):
    """No Python, pandas or Arrow node in the plans of the native operators."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (op10_quality_rules.score(docs), op10_quality_rules.measure(docs), op1_licenses.scan(docs), op1_licenses.paragraphs(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


#: Wrapped, inline and unanchored notices, and text that only sounds like one.
NOTICES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("mit", "Copyright 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software\n\nThe above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\");\r\nyou may not use this file except in compliance with the License.\r\nYou may obtain a copy of the License at\r\n\r\n    http://www.apache.org/licenses/LICENSE-2.0\r\n"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer."),
    ("cc-by-sa", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mit", "Distributed under MIT terms."), ("gpl", "This code is GPLv3."), ("cc-by-sa", "Available under CC BY-SA 4.0."), ("gpl", "Distributed under the GNU GPL v3."), ("apache", "Released under Apache 2.0."),
    ("mit", "The code in this repository is MIT licensed, see the file for details."), ("agpl", "The server is licensed under AGPLv3 for everyone."), ("bsd", "This package is distributed under the BSD 3-Clause License by its authors."),
    ("public-domain", "The author has placed this text in the public domain."), ("cc-by-nc", "All photos are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("cc-by", "Except where noted, text on this page is available under CC BY 4.0."),
    ("none", "Er ging mit dem Hund und mit der Katze in den Wald, und mit allen anderen."), ("none", "All seats at the theatre were reserved by the school."), ("none", "Rights of workers are discussed in this chapter of the book."), ("none", "The Apache lived in the desert, said the general."),
]


def test_wrapped_inline_and_unanchored_licences(spark):
    prose = "Nothing of the kind was said.\nThe weather stayed as it had been"
    df = spark.createDataFrame([(k, f"{prose}.\n{x}\n\n{prose}") for k, (_, x) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in op1_licenses.scan(df).collect()}
    missed = [(x[:60], got[k]) for k, (want, x) in enumerate(NOTICES) if want != "none" and got[k] != want]
    assert len(missed) <= 0.1 * sum(w != "none" for w, _ in NOTICES), missed
    assert all(got[k] == "none" for k, (want, _) in enumerate(NOTICES) if want == "none")


def test_paragraphs_without_a_trigger_are_none():
    """The bound behind the trigger words, on the grams that could break it."""
    import numpy as np

    m = op1_licenses.model()
    none = op1_licenses.CLASSES.index("none")
    left = [np.array(w) for g, w in m["weights"].items() if not set(g.split()) & set(m["triggers"])]
    assert left and 0 < len(m["triggers"]) < 150
    most = np.array(m["intercepts"]) - m["intercepts"][none] + sum(np.maximum(0, w - w[none]) for w in left)
    assert all(x < 0 for k, x in enumerate(most) if k != none)


def test_scan_of_another_column(spark, odd):
    df = spark.createDataFrame([(1, "none here", "MIT licensed"), (1, "none here", "MIT licensed"), (None, None, None)], "doc_id long, text string, body string")
    assert sorted((str(r.doc_id), r.license) for r in op1_licenses.scan(df, "body").collect()) == [("1", "mit"), ("1", "mit"), ("None", "none")]
    assert [r.family for r in op1_licenses.scan_paragraphs(df, "body").collect()] == ["mit", "mit"] and op1_licenses.paragraphs(df).filter("place is not null").count() == 0


#: Written before the names and carriers of the module, and none of them.
FRESH = [
    ("License: MIT", "mit"), ("Licence: BSD", "bsd"), ("Code released under GPL-3.0", "gpl"), ("Licensed under CC0", "public-domain"), ("Alle Rechte vorbehalten", "proprietary"), ("dual-licensed under MIT or Apache-2.0", "apache,mit"),
    ("The tool was written over many years by people of the institute, who met on Fridays. This program is licensed under GPL version 3. Its authors may be asked for help, and are found in the list", "gpl"),
    ("Distributed under the Apache licence", "apache"), ("This package is BSD licensed (3-clause)", "bsd"), ("(C) 2011 A. Author, licensed CC-BY-SA 3.0", "cc-by-sa"), ("You may use it under the GNU LGPL, version 3 or later", "lgpl"), ('license = "MPL-2.0"', "mpl"),
    ("SPDX: AGPL-3.0-or-later", "agpl"), ("Published under Creative Commons Attribution 3.0", "cc-by"), ("code: MIT license, docs: CC BY 4.0 license", "cc-by,mit"), ("Available under a BSD license", "bsd"), ("Source is GPL v2+ licensed", "gpl"), ("This font is in the public domain", "public-domain"),
    ("The Mozilla Public License Version 1.1 applies", "mpl"), ("License :: OSI Approved :: MIT License", "mit"), ("See the GNU Affero GPL for details", "agpl"), ("Tous droits reserves", "proprietary"), ("Photos are CC BY-NC 2.0 licensed", "cc-by-nc"), ("# licensed under the GNU General Public License v2", "gpl"),
]
NAMELESS = ["The ISC License", "EUPL v1.2 licence", "WTFPL license", "Released under the Zlib license", "Licensed under the Quux Public Licence 2.0"]
PLAIN = [
    "He went mit dem Hund in den Wald.", "Researchers at MIT built a small robot.", "The Apache helicopter landed near the river.", "A fishing licence costs ten pounds.", "She was licensed to practise medicine in Ohio.", "The treaty reserved rights for both of the sides.",
    "The public library opens at nine.", "Er kam mit der Bahn, und mit ihm kam der Regen.", "My driving license was stolen in May.", "The general gave a public speech about freedom.",
]


def test_fresh_notices(spark):
    """Notices that no template has: at least nine in ten are found, with all families that they name; other licences are unknown, other text none."""
    texts = [t for t, _ in FRESH] + NAMELESS + PLAIN
    got = {r.doc_id: (r.license, r.families) for r in op1_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = [(t, got[k]) for k, (t, want) in enumerate(FRESH) if got[k][1] != want]
    assert len(missed) <= len(FRESH) // 10, missed
    others = [(t, got[len(FRESH) + k]) for k, t in enumerate(NAMELESS) if got[len(FRESH) + k][0] != "unknown"]
    assert len(others) <= 1, others
    wrong = [(t, got[len(FRESH) + len(NAMELESS) + k]) for k, t in enumerate(PLAIN) if got[len(FRESH) + len(NAMELESS) + k][0] != "none"]
    assert len(wrong) <= 1, wrong
