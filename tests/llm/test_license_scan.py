from __future__ import annotations

import re

from huntline.llm import license_scan
from huntline.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"
# Lines of the test documents that name a license, by the license they name.
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT",
}


def test_every_license_line_and_nothing_else(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, name, m.start()) for r in docs for line, name in LINES.items() for m in re.finditer(re.escape(line), r.text or ""))
    got = QUERIES["op5_license_scans"](spark, MEDIUM).collect()
    assert len(want) > 10
    assert sorted((r.doc_id, r.license, r.begin) for r in got) == want
    assert all(r.missing == r.added == [] and r.reduction > 0 for r in got)


def test_wording():
    scan = lambda t: [(h[0], h[7], h[8]) for h in license_scan.Scanner().scan(t)]
    assert scan("x y. RELEASED  under\nthe MIT license!") == [("MIT", [], [])]
    assert scan("Licensed under the Apache License, Version 1.1.") == []
    assert scan("This program is licensed under the GNU General Public License, version 2.") == []
    assert scan("Licensed under CC BY 4.0.") == [("CC-BY-4.0", [], [])]
    assert scan("Licensed under the well known Apache License, Version 2.0") == [("Apache-2.0", [], ["well", "known"])]
    assert sorted(scan("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")) == [("CC-BY-NC-4.0", [], []), ("MIT", [], [])]
    assert scan("The driver's license of the version was under the terms.") == []
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files (the"
    assert scan(long) == [("MIT", ["associated"], ["its"])]


def test_odd_rows(spark):
    tail = "word " * 50000 + "Released under the MIT License."
    rows = [(1, None, 0), (2, "", 0), (None, "Released under the MIT License.", 0), (3, tail, 0), (3, tail, 0), (4, "license", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, begin int")
    assert sorted((str(r.doc_id), r.license, r.begin) for r in license_scan.scan(docs).collect()) == [("3", "MIT", 250000), ("3", "MIT", 250000), ("None", "MIT", 0)]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_reworded_notice_after_common_words():
    scan = lambda t: [(h[0], t[h[1] : h[2]], h[7], h[8]) for h in license_scan.Scanner().scan(t)]
    notice = "this code is licensed under the GNU General Public License, version 3"
    want = [("GPL-3.0", notice, ["work"], ["code"])]
    assert scan(notice) == want
    assert scan("of this software in source form and " + notice) == want
    assert scan(notice + " and of this software in source form and") == want
    assert scan("of this software and the gnu general public license version or " + notice) == want
    both = "of this software in source form and " + notice + ". Released under the MIT License."
    assert sorted(h[0] for h in scan(both)) == ["GPL-3.0", "MIT"]


OTHERS = {
    "SPDX-License-Identifier: MIT": "MIT", "// spdx-license-identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: CC-BY-NC-ND-4.0": "CC-BY-NC-ND-4.0",
    "Texte et images: CC BY 4.0": "CC-BY-4.0", "photo (cc by-sa 4.0)": "CC-BY-SA-4.0", "CC0 1.0": "CC0-1.0",
    "We dedicated to the public domain what is here": "Public-Domain", "The map is in the public domain.": "Public-Domain",
    "The code is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "Our server is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "Licensed under the BSD 2-clause license": "BSD-2-Clause", "Use it under the ISC licence or under the ISC license.": "ISC",
    "This program and the materials are made available under the terms of the Eclipse Public License v. 2.0": "EPL-2.0",
    "This is free and unencumbered software, released into the public domain": "Unlicense",
}


def test_other_licenses(spark):
    scan = lambda t: [h[0] for h in license_scan.Scanner().scan(t)]
    assert {t: scan(t) for t in OTHERS} == {t: [name] for t, name in OTHERS.items()}
    for t in ("SPDX-License-Identifier: Artistic-2.0", "Licensed under CC BY-NC-ND 3.0", "the public domain", "a domain in the public eye"):
        assert scan(t) == []
    docs = spark.createDataFrame(list(enumerate(OTHERS)), "doc_id long, text string")
    assert sorted(r.doc_id for r in license_scan.scan(docs).collect()) == list(range(len(OTHERS)))


def test_reserved_rights(spark):
    docs = spark.createDataFrame([(1, "some words.\nAll rights reserved."), (2, "all rights are reserved"), (3, "Released under the MIT License. ALL RIGHTS RESERVED")], "doc_id long, text string")
    got = license_scan.scan(docs, tags=license_scan.TAGS + license_scan.RESERVED).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "All-Rights-Reserved"), (3, "All-Rights-Reserved"), (3, "MIT")]
