from tidemark.llm import licenses as L


def test_scan_and_inheritance(spark):
    files = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.txt", "plain text"),
             (3, "a/b/c/LICENSE.md", "some words\nReleased under the MIT License."), (4, "a/b/c/y", "text"), (5, "a/b/c/d/e/z", None),
             (6, "q/x", "nothing"), (7, "a/w", "All rights reserved. More text"), (8, None, "lost"), (9, "a/notes", "a licence to thrill"),
             (10, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (11, "top", "")]
    df = spark.createDataFrame(files, "file_id long, path string, text string").selectExpr("*", "1 as row", "2 as mark", "3 as own")
    got = {r.file_id: (r.licence, r.origin, r.directory) for r in L.scan(df).collect()}
    assert got[1] == ("Apache-2.0", "direct", None) and got[2] == ("Apache-2.0", "inherited", "a")
    assert got[3][0] == "MIT" and got[7] == ("Proprietary", "direct", None)
    assert got[4][1] == "inherited" and got[4][2] == "a/b/c" and got[5] == got[4]  # the nearest ancestor
    assert got[6] == (None, "none", None) == got[8] == got[11] and got[9] == ("Apache-2.0", "inherited", "a")


def test_root_licence_reaches_all(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License")] + [(i, f"d{i}/f", "x") for i in range(2, 30)],
                               "file_id long, path string, text string")
    rows = L.scan(df).collect()
    assert len(rows) == 29 and all(r.licence == "MIT" for r in rows)


def test_given_lines_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
             "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    got = {r.doc_id: r for r in L.scan_documents(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        held = [k for k, x in lines.items() if x in r.text]
        if held:
            assert got[r.doc_id].origin == "direct" and got[r.doc_id].licence in held
        elif "rights reserved" not in r.text:
            assert got[r.doc_id].origin != "direct"


def test_edges(edge, nothing):
    assert L.scan_documents(edge).count() == edge.count()
    assert L.scan_documents(nothing).count() == 0


def test_header_blocks():
    apache = """/*
 * Copyright 2020 Some One. All rights reserved.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */
int x;"""
    bsd = """# Copyright (c) 2020, Some One
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
"""
    mpl = """// This Source Code Form is subject to the terms of the
// Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
// with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
    scanner = L.Scanner({t: 300 for t in ("the", "of", "and", "in", "to", "is", "are", "this", "with")}, 1000)
    for text, want in ((apache, "Apache-2.0"), (bsd, "BSD-3-Clause"), (mpl, "MPL-2.0"), ("// SPDX-License-Identifier: MIT\n", "MIT"),
                       ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("Copyright 2020 X.\nAll rights\nreserved.", "Proprietary"),
                       ("Permission is\nhereby granted, free of charge, to any person\nobtaining a copy of this software", "MIT")):
        assert scanner.best(text)[0] == want, (want, scanner.best(text))


GNU = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {0} License as published by\n"
       "the Free Software Foundation; either version {1} of the License, or\n(at your option) any later version.\n")
BSD = ("Copyright 2021 Some One\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
       "following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
       "disclaimer in the documentation and/or other materials provided with the distribution.\n")


def test_versions_and_qualifiers_decide():
    scanner = L.Scanner({t: 300 for t in ("the", "of", "and", "in", "to", "is", "are", "this", "with", "or")}, 1000)
    for text, want in (("GNU General Public License, version 2", "GPL-2.0"), ("GNU General Public License, version 3", "GPL-3.0"),
                       ("GNU Lesser General Public License, version 3", "LGPL-3.0"), ("GNU Affero General Public License version 3", "AGPL-3.0"),
                       (GNU.format("General Public", 2), "GPL-2.0"), (GNU.format("Lesser General Public", "2.1"), "LGPL-2.1"),
                       ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY 3.0", "CC-BY-3.0"),
                       ("Licensed under CC BY 2.5", None), ("The Apache Software License, Version 1.1", "Apache-1.1"), (BSD, "BSD-2-Clause"),
                       (BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                        "derived from this software without specific prior written permission.\n", "BSD-3-Clause"),
                       ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided "
                        "that the above\ncopyright notice and this permission notice appear in all copies.", "ISC")):
        assert scanner.best(text)[0] == want, (text, want, scanner.best(text))


def test_cosine_against_a_plain_one():
    import math
    from collections import Counter
    df, n = {"the": 40, "license": 7, "version": 5}, 100
    scanner = L.Scanner(df, n)
    text = "Licensed under the Apache License, Version 2.0 and nothing else"
    known = {t for notices in L.TEMPLATES.values() for x in notices for t in L.terms(x)}
    weight = lambda t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 if t in known else math.log(n + 1) + 1
    a = {t: c * weight(t) for t, c in Counter(L.terms(text.lower())).items()}
    want = 0.0
    for x in L.TEMPLATES["Apache-2.0"]:
        b = {t: c * weight(t) for t, c in Counter(L.terms(x)).items()}
        dot = sum(a.get(t, 0) * y for t, y in b.items())
        want = max(want, dot / math.sqrt(sum(y * y for y in a.values()) * sum(y * y for y in b.values())))
    name, cosine = scanner.best(text)
    assert name == "Apache-2.0" and abs(cosine - want) < 1e-12
