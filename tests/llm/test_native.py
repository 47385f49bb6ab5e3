import hashlib

import pytest
from oracle import rows, sql_rows

from loomgraph.llm import exact_dedup, license_scan

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, text_sha256 string, seq int"


@pytest.mark.parametrize(
    ("query", "sql"),
    [(exact_dedup.op8_exact_dedup, exact_dedup.ORACLE), (license_scan.op6_license_scan, license_scan.ORACLE)],
)
def test_same_as_sql(spark, query, sql):
    assert rows(query(spark, SMALL)) == sql_rows(SMALL, sql)


def test_exact_dedup_edges(spark):
    data = [(1, "Ab É", "en", "x", 0), (2, "aB É", None, None, 0), (3, "ab é", "en", "x", 0), (4, None, "en", "x", 0), (5, "", "en", "x", 0), (None, "", "en", "x", 0), (7, "t", "en", "x", 0), (7, "t", "en", "x", 0)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, SCHEMA)).collect()
    by = {(r.doc_id, r.text_sha256): r for r in got if r.doc_id != 7}
    digest = hashlib.sha256("ab É".encode()).hexdigest()
    assert (by[1, digest].keep_id, by[1, digest].kept, by[1, digest].group_size) == (2, False, 2)
    assert by[2, digest].kept
    empty = hashlib.sha256(b"").hexdigest()
    assert by[5, empty].kept and not by[4, empty].kept and by[None, empty].keep_id == 5 and by[4, empty].group_size == 3
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_hot_and_cold_agree(spark):
    data = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    few, many = (sorted(map(tuple, exact_dedup.exact_dedup(df, k=k).collect())) for k in (1, 64))
    assert few == many
    assert sum(r[3] for r in few) == len({t for _, t in data})


def test_license_rules(spark):
    long = "x. " * 20_000 + "All rights reserved."
    data = [
        (1, "Intro.\nReleased under the MIT License.\nAll rights reserved."),
        (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License!"),
        (3, None),
        (4, ""),
        (5, long),
        (6, "A licensed thing."),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1].licenses, got[1].license, got[1].n_known) == ("MIT Proprietary", "MIT", 2)
    assert (got[2].license, got[2].sentence_ids) == ("Apache-2.0", "apache-2 apache-2-comply")
    assert got[5].license == "Proprietary"
    assert [got[i].licenses for i in (3, 4, 6)] == ["", "", ""]


def test_anchors_cover_sentences():
    for s in license_scan.SENTENCES.values():
        assert any(all(w in s for w in a.split(" ")) for a in license_scan.ANCHORS), s


MIT = """MIT License

Copyright (c) 2020 Ada

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at
"""
BSD = """Copyright 2008 Google Inc.  All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
"""
ENDORSE = """3. Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2 = GPL.replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL.replace("General", "Lesser General").replace("program", "library").replace("version 3", "version 2.1")
KERNEL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
STANDARD = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (ASF, "Apache-2.0"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (GPL, "GPL-3.0"), (GPL2, "GPL-2.0"), (LGPL, "LGPL-2.1"), (KERNEL, "GPL-2.0"), (ISC, "ISC"), (MPL, "MPL-2.0")]


@pytest.mark.parametrize("leader", ["", " * ", "// ", "# "])
def test_wrapped_standard_licences(spark, leader):
    texts = ["".join(f"{leader}{line}\n" for line in t.split("\n")) for t, _ in STANDARD]
    texts += [t.replace("\n", "\r\n") for t in texts]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.license for r in sorted(got)] == [n for _, n in STANDARD] * 2


def test_blank_line_and_other_words_end_a_sentence(spark):
    data = [(1, "Licensed under\n\nthe MIT License"), (2, "Never licensed under the MIT License"), (3, "Some line\nlicensed under\n the MIT License\nother"), (4, "Licensed under. The MIT license")]
    got = license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [r.sentence_ids for r in sorted(got)] == ["mit-title", "", "mit-licensed", "mit-title"]
