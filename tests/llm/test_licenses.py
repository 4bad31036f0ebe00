"""Operator 8: whole license notices, wrapped and on lines, and the SQL."""

import textwrap

import duckdb

from casemill.llm import licenses as li

APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
TEXTS = {
    1: (APACHE, "Apache-2.0"),
    2: ("Some prose.\nReleased under the MIT License.", "MIT"),
    3: ("no full stop before\nThis work is licensed under the GNU General Public License, version 3.\nmore", "GPL-3.0-only"),
    4: ("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "Apache-2.0,CC-BY-NC-4.0"),
    5: ("He said licensed under the Apache License is fine.", ""),
    6: (None, ""),
    7: ("", ""),
    8: ("This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy", "MPL-2.0"),
    9: ("ALL RIGHTS RESERVED!", "proprietary"),
    10: ("word " * 50000 + ".\nReleased under the MIT license", "MIT"),
}


def test_scan_and_sql(spark):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in TEXTS.items()] + [(2, TEXTS[2][0], "x")], "doc_id long, text string, licenses string")
    got = sorted(tuple(r) for r in li.scan(df).collect())
    assert {r[0]: r[2] for r in got} == {k: want for k, (_, want) in TEXTS.items()} and len(got) == 11
    documents = df.toPandas()  # noqa: F841  read by name
    assert got == sorted(duckdb.connect().sql(li.oracle()).fetchall())
    assert li.scan(df.limit(0)).count() == 0


def test_every_known_sentence_is_found(spark):
    df = spark.createDataFrame(list(li.SENTENCES.items()), "doc_id string, text string")
    assert [r.doc_id for r in li.scan(df).where("n_sentences <> 1").collect()] == []


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
MIT = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + GRANT + AS_IS
BSD = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
ISC = """Copyright 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
GPL = """    This program is free software%s you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation%s either version %d of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
FILES = [
    (MIT, "MIT"),
    (MIT.replace("\n", "\r\n"), "MIT"),
    (GRANT, "MIT"),
    (MIT.replace("conditions:\n\n", "conditions:\n"), "MIT"),
    ("\n\n".join(" ".join(x.split()) for x in MIT.split("\n\n")), "MIT"),  # a paragraph a line
    ("Released under the\nMIT License.\n\n" + MIT, "MIT"),
    ("Licensed under the Apache License,\nVersion 2.0.", "Apache-2.0"),
    (APACHE, "Apache-2.0"),
    (BSD, "BSD-2-Clause"),
    (BSD + BSD3, "BSD-3-Clause"),
    (ISC, "ISC"),
    (GPL % (":", ",", 3), "GPL-3.0-or-later"),
    (GPL % (";", ";", 2), "GPL-2.0-or-later"),
    ("This work is licensed under the GNU General\nPublic License, version 3.", "GPL-3.0-only"),
    ("Licensed under\nCC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("Licensed under\nCC BY 4.0.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-4.0"),
    ("Licensed under\nCC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
    ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"),
    ("To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.", "CC0-1.0"),
    ("Some prose. All rights\nreserved.", "proprietary"),
    ("All  rights  reserved.", "proprietary"),
]


#: Sentences of further licences as files set them: wrapped at 72 columns, a full stop after each.
WRAPPED = {
    "VjklW": "BSD-4-Clause", "z": "0BSD", "LMNy": "GPL-2.0-or-later WITH exception", "acd": "LGPL-2.1-or-later", "bcd": "LGPL-3.0-or-later", "eMf": "AGPL-3.0-or-later", "hMN": "GPL-2.0-only",
    "g": "EPL-2.0", "x": "EUPL-1.2", "m": "BSL-1.0", "opq": "Zlib", "r": "CC-BY-SA-4.0", "s": "CC-BY-ND-4.0", "t": "CC-BY-NC-ND-4.0", "u": "CC-BY-NC-SA-4.0", "w": "WTFPL",
}
FILES += [(textwrap.fill(". ".join(li.SENTENCES[c] for c in ids) + ".", 72), name) for ids, name in WRAPPED.items()]
FILES += [(f"#!/bin/sh\n# SPDX-License-Identifier: {name}\necho", name) for name in li.OF_NOTICE]


def test_wrapped_license_files(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FILES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in li.scan(df).collect()}
    assert {i: (FILES[i][0][:40], x) for i, x in got.items()} == {i: (t[:40], want) for i, (t, want) in enumerate(FILES)}
    assert {name for _, name in FILES} == {name for _, name, _ in li.RULES}


def test_halves_far_apart_and_near_misses(spark):
    v, w, j, k = (li.SENTENCES[x] for x in "VWjk")
    rows = [
        ("near", f"{v}:\n{j}.\n{k}.\nNames differ here.\n{w}.", "BSD-3-Clause"),
        ("far", f"{v}. " + "One more plain sentence. " * (li.GAP + 1) + f"{w}.", "BSD-2-Clause"),
        ("just near", f"{v}. " + "One more plain sentence. " * li.GAP + f"{w}.", "BSD-3-Clause"),
        ("word missing", v.replace("source and binary", "binary") + ".", ""),
        ("or later", f"{li.SENTENCES['a']}.\n{li.SENTENCES['c']}.\n{li.SENTENCES['d']}.", "LGPL-2.1-or-later"),
        ("exception", f"{li.SENTENCES['L']}. {li.SENTENCES['M']}. {li.SENTENCES['N']}. {li.SENTENCES['y']}.", "GPL-2.0-or-later WITH exception"),
        ("affero", f"{li.SENTENCES['e']}. {li.SENTENCES['f']}.", "AGPL-3.0-or-later"),
        ("zlib", f"{li.SENTENCES['o']}. {li.SENTENCES['p']}. {li.SENTENCES['q']}:", "Zlib"),
    ]
    got = {r.doc_id: r.licenses for r in li.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")).collect()}
    assert got == {k: want for k, _, want in rows}


def test_sql_reads_whole_files_too(spark):
    """MIT's grant stands over a blank line; Spark and SQL both read it as one sentence."""
    texts = [MIT, MIT.replace("\n\n", "\n \n"), BSD, GRANT, AS_IS, MIT.replace("conditions:", "conditions"), APACHE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in li.scan(df).collect())
    documents = df.toPandas()  # noqa: F841  read by name
    assert got == sorted(duckdb.connect().sql(li.oracle()).fetchall())
    assert [r[2] for r in got][:2] == ["MIT", "MIT"] and "MIT" not in got[5][2]


def test_every_notice_is_found_and_names_its_license(spark):
    known = li.notices()
    df = spark.createDataFrame([(i, f"Some prose about it.\n{s}.\nMore prose.") for i, s in enumerate(known)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in li.scan(df).collect()}
    name_of = {k: n for n, k in li.OF_NOTICE.items()}
    wrong = [(s, got[i]) for i, (s, k) in enumerate(known.items()) if got[i].split(" WITH")[0] != name_of[k]]
    assert len(known) > 1000 and not wrong


def test_notices_in_code_and_near_misses(spark):
    rows = [
        ("c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", "GPL-2.0-or-later"), ("two", "// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0,MIT"), ("other", "# SPDX-License-Identifier: MITX", ""),
        ("wrapped", "This project is licensed under the terms of the Mozilla\nPublic License 2.0.", "MPL-2.0"), ("word more", "This project is not licensed under the MIT License", ""), ("file and tag", "# SPDX-License-Identifier: MIT\n\n" + MIT, "MIT"), ("name alone", "The MIT License is short.", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    got = sorted(tuple(r) for r in li.scan(df).collect())
    assert [(rows[i][0], r[2]) for i, r in enumerate(got)] == [(k, want) for k, _, want in rows]
    documents = df.toPandas()  # noqa: F841  read by name
    assert got == sorted(duckdb.connect().sql(li.oracle()).fetchall())
