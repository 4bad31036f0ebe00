"""License scans by sentence rules (operator 8).

Each normalised sentence that is known maps to a one-character identifier; the sequence of a document's identifiers is matched, from the
left, against ordered rules, of which the first that fits wins. A few unknown sentences may stand between those of a rule (names, dates,
conditions in other words); more of them part it. All of it is Spark expressions over whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses and their notices, by identifier.
SENTENCES = {
    "A": "Licensed under the Apache License, Version 2.0",
    "B": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "C": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "D": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "E": "See the License for the specific language governing permissions and limitations under the License",
    "F": "Released under the MIT License",
    "G": "Licensed under the MIT License",
    "H": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "I": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "J": "This work is licensed under the GNU General Public License, version 3",
    "K": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "L": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "M": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "N": "See the GNU General Public License for more details",
    "O": "Licensed under CC BY-NC 4.0",
    "P": "Licensed under CC BY 4.0",
    "Q": "Licensed under CC BY-SA 4.0",
    "R": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "S": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "T": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "U": "This is free and unencumbered software released into the public domain",
    "V": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "W": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "X": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Y": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Z": "All rights reserved",
    "a": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "b": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "c": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "d": "See the GNU Lesser General Public License for more details",
    "e": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "f": "See the GNU Affero General Public License for more details",
    "g": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "h": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "i": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "j": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "k": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "l": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "m": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "n": "Distributed under the Boost Software License, Version 1.0",
    "o": "This software is provided 'as-is', without any express or implied warranty",
    "p": "In no event will the authors be held liable for any damages arising from the use of this software",
    "q": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "r": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "s": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "t": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "u": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "v": "Licensed under the GNU General Public License, version 2",
    "w": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "x": "Licensed under the EUPL, Version 1.2",
    "y": "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules",
    "z": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
# Licenses by their public short identifiers, with their kind and the names that notices use.
NOTICED = {
    "permissive": {
        "MIT": ("MIT License", "MIT license"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2"), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD License"),
        "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD License"), "BSD-4-Clause": ("BSD 4-Clause License",), "ISC": ("ISC License",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"), "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"),
        "Unlicense": ("Unlicense",), "CC0-1.0": ("Creative Commons CC0 1.0 Universal License", "CC0 1.0 License"), "WTFPL": ("WTFPL License",), "Artistic-2.0": ("Artistic License 2.0",), "PostgreSQL": ("PostgreSQL License",), "Python-2.0": ("Python License 2.0",), "PHP-3.01": ("PHP License, version 3.01",), "Ruby": ("Ruby License",), "OpenSSL": ("OpenSSL License",),
        "NCSA": ("University of Illinois/NCSA Open Source License",), "X11": ("X11 License",), "curl": ("curl License",), "Libpng": ("libpng License",), "FTL": ("FreeType Project License",), "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "MIT-0": ("MIT No Attribution License",), "AFL-3.0": ("Academic Free License 3.0",), "ECL-2.0": ("Educational Community License, Version 2.0",),
        "MulanPSL-2.0": ("Mulan PSL v2 License",), "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0",), "UPL-1.0": ("Universal Permissive License 1.0",), "Vim": ("Vim License",), "ZPL-2.1": ("Zope Public License 2.1",), "W3C": ("W3C Software Notice and License",), "TCL": ("TCL/TK License",), "ICU": ("ICU License",), "HPND": ("Historical Permission Notice and Disclaimer License",),
        "CC-BY-4.0": ("Creative Commons Attribution 4.0 License", "CC BY 4.0 License"), "CC-BY-3.0": ("Creative Commons Attribution 3.0 License", "Creative Commons Attribution 3.0 Unported License", "CC BY 3.0 License"), "CC-BY-2.0": ("Creative Commons Attribution 2.0 License", "CC BY 2.0 License"),
    },
    "copyleft": {
        "GPL-2.0-only": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2 license"), "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GPLv2 or later license"), "GPL-3.0-only": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3 license"), "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GPLv3 or later license"),
        "LGPL-2.0-only": ("GNU Library General Public License, version 2",), "LGPL-2.0-or-later": ("GNU Library General Public License, version 2 or later",), "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1 license"), "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later",), "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "LGPLv3 license"), "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later",),
        "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "AGPLv3 license"), "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later",), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"), "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, version 1.1"), "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
        "EUPL-1.2": ("European Union Public Licence 1.2",), "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, version 1.0"), "CPL-1.0": ("Common Public License 1.0",), "OSL-3.0": ("Open Software License 3.0",), "MS-RL": ("Microsoft Reciprocal License",), "GFDL-1.3-only": ("GNU Free Documentation License, version 1.3",), "GFDL-1.3-or-later": ("GNU Free Documentation License, version 1.3 or later",),
        "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 4.0 License"), "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0 License"), "CECILL-2.1": ("CeCILL License, version 2.1",), "QPL-1.0": ("Q Public License 1.0",),
    },
    "noncommercial": {"CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 License",), "CC-BY-NC-3.0": ("Creative Commons Attribution-NonCommercial 3.0 License",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0 License",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0 License",)},
    "restricted": {"SSPL-1.0": ("Server Side Public License, version 1",), "BUSL-1.1": ("Business Source License 1.1",), "Elastic-2.0": ("Elastic License 2.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0 License",)},
}
TAG = "SPDX-License-Identifier: {}"
#: How notices begin; each with each name is a known sentence, as is the tag with the identifier.
PHRASES = (
    "Licensed under the {}", "Released under the {}", "Distributed under the {}", "Published under the {}", "Available under the {}", "Licensed under the terms of the {}", "Distributed under the terms of the {}", "Released under the terms of the {}", "This project is licensed under the {}",
    "This project is licensed under the terms of the {}", "This software is licensed under the {}", "This software is released under the {}", "This software is distributed under the {}", "This library is licensed under the {}", "This program is licensed under the {}", "This file is licensed under the {}",
    "This work is licensed under the {}", "This work is licensed under a {}", "This package is licensed under the {}", "This code is licensed under the {}", "This code is released under the {}", "The code is licensed under the {}", "The source code is licensed under the {}", "This document is licensed under the {}", "License: {}",
)
#: The most unknown sentences between two of one rule.
GAP = 12
#: Ordered rules: a pattern over identifiers, the license, and its kind. Longer statements come before the shorter ones they begin with.
RULES = (
    ("BC?D?E?", "Apache-2.0", "permissive"),
    ("AC?D?E?", "Apache-2.0", "permissive"),
    ("[FG]?HI", "MIT", "permissive"),
    ("[FG]H?", "MIT", "permissive"),
    ("H", "MIT", "permissive"),
    ("KM?N?", "GPL-3.0-or-later", "copyleft"),
    ("LM?N?y", "GPL-2.0-or-later WITH exception", "copyleft"),
    ("LM?N?", "GPL-2.0-or-later", "copyleft"),
    ("J", "GPL-3.0-only", "copyleft"),
    ("[OS]", "CC-BY-NC-4.0", "noncommercial"),
    ("[PR]", "CC-BY-4.0", "permissive"),
    ("Q", "CC-BY-SA-4.0", "copyleft"),
    ("Ti?", "MPL-2.0", "copyleft"),
    ("U", "Unlicense", "permissive"),
    ("Vj?k?lW", "BSD-4-Clause", "permissive"),
    ("Vj?k?W", "BSD-3-Clause", "permissive"),
    ("Vj?k?", "BSD-2-Clause", "permissive"),
    ("XI?", "ISC", "permissive"),
    ("z", "0BSD", "permissive"),
    ("ac?d?", "LGPL-2.1-or-later", "copyleft"),
    ("bc?d?", "LGPL-3.0-or-later", "copyleft"),
    ("eM?f?", "AGPL-3.0-or-later", "copyleft"),
    ("[hv]M?N?", "GPL-2.0-only", "copyleft"),
    ("g", "EPL-2.0", "copyleft"),
    ("x", "EUPL-1.2", "copyleft"),
    ("n", "BSL-1.0", "permissive"),
    ("m", "BSL-1.0", "permissive"),
    ("opq", "Zlib", "permissive"),
    ("r", "CC-BY-SA-4.0", "copyleft"),
    ("s", "CC-BY-ND-4.0", "restricted"),
    ("t", "CC-BY-NC-ND-4.0", "noncommercial"),
    ("u", "CC-BY-NC-SA-4.0", "noncommercial"),
    ("w", "WTFPL", "permissive"),
    ("Y", "CC0-1.0", "permissive"),
    ("Z", "proprietary", "restricted"),
)
#: A licence's own one-character identifier, for its notices: from the private characters, as letters are used up.
OF_NOTICE = {name: chr(0xE000 + i) for i, name in enumerate(n for names in NOTICED.values() for n in names)}
RULES += tuple((OF_NOTICE[name], name, kind) for kind, names in NOTICED.items() for name in names)
END, OTHER = r"[.!?]+([ \t\r\n]+|\z)", r"[^a-z0-9\x01]+"
ALL = "|".join(f"(?:{p})" for p, *_ in RULES)
#: Where a known sentence goes on after a blank line: sentence H, which licence files set as two paragraphs.
JOINED = r"(subject[ \t\r\n]+to[ \t\r\n]+the[ \t\r\n]+following[ \t\r\n]+conditions:)[ \t\r\n]+(?=the[ \t\r\n]+above[ \t\r\n]+copyright[ \t\r\n]+notice)"
#: Words of which every known sentence holds one, however it is wrapped.
HINT = "licen[sc]e|permission|permitted|redistribution|eupl|advertising|as[^a-z0-9]+is|held[^a-z0-9]+liable|special[^a-z0-9]+exception|of[^a-z0-9]+the[^a-z0-9]+mpl|free[^a-z0-9]+software|warrant|copyright|rights[^a-z0-9]+reserved|public[^a-z0-9]+domain"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _parts(sentence: str) -> list[str]:
    """A known sentence as the scan cuts it: at sentence ends inside it, as after an abbreviation."""
    return [p for p in map(normalised, re.split(r"[.!?]+(?:[ \t\r\n]+|\Z)", sentence)) if p]


def notices() -> dict[str, str]:
    """Sentences that name a license, with its identifier: every phrase with every name, and the tag; those without a hint word are left out."""
    said = {TAG.format(name): OF_NOTICE[name] for name in OF_NOTICE}
    for names in NOTICED.values():
        for name, titles in names.items():
            said |= {phrase.format(title): OF_NOTICE[name] for title in titles for phrase in PHRASES}
    return {s: k for s, k in said.items() if re.search(HINT, s.lower())}


def table() -> dict[str, str]:
    """Normalised sentence -> identifier; of a sentence that the scan cuts, its longest part stands for it. Sentences written out come before made ones."""
    return {max(_parts(s), key=len): k for s, k in notices().items()} | {max(_parts(s), key=len): k for k, s in SENTENCES.items()}


def identifiers(text: Column, wrapped: bool) -> Column:
    """Identifiers of the known sentences of a text, in order, as one string, with _ where more than GAP unknown ones stand between; ``wrapped`` reads single line breaks as blanks."""
    known = table()
    low = F.regexp_replace(F.lower(text), JOINED, "$1 ")
    low = F.regexp_replace(low, r"\n[ \t\r]*\n", "\x01") if wrapped else F.translate(low, "\n", "\x01")
    cut = F.regexp_replace(F.regexp_replace(low, END, "\x01"), OTHER, " ")
    parts = F.filter(F.transform(F.split(cut, "\x01"), lambda s: F.trim(s)), lambda s: s != "")
    of = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    # the map is looked through from its start, so only sentences with a word that every known one holds are looked up
    marks = F.array_join(F.transform(parts, lambda s: F.coalesce(F.when(s.rlike(HINT), F.try_element_at(of, s)), F.lit("."))), "")
    return F.replace(F.regexp_replace(marks, f"[.]{{{GAP + 1},}}", "_"), F.lit("."), F.lit(""))


def of_rules(found: Column) -> Column:
    """Licenses of the rules that match a string of identifiers from the left, as an array."""
    out = F.lit(None).cast("string")

    def of(m: Column) -> Column:
        name = out
        for p, license_, _ in reversed(RULES[: -len(OF_NOTICE)]):
            name = F.when(m.rlike(f"^(?:{p})$"), license_).otherwise(name)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n, k in OF_NOTICE.items() for x in (k, n)]), m), name)

    return F.transform(F.regexp_extract_all(found, F.lit(f"({ALL})"), F.lit(1)), of)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_sentences (known ones), licenses (distinct, sorted, comma-joined; '' if none) and kinds (likewise).

    A sentence may stand on a line of its own or run over wrapped lines. Null and empty texts have none. Repeated rows stay.
    """
    texts = F.coalesce(F.col(text), F.lit(""))
    # one cheap look for a word that every known sentence holds spares most texts the rest
    hint = F.lower(texts).rlike(HINT)
    ids = [F.when(hint, identifiers(texts, w)).otherwise("") for w in (False, True)]
    out = df.select(F.col(key).alias(key), ids[0].alias("__a"), ids[1].alias("__b"))
    licenses = F.array_sort(F.array_distinct(F.concat(of_rules(F.col("__a")), of_rules(F.col("__b")))))
    out = out.select(key, F.greatest(*[F.length(F.replace(F.col(c), F.lit("_"), F.lit(""))) for c in ("__a", "__b")]).cast("long").alias("n_sentences"), licenses.alias("__l"))
    kind = F.create_map(*[F.lit(x) for _, license_, k in {r[1]: r for r in RULES}.values() for x in (license_, k)])
    kinds = F.array_sort(F.array_distinct(F.transform("__l", lambda x: F.element_at(kind, x))))
    return out.select(key, "n_sentences", F.array_join("__l", ",").alias("licenses"), F.array_join(kinds, ",").alias("kinds"))


def oracle() -> str:
    """The scan in DuckDB SQL."""
    known = table()
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    cases = " ".join(f"WHEN regexp_full_match(m, '(?:{p})') THEN '{n}'" for p, n, _ in RULES)
    kinds = " ".join(f"WHEN x = '{n}' THEN '{k}'" for _, n, k in RULES)

    gap = r"[ \t\r\n]+"
    grant = gap.join("subject to the following conditions:".split()), gap.join("the above copyright notice".split())
    joined = f"regexp_replace(lower(text), '({grant[0]}){gap}({grant[1]})', '\\1 \\2', 'g')"

    def ids(wrapped: bool) -> str:
        low = f"regexp_replace({joined}, '\\n[ \\t\\r]*\\n', chr(1), 'g')" if wrapped else f"replace({joined}, chr(10), chr(1))"
        cut = f"regexp_replace(regexp_replace({low}, '{END}', chr(1), 'g'), '{OTHER}', ' ', 'g')"
        parts = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
        marks = f"array_to_string(list_transform({parts}, lambda s: coalesce([{quoted(known.values())}][list_position([{quoted(known)}], s)], '.')), '')"
        return f"coalesce(replace(regexp_replace({marks}, '[.]{{{GAP + 1},}}', '_', 'g'), '.', ''), '')"

    found = lambda c: f"list_transform(regexp_extract_all({c}, '{ALL}'), lambda m: CASE {cases} END)"
    return f"""
WITH i AS (SELECT doc_id, {ids(False)} AS a, {ids(True)} AS b FROM documents),
l AS (SELECT doc_id, greatest(length(replace(a, '_', '')), length(replace(b, '_', '')))::BIGINT AS n_sentences, list_sort(list_distinct(list_concat({found("a")}, {found("b")}))) AS l FROM i)
SELECT doc_id, n_sentences, coalesce(array_to_string(l, ','), '') AS licenses,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(l, lambda x: CASE {kinds} END))), ','), '') AS kinds
FROM l
"""
