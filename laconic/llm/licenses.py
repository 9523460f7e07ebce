"""Licence scans by sentence rules.

Texts are cut into sentences; a normalised sentence that is known becomes
its identifier, and a document becomes a sequence of identifiers.  Ordered
rules then name licences: a rule lists identifiers that must follow each
other with at most `GAP` unknown sentences between them; where rules
overlap, the earlier rule wins, at each place from left to right.

A sentence may be wrapped over lines, so consecutive fragments are joined as
long as they begin a known sentence.  The pass is
narrow and without state; texts without any of a few necessary words skip
the sentence work, which changes no result: the words are taken from the
book in use, each known sentence holds one, and a single word can't be
wrapped.

Defined results: a null or empty text has no sentence and no licence;
repeated rows are scanned on their own; columns of the input with the names
of the added ones are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 3

# Licence sentences in public use, by identifier.
SENTENCES = {
    "mit-named": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License", "The MIT License (MIT)", "This software is released under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-named": ["ISC License", "Licensed under the ISC License", "Released under the ISC License"],
    "apache-named": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "Apache License, Version 2.0"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-named": ["Licensed under the BSD License", "Released under the BSD License", "Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "BSD 3-Clause License"],
    "bsd2-named": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "BSD 2-Clause License"],
    "gpl-any": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-any": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl3-named": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "GNU General Public License, version 3"],
    "gpl2-named": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2", "GNU General Public License, version 2"],
    "lgpl-named": ["Licensed under the GNU Lesser General Public License, version 3", "This library is licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "agpl-named": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-see": ["See the GNU General Public License for more details"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "public-domain": ["Released into the public domain", "This work is in the public domain", "This work is dedicated to the public domain"],
    "cc0": ["Licensed under CC0 1.0", "Licensed under CC0", "This work is licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0"],
    "proprietary": ["All rights reserved", "All rights reserved under copyright", "This software is proprietary and may not be copied without permission"],
}
# Names of the SPDX list that a tag line may give.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"]
#: Ordered rules: full texts before headers before bare names.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    # the header of BSD texts reserves rights too
    ("BSD-3-Clause", ("proprietary", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("proprietary", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-named", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-named", "apache-use")),
    ("GPL-3.0-or-later", ("gpl-any", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-any",)),
    ("GPL-2.0-or-later", ("gpl2-any",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-named",)),
    ("Apache-2.0", ("apache-named",)),
    ("GPL-3.0-only", ("gpl3-named",)),
    ("GPL-2.0-only", ("gpl2-named",)),
    ("LGPL-3.0-only", ("lgpl-named",)),
    ("AGPL-3.0-only", ("agpl-named",)),
    ("BSD-3-Clause", ("bsd-named",)),
    ("BSD-2-Clause", ("bsd2-named",)),
    ("ISC", ("isc-named",)),
    ("MPL-2.0", ("mpl",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("LicenseRef-public-domain", ("public-domain",)),
    ("LicenseRef-proprietary", ("proprietary",)),
    *((name, (f"spdx:{name}",)) for name in SPDX),
]
_CUT = re.compile(r"(?<=[.;:!?])\s+|\n")
_TOKEN = re.compile(r"[a-z0-9]+")


def normal(sentence: str) -> str:
    """Lower case, letters and digits only, single blanks: comment marks, quotes and punctuation go."""
    return " ".join(_TOKEN.findall(sentence.lower()))


def necessary(known) -> str:
    """A pattern of single words that lower-cased texts with one of these normal sentences match; long words and those of many sentences first."""
    left, chosen = [s.split() for s in known if s], []
    while left:
        words = {w for s in left for w in s if len(w) >= min(6, max(map(len, s)))}
        word = max(words, key=lambda w: (sum(any(w in x for x in s) for s in left), len(w), w))
        chosen.append(word)
        left = [s for s in left if not any(word in x for x in s)]
    return "|".join(chosen) or "(?!)"


class Book:
    """Known sentences by their normal form, and all beginnings of them at word ends."""

    def __init__(self, sentences: dict[str, list[str]] | None = None, spdx: list[str] | None = None, rules=None):
        self.known = {normal(s): i for i, group in (SENTENCES if sentences is None else sentences).items() for s in group}
        self.known |= {normal(f"SPDX-License-Identifier: {x}"): f"spdx:{x}" for x in (SPDX if spdx is None else spdx)}
        self.begun = {" ".join(w[:k]) for w in map(str.split, self.known) for k in range(1, len(w))}
        self.rules = RULES if rules is None else rules
        self.necessary = necessary(self.known)

    def sentences(self, text: str) -> list[str | None]:
        """The text as a sequence of sentence identifiers; None for each unknown fragment that is not empty."""
        parts = [n for n in map(normal, _CUT.split(text)) if n]
        out, i = [], 0
        while i < len(parts):
            whole, best, j = parts[i], None, i
            while True:
                if whole in self.known:
                    best = self.known[whole], j + 1
                j += 1
                if whole not in self.begun or j >= len(parts):
                    break
                whole = f"{whole} {parts[j]}"
            out.append(best[0] if best else None)
            i = best[1] if best else i + 1
        return out

    def licenses(self, found: list[str | None]) -> list[tuple[str, int, int]]:
        """(licence, first sentence, end) for each match of a rule, from left to right, earlier rules first."""
        out, i = [], 0
        while i < len(found):
            for name, rule in self.rules if found[i] is not None else ():
                at = i
                for k, wanted in enumerate(rule):
                    if k:
                        at = next((p for p in range(at + 1, min(len(found), at + GAP + 2)) if found[p] == wanted and all(x is None for x in found[at + 1 : p])), -1)
                    elif found[at] != wanted:
                        at = -1
                    if at < 0:
                        break
                if at >= 0:
                    out.append((name, i, at + 1))
                    i = at
                    break
            i += 1
        return out


#: The words of the built-in book.
NECESSARY = Book().necessary


def scan(docs: DataFrame, text: str = "text", book: Book | None = None) -> DataFrame:
    """docs with n_known (known sentences), sentence_ids and licenses (both in order of the text, comma-joined), n_licenses."""
    book = book or Book()
    added = {"n_known": "long", "sentence_ids": "string", "licenses": "string", "n_licenses": "long"}
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns
    marked = docs.withColumn("_worth", F.coalesce(F.lower(text).rlike(book.necessary), F.lit(False)))

    def run(batches):
        for batch in batches:
            rows = []
            for t, worth in zip(batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                found = book.sentences(t) if worth else []
                ids, named = [x for x in found if x], [x for x, _, _ in book.licenses(found)]
                rows.append((len(ids), ",".join(ids), ",".join(named), len(named)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, {"long": pa.int64(), "string": pa.string()}[k]) for c, k in zip(columns, added.values(), strict=True))], names=[*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{k} {v}" for k, v in added.items())])
    return marked.mapInArrow(run, schema)
