"""License scans by sentences and rules.

A text is cut into fragments at line ends and after sentence marks that white space follows. A sentence is a fragment,
or a run of fragments that only line ends, colons or semicolons separate (licences are often wrapped), so a known
sentence is found where it begins a fragment, and not in the middle of one. A sentence is normalised to lower-case words
of letters and digits and mapped to the identifier of a known licence sentence; in some, a holder's or a project's name
of up to ``NAME_WORDS`` words may stand in one place. The identifiers found, in order, are matched against rules, in
their order: a rule names a licence by a sequence of identifiers that stand next to each other; identifiers that a rule
has used are not used again. Identifiers that no rule used are reported as unmatched.

Null texts and texts without known sentences have no licences. Whole texts are read; a text in which none of
``TRIGGERS`` occurs (each known sentence holds one) is not cut up. Input columns stay; one that has the name of a
result is replaced. Repeated rows are scanned each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

NAME_WORDS = 8

# Licences, with the names by which sentences call them (normalised).
NAMES = {
    "MIT": ("mit license", "mit licence", "mit license mit", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license version 2 0 the license", "apache 2 0 license"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0 license", "creative commons zero v1 0 universal license"),
    "CC-BY-4.0": ("cc by 4 0", "cc by 4 0 license", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"),
}
# What says of a work that it has a licence; * is a name.
WORKS = ("", "this work is ", "this project is ", "this software is ", "this program is ", "this library is ", "this code is ", "this file is ", "* is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "made available under ", "available under ")
TAILS = ("", " see *")

# Sentences of licences and notices, normalised, and their identifiers; * is a name.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-received",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-received",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "to the extent possible under law * has waived all copyright and related or neighboring rights to this work": "cc0-waived",
}
# Rules in the order in which they are tried.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("Apache-2.0", "apache-comply", "apache-2-copy", "apache-as-is", "apache-see")),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-hope", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-hope", "gpl-received")),
    ("LGPL-2.1-or-later", ("lgpl-21-later", "gpl-hope", "lgpl-received")),
    ("LGPL-3.0-or-later", ("lgpl-3-later", "gpl-hope", "lgpl-received")),
    ("AGPL-3.0-or-later", ("agpl-3-later", "gpl-hope", "agpl-received")),
    ("MPL-2.0", ("mpl-2-header", "mpl-2-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("LGPL-2.1-or-later", ("lgpl-21-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3-later",)),
    ("AGPL-3.0-or-later", ("agpl-3-later",)),
    ("MPL-2.0", ("mpl-2-header",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-2-copy",)),
    *((name, (name,)) for name in NAMES),
)
TRIGGERS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "liab", "mozilla", "anyone", "cc0", "cc by", "cc-by")


@cache
def sentences() -> dict[str, str]:
    """Known sentences and their identifiers: TEXTS; and, for each licence of NAMES (its own identifier), its name, what is
    said of works, and its tag in source files."""
    out = dict(TEXTS)
    for licence, names in NAMES.items():
        for name in names:
            for work, verb, the, tail in product(WORKS, VERBS, ("the ", "a ", "the terms of the ", ""), TAILS):
                out.setdefault(f"{work}{verb}{the}{name}{tail}", licence)
            out[name] = out[f"the {name}"] = licence
        tag = " ".join(_WORD.findall(licence.lower()))
        out[f"spdx license identifier {tag}"] = licence
    return out


_FRAGMENT = re.compile(r"(.*?)(\n|[.!?:;](?=\s|$)|$)", re.S)
_WORD = re.compile(r"[a-z0-9]+")


@cache
def _lookup() -> tuple[dict[str, str], dict[str, list[tuple[list[str], list[str], str]]], dict[str, list[tuple[list[str], list[str], str]]], frozenset[str], int]:
    """Sentences without a name in them; those with one, as the words before and after it, by first word, or by last word
    where the name begins them; the words that sentences begin with; the length of the longest."""
    plain = {s: i for s, i in sentences().items() if "*" not in s.split()}
    framed: dict[str, list] = {}
    ended: dict[str, list] = {}
    longest = 0
    for s, i in sentences().items():
        words = s.split()
        longest = max(longest, len(words) + NAME_WORDS)
        if "*" in words:
            at = words.index("*")
            if words.count("*") > 1:  # a name at both ends: no sentence of its own
                continue
            (framed.setdefault(words[0], []) if at else ended.setdefault(words[-1], [])).append((words[:at], words[at + 1 :], i))
    return plain, framed, ended, frozenset(s.split(" ", 1)[0] for s in plain) | framed.keys(), longest


def _framed(words: list[str], frames: list[tuple[list[str], list[str], str]]) -> str | None:
    for before, after, name in frames:
        rest = len(words) - len(before) - len(after)
        if 1 <= rest <= NAME_WORDS and words[: len(before)] == before and words[len(words) - len(after) :] == after:
            return name
    return None


def known_sentences(text: str) -> list[str]:
    """Identifiers of the known sentences of a text, in order; the longest sentence from a fragment on counts. A sentence
    that begins with a name is one fragment."""
    lower = text.lower()
    if not any(t in lower for t in TRIGGERS):
        return []
    plain, framed, ended, begins, longest = _lookup()
    parts = [(_WORD.findall(m[1]), m[2]) for m in _FRAGMENT.finditer(lower)]
    out, at = [], 0
    while at < len(parts):
        step, found, first = 1, None, parts[at][0]
        if first and first[-1] in ended:
            found = _framed(first, ended[first[-1]])
        if first and first[0] in begins:
            words: list[str] = []
            for k in range(at, len(parts)):
                words = words + parts[k][0]
                if len(words) > longest:
                    break
                if name := plain.get(" ".join(words)) or _framed(words, framed.get(words[0], [])):
                    found, step = name, k + 1 - at
                if parts[k][1] not in ("\n", ":", ";"):
                    break
        if found:
            out.append(found)
        at += step
    return out


def licences_of(names: list[str]) -> tuple[list[str], list[str]]:
    """Licences in order of the text, and the identifiers that no rule used."""
    free, found = [*names], []
    for licence, rule in RULES:
        at = 0
        while at + len(rule) <= len(free):
            if tuple(free[at : at + len(rule)]) == rule:
                found.append((at, licence))
                free[at : at + len(rule)] = [None] * len(rule)
            at += 1
    return [licence for _, licence in sorted(found)], [n for n in free if n is not None]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with licenses (distinct, in order), n_sentences (known ones) and unmatched (identifiers)."""
    strings = T.ArrayType(T.StringType())
    added = {"licenses": strings, "n_sentences": T.LongType(), "unmatched": strings}
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [known_sentences(x.as_py() or "") for x in batch.column(text)]
            found = [licences_of(n) for n in names]
            columns = [pa.array([list(dict.fromkeys(f)) for f, _ in found], pa.list_(pa.string())), pa.array([len(n) for n in names], pa.int64()), pa.array([u for _, u in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], schema.names)

    return df.mapInArrow(run, schema)
