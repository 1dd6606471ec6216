"""License scans by sentence rules.

A text is split into sentences; normalised sentences (lower case, runs of ASCII
letters and digits joined by single spaces) are mapped to the identifiers of
known licence sentences; the sequence of identifiers is matched against licence
rules in their order of precedence. A rule is an ordered sequence of identifiers;
between two of them at most ``GAP`` unknown sentences may stand. Longer sequences
come first, then the rule's place in the list, and a sentence serves one match.

Known sentences are a trie over words, which is walked over the words of the whole
text, the longest known sentence winning. So one is also known across line breaks
and end marks within it (hard-wrapped texts, commented headers, "v. 2.0") and
within a longer sentence ("This file is licensed under the MIT License"). Line
breaks and end marks cut a text into pieces; those that a known sentence covers
count as one sentence, pieces without a letter or digit (comment signs, rules)
are none.

SPDX tags give each licence of their expression, as it is spelled there or, for a
licence of the rules, as its rule spells it. Copyright lines are known by pattern.
Defined cases: null and empty texts have no sentences and no licence; rows are
scanned as they come, so repeated rows and null ids are kept; other columns are
ignored. Whole texts are scanned, in one map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light_batches

# Sentences of public licence texts and notices, and the rules that they make.
SENTENCES = {
    "apache-2.0.notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache-2.0.restrict": ["you may not use this file except in compliance with the license"],
    "apache-2.0.copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache-2.0.asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-2.0.see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit.notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.include": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit.liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd.redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl-3.notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl.hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.details": ["see the gnu general public license for more details"],
    "gpl.received": ["you should have received a copy of the gnu general public license along with this program"],
    "mpl-2.0.subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl-2.0.copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "lgpl.free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl.hope": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-2.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "agpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "bsl-1.0.grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "bsl-1.0.notice": ["distributed under the boost software license version 1 0"],
    "zlib.asis": ["this software is provided as is without any express or implied warranty"],
    "zlib.permission": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "epl-2.0.notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "wtfpl.notice": ["do what the fuck you want to public license"],
    "unlicense.public": ["this is free and unencumbered software released into the public domain"],
    "cc-by-4.0.notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4.0.notice": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4.0.notice": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0-1.0.notice": ["licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["all rights reserved"],
}
#: A copyright line, and the words before an SPDX expression.
COPYRIGHT, SPDX = ("copyright", r"copyright (?:c )?(?:\d{4} ?)+.*"), ("spdx", "license", "identifier")
#: (licence, identifiers in order); earlier rules win among equally long ones.
RULES = [
    ("Apache-2.0", ("apache-2.0.notice", "apache-2.0.restrict", "apache-2.0.copy", "apache-2.0.asis", "apache-2.0.see")),
    ("Apache-2.0", ("apache-2.0.notice", "apache-2.0.restrict", "apache-2.0.copy")),
    ("MIT", ("mit.grant", "mit.include", "mit.asis", "mit.liability")),
    ("MIT", ("mit.grant", "mit.include")),
    ("BSD-3-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary")),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope", "gpl.details", "gpl.received")),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("MPL-2.0", ("mpl-2.0.subject", "mpl-2.0.copy")),
    ("MPL-2.0", ("mpl-2.0.subject",)),
    ("ISC", ("isc.grant",)),
    ("Apache-2.0", ("apache-2.0.notice",)),
    ("MIT", ("mit.notice",)),
    ("GPL-3.0-only", ("gpl-3.notice",)),
    ("Unlicense", ("unlicense.public",)),
    ("CC-BY-4.0", ("cc-by-4.0.notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0.notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0.notice",)),
    ("CC0-1.0", ("cc0-1.0.notice",)),
    ("LicenseRef-all-rights-reserved", ("copyright", "reserved")),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
    ("LGPL-2.1-or-later", ("lgpl.free", "lgpl.hope")),
    ("LGPL-2.1-or-later", ("lgpl.free",)),
    ("GPL-2.0-or-later", ("gpl-2.free", "gpl.hope")),
    ("GPL-2.0-or-later", ("gpl-2.free",)),
    ("AGPL-3.0-or-later", ("agpl.free", "gpl.hope")),
    ("AGPL-3.0-or-later", ("agpl.free",)),
    ("Zlib", ("zlib.asis", "zlib.permission")),
    ("BSL-1.0", ("bsl-1.0.grant",)),
    ("BSL-1.0", ("bsl-1.0.notice",)),
    ("EPL-2.0", ("epl-2.0.notice",)),
    ("WTFPL", ("wtfpl.notice",)),
]
GAP = 2
# End of the fixed values.

_END = re.compile(r"[.!?;]+(?=[\s\"')\]]|$)|[\r\n]+")
_TOKEN = re.compile(r"[a-z0-9]+")
_KNOWN = {s: k for k, v in SENTENCES.items() for s in v}
_COPYRIGHT = re.compile(COPYRIGHT[1])
_EXPRESSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_SPELLED = {name.lower(): name for name, _ in RULES}
_ORDER = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][1]), i))


def _trie() -> dict:
    """Known sentences by their words; the key None holds the identifier of a whole one."""
    root: dict = {}
    for s, k in _KNOWN.items():
        at = root
        for w in s.split(" "):
            at = at.setdefault(w, {})
        at[None] = k
    return root


_TRIE = _trie()


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) in characters of what stands between line breaks and end marks."""
    at = 0
    for m in _END.finditer(text):
        if not text[at : m.start()].isspace() and m.start() > at:
            yield at, m.start()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def longest(words: list[str], i: int) -> tuple[int, str | None]:
    """(end, identifier) of the longest known sentence that begins with word ``i``."""
    at, found = _TRIE, (i, None)
    for j in range(i, len(words)):
        at = at.get(words[j])
        if at is None:
            break
        if None in at:
            found = j + 1, at[None]
    return found


def spdx(tag: str) -> list[str]:
    """The licences of the expression that follows the colon of a tag."""
    names = [x for x in _EXPRESSION.findall(tag.partition(":")[2]) if x.upper() not in ("AND", "OR", "WITH")]
    return [_SPELLED.get(x.lower(), x) for x in names]


def match(seq: list[tuple[int, str]]) -> list[tuple[str, str, list[int]]]:
    """(licence, rule, sentence numbers) of a sequence of (sentence number, identifier), by rule order."""
    used: set[int] = set()
    found = []
    by_id: dict[str, list[int]] = {}
    for i, (_, k) in enumerate(seq):
        by_id.setdefault(k, []).append(i)
    for r in _ORDER:
        name, want = RULES[r]
        for start in by_id.get(want[0], ()):
            if start in used:
                continue
            path, at = [start], start
            for k in want[1:]:
                at += 1
                if at >= len(seq) or seq[at][1] != k or at in used or seq[at][0] - seq[at - 1][0] > GAP + 1:
                    break
                path.append(at)
            if len(path) == len(want):
                used.update(path)
                found.append((name, f"r{r}", [seq[i][0] for i in path]))
    for i, (n, k) in enumerate(seq):
        if k.startswith("spdx:") and i not in used:
            found += [(x, "spdx", [n]) for x in k.removeprefix("spdx:").split()]
    return sorted(found, key=lambda x: x[2])


def scan_text(text: str | None) -> tuple[int, list[tuple[str, str, int, int]]]:
    """(number of sentences, [(licence, rule, start, end)])."""
    if not text:
        return 0, []
    parts = list(pieces(text))
    words: list[str] = []
    piece: list[int] = []
    blank = set()
    for k, (s, e) in enumerate(parts):
        own = _TOKEN.findall(text[s:e].lower())
        if not own and not any(map(str.isalnum, text[s:e])):
            blank.add(k)
        words += own
        piece += [k] * len(own)
    hits: list[tuple[int, int, str]] = []  # first and last piece, identifier
    i = 0
    while i < len(words):
        if words[i] in _TRIE:
            end, k = longest(words, i)
            if k:
                hits.append((piece[i], piece[end - 1], k))
                i = end
                continue
        if words[i] in ("spdx", "copyright") and (i == 0 or piece[i - 1] < piece[i]):
            s, e = parts[piece[i]]
            if words[i] == SPDX[0] and tuple(words[i : i + 3]) == SPDX:
                if names := spdx(text[s:e]):
                    hits.append((piece[i], piece[i], "spdx:" + " ".join(names)))
            elif _COPYRIGHT.fullmatch(" ".join(_TOKEN.findall(text[s:e].lower()))):
                hits.append((piece[i], piece[i], COPYRIGHT[0]))
        i += 1
    # the sentence that each piece belongs to: a known one takes all that it covers
    joined = {k for s, e, _ in hits for k in range(s + 1, e + 1)}
    place, n, number = [], 0, -1
    for k in range(len(parts)):
        number += k not in joined and k not in blank
        n += k not in joined
        place.append(max(0, number))
    seq, spans = [], {}
    for s, e, k in hits:
        seq.append((place[s], k))
        spans.setdefault(place[s], (parts[s][0], parts[e][1]))
        spans[place[s]] = spans[place[s]][0], max(spans[place[s]][1], parts[e][1])
    return n, [(name, rule, spans[at[0]][0], spans[at[-1]][1]) for name, rule, at in match(seq)]


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [scan_text(t) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n_sentences": [n for n, _ in got], "matches": [[{"license": a, "rule": r, "start": s, "end": e} for a, r, s, e in m] for _, m in got]})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, matches array<struct<license, rule, start, end>>), one row per row of ``docs``."""
    light_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(_run, f"id {src.schema['id'].dataType.simpleString()}, n_sentences long, matches array<struct<license:string,rule:string,start:long,end:long>>")
