"""Licences of documents by sentence rules.

Markup is dropped (block tags end paragraphs), so are comment signs at the start
of lines; list items begin paragraphs, and single line breaks are blanks, so
wrapped headers and whole licence texts read as running text.  It is cut into sentences (at blank lines and behind
. ! ? ; before white space); since short notices also stand on a line of their
own without a full stop, the lines are cut a second time, each for itself.  A
sentence is normalised (lower case, everything but a-z and 0-9 one space) and
mapped to its identifier, or to none.  Each row of identifiers is matched against
ordered rules, the longest first, from the left, without overlap; between two
sentences of a rule at most three unknown ones may stand.  Notices within a
longer sentence ("licensed under the MIT License, see LICENSE") are sentences of
their own, wherever lines end, and so is each operand of an SPDX expression;
exceptions behind WITH are not licences.  A document's licences are those of all.  The catalogue is a small literal in the plan, so the
whole scan is one projection without a shuffle.

Edge cases: null or empty text has no sentences, and neither has text without
letters a-z; a document may match a rule several times and names it once;
repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Well-known licence sentences, by identifier, and the rules made of them.
SENTENCES = {
    "mit-title": "The MIT License",
    "mit-title-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "later-2": "either version 2 of the License, or (at your option) any later version",
    "later-2.1": "either version 2.1 of the License, or (at your option) any later version",
    "later-3": "either version 3 of the License, or (at your option) any later version",
    "only-2": "version 2 of the License",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "apache-file": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-conditions": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-means": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document",
    "apache-copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "gpl-away": "The licenses for most software are designed to take away your freedom to share and change it",
    "gpl2-contrast": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "lgpl2.1-contrast": "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "gpl3-away": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "lgpl3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "agpl3-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
}
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-title-2", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-mit")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-2",)),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-implied")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("GPL-2.0-or-later", ("gpl-terms", "later-2")),
    ("GPL-2.0-only", ("gpl-terms", "only-2")),
    ("GPL-3.0-or-later", ("gpl-terms", "later-3")),
    ("LGPL-2.0-or-later", ("lgpl-terms", "later-2")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "later-2.1")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "later-3")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy-2")),
    ("EPL-2.0", ("epl2-terms",)),
    ("Unlicense", ("unlicense-free",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("Apache-2.0", ("apache-file",)),
    ("Apache-2.0", ("apache-file", "apache-conditions", "apache-means")),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("Apache-2.0", ("apache-means",)),
    ("Apache-2.0", ("apache-copyright",)),
    ("GPL-2.0", ("gpl-away", "gpl2-contrast")),
    ("LGPL-2.1", ("gpl-away", "lgpl2.1-contrast")),
    ("GPL-3.0", ("gpl3-copyleft",)),
    ("GPL-3.0", ("gpl3-copyleft", "gpl3-away")),
    ("LGPL-3.0", ("lgpl3-incorporates",)),
    ("AGPL-3.0", ("agpl3-copyleft",)),
    ("AGPL-3.0", ("agpl3-copyleft", "gpl3-away")),
]
# Names that notices give, and what they say of them; and identifiers of tags.
NAMED = {
    "the MIT License": "MIT",
    "the ISC License": "ISC",
    "the Apache License, Version 2.0": "Apache-2.0",
    "the Apache License 2.0": "Apache-2.0",
    "the GNU General Public License, version 2": "GPL-2.0",
    "the GNU General Public License, version 3": "GPL-3.0",
    "the GNU GPL v2": "GPL-2.0",
    "the GNU GPL v3": "GPL-3.0",
    "the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "the GNU Affero General Public License, version 3": "AGPL-3.0",
    "the BSD 2-Clause License": "BSD-2-Clause",
    "the BSD 3-Clause License": "BSD-3-Clause",
    "the Mozilla Public License 2.0": "MPL-2.0",
    "the Boost Software License, Version 1.0": "BSL-1.0",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
}
SAID = ("Released under", "Licensed under", "Distributed under", "This work is licensed under", "This project is licensed under")
TAGS = (
    "MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0",
    "Unlicense", "Zlib", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
)
# Older identifiers of tags, and what they are now.
OLDER = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later",
}
# With the article and without.
CALLED = {n: license for name, license in NAMED.items() for n in (name, name.removeprefix("the "))}
for _name, _license in CALLED.items():
    for _n, _said in enumerate(SAID):
        SENTENCES[f"{_license}: {_name}, {_n}"] = f"{_said} {_name}"
        RULES.append((_license, (f"{_license}: {_name}, {_n}",)))
for _license in TAGS:
    SENTENCES[f"tag {_license}"] = f"SPDX-License-Identifier: {_license}"
    RULES.append((_license, (f"tag {_license}",)))

#: At line starts: comment signs, and marks of list items.
COMMENT = r"(^|\n)[ \t]*(?://+|#+|/?\*+/?|;+|--+|%+)[ \t]?"
ITEM = r"(^|\n)[ \t]*(?:[0-9]+[.)]|\([a-z0-9]\)|-)[ \t]+"
#: Markup, after which lower-case text is left: tags between blocks, other tags, and names of characters.
BLOCK_TAG = r"</?(?:p|br|div|li|ul|ol|h[1-6]|pre|td|tr|table|blockquote|section)(?:[ \t\r\n][^<>]*)?/?>"
TAG = r"</?[a-z][a-z0-9]*(?:[ \t\r\n][^<>]*)?/?>"
ENTITY = r"&(?:quot|apos|nbsp|amp|lt|gt|#[0-9]+);"
#: The expression of an SPDX tag, and what stands between its operands.
EXPRESSION = r"spdx-license-identifier:([^\n]*)"
BETWEEN = r"[^a-z0-9.+-]+"
PARAGRAPH = r"\n[ \t\r\f]*\n"
SENTENCE_END = r"[.!?;]+[ \t\r\n\f]+"
GAP = 3


def normal(sentence: str) -> str:
    """A catalogue sentence as the scan has it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def notice_pattern() -> str:
    """A notice anywhere, its words however far apart."""
    gap = "[^a-z0-9]+"
    heads = sorted({normal(said).split()[-2] for said in SAID})
    names = sorted({normal(name) for name in CALLED}, key=lambda name: (-len(name), name))
    return f"(?:{'|'.join(heads)}){gap}under{gap}(?:{'|'.join(name.replace(' ', gap) for name in names)})(?:[^a-z0-9]|$)"


def operands() -> dict[str, str]:
    """Identifiers of tags in lower case, and the licences that they mean."""
    return {name.lower(): license for name, license in (*((t, t) for t in TAGS), *OLDER.items())}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def cover(normals: list[str]) -> list[str]:
    """A few words such that every sentence has one of them."""
    left, chosen = [set(s.split()) for s in normals], []
    while left:
        words = {w for s in left for w in s}
        best = max(sorted(words), key=lambda w: (sum(w in s for s in left) * (len(w) > 5), len(w)))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def any_of(value: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(value, F.lit(w)) for w in words), F.lit(False))


def with_letters(cut: Column) -> Column:
    return F.filter(cut, lambda s: F.rlike(s, F.lit("[a-z]")))


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def rule_pattern(numbers: list[str]) -> str:
    """A rule's sentences, |n| each, with at most GAP unknown ones, |-|, between two."""
    return rf"(?:\|-\|){{0,{GAP}}}".join(rf"\|{n}\|" for n in numbers)


def license_scan(
    docs: DataFrame, catalogue: dict[str, str] = SENTENCES, rules: list | tuple = tuple(RULES), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses): running sentences, the known ones in order, and the licences found, sorted."""
    number = {name: str(i) for i, name in enumerate(catalogue)}
    known = literal_map({normal(s): f"|{number[name]}|" for name, s in catalogue.items()})
    form = {"".join(f"|{number[x]}|" for x in ids): license for license, ids in rules}
    ordered = sorted(([number[x] for x in ids] for _, ids in rules), key=lambda ids: (-len(ids), ids))
    pattern = "(" + "|".join(rule_pattern(ids) for ids in ordered) + ")"
    clean = F.lower(F.coalesce(text, F.lit("")))
    for form_of_mark, instead in ((BLOCK_TAG, "\n\n"), (TAG, ""), (ENTITY, " "), (COMMENT, "$1")):
        clean = F.regexp_replace(clean, form_of_mark, instead)
    cut = docs.select(F.col(doc_id), F.regexp_replace(clean, ITEM, "\n\n").alias("__text"))
    running = F.split(F.col("__text"), f"{SENTENCE_END}|{PARAGRAPH}")
    # Notices and tags are searched only where a word of them stands.
    notices = F.when(F.contains("__text", F.lit("under")), F.regexp_extract_all("__text", F.lit(notice_pattern()), 0))
    tags = F.when(F.contains("__text", F.lit("spdx-")), F.regexp_extract_all("__text", F.lit(EXPRESSION), 1))
    cut = cut.select(doc_id, notices.alias("__notices"), tags.alias("__tags"), with_letters(running).alias("__sentences"), with_letters(F.split("__text", rf"{SENTENCE_END}|\n+")).alias("__lines"))
    # Only sentences with a word of the catalogue's cover are normalised and looked up.
    words = cover([normal(s) for s in catalogue.values()])
    name = lambda s: F.when(any_of(s, words), F.coalesce(F.try_element_at(known, normalised(s)), F.lit("|-|"))).otherwise("|-|")
    rows = [F.array_join(F.transform(c, name), "") for c in ("__sentences", "__lines")]
    found = cut.select(doc_id, "__notices", "__tags", F.size("__sentences").cast("long").alias("n_sentences"), rows[0].alias("__running"), rows[1].alias("__single"))
    met = []
    for row in ("__running", "__single"):
        # Rows without a known sentence are not searched.
        hits = F.when(F.rlike(row, F.lit("[0-9]")), F.regexp_extract_all(F.col(row), F.lit(pattern), 1)).otherwise(F.array().cast("array<string>"))
        met.append(F.transform(hits, lambda x: F.element_at(literal_map(form), F.replace(x, F.lit("|-|"), F.lit("")))))
    none = F.array().cast("array<string>")
    met.append(F.transform(F.coalesce("__notices", none), lambda x: F.element_at(literal_map(form), F.element_at(known, normalised(x)))))
    parts = F.flatten(F.transform(F.coalesce("__tags", none), lambda x: F.split(x, BETWEEN)))
    meant = F.transform(parts, lambda x: F.try_element_at(literal_map(operands()), F.regexp_replace(x, "[.-]+$", "")))
    met.append(F.filter(meant, lambda x: x.isNotNull()))
    names = literal_map({n: name for name, n in number.items()})
    ids = F.transform(F.regexp_extract_all("__running", F.lit("([0-9]+)"), 1), lambda n: F.element_at(names, n))
    return found.select(doc_id, "n_sentences", ids.alias("sentence_ids"), F.array_sort(F.array_distinct(F.concat(*met))).alias("licenses"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_sentences",
        F.size("sentence_ids").cast("long").alias("n_license_sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    """The scan over joined rows: the catalogue and the rules are tables, their texts are those above."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(f"({quote(normal(s))}, {quote(name)})" for name, s in SENTENCES.items())
    number = {name: str(i) for i, name in enumerate(SENTENCES)}
    ordered = sorted(([number[x] for x in ids] for _, ids in RULES), key=lambda ids: (-len(ids), ids))
    pattern = "|".join(rule_pattern(ids) for ids in ordered)
    by_number = ", ".join(f"({quote(''.join(f'|{number[x]}|' for x in ids))}, {quote(license)})" for license, ids in RULES)
    numbered = ", ".join(f"({quote(name)}, {quote(n)})" for name, n in number.items())
    means = ", ".join(f"({quote(name)}, {quote(license)})" for name, license in operands().items())
    return f"""
WITH k(s, name) AS (VALUES {names}), m(name, n) AS (VALUES {numbered}), r(ids, license) AS (VALUES {by_number}), o(name, license) AS (VALUES {means}),
g AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{BLOCK_TAG}', chr(10) || chr(10), 'g'), '{TAG}', '', 'g'), '{ENTITY}', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{COMMENT}', '\\1', 'g'), '{ITEM}', chr(10) || chr(10), 'g') AS t FROM g),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{notice_pattern()}')) AS s FROM c),
x AS (SELECT doc_id, unnest(string_split_regex(e, '{BETWEEN}')) AS name FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{EXPRESSION}', 1)) AS e FROM c)),
u AS (SELECT doc_id, list_filter(string_split_regex(t, '{SENTENCE_END}|{PARAGRAPH}'), lambda x: regexp_matches(x, '[a-z]')) AS ss,
  list_filter(string_split_regex(t, '{SENTENCE_END}|\\n+'), lambda x: regexp_matches(x, '[a-z]')) AS ls FROM c),
e AS (SELECT doc_id, 1 AS kind, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM u UNION ALL SELECT doc_id, 2, unnest(ls), generate_subscripts(ls, 1) FROM u),
f AS (SELECT doc_id, kind, count(n) AS n, string_agg('|' || coalesce(n, '-') || '|', '' ORDER BY i) AS row
  FROM e LEFT JOIN k ON k.s = trim(regexp_replace(e.s, '[^a-z0-9]+', ' ', 'g')) LEFT JOIN m USING (name) GROUP BY doc_id, kind),
h AS (SELECT doc_id, unnest(regexp_extract_all(row, '{pattern}')) AS hit FROM f WHERE n > 0),
a AS (SELECT doc_id, license FROM h JOIN r ON r.ids = replace(hit, '|-|', '')
  UNION ALL SELECT doc_id, license FROM w JOIN k ON k.s = trim(regexp_replace(w.s, '[^a-z0-9]+', ' ', 'g')) JOIN m USING (name) JOIN r ON r.ids = '|' || n || '|'
  UNION ALL SELECT doc_id, license FROM x JOIN o ON o.name = regexp_replace(x.name, '[.-]+$', '')),
l AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM a GROUP BY doc_id)
SELECT u.doc_id, len(ss)::BIGINT AS n_sentences, coalesce(f.n, 0)::BIGINT AS n_license_sentences, coalesce(licenses, '') AS licenses
FROM u LEFT JOIN f ON u.doc_id = f.doc_id AND f.kind = 1 LEFT JOIN l ON u.doc_id = l.doc_id"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": _sql()}
