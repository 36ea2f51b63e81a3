"""Licence scans by sentence-rule recognition.

A text is cut into sentences, each sentence is normalised (lower case, every run of other characters than a-z and 0-9
one space) and mapped to the identifier of a known licence sentence. The sequence of identifiers, in text order, is
then matched against ordered licence rules; a rule names the sentences that must follow one another, other known
sentences may stand between them.

Cuts fall at line ends and behind ``. ! ? ; :``, so wrapped texts and marks inside a sentence leave several pieces of it.
A known sentence is therefore one piece or several that follow one another (the longest such run, from left to right),
whatever marks, blank lines or comment leaders stand between them.

A licence may be named, too: ``NAMES`` holds the phrases, as a line of their own (a title) or behind words such as
"this project is licensed under the"; those of families with versions come from rules. A line "SPDX-License-Identifier:
..." is the sentence ``spdx`` and its expression is read by the grammar of SPDX expressions: identifiers joined by AND, OR
and WITH, up to the first word that breaks this order. Every identifier names a licence, exceptions behind WITH don't; known
ones get their usual spelling, others stay as written.

Names are those of SPDX. A text that says "or any later version" is or-later, one that names a version alone is only. The
GNU GPL 3's own title line and preamble give GPL-3.0, as they say neither.

The maps are small fixed values that stay in the plan, so each row is handled by itself in DataFrame functions: no
join, no shuffle, no Python worker. A text none of whose known sentences' anchor phrases occurs is not cut at all.

Edge cases: null and empty texts have no sentences and no licence; a sentence that occurs twice counts twice in the
sequence, a licence is named once; repeated rows and ids are scanned row by row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import let, table

#: Known licence sentences, normalised. Fixed values from the public licence texts.
SENTENCES = {
    "arr": ["all rights reserved"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache2_use": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl_redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl_warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd_as_is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "isc_grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "zlib_as_is": ["this software is provided as is without any express or implied warranty"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost_grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "gpl2_redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "lgpl_redistribute": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl21_redistribute": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"
    ],
    "agpl_redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl3_title": ["gnu general public license version 3 29 june 2007"],
    "gpl3_copy": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "mpl_subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "gpl2only_redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    ],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "cddl_subject": ["the contents of this file are subject to the terms of the common development and distribution license"],
    "ofl_font": ["this font software is licensed under the sil open font license version 1 1"],
    "gfdl_copy": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation"
    ],
    "python2": ["python software foundation license version 2"],
    "public_domain": ["this work is dedicated to the public domain"],
    "spdx": ["spdxlicenseidentifier"],
}

#: Phrases that name a licence, normalised. Fixed values; families with versions follow from VERSIONED, GNU and CC.
NAMES = {
    "MIT": ["mit license", "mit license mit", "mit x11 license", "expat license"],
    "MIT-0": ["mit no attribution", "mit no attribution license"],
    "Apache-2.0": ["apache 2 0 license", "apache 2 license", "apache license version 2 0 january 2004"],
    "BSD": ["bsd license", "bsd style license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause new or revised license"],
    "0BSD": ["bsd zero clause license", "zero clause bsd license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["boost software license version 1 0 august 17th 2003"],
    "WTFPL": ["do what the fuck you want to public license", "wtfpl"],
    "PostgreSQL": ["postgresql license"],
    "MS-PL": ["microsoft public license", "microsoft public license ms pl"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"],
}

#: A family's phrases and its versions; the licence is the key with the version behind it.
VERSIONED = {
    "Apache-": (["apache license", "apache software license"], ["1.1", "2.0"]),
    "MPL-": (["mozilla public license", "mozilla public license mpl"], ["1.1", "2.0"]),
    "EPL-": (["eclipse public license"], ["1.0", "2.0"]),
    "BSL-": (["boost software license"], ["1.0"]),
    "CDDL-": (["common development and distribution license", "common development and distribution license cddl"], ["1.0", "1.1"]),
    "Artistic-": (["artistic license"], ["1.0", "2.0"]),
    "OFL-": (["sil open font license"], ["1.0", "1.1"]),
    "AFL-": (["academic free license"], ["2.1", "3.0"]),
    "EUPL-": (["european union public licence", "eupl"], ["1.1", "1.2"]),
    "Python-": (["python software foundation license"], ["2.0"]),
}
GNU = {"GPL-": (["gnu general public license", "gnu gpl"], ["1", "2", "3"]), "LGPL-": (["gnu lesser general public license", "gnu lgpl"], ["2.1", "3"]), "AGPL-": (["gnu affero general public license", "gnu agpl"], ["3"])}
LATER = ["or later", "or any later version", "or at your option any later version"]
CC = {"BY": "attribution", "BY-NC": "attribution noncommercial", "BY-SA": "attribution sharealike", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]


def _words(x: str) -> str:
    return x.lower().replace("-", " ").replace(".", " ")


def _versions(phrases: list[str], version: str) -> list[str]:
    return [f"{x}{mark}{_words(version)}" for x in phrases for mark in (" ", " v", " v ", " version ")]


for _key, (_phrases, _all) in VERSIONED.items():
    for _v in _all:
        NAMES[_key + _v] = NAMES.get(_key + _v, []) + _versions(_phrases, _v)
for _key, (_phrases, _all) in GNU.items():
    for _v in _all:
        _full = _key + (_v if "." in _v else _v + ".0")
        _plain = _versions(_phrases, _v) + (_versions(_phrases, _v + ".0") if "." not in _v else [])
        NAMES[_full + "-only"] = _plain + [f"{x} only" for x in _plain]
        NAMES[_full + "-or-later"] = [f"{x} {later}" for x in _plain for later in LATER]
for _key, _phrase in CC.items():
    for _v in CC_VERSIONS:
        _long = f"creative commons {_phrase} {_words(_v)}"
        NAMES[f"CC-{_key}-{_v}"] = [f"cc {_words(_key)} {_words(_v)}", _long, f"{_long} license", f"{_long} international license", f"{_long} unported license", f"{_long} international", f"{_long} unported"]

#: What may stand before and behind such a phrase in one sentence; patterns over normalised words.
BEFORE = "(?:(?:this|the) (?:[a-z0-9]+ )?(?:[a-z0-9]+ )?is )?(?:made )?(?:licensed|released|distributed|provided|published|available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?|this program and the accompanying materials are made available under the terms of the |the "
BEHIND = " the license| which is available at| see (?:the )?(?:accompanying )?(?:file )?license(?: [a-z]+)?(?: file)?(?: for (?:more )?(?:details|information))?"

#: Usual spellings of SPDX identifiers: those of NAMES, deprecated names of the GNU licences, and some more.
SPDX = {x.lower(): x for x in [*NAMES, "EPL-2.0", "X11", "Python-2.0", "PSF-2.0", "OpenSSL", "curl", "NCSA", "GFDL-1.3-only", "GFDL-1.3-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "CC-PDDC", "BSD-4-Clause", "Ruby", "PHP-3.01", "Vim", "W3C", "SSPL-1.0", "BUSL-1.1"]}
SPDX |= {f"{k}{v}{end}".lower(): f"{k}{v}{name}" for k, vs in (("GPL-", ("1.0", "2.0", "3.0")), ("LGPL-", ("2.0", "2.1", "3.0")), ("AGPL-", ("3.0",))) for v in vs for end, name in (("", "-only"), ("+", "-or-later"))}

SPDX_MARK = r"(?i)SPDX-License-Identifier[ \t]*:"
SPDX_LINE = SPDX_MARK + r"[ \t]*([A-Za-z0-9.+()\t -]*)"
SPDX_TOKEN = r"([A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)"
SPDX_JOINS = ["AND", "OR", "WITH"]
SPDX_NONE = ["NONE", "NOASSERTION"]

#: Ordered rules: a licence, the sentence identifiers that must follow one another, and one that must not occur. Fixed values.
RULES = [
    ("MIT", ["mit_grant", "mit_notice"], None),
    ("MIT", ["mit_grant", "as_is"], None),
    ("ISC", ["isc_grant"], None),
    ("Zlib", ["zlib_as_is", "zlib_grant"], None),
    ("BSL-1.0", ["boost_grant"], None),
    ("Unlicense", ["unlicense"], None),
    ("GPL-2.0-only", ["gpl2only_redistribute"], None),
    ("GPL-2.0-or-later", ["gpl2_redistribute"], None),
    ("GPL-3.0-or-later", ["gpl_redistribute", "gpl_warranty"], None),
    ("GPL-3.0", ["gpl3_title"], None),
    ("GPL-3.0", ["gpl3_copy"], None),
    ("LGPL-3.0-or-later", ["lgpl_redistribute"], None),
    ("LGPL-2.1-or-later", ["lgpl21_redistribute"], None),
    ("AGPL-3.0-or-later", ["agpl_redistribute"], None),
    ("Apache-2.0", ["apache2_use", "apache2_copy"], None),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"], None),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"], "bsd_endorse"),
    ("BSD", ["bsd_grant", "bsd_source"], "bsd_binary"),
    ("BSD", ["bsd_binary", "bsd_as_is"], "bsd_grant"),
    ("BSD", ["bsd_endorse", "bsd_as_is"], "bsd_binary"),
    ("MPL-2.0", ["mpl_subject"], None),
    ("CDDL-1.0", ["cddl_subject"], None),
    ("OFL-1.1", ["ofl_font"], None),
    ("GFDL-1.3-or-later", ["gfdl_copy"], None),
    ("Python-2.0", ["python2"], None),
    ("WTFPL", ["wtfpl"], None),
    ("CC0-1.0", ["public_domain"], None),
    ("All-Rights-Reserved", ["arr"], None),
    *((x, [f"ref_{x}"], None) for x in NAMES),
]

#: Every known sentence holds one of these, in lower case and as it is written, before normalisation.
ANCHORS = ["licens", "licence", "software is provided", "rights", "permi", "conditions", "warranty", "redistribut", "obtain a copy", "domain", "cc by", "cc-by", "cc0", "wtfpl", "gnu ", "mit no attribution", "creative commons", "eupl"]

#: Comment leaders that are words; the others go with the normalisation.
LEADERS = r"\|(?:dnl|rem|c) "

ENDS = r"[.!?;:]+(\s+|$)|[\r\n]+"

#: Between the words of a sentence: a blank, or the bars between two pieces.
GAP = r"(?: |\|\|)"


def _longest(phrases: list[str]) -> str:
    return "|".join(sorted(set(phrases), key=lambda x: (-len(x), x)))


def _known() -> str:
    named = f"(?:{BEFORE})?(?:{_longest([x for xs in NAMES.values() for x in xs])})(?:{BEHIND})?"
    return rf"\|({named}|{_longest([x for xs in SENTENCES.values() for x in xs])})\|".replace(" ", GAP)


KNOWN = _known()
NAMED = f"^(?:{BEFORE})?({_longest([x for xs in NAMES.values() for x in xs])})(?:{BEHIND})?$"


def _rule_pattern(ids: list[str]) -> str:
    """The identifiers in this order, with any others between them, in a sequence joined and bounded by commas."""
    return "".join(f",{x}," if k == 0 else f"(.*,)?{x}," for k, x in enumerate(x.replace(".", "[.]") for x in ids))


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    marked = F.regexp_replace(text, SPDX_MARK, "\n" + SENTENCES["spdx"][0] + "\n")
    cut = F.split(F.regexp_replace(marked, ENDS, "\n"), "\n")
    pieces = F.array_join(F.filter(F.transform(cut, _normal), lambda s: s != ""), "||")
    joined = F.regexp_replace(F.concat(F.lit("|"), pieces, F.lit("|")), LEADERS, "|")
    known = F.transform(F.regexp_extract_all(joined, F.lit(KNOWN), F.lit(1)), lambda s: F.replace(s, F.lit("||"), F.lit(" ")))
    sentences = _lookup({s: k for k, v in SENTENCES.items() for s in v})
    names = _lookup({s: f"ref_{k}" for k, v in NAMES.items() for s in v})
    named = F.transform(known, lambda s: F.coalesce(F.try_element_at(sentences, s), F.try_element_at(names, F.regexp_extract(s, NAMED, 1))))
    lowered = F.lower(text)
    holds = F.lit(False)
    for a in ANCHORS:
        holds = holds | F.contains(lowered, F.lit(a))
    return F.when(holds, named).otherwise(F.array().cast("array<string>"))


def spdx_names(text: Column) -> Column:
    """The licences that the SPDX lines of a text name."""
    usual = _lookup(SPDX)

    def names(tokens: Column) -> Column:
        n = F.size(tokens)
        breaks = F.filter(F.sequence(F.lit(0), n + 1), lambda i: (i % 2 == 1) & ((i >= n) | ~F.upper(F.get(tokens, i)).isin(SPDX_JOINS)))
        stop = F.array_min(breaks)
        own = F.filter(
            tokens,
            lambda t, i: (i < stop) & (i % 2 == 0) & ((i == 0) | (F.upper(F.get(tokens, i - 1)) != "WITH")) & ~F.upper(t).isin([*SPDX_JOINS, *SPDX_NONE]),
        )
        return F.transform(own, lambda t: F.coalesce(F.try_element_at(usual, F.lower(t)), t))

    lines = F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1))
    return F.flatten(F.transform(lines, lambda x: names(F.regexp_extract_all(x, F.lit(SPDX_TOKEN), F.lit(1)))))


def licenses_of(ids: Column, text: Column) -> Column:
    """The distinct licences whose rules match or that SPDX lines name, sorted."""
    sequence = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))

    def matches(rule: list[str], without: str | None) -> Column:
        found = F.array_contains(ids, rule[0]) if len(rule) == 1 else sequence.rlike(_rule_pattern(rule))
        return found & ~F.array_contains(ids, without) if without else found

    named = F.array(*[F.when(matches(r, w), F.lit(name)) for name, r, w in RULES if len(r) > 1 or not r[0].startswith("ref_")])
    refs = F.transform(F.filter(ids, lambda x: x.startswith("ref_")), lambda x: F.substring(x, 5, 100))
    lines = F.when(F.array_contains(ids, "spdx"), spdx_names(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.concat(F.array_compact(named), refs, lines)))
    )


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses: arrays, one row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = let(sentence_ids(text), lambda x: F.struct(x.alias("sentence_ids"), licenses_of(x, text).alias("licenses")))
    return documents.select("doc_id", found.alias("_f")).select("doc_id", "_f.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, v in SENTENCES.items() for s in v)
    names = ", ".join(f"('{s}', 'ref_{k}')" for k, v in NAMES.items() for s in v)
    rules = ", ".join(f"('{name}', '{_rule_pattern(r)}', {f"',{w},'" if w else 'NULL'})" for name, r, w in RULES)
    usual = ", ".join(f"('{k}', '{v}')" for k, v in SPDX.items())
    joins, none = (str(tuple(x)) for x in (SPDX_JOINS, SPDX_JOINS + SPDX_NONE))
    return rf"""
WITH known(s, id) AS (VALUES {known}), names(s, id) AS (VALUES {names}), rules(name, pattern, without) AS (VALUES {rules}), usual(k, v) AS (VALUES {usual}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT rid, string_split(regexp_replace(regexp_replace(text, '{SPDX_MARK}', chr(10) || '{SENTENCES["spdx"][0]}' || chr(10), 'g'), '{ENDS}', chr(10), 'g'), chr(10)) AS parts FROM d),
n AS (SELECT rid, list_filter(list_transform(parts, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM c),
j AS (SELECT rid, regexp_replace('|' || array_to_string(parts, '||') || '|', '{LEADERS}', '|', 'g') AS joined FROM n),
m AS (SELECT rid, list_transform(regexp_extract_all(joined, '{KNOWN}', 1), lambda x: replace(x, '||', ' ')) AS found FROM j),
u AS (SELECT rid, unnest(range(1, len(found) + 1)) AS i, found FROM m),
k AS (SELECT rid, i, coalesce(known.id, names.id) AS id FROM u LEFT JOIN known ON known.s = found[i] LEFT JOIN names ON names.s = regexp_extract(found[i], '{NAMED}', 1)),
f AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, ',' || string_agg(id, ',,' ORDER BY i) || ',' AS seq FROM k GROUP BY rid),
x AS (SELECT rid, regexp_extract_all(unnest(regexp_extract_all(text, '{SPDX_LINE}', 1)), '{SPDX_TOKEN}', 1) AS t FROM d),
y AS (SELECT rid, t, list_min(list_filter(range(0, len(t) + 2), lambda i: i % 2 = 1 AND (i >= len(t) OR upper(t[i + 1]) NOT IN {joins}))) AS stop FROM x),
z AS (SELECT rid, t, stop, unnest(range(0, len(t))) AS i FROM y),
l AS (SELECT rid, name FROM f JOIN rules ON regexp_matches(f.seq, rules.pattern) AND (without IS NULL OR NOT contains(f.seq, without))
      UNION SELECT rid, coalesce(v, t[i + 1]) FROM z LEFT JOIN usual ON k = lower(t[i + 1])
      WHERE i < stop AND i % 2 = 0 AND (i = 0 OR upper(t[i]) <> 'WITH') AND upper(t[i + 1]) NOT IN {none}),
a AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM l GROUP BY rid)
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_sentences, coalesce(f.ids, '') AS sentence_ids, coalesce(a.names, '') AS licenses
FROM d LEFT JOIN f ON f.rid = d.rid LEFT JOIN a ON a.rid = d.rid
"""


OP10_SQL = _sql()
