"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is brought to a normal form, and known licence sentences get an identifier. The
identifiers of a text in their order are matched against ordered rules: the first rule that fits takes its
identifiers, and later rules see what is left.

Sentences end at ``. ! ? ;`` before white space, at a colon that ends a line and at blank lines, so a sentence may be wrapped over lines (marks
of comments fall away in the normal form); one that is unknown as a whole is tried line by line. The texts that
hold none of ``KEYWORDS`` have no known sentence (each of those has one, in one word) and are not cut at all.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER, documents_of, lower_ascii

# The words of public licences and of the usual references to them.
NAMES = {
    "MIT": ["the mit license", "mit license", "the mit licence", "mit"],
    "Apache-2.0": ["the apache license, version 2.0", "the apache license version 2.0", "apache license 2.0", "the apache 2.0 license", "apache-2.0"],
    "GPL-3.0": ["the gnu general public license, version 3", "the gnu general public license version 3", "the gnu gpl, version 3", "gplv3", "gpl-3.0"],
    "GPL-2.0": ["the gnu general public license, version 2", "the gnu general public license version 2", "gplv2", "gpl-2.0"],
    "LGPL-3.0": ["the gnu lesser general public license, version 3", "lgplv3", "lgpl-3.0"],
    "AGPL-3.0": ["the gnu affero general public license, version 3", "agplv3", "agpl-3.0"],
    "MPL-2.0": ["the mozilla public license, version 2.0", "the mozilla public license 2.0", "mpl-2.0"],
    "BSD-3-Clause": ["the bsd 3-clause license", "the 3-clause bsd license", "bsd-3-clause"],
    "BSD-2-Clause": ["the bsd 2-clause license", "the 2-clause bsd license", "bsd-2-clause"],
    "ISC": ["the isc license", "isc"],
    "CC-BY-4.0": ["cc by 4.0", "the creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "the creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "the creative commons attribution-noncommercial 4.0 international license"],
    "CC0-1.0": ["cc0 1.0", "the cc0 1.0 universal public domain dedication"],
}
LEADS = [
    "licensed under", "released under", "distributed under", "this work is licensed under", "this file is licensed under",
    "this software is licensed under", "this project is licensed under", "this program is licensed under", "available under",
    "spdx-license-identifier:",
]
SENTENCES = {
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MitLiability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ApacheRef": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "ApacheFile": "you may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "Gpl3Later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Gpl3Split": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Gpl2Later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Gpl2Split": "either version 2 of the License, or (at your option) any later version.",
    "GnuTerms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "GnuHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GnuImplied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GnuMore": "See the GNU General Public License for more details.",
    "MplForm": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AllRights": "All rights reserved.",
}
KEYWORDS = ["licens", "licenc", "copyright", "permission", "warrant", "distribut", "released", "available", "unencumbered", "reserved", "mozilla"]
# Ordered rules: (licence, identifiers in their order); a longer text stands before its parts.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitGrant"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheRef", "ApacheFile", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheFile"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GnuHope", "GnuImplied", "GnuMore"]),
    ("GPL-3.0-or-later", ["Gpl3Split", "GnuHope", "GnuImplied", "GnuMore"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-3.0-or-later", ["Gpl3Split"]),
    ("GPL-2.0-or-later", ["GnuTerms", "Gpl2Split", "GnuHope", "GnuImplied", "GnuMore"]),
    ("GPL-2.0-or-later", ["GnuTerms", "Gpl2Split"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("MPL-2.0", ["MplForm"]),
    ("ISC", ["IscGrant"]),
    ("Unlicense", ["Unlicense"]),
]
# End of fixed values.

_END = "\u0001"
_BREAK = r"([.!?;])[ \t\r\n]+|(:)[ \t\r]*\n|\n[ \t\r*#/]*\n[ \t\r\n]*"


def normal_form(sentence: str) -> str:
    """Lower case; one blank for each run of other characters; no full stop or blank at the ends."""
    lower = sentence.translate(str.maketrans(UPPER, LOWER)).replace("licence", "license")
    return re.sub(r"[^a-z0-9.]+", " ", lower).strip(" .")


def known_sentences() -> dict[str, str]:
    """Normal form -> identifier: the sentences above, and each lead with each name of a licence."""
    known = {normal_form(s): i for i, s in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            known.update({normal_form(f"{lead} {name}"): f"Ref:{licence}" for lead in LEADS})
    return known


def rules() -> list[tuple[str, str]]:
    """(pattern over ``<identifier>`` marks, licence); references come last, in the order of their names."""
    listed = [*RULES, *((licence, [f"Ref:{licence}"]) for licence in NAMES)]
    return [("".join(f"<{re.escape(i)}>" for i in ids), licence) for licence, ids in listed]


def _normal(sentence: Column) -> Column:
    lower = F.replace(lower_ascii(sentence), F.lit("licence"), F.lit("license"))
    return F.btrim(F.regexp_replace(lower, r"[^a-z0-9.]+", " "), F.lit(" ."))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in their order."""
    known = known_sentences()
    names = list(known)

    def of_sentence(s: Column) -> Column:
        whole = _normal(s)
        lines = F.transform(F.split(s, "\n", -1), _normal)
        return F.when(whole.isin(names), F.array(whole)).otherwise(F.filter(lines, lambda x: x.isin(names)))

    cut = F.split(F.regexp_replace(text, _BREAK, f"$1$2{_END}"), _END, -1)
    found = F.flatten(F.transform(cut, of_sentence))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # The one-element array binds the lowered text once for all of the comparisons.
    held = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in KEYWORDS]))
    none = F.array().cast("array<string>")
    return F.when(held, F.transform(found, lambda s: F.element_at(table, s))).otherwise(none)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, licences, sentences, unmatched for every row; all arrays are in the order of the text.

    ``sentences`` are the identifiers found, ``licences`` what the rules make of them (repeats stay),
    ``unmatched`` the identifiers that no rule took. A null or empty text gives empty arrays, repeated
    rows give equal rows, and a null doc_id is kept. An empty table gives no row.
    """
    plain = documents_of(docs)
    rows = plain.select("doc_id", sentence_ids(F.col("text")).alias("sentences"))
    sequence = F.concat(F.lit(""), F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    rows = rows.withColumn("sequence", sequence)
    for pattern, licence in rules():
        rows = rows.withColumn("sequence", F.regexp_replace("sequence", pattern, f"<@{licence}>"))
    # The chain of rules is one expression; an empty sequence passes through it untouched.
    return rows.select(
        "doc_id",
        F.regexp_extract_all("sequence", F.lit("<@([^>]+)>"), F.lit(1)).alias("licences"),
        "sentences",
        F.regexp_extract_all("sequence", F.lit("<([^@>][^>]*)>"), F.lit(1)).alias("unmatched"),
    )


def check_sql() -> str:
    """The same in SQL of the checking database, from the same tables of sentences and rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known_sentences().items())
    normal = lambda s: f"trim(regexp_replace(replace(translate({s}, '{UPPER}', '{LOWER}'), 'licence', 'license'), '[^a-z0-9.]+', ' ', 'g'), ' .')"
    sequence = "seq"
    for pattern, licence in rules():
        sequence = f"regexp_replace({sequence}, {quote(pattern)}, {quote(f'<@{licence}>')}, 'g')"
    return f"""WITH k(s, id) AS (VALUES {values}),
 cut AS (SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, text,
   string_split(regexp_replace(coalesce(text, ''), '{_BREAK}', '\\1\\2' || chr(1), 'g'), chr(1)) AS parts FROM documents)),
 whole AS (SELECT doc_id, pos, 0 AS line, id FROM cut JOIN k ON {normal('part')} = s),
 lines AS (SELECT doc_id, pos, unnest(ls) AS part, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, pos, string_split(part, chr(10)) AS ls FROM cut)),
 hits AS (SELECT * FROM whole UNION ALL SELECT doc_id, pos, line, id FROM lines l JOIN k ON {normal('part')} = s
   WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = l.doc_id AND w.pos = l.pos)),
 seqs AS (SELECT doc_id, list(id ORDER BY pos, line) AS sentences, string_agg('<' || id || '>', '' ORDER BY pos, line) AS seq FROM hits GROUP BY doc_id),
 done AS (SELECT doc_id, sentences, {sequence} AS seq FROM seqs)
 SELECT d.doc_id, array_to_string(coalesce(regexp_extract_all(seq, '<@([^>]+)>', 1), []), ',') AS licences,
  array_to_string(coalesce(sentences, []), ',') AS sentences,
  array_to_string(coalesce(regexp_extract_all(seq, '<([^@>][^>]*)>', 1), []), ',') AS unmatched
 FROM documents d LEFT JOIN done USING (doc_id)"""
