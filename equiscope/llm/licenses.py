"""Licence scans by sentence-rule recognition.

A text is cut into sentences (after ``. ; : ! ?`` and white space) whose line
breaks are kept as marks. Comment leaders and ends of lines go first, so an
empty comment line is a blank one. A sentence over several lines is tried as a
whole and line by line, and if it is not known as a whole, by runs of its
lines, longest first. Each is normalised (lower case, letters and digits only)
and looked up among the known licence sentences, which gives the document's
sequence of sentence identifiers. Ordered rules name a licence for a run of
identifiers; a run that a rule has taken is not seen by the later ones.

All of it is one projection: no shuffle, no join, work in proportion to the
text. Only texts with one of the words that every known sentence has part of
are cut up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences by identifier, and rules in the order in which they are tried.
SENTENCES = {
    "apache-short": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");",
                     "Released under the Apache License, Version 2.0."],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-title": ["The MIT License (MIT)", "MIT License", "The MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "lgpl3-short": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "agpl3-short": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "ccbync4-short": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ccby4-short": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ccbysa4-short": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-short": ["Licensed under CC0 1.0."],
    "mpl2-short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-asis"]), ("MIT", ["mit-grant", "mit-notice", "mit-asis"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-asis"]), ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-short", "apache-comply", "apache-copy", "apache-asis", "apache-see"]), ("Apache-2.0", ["apache-short", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]), ("GPL-3.0-or-later", ["gpl-free"]), ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]), ("GPL-2.0-or-later", ["gpl2-free"]),
    ("Apache-2.0", ["apache-short"]), ("MIT", ["mit-short"]), ("GPL-3.0-only", ["gpl3-short"]), ("GPL-2.0-only", ["gpl2-short"]),
    ("LGPL-3.0-only", ["lgpl3-short"]), ("AGPL-3.0-only", ["agpl3-short"]), ("CC-BY-NC-4.0", ["ccbync4-short"]), ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]), ("CC0-1.0", ["cc0-short"]), ("MPL-2.0", ["mpl2-short"]), ("Unlicense", ["unlicense"]), ("MIT", ["mit-title"]),
]
#: Every part of a known sentence that the cutting leaves has one of these.
TRIGGERS = ["licen", "permission", "copyright", "software", "redistribut", "warrant", "names", "merchantability", "written", "option", "as is", "purpose", "v. 2.0", "conditions"]
LINE, CUT = "\x01", "\x02"
LEADER = r"(?md)^[ \t]*(?:#+|//+!?|/\*+!?|\*+/|\*+|--+>?|;+|%+|<!--+)(?=[ \t\n]|\z)[ \t]*"
ENDING = r"(?md)[ \t]+(?:\*+/?|#+|--+>)[ \t]*$"
NEW = ["licenses", "sentence_ids", "unmatched_ids"]


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier. A known sentence that the cutting would part (at ``; `` or ``: ``) is known by its longest part."""
    table = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            parts = [normalised(p) for p in re.split(r"(?<=[.;:!?])\s+", text)]
            table[max(parts, key=len)] = name
    return table


def scan(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """The input columns with ``licenses`` (distinct, in the order of the rules), ``sentence_ids`` (in order) and ``unmatched_ids``, as arrays.

    One row per input row; a text without licence sentences (null, empty, any
    other) has empty arrays. Whole texts of any length are read. Identical
    sentences count each. Sentences of no licence between two known ones don't
    part a run. An empty table gives an empty result. An input column named
    like a new one gives way to it.
    """
    columns = docs.columns if keep_columns is None else keep_columns
    table = sentence_table()
    # white space between sentences ends one; line breaks inside stay as marks; a blank line ends one too
    cut = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    cut = F.regexp_replace(F.regexp_replace(cut, LEADER, ""), ENDING, "")
    cut = F.regexp_replace(cut, r"([.;:!?])[ \t\n]+", "$1" + CUT)
    cut = F.regexp_replace(cut, r"\n[ \t]*\n[ \t\n]*", CUT)
    cut = F.regexp_replace(cut, r"\n", LINE)
    sentences = F.split(cut, CUT)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    is_known = lambda s: F.array_contains(F.array(*[F.lit(k) for k in table]), s)
    flat = lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))
    marked = lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9\x01]+", " "), r" *\x01[ \x01]*|^ +| +$", LINE)
    # known sentences that begin and end with a line, in order
    run = r"(?<![^\x01])(?:" + "|".join(k.replace(" ", r"[ \x01]") for k in sorted(table, key=len, reverse=True)) + r")(?![^\x01])"
    runs = lambda s: F.transform(F.regexp_extract_all(marked(s), F.lit(run), F.lit(0)), lambda r: F.translate(r, LINE, " "))
    tried = lambda s: F.when(F.instr(s, LINE) == 0, F.array(flat(s))).when(is_known(flat(s)), F.concat(F.array(flat(s)), F.transform(F.split(s, LINE), flat))).otherwise(runs(s))
    found = F.transform(F.filter(F.flatten(F.transform(sentences, tried)), is_known), lambda s: F.element_at(known, s))
    has_word = F.col(text).rlike("(?i)" + "|".join(re.escape(t) for t in TRIGGERS))
    none = F.array().cast("array<string>")
    ids = docs.select(*[F.col(f"`{c}`") for c in columns if c not in NEW], F.when(has_word, found).otherwise(none).alias("sentence_ids"))
    left: Column = F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    hits = []
    stages = ids.withColumn("_left", left)
    for i, (name, run) in enumerate(RULES):
        pattern = F.lit("".join(f"<{s}>" for s in run))
        hits.append(F.when(F.col(f"_hit{i}"), F.lit(name)))
        stages = stages.withColumns({f"_hit{i}": F.instr(F.col("_left"), "".join(f"<{s}>" for s in run)) > 0, "_left": F.replace(F.col("_left"), pattern, F.lit("|"))})
    unmatched = F.filter(F.split(F.regexp_replace("_left", r"[|<]", ""), ">"), lambda s: s != "")
    return stages.select(*[F.col(f"`{c}`") for c in columns if c not in NEW], F.array_distinct(F.array_compact(F.array(*hits))).alias("licenses"), "sentence_ids", unmatched.alias("unmatched_ids"))


def oracle_sql() -> str:
    """The same over ``documents`` in DuckDB SQL, arrays joined by commas, for texts without comment leaders and runs of lines inside a sentence."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sentence_table().items())
    cut = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([.;:!?])[ \t\n]+', '\1' || chr(2), 'g'), '\n[ \t]*\n[ \t\n]*', chr(2), 'g'), '\n', chr(1), 'g')"
    left, steps, hits = "s0", [], []
    for i, (name, run) in enumerate(RULES):
        pattern = quote("".join(f"<{s}>" for s in run))
        steps.append(f"r{i} AS (SELECT *, contains(left_{i}, {pattern}) AS hit{i}, replace(left_{i}, {pattern}, '|') AS left_{i + 1} FROM {left})")
        hits.append(f"CASE WHEN hit{i} THEN {quote(name)} END")
        left = f"r{i}"
    first = {}
    for i, (name, _) in enumerate(RULES):
        first.setdefault(name, []).append(f"hit{i}")
    names = ", ".join(f"CASE WHEN {' OR '.join(h)} THEN {quote(n)} END" for n, h in _in_order(first))
    return f"""
WITH known(norm, id) AS (VALUES {table}),
c AS (SELECT row_number() OVER () AS rid, doc_id, string_split({cut}, chr(2)) AS sentences FROM documents),
l AS (SELECT rid, generate_subscripts(sentences, 1) AS p, unnest(sentences) AS s FROM c),
t AS (SELECT rid, p, 0 AS k, s FROM l UNION ALL
      SELECT rid, p, generate_subscripts(string_split(s, chr(1)), 1), unnest(string_split(s, chr(1))) FROM l WHERE contains(s, chr(1))),
f AS (SELECT rid, string_agg('<' || id || '>', '' ORDER BY p, k) AS ids FROM t JOIN known ON norm = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY rid),
s0 AS (SELECT c.rid, doc_id, coalesce(ids, '') AS ids, coalesce(ids, '') AS left_0 FROM c LEFT JOIN f ON c.rid = f.rid),
{', '.join(steps)}
SELECT doc_id, concat_ws(',', {names}) AS licenses, replace(replace(replace(ids, '><', ','), '<', ''), '>', '') AS sentence_ids,
       replace(replace(replace(replace(left_{len(RULES)}, '|', ''), '><', ','), '<', ''), '>', '') AS unmatched_ids
FROM r{len(RULES) - 1}"""


def _in_order(first: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return list(first.items())
