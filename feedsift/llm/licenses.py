"""Licence scans by sentences: known sentences get identifiers, rules are sequences of these.

A text is cut into sentences, which are lower-cased and stripped of all but
letters and digits. Cuts at stops and blank lines hold; those before a line
that begins with a capital, a comment sign or a list mark may also lie inside a
known sentence, so it is found at any line width. Known sentences that lie
between the nearest cuts come first, then longer ones. They give their numbers,
in the order of the text, with a gap mark wherever other words stand between two
of them; a list label of up to three characters is no gap. The rules are tried
in order, longest first; a rule holds where its numbers stand side by side with
no gap, and takes them from later rules.
All of it is column expressions in the stage that reads the table.

Cases: null and empty texts have no sentence; repeated rows get equal results;
other columns are not looked at; texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, as they are written there.
SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_grant_head": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "no_event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit_released": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "mit_this": "This project is licensed under the MIT License",
    "apache_head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "apache_short": "Licensed under the Apache License, Version 2.0",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_see": "See the GNU General Public License for more details",
    "gpl_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl_licensed": "Licensed under the GNU General Public License, version 3",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_licensed": "Licensed under the BSD License",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mpl_head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc_by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc_by_short": "Licensed under CC BY 4.0",
    "cc_by_sa_short": "Licensed under CC BY-SA 4.0",
    "cc_zero": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "public_domain": "This is free and unencumbered software released into the public domain",
    "all_rights": "All rights reserved",
    "lgpl_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_see": "See the GNU Lesser General Public License for more details",
    "agpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl_see": "See the GNU Affero General Public License for more details",
}

# Names of the public licence list that a file may state in one line.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense",
)
SENTENCES |= {f"spdx {name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

# Licences by the sentences that make them up, in the order in which they are tried.
RULES = (
    ("MIT-full", ("mit_grant_head", "mit_notice", "as_is", "no_event")),
    ("MIT-full", ("mit_grant", "as_is", "no_event")),
    ("Apache-2.0-header", ("apache_head", "apache_copy", "apache_see")),
    ("GPL-3.0-header", ("gpl_free", "gpl_hope", "gpl_see")),
    ("GPL-2.0-header", ("gpl2_free", "gpl_hope", "gpl_see")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("Apache-2.0-header", ("apache_unless", "apache_see")),
    ("MIT", ("mit_grant",)), ("MIT", ("mit_grant_head",)),
    ("MIT", ("mit_released",)), ("MIT", ("mit_licensed",)), ("MIT", ("mit_this",)),
    ("Apache-2.0", ("apache_head",)), ("Apache-2.0", ("apache_short",)),
    ("GPL-3.0", ("gpl_free",)), ("GPL-3.0", ("gpl_work",)), ("GPL-3.0", ("gpl_licensed",)),
    ("GPL-2.0", ("gpl2_free",)),
    ("BSD", ("bsd_licensed",)),
    ("MPL-2.0", ("mpl_head",)),
    ("CC-BY-4.0", ("cc_by",)), ("CC-BY-4.0", ("cc_by_short",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)), ("CC-BY-SA-4.0", ("cc_by_sa_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC0-1.0", ("cc_zero",)),
    ("Unlicense", ("public_domain",)),
    ("LGPL-2.1-header", ("lgpl_free", "lgpl_hope", "lgpl_see")),
    ("AGPL-3.0-header", ("agpl_free", "gpl_hope", "agpl_see")),
    ("LGPL-2.1", ("lgpl_free",)), ("AGPL-3.0", ("agpl_free",)),
    *((name, (f"spdx {name}",)) for name in SPDX),
)

# Where sentences end in the reference SQL. A line break ends one before a blank line or a capital and a small letter.
CUT = "\x01"
CUTS = (
    (r"[.!?]+([ \t\n\r\f]+|\z)", CUT),
    (r"\n[ \t\r\f]*\n", CUT),
    (r"\n[ \t\r\f]*([A-Z][a-z])", CUT + r"\1"),
)


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


NUMBERS = {name: n + 1 for n, name in enumerate(SENTENCES)}
KNOWN = {normalised(text): NUMBERS[name] for name, text in SENTENCES.items()}


def tag(names: tuple[str, ...]) -> str:
    return "".join(f"<{NUMBERS[n]}>" for n in names)


# Cuts as ``found_sentences`` sees them. HARD ends a sentence; the others are blanks inside one, or its end.
HARD, LINE, MARK, COLON = "\x01", "\x02", "\x03", "\x04"
SEEN = (
    (r"[.!?]+(?:[ \t\n\r\f]+|\z)", HARD),
    (r"\n[ \t\r\f]*\n", HARD),
    (r"\n[ \t\r\f]*(?=[A-Z][a-z])", LINE),
    (r"([\n\x01])[ \t\r\f]*[-*+#;%/>|\u2022]*[ \t]*\(?[0-9a-z]{1,3}\)[ \t]+", "$1" + MARK),
    (r"\n[ \t\r\f]*[-*+#;%/>|\u2022]*[ \t]*(?=[A-Z]|[0-9a-z]{1,3}\x01)", MARK),
    (r":(?=[ \t\n\r\f])", COLON),
)


def known_pattern() -> str:
    """A cut and a known sentence up to a cut: within the nearest cuts of CUTS, or else across lines."""
    def words(name: str, between: str) -> str:
        cut = SENTENCES[name]
        for pattern, by in SEEN[:1]:  # a stop inside a known sentence is no cut
            cut = re.sub(pattern.replace(r"\z", r"\Z"), by, cut)
        parts = [normalised(x).split() for x in cut.split(HARD) if normalised(x)]
        return "[ \x01-\x04]++".join(between.join(x) for x in parts)

    def ends(name: str) -> str:
        return " *[\x01-\x04]" if SENTENCES[name].endswith(":") else "[ \x04]*[\x01-\x03]"

    longest = sorted(SENTENCES, key=lambda n: -len(normalised(SENTENCES[n])))
    near = [words(n, "[ \x03\x04]++") + "(?=[ \x03\x04]*[\x01\x02])" for n in longest]
    far = [words(n, "[ \x02-\x04]++") + f"(?={ends(n)})" for n in longest]
    return "[\x01-\x04] *(" + "|".join(near + far) + ")"


# Marks around known sentences: one begins, one ends, the next follows at once, the next follows after other words.
BEGIN, END, NEXT, APART = "\x05", "\x06", "\x07", "\x08"
GAP = "|"
LABEL = "[0-9a-z]{1,3}"


def found_sentences(text: Column) -> Column:
    """Known sentences, normalised and in order, each after NEXT or APART."""
    cut = F.translate(text, LINE + MARK + COLON, "   ")
    for pattern, by in SEEN:
        cut = F.regexp_replace(cut, pattern, by)
    plain = F.concat(F.lit(HARD), F.regexp_replace(F.lower(cut), "[^a-z0-9\x01-\x04]+", " "), F.lit(HARD))
    told = F.concat(F.lit(END), F.regexp_replace(plain, known_pattern(), f"{BEGIN}$1{END}"))
    blank = "[ \x01-\x04]*+"
    for pattern, by in (
        (f"{END}{blank}(?:{LABEL}{blank})?{BEGIN}", NEXT),  # a cut before a sentence went with it
        (f"{END}[^{BEGIN}]*+{BEGIN}", APART),
        (f"{END}[^{BEGIN}]*+\\z", ""),
    ):
        told = F.regexp_replace(told, pattern, by)
    found = F.regexp_extract_all(told, F.lit(f"[{NEXT}{APART}][^{NEXT}{APART}]+"), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(s, "[ \x01-\x04]+", " "))


def known_numbers(text: Column) -> Column:
    """Numbers of the known sentences, in order, written <n><m>, or <n>|<m> if other words stand between."""
    numbers = F.create_map(*[
        x for s, n in KNOWN.items() for x in (F.lit(NEXT + s), F.lit(f"<{n}>"), F.lit(APART + s), F.lit(f"{GAP}<{n}>"))
    ])
    return F.ltrim(F.array_join(F.transform(found_sentences(text), lambda s: numbers[s]), ""), F.lit(GAP))


def matched(numbers: Column) -> Column:
    """Licences of the rules that hold, in the rules' order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(tag(parts)).alias("tag")) for name, parts in RULES])
    start = F.struct(numbers.alias("left"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, rule: Column) -> Column:
        holds = F.contains(state["left"], rule["tag"])
        return F.struct(
            F.replace(state["left"], rule["tag"], F.lit("<>")).alias("left"),
            F.when(holds, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    return F.array_distinct(F.aggregate(rules, start, step, lambda s: s["names"]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, n_sentences (known ones) and licenses of each document (doc_id, text)."""
    numbers = docs.select("doc_id", known_numbers(F.coalesce("text", F.lit(""))).alias("sentence_ids"))
    return numbers.select(
        "doc_id", "sentence_ids",
        F.regexp_count("sentence_ids", F.lit("<")).cast("bigint").alias("n_sentences"),
        F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.array_join(matched(F.col("sentence_ids")), ",")).alias("licenses"),
    )


def oracle() -> str:
    """The scan in DuckDB SQL, for texts whose known sentences lie between two cuts of CUTS."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cut = "coalesce(text, '')"
    for pattern, by in CUTS:
        by = by.replace(CUT, "' || chr(1) || '")
        cut = f"regexp_replace({cut}, {quoted(pattern)}, '{by}', 'g')"
    known = ", ".join(f"({quoted(s)}, {n})" for s, n in KNOWN.items())
    steps = ["s0 AS (SELECT doc_id, sentence_ids, sentence_ids AS rest, [] :: VARCHAR[] AS names FROM ids)"]
    for n, (name, parts) in enumerate(RULES):
        t = quoted(tag(parts))
        steps.append(
            f"s{n + 1} AS (SELECT doc_id, sentence_ids, replace(rest, {t}, '<>') AS rest, CASE WHEN contains(rest, {t}) "
            f"AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM s{n})"
        )
    return f"""
WITH known(s, n) AS (VALUES {known}),
numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
pieces AS (
  SELECT r, unnest(string_split({cut}, chr(1))) AS s, generate_subscripts(string_split({cut}, chr(1)), 1) AS pos FROM numbered),
plain AS (SELECT r, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM pieces),
told AS (
  SELECT r, s, row_number() OVER o AS pos, CASE WHEN regexp_full_match(lag(s) OVER o, '{LABEL}') THEN 1 ELSE 0 END AS label
  FROM plain WHERE s <> '' WINDOW o AS (PARTITION BY r ORDER BY pos)),
side AS (
  SELECT r, n, pos, pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) - 1 AS other, label FROM told JOIN known USING (s)),
held AS (
  SELECT r, string_agg(CASE WHEN other > 0 AND NOT (other = 1 AND label = 1) THEN '{GAP}' ELSE '' END || '<' || n || '>', '' ORDER BY pos) AS ids
  FROM side GROUP BY r),
ids AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids FROM numbered LEFT JOIN held USING (r)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, length(sentence_ids) - length(replace(sentence_ids, '<', '')) AS n_sentences,
       array_to_string(names, ',') AS licenses FROM s{len(RULES)}"""
