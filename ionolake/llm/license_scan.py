"""Licence recognition by sentences: normalised sentences are mapped to identifiers of known licence sentences, and the identifiers of a text, in order, are matched against rules.

A text is lower-cased and cut into runs after . ! ? or : before white space, and at lines without letters or digits (blank lines, lines of a comment's frame); the dot of `v.` and the colon of an
SPDX tag don't cut. Everything but a to z and digits becomes one space, so comment marks, quotes and list bullets vanish. A run of several lines is read in two ways: each line by
itself (titles, copyright lines), and joined from each of its lines to its end (hard-wrapped sentences, whatever stands on the lines before them). A sentence is looked up whole and exactly and gives one
identifier; every sentence of the catalogue is one run, so its identifier stands for all of its words. A line that begins with copyright has the identifier `copyright`.
A rule is a list of identifiers that must occur in that order, with any other sentences between them. The rules that match are reported, but not those whose identifiers another matching rule contains.

Main path: DataFrame functions only. Candidate sentences are exploded and met with the catalogue (a fixed table of this module, broadcast by its known size); only hits are grouped by document, and
rules are folded over a document's identifiers in one pass each.

Cases: null or empty texts give no rows; rows that repeat a doc_id are one document, each of its texts matched by itself (equal texts count once); null doc_ids are reported together by text; a text is
never cut off: a long one makes more sentences, not longer ones; a document may hold any number of known sentences; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence, its names as sentences use them, and its identifier in SPDX tags (the part before any -only or -or-later).
NAMES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("MIT", ("MIT License", "MIT Licence", "MIT", "MIT License (MIT)"), "MIT"),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0"), "Apache-2.0"),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License version 3, 29 June 2007", "GPLv3", "GPL-3.0"), "GPL-3.0"),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License version 2, June 1991", "GPLv2", "GPL-2.0"), "GPL-2.0"),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3, 29 June 2007", "LGPLv3", "LGPL-3.0"), "LGPL-3.0"),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 2.1, February 1999", "LGPLv2.1", "LGPL-2.1"), "LGPL-2.1"),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU Affero General Public License version 3, 19 November 2007", "AGPLv3", "AGPL-3.0"), "AGPL-3.0"),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"), "BSD-2-Clause"),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"), "BSD-3-Clause"),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"), "MPL-2.0"),
    ("ISC", ("ISC License",), "ISC"),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), "0BSD"),
    ("Zlib", ("zlib License",), "Zlib"),
    ("Unlicense", ("Unlicense", "The Unlicense"), "Unlicense"),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"), "EPL-2.0"),
    ("Artistic-2.0", ("Artistic License 2.0", "Artistic-2.0"), "Artistic-2.0"),
    ("OFL-1.1", ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1"), "OFL-1.1"),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"), "BSL-1.0"),
    ("WTFPL", ("Do What The Fuck You Want To Public License", "WTFPL"), "WTFPL"),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal"), "CC0-1.0"),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"), "CC-BY-4.0"),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International"), "CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International"), "CC-BY-NC-4.0"),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), "CC-BY-ND-4.0"),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), "CC-BY-NC-SA-4.0"),
    ("CC-BY-NC-ND-4.0", ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), "CC-BY-NC-ND-4.0"),
)
#: What stands before a name in a sentence that grants by it.
LEADS = (
    "Released under the", "Released under", "Licensed under the", "Licensed under", "Distributed under the", "Available under the", "This project is licensed under the", "This project is released under the",
    "This software is licensed under the", "This software is released under the", "This code is licensed under the", "This file is licensed under the", "This work is licensed under the", "This work is licensed under a",
    "This library is licensed under the", "This program is licensed under the", "This work is dedicated to the public domain under",
)
#: A name of so many characters or more, normalised, counts as a sentence of its own (a title).
TITLE = 10
#: The public licences whose notice names a program or library and a version.
FAMILIES = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
#: Other known licence sentences by identifier, as their licences word them.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as-is-software": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "apache-grant": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-as-is": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "gnu-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-name": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "mpl-subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "zero-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "as-is-author": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "unlicense-domain": ("This is free and unencumbered software released into the public domain.",),
    "unlicense-grant": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "epl-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    "ofl-notice": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",),
    "reserved": ("All rights reserved.",),
}
#: Rule, licence, identifiers in order; those by name and by public notice are added by rule.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit_text", "MIT", ("mit-grant", "mit-notice", "as-is-software")),
    ("apache_notice", "Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is", "apache-see")),
    ("bsd2_text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd3_text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("mpl_subject", "MPL-2.0", ("mpl-subject",)),
    ("mpl_notice", "MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("isc_text", "ISC", ("isc-grant", "as-is-author")),
    ("zero_bsd_text", "0BSD", ("zero-grant", "as-is-author")),
    ("zlib_text", "Zlib", ("zlib-as-is", "zlib-grant")),
    ("unlicense_text", "Unlicense", ("unlicense-domain", "unlicense-grant")),
    ("epl_notice", "EPL-2.0", ("epl-notice",)),
    ("ofl_notice", "OFL-1.1", ("ofl-notice",)),
    ("boost_text", "BSL-1.0", ("boost-grant",)),
    ("reserved", "Proprietary", ("reserved",)),
    ("copyright_reserved", "Proprietary", ("copyright", "reserved")),
)
_MARK = "\x01"
#: In order: what would cut but doesn't, sentence ends, lines without words, everything that is no word.
_STEPS = ((r"((?:^|[^a-z0-9])v|license-identifier)[.:]", r"{1} "), (r"([.!?:])[ \t\r\n\f]+", r"{1}" + _MARK), (rf"\n[^a-z0-9{_MARK}]*\n", _MARK), (rf"[^a-z0-9\n{_MARK}]+", " "))


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def runs(text: str) -> list[str]:
    """The runs of a text, lines kept apart."""
    text = text.lower()
    for pattern, new in _STEPS:
        text = re.sub(pattern, new.replace("{1}", r"\1"), text)
    return [r for r in text.split(_MARK) if r.strip(" \n")]


def known_sentences() -> dict[str, tuple[str, ...]]:
    """All sentences by identifier."""
    out = {}
    for licence, names, tag in NAMES:
        titles = [n for n in names if len(normal(n)) >= TITLE]
        spdx = [f"SPDX-License-Identifier: {tag}{end}" for end in ("", "-only", "-or-later")]
        out[f"{licence}-name"] = (*titles, *(f"The {t}" for t in titles), *(f"{lead} {n}" for lead in LEADS for n in names), *spdx)
    for licence, name, version in FAMILIES:
        grant = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
        ends = (f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License", f"version {version}")
        out[f"{licence}-grant"] = tuple(f"{start} {grant}, {end}" for start in ("", "This program is free software;", "This library is free software;") for end in ends)
        out.setdefault(f"{name}-see", (f"See the {name} for more details.",))
    return out | SENTENCES


def rules() -> list[tuple[str, str, tuple[str, ...]]]:
    """Rule, licence, identifiers in order."""
    plain = lambda x: re.sub(r"[^a-z0-9]+", "_", x.lower())
    by_name = [(f"{plain(licence)}_name", licence, (f"{licence}-name",)) for licence, *_ in NAMES]
    notices = [(f"{plain(licence)}_notice", licence, (f"{licence}-grant", "gnu-hope", f"{name}-see")) for licence, name, _ in FAMILIES]
    return [*by_name, *notices, *RULES]


def contained() -> dict[str, list[str]]:
    """For each rule, the rules whose identifiers hold its own in order."""

    def holds(big: tuple[str, ...], small: tuple[str, ...]) -> bool:
        it = iter(big)
        return len(big) > len(small) and all(k in it for k in small)

    return {r: over for r, _, keys in rules() if (over := [o for o, _, others in rules() if holds(others, keys)])}


def identifiers() -> dict[str, int]:
    """Identifiers by number; the last one is of copyright lines."""
    return {k: n for n, k in enumerate([*known_sentences(), "copyright"])}


def catalogue() -> list[tuple[str, int]]:
    """Normalised sentences and their identifiers' numbers."""
    number, out = identifiers(), {}
    for key, sentences in known_sentences().items():
        for s in sentences:
            if len(runs(s)) != 1:
                raise ValueError(f"{s!r} is more than one run")
            if out.setdefault(normal(s), number[key]) != number[key]:
                raise ValueError(f"{s!r} has two identifiers")
    return sorted(out.items())


def licence_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, run, line (the place of the sentence), sentence_id, for each known sentence of each text; a sentence may come twice."""
    spark, rows = docs.sparkSession, catalogue()
    known = F.broadcast(spark.createDataFrame(rows, "sentence string, n int"))  # a fixed table of this module
    longest, shortest, most_words = max(len(s) for s, _ in rows), min(len(s) for s, _ in rows), max(s.count(" ") + 1 for s, _ in rows)
    text = F.lower("text")
    for pattern, new in _STEPS:
        text = F.regexp_replace(text, pattern, new.replace("{1}", "$1"))
    # the key first: what is cut up is only the text, and no row of a piece carries the whole
    keyed = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), text.alias("text"))
    cut = keyed.select("doc_id", "text_key", F.posexplode(F.split("text", _MARK)).alias("run", "raw"))
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def place(line: Column, sentence: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), sentence.alias("sentence"))

    def readings(of: Column) -> Column:
        """Each line by itself, and the run from each line on; a start that leaves more words than any known sentence has can't give one, and a line has a word at least."""
        n = F.size(of)
        single = F.transform(of, lambda x, i: place(i, x))
        starts = F.when(n > 1, F.sequence(F.greatest(F.lit(0), n - F.lit(most_words)), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.concat(single, F.transform(starts, lambda i: place(i, F.array_join(F.slice(of, i + 1, n - i), " "))))

    whole = F.array(place(F.lit(0), F.trim("raw")))
    # the lines of a run are cut once, before the readings that use them
    cut = cut.withColumn("lines", F.when(F.instr("raw", "\n") > 0, lines))
    found = cut.select("doc_id", "text_key", "run", F.explode(F.when(F.col("lines").isNull(), whole).otherwise(readings(F.col("lines")))).alias("x")).select("doc_id", "text_key", "run", "x.line", "x.sentence")
    held = F.col("sentence").startswith("copyright ")
    found = found.where(F.length("sentence").between(shortest, longest) | held)
    own = F.when(held, F.lit(identifiers()["copyright"]))
    return found.join(known, "sentence", "left").select("doc_id", "text_key", "run", "line", F.coalesce("n", own).alias("sentence_id")).where("sentence_id is not null")


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, rule, licence, n_sentences (known sentences in the document): a row for each rule that a document matches."""
    number = identifiers()
    seq = licence_sentences(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("run", "line", "sentence_id"))).alias("x"))
    seq = seq.select("doc_id", F.size("x").cast("long").alias("n_sentences"), F.col("x.sentence_id").alias("ids"))
    every = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("licence"), F.array(*[F.lit(number[x]) for x in keys]).alias("keys")) for r, k, keys in rules()])

    def matches(rule: Column) -> Column:
        """The rule's identifiers are taken one after the other as the document's pass by."""
        taken = F.aggregate("ids", F.lit(0), lambda done, one: F.when(one == F.get(rule["keys"], done), done + 1).otherwise(done))
        return taken == F.size(rule["keys"])

    hits = seq.withColumn("hits", F.filter(every, matches))
    inside = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in contained().items() for x in pair])
    kept = F.filter("hits", lambda x: ~F.coalesce(F.arrays_overlap(inside[x["rule"]], F.col("hits.rule")), F.lit(False)))
    return hits.select("doc_id", "n_sentences", F.explode(kept).alias("h")).groupBy("doc_id", F.col("h.rule").alias("rule"), F.col("h.licence").alias("licence")).agg(F.max("n_sentences").alias("n_sentences"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of licences(documents), from the fixed values and the rules: names and leads are put together, sentences normalised, and rules matched (as patterns over the identifiers) in SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda rows: ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    cuts = "lower({})"
    for pattern, new in _STEPS:
        cuts = f"regexp_replace({cuts}, {text(pattern)}, {text(new.replace('{1}', chr(92) + '1'))}, 'g')"
    return f"""
WITH name(licence, name) AS (VALUES {table((k, n) for k, names, _ in NAMES for n in names)}), tag(licence, tag) AS (VALUES {table((k, t) for k, _, t in NAMES)}), lead_in(lead) AS (VALUES {table((x,) for x in LEADS)}),
family(licence, name, version) AS (VALUES {table(FAMILIES)}), other(key, sentence) AS (VALUES {table((k, s) for k, ss in SENTENCES.items() for s in ss)}), fixed_rule(rule, licence, keys) AS (VALUES {table((r, k, '>'.join(keys)) for r, k, keys in RULES)}),
given AS (
  SELECT licence || '-name' AS key, name AS s FROM name UNION ALL SELECT licence || '-name', 'the ' || name FROM name UNION ALL SELECT licence || '-name', lead || ' ' || name FROM name CROSS JOIN lead_in
  UNION ALL SELECT licence || '-name', 'spdx license identifier ' || tag || e FROM tag CROSS JOIN (VALUES (''), ('-only'), ('-or-later')) ends(e)
  UNION ALL SELECT licence || '-grant', b || 'you can redistribute it and or modify it under the terms of the ' || name || ' as published by the free software foundation ' || replace(e, '#', version)
  FROM family CROSS JOIN (VALUES (''), ('this program is free software '), ('this library is free software ')) starts(b) CROSS JOIN (VALUES ('either version # of the license or at your option any later version'), ('version # of the license'), ('version #')) ends(e)
  UNION ALL SELECT name || '-see', 'see the ' || name || ' for more details' FROM family UNION ALL SELECT key, sentence FROM other),
normalised AS (SELECT key, s, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM given),
known AS (SELECT DISTINCT key, sentence FROM normalised WHERE NOT (key LIKE '%-name' AND EXISTS (SELECT 1 FROM name n WHERE n.licence || '-name' = key AND s IN (n.name, 'the ' || n.name) AND length(trim(regexp_replace(lower(n.name), '[^a-z0-9]+', ' ', 'g'))) < {TITLE}))),
rules AS (SELECT rule, licence, keys FROM fixed_rule UNION ALL SELECT regexp_replace(lower(licence), '[^a-z0-9]+', '_', 'g') || '_name', licence, licence || '-name' FROM tag
  UNION ALL SELECT regexp_replace(lower(licence), '[^a-z0-9]+', '_', 'g') || '_notice', licence, licence || '-grant>gnu-hope>' || name || '-see' FROM family),
patterns AS (SELECT rule, licence, '>' || replace(keys, '>', '>(.*>)?') || '>' AS pattern, '>' || keys || '>' AS keys FROM rules),
inside AS (SELECT a.rule, b.rule AS other FROM patterns a JOIN patterns b ON a.rule <> b.rule AND length(b.keys) > length(a.keys) AND regexp_matches(b.keys, a.pattern)),
cut AS (SELECT doc_id, text, unnest(string_split(t, chr(1))) AS raw, generate_subscripts(string_split(t, chr(1)), 1) AS run FROM (SELECT doc_id, text, {cuts.format("text")} AS t FROM documents WHERE text IS NOT NULL)),
parts AS (SELECT doc_id, text, run, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM cut),
places AS (SELECT *, unnest(range(len(ls))) AS line FROM parts),
candidates AS (SELECT doc_id, text, run, line, ls[line + 1] AS sentence FROM places UNION ALL SELECT doc_id, text, run, line, array_to_string(ls[line + 1:], ' ') FROM places WHERE len(ls) - line BETWEEN 2 AND 200),
f AS (SELECT DISTINCT doc_id, text, run, line, COALESCE(key, CASE WHEN starts_with(c.sentence, 'copyright ') THEN 'copyright' END) AS key FROM candidates c LEFT JOIN known ON c.sentence = known.sentence),
q AS (SELECT doc_id, text, count(*) AS n_sentences, '>' || string_agg(key, '>' ORDER BY run, line, key) || '>' AS ids FROM f WHERE key IS NOT NULL GROUP BY doc_id, text),
h AS (SELECT q.doc_id, q.text, q.n_sentences, p.rule, p.licence FROM q JOIN patterns p ON regexp_matches(q.ids, p.pattern))
SELECT h.doc_id, h.rule, h.licence, max(h.n_sentences) AS n_sentences FROM h
WHERE NOT EXISTS (SELECT 1 FROM inside i JOIN h o ON o.rule = i.other WHERE i.rule = h.rule AND o.doc_id = h.doc_id AND o.text = h.text)
GROUP BY h.doc_id, h.rule, h.licence"""
