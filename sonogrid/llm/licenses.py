"""Operator 9: licence scans by sentence rules, in DataFrame functions only.

Sentences end at blank lines and at . ! ? before white space (but not after "v."); at a
single line break, also in a comment, they may end or go on. A normalised sentence (lower
case, runs of anything but a-z, 0-9, + and . as one space, no full stop at the end) that
is known gives its identifier, the longest one from where it starts; known sentences of
LONG words and more count wherever they stand, so that titles, names and copyright lines
may run into them. The identifiers of a text are matched from the left against the rules,
longest first, and a match uses its sentences up. The rule of last resort (LAST) counts
only if no other one matches.

A tag line (SPDX-License-Identifier and an expression up to the end of the line or comment) is
a sentence for each of the expression's terms, known by rule and not by list: a licence's
identifier, + for "or later", and what follows WITH. Their identifiers (spdx: and the term in
lower case) come after the others, and each is a rule of its own. An expression with anything
but terms, AND, OR and brackets is no tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import LOWER_AZ, UPPER_AZ, lower_az, whole

#: Words of a known sentence that counts wherever it stands, at least.
LONG = 10
# Known sentences of licence notices, by identifier.
SENTENCES = {
    "mit-title": "mit license",
    "mit-the-title": "the mit license",
    "mit-the-title-mit": "the mit license mit",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-2": "licensed under the apache license version 2.0",
    "apache-2-title": "apache license version 2.0 january 2004",
    "apache-2-file": "under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-2-kernel": "under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "lgpl-2.1-title": "gnu lesser general public license version 2.1 february 1999",
    "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl-warranty": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-4": "licensed under cc by nc 4.0",
    "cc-by-4": "licensed under cc by 4.0",
    "cc-by-sa-4": "licensed under cc by sa 4.0",
    "cc0-deed": "has waived all copyright and related or neighboring rights to this work",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-title": "boost software license version 1.0 august 17th 2003",
    "boost-file": "distributed under the boost software license version 1.0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl-2-title": "mozilla public license version 2.0",
    "epl-1": "are made available under the terms of the eclipse public license v 1.0",
    "epl-2": "are made available under the terms of the eclipse public license v 2.0",
    "cddl-file": "the contents of this file are subject to the terms of the common development and distribution license",
    "perl-terms": "you can redistribute it and or modify it under the same terms as perl itself",
    "bsd-style": "use of this source code is governed by a bsd style license that can be found in the license file",
    "rights": "all rights reserved",
}
# Identifiers whose case in tags is mended.
TAGS = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
# What the notices of one family differ in: the word before "general public license", its versions, and the licence.
GNU = [("", ("2", "3"), "GPL"), ("lesser ", ("2.1", "3"), "LGPL"), ("affero ", ("3",), "AGPL")]
# The terms of public licences of works, in words and letters.
WORKS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
# Rules as sequences of sentence identifiers, and the licence that each tells.
RULES = [
    (("mit-title", "mit-grant", "mit-notice"), "MIT"),
    (("mit-the-title", "mit-grant", "mit-notice"), "MIT"),
    (("mit-the-title-mit", "mit-grant", "mit-notice"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-title",), "MIT"),
    (("mit-the-title",), "MIT"),
    (("mit-the-title-mit",), "MIT"),
    (("mit-released",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("mit-grant",), "MIT"),
    (("apache-2-file", "apache-copy"), "Apache-2.0"),
    (("apache-2",), "Apache-2.0"),
    (("apache-2-file",), "Apache-2.0"),
    (("apache-2-title",), "Apache-2.0"),
    (("gpl-3-work",), "GPL-3.0-only"),
    (("gpl-2-kernel", "gpl-warranty"), "GPL-2.0-only"),
    (("gpl-2-kernel",), "GPL-2.0-only"),
    (("gpl-2-title",), "GPL-2.0"),
    (("gpl-3-title",), "GPL-3.0"),
    (("lgpl-2.1-title",), "LGPL-2.1"),
    (("lgpl-3-title",), "LGPL-3.0"),
    (("agpl-3-title",), "AGPL-3.0"),
    (("cc-by-nc-4",), "CC-BY-NC-4.0"),
    (("cc-by-4",), "CC-BY-4.0"),
    (("cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("cc0-deed",), "CC0-1.0"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-redistribution",), "BSD"),
    (("isc-grant",), "ISC"),
    (("zlib-grant",), "Zlib"),
    (("boost-title", "boost-grant"), "BSL-1.0"),
    (("boost-title",), "BSL-1.0"),
    (("boost-file",), "BSL-1.0"),
    (("boost-grant",), "BSL-1.0"),
    (("unlicense",), "Unlicense"),
    (("mpl-2",), "MPL-2.0"),
    (("mpl-2-title",), "MPL-2.0"),
    (("epl-1",), "EPL-1.0"),
    (("epl-2",), "EPL-2.0"),
    (("cddl-file",), "CDDL"),
    (("perl-terms",), "Perl"),
    (("bsd-style",), "BSD"),
    (("rights",), "proprietary"),
]
for _word, _versions, _name in GNU:
    for _version in _versions:
        _id, _licence = f"{_name.lower()}-{_version}-later", f"{_name}-{_version if '.' in _version else _version + '.0'}-or-later"
        SENTENCES[_id] = f"is free software you can redistribute it and or modify it under the terms of the gnu {_word}general public license as published by the free software foundation either version {_version} of the license or at your option any later version"
        RULES += [((_id, "gpl-warranty"), _licence), ((_id,), _licence)]
for _letters, _words in WORKS.items():
    SENTENCES[f"work-{_letters}-4"] = f"this work is licensed under a creative commons {_words} 4.0 international license"
    RULES.append(((f"work-{_letters}-4",), f"CC-{_letters.upper()}-4.0"))
    SENTENCES[f"work-{_letters}-3"] = f"this work is licensed under a creative commons {_words} 3.0 unported license"
    RULES.append(((f"work-{_letters}-3",), f"CC-{_letters.upper()}-3.0"))
#: The licence that counts only if no other does.
LAST = "proprietary"
#: What a text with a known sentence has in it; texts without are not looked at further.
TRIGGERS = ("licen", "permission", "redistribut", "rights", "unencumbered", "warranty", "advertising")

#: Steps that lead from a lower-case text, with a line break before it, to its normalised words between marks: || where a sentence ends, ~~ where it may.
STEPS = [
    (r"\n[ \t]*(?://+|/[*]+|[*]+/?|#+|;+|--+|<!--|rem )[ \t]*", "\n"),
    (r"\n[ \t\r]*(?:\n[ \t\r]*)+", "||"),
    (r"([^a-z0-9])v[.][ \t\r\n]+", "{1}v "),
    (r"[.]{2,}", "."),
    (r"[.!?][ \t\r\n]+", "||"),
    (r"\n", "~~"),
    (r"[^a-z0-9+.|~]+", " "),
    (r"[. ]+([|~])", "{1}"),
    (r"([|~])[. ]+", "{1}"),
]


#: A tag line and its expression; what may stand between its terms; a term; a term that is a family's identifier of old, later versions too or not.
TAG_LINE = r"""(?i:SPDX-License-Identifier):([A-Za-z0-9.+() \t-]+)(?:\z|[\r\n*}"'#<>;])"""
BETWEEN = r"[ \t()]+(?:AND|OR)[ \t()]+"
TERM = r"^[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?[+]?(?: WITH [A-Za-z0-9][A-Za-z0-9.-]*)?$"
OLD_LATER, OLD_ONLY = r"^([AL]?GPL-[0-9.]+)[+]", r"^([AL]?GPL-[0-9.]*[0-9])( WITH .*)?$"


def tags(text: Column) -> Column:
    """The terms of all tag lines, in order, as current identifiers."""
    names = F.create_map(*(F.lit(x) for n in TAGS for x in (n.lower(), n)))

    def terms(line: Column) -> Column:
        bare = F.transform(F.split(F.regexp_replace(line, r"[ \t.-]+$", ""), BETWEEN), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[ \t()]+|[ \t()]+$", ""), r"[ \t]+", " "))
        return F.when(F.forall(bare, lambda x: x.rlike(TERM)), bare).otherwise(F.array().cast("array<string>"))

    def current(x: Column) -> Column:
        mended = F.concat(F.coalesce(F.try_element_at(names, lower_az(F.regexp_extract(x, "^[^ ]+", 0))), F.regexp_extract(x, "^[^ ]+", 0)), F.regexp_extract(x, " .*$", 0))
        upper = F.regexp_replace(F.regexp_replace(mended, r"^(?i:gpl-)", "GPL-"), r"^(?i:lgpl-)", "LGPL-")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(upper, r"^(?i:agpl-)", "AGPL-"), OLD_LATER, "$1-or-later"), OLD_ONLY, "$1-only$2")

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG_LINE), F.lit(1)), terms))
    return F.when(F.contains(lower_az(text), F.lit("spdx-")), F.transform(found, current)).otherwise(F.array().cast("array<string>"))


def tags_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda items: "[" + ", ".join(map(quoted, items)) + "]"
    lower = lambda x: f"translate({x}, '{UPPER_AZ}', '{LOWER_AZ}')"
    names = f"MAP({listed(n.lower() for n in TAGS)}, {listed(TAGS)})"
    bare = f"list_transform(regexp_split_to_array(regexp_replace(line, '[ \\t.-]+$', ''), {quoted(BETWEEN)}), lambda x: regexp_replace(regexp_replace(x, '^[ \\t()]+|[ \\t()]+$', '', 'g'), '[ \\t]+', ' ', 'g'))"
    terms = f"CASE WHEN len(list_filter({bare}, lambda x: NOT regexp_matches(x, {quoted(TERM)}))) = 0 THEN {bare} ELSE [] END"
    head = "regexp_extract(x, '^[^ ]+', 0)"
    out = f"coalesce(map_extract({names}, {lower(head)})[1], {head}) || regexp_extract(x, ' .*$', 0)"
    for pattern, by in ((r"^(?i:gpl-)", "GPL-"), (r"^(?i:lgpl-)", "LGPL-"), (r"^(?i:agpl-)", "AGPL-"), (OLD_LATER, r"\1-or-later"), (OLD_ONLY, r"\1-only\2")):
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)})"
    return f"list_transform(flatten(list_transform(regexp_extract_all({text}, {quoted(TAG_LINE)}, 1), lambda line: {terms})), lambda x: {out})"


def normal(text: Column) -> Column:
    x = F.concat(F.lit("\n"), F.translate(lower_az(text), "|~", "##"))
    for pattern, by in STEPS:
        x = F.regexp_replace(x, pattern, by.format("", "$1"))
    return F.concat(F.lit("||"), F.regexp_replace(x, "[. ]+$", ""), F.lit("||"))


def alternatives(sentences: list[str]) -> str:
    """The sentences, longest first, those with the same first word together; a break may stand for any space."""
    by_first: dict[str, list[str]] = {}
    for s in sorted(sentences, key=lambda s: (-len(s), s)):
        first, _, rest = s.partition(" ")
        by_first.setdefault(first, []).append("".join("(?: |~~)" + w.replace(".", "[.]").replace("+", "[+]") for w in rest.split(" ")))
    return "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in by_first.items())


def sentence_pattern(sentences: dict[str, str]) -> str:
    """Known sentences where they count: long ones anywhere, also after a mark, others between marks."""
    long = [s for s in sentences.values() if len(s.split()) >= LONG]
    short = [s for s in sentences.values() if len(s.split()) < LONG]
    parts = ([rf"[|~]?\b(?:{alternatives(long)})\b"] if long else []) + ([f"[|~](?:{alternatives(short)})[|~]"] if short else [])
    return "|".join(parts)


def rule_pattern(rules: list[tuple[tuple[str, ...], str]]) -> str:
    return ",(?:" + "|".join(",,".join(sequence).replace(".", "[.]") for sequence, _ in sorted(rules, key=lambda r: (-len(r[0]), -len(",".join(r[0]))))) + "),"


def license_scans(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[tuple[str, ...], str]] = RULES) -> DataFrame:
    """One row for each document: doc_id, n_sentences (known ones), sentence_ids (comma-joined, in order), licences (comma-joined, sorted, each once) and n_matches.

    A null text counts as empty: no sentences. Rows with a null or repeated doc_id are
    scanned one by one; columns other than doc_id and text are not read.
    """
    known = F.create_map(*(F.lit(x) for i, s in sentences.items() for x in (s, i)))
    told = F.create_map(*(F.lit(x) for sequence, name in rules for x in ("," + ",,".join(sequence) + ",", name)))
    found = F.regexp_extract_all(normal(F.col("text")), F.lit(sentence_pattern(sentences)), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.btrim(F.replace(s, F.lit("~~"), F.lit(" ")), F.lit("|~"))))
    if all(any(t in s for t in TRIGGERS) for s in sentences.values()):
        some = lower_az(F.col("text"))
        ids = F.when(sum((F.contains(some, F.lit(t)).cast("int") for t in TRIGGERS), F.lit(0)) > 0, ids).otherwise(F.array().cast("array<string>"))
    out = whole(docs, "doc_id").select("doc_id", ids.alias("ids"), tags(F.col("text")).alias("tags"))
    joined = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    out = out.withColumn("matches", F.concat(F.transform(F.regexp_extract_all(joined, F.lit(rule_pattern(rules)), F.lit(0)), lambda m: F.try_element_at(told, m)), F.col("tags")))
    out = out.withColumn("ids", F.concat("ids", F.transform("tags", lambda x: F.concat(F.lit("spdx:"), lower_az(x)))))
    others = F.filter("matches", lambda m: m != LAST)
    counted = F.when(F.size(others) > 0, others).otherwise(F.col("matches"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct(counted)), ",").alias("licences"), F.size(counted).cast("long").alias("n_matches"))


def sql(sentences: dict[str, str] = SENTENCES, rules: list[tuple[tuple[str, ...], str]] = RULES) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    x = f"chr(10) || translate(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '|~', '##')"
    for pattern, by in STEPS:
        by = "chr(10)" if by == "\n" else quoted(by.format("", r"\1"))
        x = f"regexp_replace({x}, {quoted(pattern)}, {by}, 'g')"
    listed = lambda items: "[" + ", ".join(map(quoted, items)) + "]"
    known = f"MAP({listed(sentences.values())}, {listed(sentences)})"
    told = f"MAP({listed(',' + ',,'.join(s) + ',' for s, _ in rules)}, {listed(n for _, n in rules)})"
    return f"""
WITH normal AS (SELECT doc_id, '||' || regexp_replace({x}, '[. ]+$', '') || '||' AS x, {tags_sql("coalesce(text, '')")} AS tags FROM documents),
ids AS (SELECT doc_id, list_transform(regexp_extract_all(x, {quoted(sentence_pattern(sentences))}, 0), lambda s: map_extract({known}, trim(replace(s, '~~', ' '), '|~'))[1]) AS ids, tags FROM normal),
matches AS (SELECT doc_id, ids || list_transform(tags, lambda x: 'spdx:' || translate(x, '{UPPER_AZ}', '{LOWER_AZ}')) AS ids, list_transform(regexp_extract_all(',' || array_to_string(ids, ',,') || ',', {quoted(rule_pattern(rules))}, 0), lambda m: map_extract({told}, m)[1]) || tags AS matches FROM ids),
counted AS (SELECT doc_id, ids, CASE WHEN len(list_filter(matches, lambda m: m <> '{LAST}')) > 0 THEN list_filter(matches, lambda m: m <> '{LAST}') ELSE matches END AS m FROM matches)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(m)), ',') AS licences, len(m)::BIGINT AS n_matches FROM counted
"""
