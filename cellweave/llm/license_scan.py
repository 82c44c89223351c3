"""Licence scans by sentences: known sentences become identifiers, and ordered rules match identifier sequences."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences by their SPDX identifiers, with their class and the names that notices call them by.
LICENSES = {
    "Apache-2.0": ("permissive", ("apache license version 2 0", "apache license 2 0", "apache 2 0 license")),
    "MIT": ("permissive", ("mit license",)),
    "MIT-0": ("permissive", ("mit no attribution license",)),
    "BSD-2-Clause": ("permissive", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    "BSD-3-Clause": ("permissive", ("bsd 3 clause license", "3 clause bsd license", "new bsd license")),
    "0BSD": ("permissive", ("bsd zero clause license",)),
    "ISC": ("permissive", ("isc license",)),
    "Zlib": ("permissive", ("zlib license",)),
    "BSL-1.0": ("permissive", ("boost software license version 1 0", "boost software license 1 0")),
    "Artistic-2.0": ("permissive", ("artistic license 2 0",)),
    "PostgreSQL": ("permissive", ("postgresql license",)),
    "NCSA": ("permissive", ("university of illinois ncsa open source license",)),
    "MS-PL": ("permissive", ("microsoft public license",)),
    "OFL-1.1": ("permissive", ("sil open font license version 1 1",)),
    "Unlicense": ("public-domain", ("unlicense",)),
    "CC0-1.0": ("public-domain", ("cc0 1 0 universal license", "creative commons zero v1 0 universal license")),
    "WTFPL": ("public-domain", ("do what the fuck you want to public license",)),
    "GPL-2.0": ("copyleft", ("gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0", "gpl version 2")),
    "GPL-3.0": ("copyleft", ("gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0", "gpl version 3")),
    "LGPL-2.1": ("weak-copyleft", ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl v2 1", "lgplv2 1")),
    "LGPL-3.0": ("weak-copyleft", ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lesser general public license v3", "lgpl v3", "lgplv3")),
    "AGPL-3.0": ("copyleft", ("gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu affero general public license v3", "agpl v3", "agplv3")),
    "MPL-1.1": ("weak-copyleft", ("mozilla public license version 1 1", "mozilla public license 1 1", "mozilla public license v1 1")),
    "MPL-2.0": ("weak-copyleft", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0")),
    "EPL-1.0": ("weak-copyleft", ("eclipse public license version 1 0", "eclipse public license v1 0")),
    "EPL-2.0": ("weak-copyleft", ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0")),
    "CDDL-1.0": ("weak-copyleft", ("common development and distribution license version 1 0",)),
    "EUPL-1.2": ("copyleft", ("european union public licence version 1 2", "eupl version 1 2")),
    "CC-BY-4.0": ("permissive", ("cc by 4 0", "creative commons attribution 4 0 international license")),
    "CC-BY-SA-4.0": ("copyleft", ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license")),
    "CC-BY-NC-4.0": ("non-commercial", ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license")),
    "CC-BY-ND-4.0": ("no-derivatives", ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license")),
    "CC-BY-NC-SA-4.0": ("non-commercial", ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license")),
    "CC-BY-NC-ND-4.0": ("non-commercial", ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license")),
}
# How notices begin, before the name of the licence.
NOTICES = (
    "licensed under", "licensed under the", "released under", "released under the", "distributed under the", "available under the", "this project is licensed under the",
    "this work is licensed under the", "this work is licensed under a", "this work is licensed under", "this software is licensed under the", "this file is licensed under the",
    "this software is released under the", "this project is released under the", "the source code is licensed under the", "use of this source code is governed by the",
)
# The wording of well-known licence sentences, normalised (lower case, only a-z and 0-9, single spaces).
WORDING = {
    "licensed under the apache license version 2 0 the license": "Apache-2.0_NOTICE",
    "you may not use this file except in compliance with the license": "APACHE2_COMPLIANCE",
    "you may obtain a copy of the license at": "APACHE2_COPY",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_CONDITION",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAME",
    "this program is free software": "GPL_FREE",
    "this library is free software": "GPL_FREE",
    "you should have received a copy of the gnu general public license along with this program": "GPL_COPY",
    "all rights reserved": "ALL_RIGHTS",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_WARRANTY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZERO_BSD_GRANT",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB_GRANT",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL_GRANT",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_GRANT",
    "this source code form is subject to the terms of the mozilla public license v2 0": "MPL2_NOTICE",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "MPL11_NOTICE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "EPL2_NOTICE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which is available at": "EPL2_NOTICE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution": "EPL2_NOTICE",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "EPL1_NOTICE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "EPL1_NOTICE",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "CDDL_NOTICE",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0_GRANT",
    "this font software is licensed under the sil open font license version 1 1": "OFL_NOTICE",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WTFPL_COPY",
}
#: The GNU licences' names in notices, with the licences of their versions.
_GNU = {"gnu general public license": {"2": "GPL-2.0", "3": "GPL-3.0"}, "gnu lesser general public license": {"2 1": "LGPL-2.1", "3": "LGPL-3.0"}, "gnu affero general public license": {"3": "AGPL-3.0"}}


def _sentence_table() -> dict[str, str]:
    """Known sentences and their identifiers: the fixed wording, and what follows from names by rule."""
    out = dict(WORDING)
    for spdx, (_, names) in LICENSES.items():
        code = " ".join("".join(c if c.isalnum() else " " for c in spdx.lower()).split())
        for form in ("", " or later", " only"):
            out[f"spdx license identifier {code}{form}"] = f"{spdx}_SPDX"
        for start, name in ((s, n) for s in NOTICES for n in names):
            out[f"{start} {name}"] = f"{spdx}_NOTICE"
    for name, versions in _GNU.items():
        # the same with semicolons, which end sentences: who publishes it, then which version
        out[f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"] = f"{name.upper().replace(' ', '_')}_BY"
        for version, spdx in versions.items():
            out[f"either version {version} of the license or at your option any later version"] = out[f"version {version} of the license"] = f"GNU_VERSION_{version.replace(' ', '_')}"
            terms = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {version} of the license or at your option any later version"
            out[terms] = f"{spdx}_TERMS"
            out[terms.replace("either version", "version").split(" or at your")[0]] = f"{spdx}_TERMS"
    return out


#: Sentence -> identifier.
SENTENCES = _sentence_table()
#: Identifiers that follow each other among a text's known sentences; grants stand before notices, notices before reservations.
GRANTS = (
    ("Apache-2.0", ("Apache-2.0_NOTICE", "APACHE2_COMPLIANCE", "APACHE2_COPY")),
    ("MIT", ("MIT_GRANT", "MIT_CONDITION")),
    ("MIT-0", ("MIT_GRANT_0",)),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("ISC", ("ISC_GRANT",)),
    ("0BSD", ("ZERO_BSD_GRANT",)),
    ("Zlib", ("ZLIB_GRANT",)),
    ("BSL-1.0", ("BSL_GRANT",)),
    ("Unlicense", ("UNLICENSE_GRANT",)),
    ("CC0-1.0", ("CC0_GRANT",)),
    ("WTFPL", ("WTFPL_COPY",)),
    ("AGPL-3.0", ("AGPL-3.0_TERMS",)),
    ("LGPL-3.0", ("LGPL-3.0_TERMS",)),
    ("LGPL-2.1", ("LGPL-2.1_TERMS",)),
    ("GPL-3.0", ("GPL-3.0_TERMS",)),
    ("GPL-2.0", ("GPL-2.0_TERMS",)),
    ("MPL-2.0", ("MPL2_NOTICE",)),
    ("MPL-1.1", ("MPL11_NOTICE",)),
    ("EPL-2.0", ("EPL2_NOTICE",)),
    ("EPL-1.0", ("EPL1_NOTICE",)),
    ("CDDL-1.0", ("CDDL_NOTICE",)),
    ("OFL-1.1", ("OFL_NOTICE",)),
)
_STRICT_FIRST = ("non-commercial", "no-derivatives", "copyleft", "weak-copyleft", "permissive", "public-domain")


def _rule_table() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """(licence, class, identifiers): the first rule that matches decides; of notices the stricter class comes first."""
    named = sorted(LICENSES, key=lambda x: _STRICT_FIRST.index(LICENSES[x][0]))
    split = [(spdx, (f"{name.upper().replace(' ', '_')}_BY", f"GNU_VERSION_{v.replace(' ', '_')}")) for name, versions in _GNU.items() for v, spdx in versions.items()]
    rules = [*GRANTS, *split, *((x, (f"{x}_{kind}",)) for x in named for kind in ("SPDX", "NOTICE"))]
    known = set(SENTENCES.values())
    return *((x, LICENSES[x][0], need) for x, need in rules if known.issuperset(need)), ("proprietary", "reserved", ("ALL_RIGHTS",))


RULES = _rule_table()
#: Marks of a sentence's end (also a dash between spaces, a blank line, of comments too, and a link) and of a line's end inside a sentence.
SENTENCE_END, LINE_END = r"[.!?:;][ \t\n\r]+|[ \t]+[-\x{2013}\x{2014}]+[ \t]+|\r?\n[^a-z0-9\n\r]*\r?\n|[ \t\n\r*#/]+https?://", r"[\n\r]+"
_ANY = r"[ ~]+"
#: What is done to a lower-case text in turn, as (pattern, replacement with \1 for its group): a tag of SPDX for each licence of an
#: expression, of up to four; "v. 2" is no sentence's end, and neither is the colon of such a tag; sentences end in |, lines
#: inside them in ~; everything else becomes single spaces; the name of whoever holds the BSD licence's rights is made one.
STEPS = (
    *[(r"(spdx-license-identifier:[^\n\r.]*?(?:\.[0-9][^\n\r.]*?)*)[ \t)]+(?:or|and)[ \t(]+", r"\1. spdx-license-identifier: ")] * 3,
    (r"\bv\.[ \t]*([0-9])", r"v\1"),
    (r"identifier:[ \t]+", "identifier "),
    (SENTENCE_END, "|"),
    (LINE_END, "~"),
    ("[^a-z0-9|~]+", " "),
    (_ANY.join(("neither", "the", "name", "of", "[a-z0-9 ~|]{1,200}?[ ~|]nor", "the", "names", "of", "its", "contributors")), "neither the name of the copyright holder nor the names of its contributors"),
)


def _triggers() -> list[str]:
    """Words, long ones, of which every known sentence holds one: the most common first, until all sentences are covered."""
    left, out = list(SENTENCES), []
    while left:
        counts = Counter(w for x in left for w in set(x.split()) if len(w) >= min(6, max(map(len, x.split()))))
        out.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [x for x in left if out[-1] not in x]
    return out


#: A text without any of these words has no known sentence.
TRIGGERS = _triggers()
#: Sentences that end otherwise are not looked up.
_LAST_WORDS = sorted({x.split()[-1] for x in SENTENCES})
#: No known sentence has more lines, as each has a word.
_MOST_LINES = max(len(x.split()) for x in SENTENCES) + 1


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a lower-case text, in order.

    A sentence may be wrapped over lines: from the first of its lines on that begins a known sentence which ends with it,
    it is read as one, and lines before that are read alone.
    """
    marked = text
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to.replace("\\1", "$1"))
    sentences = F.split(marked, " ?[|] ?")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(SENTENCES.items())])
    known = list(SENTENCES)  # a set of over ten literals is looked up by hash

    def of_lines(lines):
        tail = lambda i: F.array_join(F.slice(lines, i, F.size(lines)), " ")
        from_line = F.filter(F.sequence(F.greatest(F.lit(1), F.size(lines) - _MOST_LINES), F.size(lines)), lambda i: tail(i).isin(known))
        may_end = F.substring_index(F.element_at(lines, -1), " ", -1).isin(_LAST_WORDS)
        begin = F.coalesce(F.when(may_end, F.get(from_line, F.lit(0))), F.size(lines) + 1)
        alone = F.filter(F.slice(lines, F.lit(1), begin - 1), lambda x: x.isin(known))
        return F.when(begin <= F.size(lines), F.concat(alone, F.array(tail(begin)))).otherwise(alone)

    found = F.transform(sentences, lambda s: F.when(F.contains(s, F.lit("~")), of_lines(F.transform(F.split(s, "~"), lambda x: F.trim(x)))).otherwise(F.filter(F.array(F.trim(s)), lambda x: x.isin(known))))
    return F.transform(F.flatten(found), lambda s: F.element_at(table, s))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, sentence_ids, n_license_sentences, rule (1 for the first; 0: none), license, license_class.

    sentence_ids holds the identifiers of the known sentences in order, joined by ">". A text that is null or empty or
    has no known sentence gives "", 0, 0, "none", "none"; known sentences that no rule matches give "unknown". Repeated
    rows come out repeated, null ids stay, other columns are not read. Sentences wrapped over lines, with or without
    comment marks, count too, a licence's notice may end in a dash, and of an SPDX expression every licence counts (of up to
    four). No shuffle takes place.
    """
    lower = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    may = reduce(or_, [F.contains("text", F.lit(w)) for w in TRIGGERS])
    out = docs.select(F.col(id_col).alias("id"), lower.alias("text"))
    out = out.select("id", F.when(may, _identifiers(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    out = out.select("id", F.array_join("ids", ">").alias("sentence_ids"), F.size("ids").cast("long").alias("n_license_sentences"))
    sequence = F.concat(F.lit(">"), "sentence_ids", F.lit(">"))
    rule = F.lit(0)
    for k, (_, _, need) in reversed(list(enumerate(RULES, 1))):
        rule = F.when(F.contains(sequence, F.lit(f">{'>'.join(need)}>")), F.lit(k)).otherwise(rule)
    out = out.withColumn("rule", rule.cast("long"))
    none = F.when(F.col("n_license_sentences") == 0, "none").otherwise("unknown")
    named = F.array(*[F.lit(r[0]) for r in RULES]), F.array(*[F.lit(r[1]) for r in RULES])
    columns = [F.when(F.col("rule") > 0, F.try_element_at(n, F.col("rule").cast("int"))).otherwise(none).alias(c) for n, c in zip(named, ("license", "license_class"), strict=True)]
    return out.select(F.col("id").alias(id_col), "sentence_ids", "n_license_sentences", "rule", *columns)
