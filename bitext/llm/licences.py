"""Licence scans by sentence rules.

A text's lines are normalised and known licence sentences found in them, wrapped or not; the identifiers in
their order are then matched against ordered rules, longest and most specific first, and what a rule took is not matched
again.  All in DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import without

RESULT = ["licence_sentences", "licences", "licence", "unmatched_sentences"]

# Known sentences by identifier, as their licences have them.
SENTENCES = {
    "mit_release": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This work is licensed under the MIT License."],
    "mit_grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit_warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache_release": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This work is licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "apache_compliance": ["you may not use this file except in compliance with the License."],
    "apache_copy": ["You may obtain a copy of the License at"],
    "apache_basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3_release": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "gpl2_release": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "gpl_free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2_free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl_merchant": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd_redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0, no rights reserved under copyright."],
    "all_rights": ["All rights reserved under copyright.", "Copyright, all rights reserved."],
    "lgpl3_free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl_free_old": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl_free_old": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "version2_later": ["either version 2 of the License, or (at your option) any later version."],
    "version21_later": ["either version 2.1 of the License, or (at your option) any later version."],
    "version3_later": ["either version 3 of the License, or (at your option) any later version."],
    "agpl3_free": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "library_hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "mpl_terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "mpl_copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc_grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "isc_warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "unlicense_free": ["This is free and unencumbered software released into the public domain."],
    "epl2_terms": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "epl1_terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "zlib_warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}

# How a release is said, and what the licences are called in one.
PREFIXES = [
    "Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This software is licensed under",
    "This program is licensed under", "This library is licensed under", "This file is licensed under", "The code is licensed under", "This project is released under",
]
RELEASES = {
    "mit_release": ["the MIT License", "the terms of the MIT License", "the MIT license"],
    "apache_release": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "the terms of the Apache License, Version 2.0"],
    "gpl3_release": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3"],
    "gpl2_release": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2"],
    "lgpl3_release": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3"],
    "lgpl21_release": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1"],
    "agpl3_release": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3"],
    "mpl_release": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"],
    "bsd3_release": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the Modified BSD License"],
    "bsd2_release": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "isc_release": ["the ISC License"],
    "epl2_release": ["the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"],
    "boost_release": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "zlib_release": ["the zlib License"],
    "unlicense_release": ["the Unlicense"],
    "cc_by": ["CC BY 4.0"], "cc_by_sa": ["CC BY-SA 4.0"], "cc_by_nc": ["CC BY-NC 4.0"], "cc0": ["CC0 1.0"],
}
# Licences by their names in a tag of a file's head, "SPDX-License-Identifier: <name>".
TAG = "SPDX-License-Identifier:"
TAGS = {
    "tag_mit": "MIT", "tag_apache": "Apache-2.0", "tag_gpl3": "GPL-3.0-only", "tag_gpl3_later": "GPL-3.0-or-later", "tag_gpl2": "GPL-2.0-only",
    "tag_gpl2_later": "GPL-2.0-or-later", "tag_lgpl3": "LGPL-3.0-only", "tag_lgpl3_later": "LGPL-3.0-or-later", "tag_lgpl21": "LGPL-2.1-only",
    "tag_lgpl21_later": "LGPL-2.1-or-later", "tag_agpl3": "AGPL-3.0-only", "tag_agpl3_later": "AGPL-3.0-or-later", "tag_mpl": "MPL-2.0", "tag_bsd3": "BSD-3-Clause",
    "tag_bsd2": "BSD-2-Clause", "tag_isc": "ISC", "tag_epl2": "EPL-2.0", "tag_epl1": "EPL-1.0", "tag_boost": "BSL-1.0", "tag_zlib": "Zlib", "tag_unlicense": "Unlicense",
    "tag_cc0": "CC0-1.0", "tag_cc_by": "CC-BY-4.0", "tag_cc_by_sa": "CC-BY-SA-4.0", "tag_cc_by_nc": "CC-BY-NC-4.0",
}

# Rules in the order in which they are tried; a rule is sentence identifiers that follow each other.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache_release", "apache_compliance", "apache_copy", "apache_basis"]),
    ("Apache-2.0", ["apache_release", "apache_compliance"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_merchant"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_merchant"]),
    ("BSD-3-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-3.0-only", ["gpl3_release"]),
    ("GPL-2.0-only", ["gpl2_release"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_release"]),
    ("Apache-2.0", ["apache_release"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC0-1.0", ["cc0"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "library_hope", "gpl_merchant"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("LGPL-2.1-or-later", ["lgpl_free_old", "version21_later", "library_hope", "gpl_merchant"]),
    ("LGPL-2.1-or-later", ["lgpl_free_old", "version21_later"]),
    ("LGPL-3.0-or-later", ["lgpl_free_old", "version3_later"]),
    ("GPL-2.0-or-later", ["gpl_free_old", "version2_later", "gpl_hope", "gpl_merchant"]),
    ("GPL-2.0-or-later", ["gpl_free_old", "version2_later"]),
    ("GPL-3.0-or-later", ["gpl_free_old", "version3_later"]),
    ("AGPL-3.0-or-later", ["agpl3_free", "gpl_hope", "gpl_merchant"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("LGPL-3.0-only", ["lgpl3_release"]),
    ("LGPL-2.1-only", ["lgpl21_release"]),
    ("AGPL-3.0-only", ["agpl3_release"]),
    ("MPL-2.0", ["mpl_terms", "mpl_copy"]),
    ("MPL-2.0", ["mpl_terms"]),
    ("MPL-2.0", ["mpl_release"]),
    ("BSD-3-Clause", ["bsd3_release"]),
    ("BSD-2-Clause", ["bsd2_release"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_release"]),
    ("EPL-2.0", ["epl2_terms"]),
    ("EPL-2.0", ["epl2_release"]),
    ("EPL-1.0", ["all_rights", "epl1_terms"]),
    ("EPL-1.0", ["epl1_terms"]),
    ("BSL-1.0", ["boost_release"]),
    ("Zlib", ["zlib_warranty", "zlib_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("Zlib", ["zlib_release"]),
    ("Unlicense", ["unlicense_free"]),
    ("Unlicense", ["unlicense_release"]),
    *[(licence, [tag]) for tag, licence in TAGS.items()],
    ("Proprietary", ["all_rights"]),
]

#: Every known sentence has one of these, so that a text without any has no licence sentence.
MARKERS = "licen[sc]|copyright|permission|warrant|redistribut|cc0|cc by|gnu|mozilla|public domain"

#: A line end and what is before the text of the next line: marks, words that open a comment, a number in a list.
TAG_HEAD = r"(spdx-license-identifier):[ \t]*"
SEE_TAIL = r"\(see [^()\n]{0,200}\)"
LINE_START = r"\n[^a-z0-9\n]*(?:(?:dnl|rem|c)[ \t]+[^a-z0-9\n]*)?(?:(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})[.)][ \t]*(?=[a-z]))?"


def normalised(sentence: str) -> str:
    """Lower case, every run of other characters than letters, digits and dots inside numbers a blank."""
    text = re.sub(r"[^a-z0-9.]+", " ", sentence.lower())
    return re.sub(r"\.+( |$)", r"\1", text).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier."""
    said = {normalised(s): name for name, forms in SENTENCES.items() for s in forms}
    released = {normalised(f"{p} {form}."): name for p in PREFIXES for name, forms in RELEASES.items() for form in forms}
    return {**said, **released, **{normalised(f"{TAG} {licence}"): name for name, licence in TAGS.items()}}


def lines(text: Column) -> Column:
    """A text's normalised lines, each between line ends; a blank line stands where a sentence ends inside or at the end of one.

    Marks of comments and list numbers at the start of a line are no part of it, nor is a tail like "(see LICENSE)".
    """
    out = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, TAG_HEAD, "$1 "), SEE_TAIL, " ")
    out = F.regexp_replace(out, LINE_START, "\n")
    out = F.regexp_replace(out, r"([.!?;:])(?:[ \t]+|\r?\n)", "$1\n\n")
    out = F.regexp_replace(out, r"[^a-z0-9.\n]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\.+(?=[ \n])", ""), r" *\n *", "\n")


def sentence_pattern(gap: str = r"[ \n]") -> str:
    """All known sentences; of those that begin alike the longest first.  ``gap`` is what may stand between words."""
    def spelt(sentences):
        forms = sorted(set(sentences), key=lambda s: (-len(s), s))
        return "|".join(s.replace(".", r"\.").replace(" ", gap) for s in forms)

    said = [normalised(s) for forms in SENTENCES.values() for s in forms]
    called = [normalised(f"{form}.") for forms in RELEASES.values() for form in forms]
    tagged = [normalised(licence) for licence in TAGS.values()]
    released = f"(?:{spelt(map(normalised, PREFIXES))}){gap}(?:{spelt(called)})"
    return f"{spelt(said)}|{released}|{normalised(TAG).replace(' ', gap)}{gap}(?:{spelt(tagged)})"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with licence_sentences, licences, licence, unmatched_sentences.

    Identifiers of the known sentences in order; the licences whose rules match, in the order of the rules, each once; the first
    of them; and how many known sentences no rule took.  Null or empty texts, and texts without known sentence: empty
    arrays, null, 0.  A sentence may be wrapped over lines, also in a comment, but not over a blank one.  Repeated rows are rows of their own.  Columns named like a
    result column give way.  An empty table gives an empty one.
    """
    table = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    whole = F.coalesce(F.col(text), F.lit(""))
    # Known sentences fill whole lines, one or several.
    said = F.regexp_extract_all(lines(whole), F.lit(rf"\n({sentence_pattern()})(?=\n)"), 1)
    found = F.transform(said, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    marked = F.lower(whole).rlike(MARKERS)
    rows = docs.select(
        F.struct(*without(docs, RESULT)).alias("row"), F.when(marked, found).otherwise(F.array().cast("array<string>")).alias("licence_sentences")
    )
    left = F.concat(F.lit("<"), F.array_join("licence_sentences", "><"), F.lit(">"))
    rows = rows.withColumn("left", F.when(F.size("licence_sentences") > 0, left).otherwise(""))
    hits = []
    for k, (name, sequence) in enumerate(RULES):
        pattern = "".join(f"<{s}>" for s in sequence)
        rows = rows.withColumn(f"hit{k}", F.when(F.contains("left", F.lit(pattern)), F.lit(name))).withColumn("left", F.replace("left", F.lit(pattern), F.lit("")))
        hits.append(F.col(f"hit{k}"))
    licences = F.array_distinct(F.array_compact(F.array(*hits)))
    return rows.select(
        "row.*", "licence_sentences", licences.alias("licences"), F.get(licences, 0).alias("licence"),
        F.length(F.regexp_replace("left", "[^<]", "")).alias("unmatched_sentences"),
    )
