import pytest

from bitext.llm import licences


def brute(text):
    """Sentences, licences and what is left, one text at a time."""
    import re

    known = licences.known_sentences()
    text = re.sub(r"(?i)(spdx-license-identifier):", r"\1", re.sub(r"(?i)\(see [^()\n]*\)", "", text or ""))
    cut = re.sub(r"([.!?;:])[ \t]+", r"\1\n", text).split("\n")
    found = [known[licences.normalised(s)] for s in cut if licences.normalised(s) in known]
    left, names = list(found), []
    for name, rule in licences.RULES:
        k, hit = 0, False
        while k + len(rule) <= len(left):
            if left[k : k + len(rule)] == rule:
                left[k : k + len(rule)] = [None]
                hit = True
            k += 1
        left = [x for x in left if x]
        if hit and name not in names:
            names.append(name)
    return found, names, names[0] if names else None, len(left)


TEXTS = [
    None, "", "No terms here.", "Released under the MIT License.\nText.", "text. Licensed under CC BY-NC 4.0. More text",
    "  This work is licensed under the GNU General Public License, version 3.  ", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Licensed under the MIT License (see LICENSE).", "This project is licensed under the Apache License, Version 2.0.\nThe code is licensed under the GNU LGPL v2.1.",
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later\ntext", "Distributed under the Boost Software License, Version 1.0.\nMIT",
    "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.\nReleased under the MIT License.", "I like the MIT License.", "You may obtain a copy of the License at\nhome",
    "\n".join(s for forms in licences.SENTENCES.values() for s in forms), "x\n" * 50_000 + "Released under CC0 1.0.",
]


def test_against_one_at_a_time(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, licence string")
    got = {r.doc_id: (r.licence_sentences, r.licences, r.licence, r.unmatched_sentences) for r in licences.scan(docs).collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_every_known_sentence_has_a_marker_and_a_rule():
    import re

    assert all(re.search(licences.MARKERS, s) for s in licences.known_sentences())
    assert {s for _, rule in licences.RULES for s in rule} == set(licences.known_sentences().values())


def test_every_form_is_found_alone(spark):
    forms = [(name, s) for name, f in licences.SENTENCES.items() for s in f] + [(n, f"{licences.TAG} {t}") for n, t in licences.TAGS.items()]
    forms += [(n, f"{p} {x}.") for p in licences.PREFIXES for n, f in licences.RELEASES.items() for x in f]
    docs = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: r.licence_sentences for r in licences.scan(docs).collect()}
    assert got == {k: [name] for k, (name, _) in enumerate(forms)}


def test_odd_and_empty(odd, none):
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).collect() == []


@pytest.mark.parametrize("name", ["Python", "Pandas", "Arrow"])
def test_plan_is_native(spark, odd, name):
    assert name not in licences.scan(spark.range(1).selectExpr("'x' AS text"))._jdf.queryExecution().executedPlan().toString()


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Copyright 2020 Somebody
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
LGPL = GPL.replace("General", "Lesser General").replace("This program is distributed", "This library is distributed")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy.
"""
NOTICES = [
    (LGPL, "LGPL-3.0-or-later", ["lgpl3_free", "library_hope", "gpl_merchant"]),
    (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later", ["agpl3_free", "gpl_hope", "gpl_merchant"]),
    (MPL, "MPL-2.0", ["mpl_terms", "mpl_copy"]),
    (ISC, "ISC", ["isc_grant", "isc_warranty"]),
    (EPL, "EPL-2.0", ["epl2_terms", "tag_epl2"]),
    (UNLICENSE, "Unlicense", ["unlicense_free"]),
    (MIT, "MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    (BSD2, "BSD-2-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary"]),
    (BSD3, "BSD-3-Clause", ["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse"]),
    (GPL, "GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_merchant"]),
    (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_merchant"]),
    (APACHE, "Apache-2.0", ["apache_release", "apache_compliance", "apache_copy", "apache_basis"]),
]


def test_wrapped_notices(spark):
    def ways(t):
        yield t
        yield t.replace("\n", "\r\n")
        yield t.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "iii) ")
        for mark in ("# ", "// ", " * ", ";; ", "dnl ", ".. ", '.\\" ', "C     ", "> "):
            yield "".join(mark + line + "\n" for line in t.splitlines())

    cases = [(t, name, found) for text, name, found in NOTICES for t in ways(text)]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licence_sentences, r.licences, r.licence, r.unmatched_sentences) for r in licences.scan(docs).collect()}
    assert got == {k: (found, [name], name, 0) for k, (_, name, found) in enumerate(cases)}


def test_no_sentence_over_a_blank_line(spark):
    docs = spark.createDataFrame([("Released under the\n\nMIT License.",), ("Released under the\nMIT License.\nLicensed under CC BY 4.0.",)], "text string")
    assert sorted(r.licence_sentences for r in licences.scan(docs).collect()) == [[], ["mit_release", "cc_by"]]


def test_sql_knows_wrapped_notices_too(spark, tmp_path):
    import duckdb

    from bitext.llm import queries

    texts = [*TEXTS, *[text for text, _, _ in NOTICES], *["".join(f"// {line}\r\n" for line in text.splitlines()) for text, _, _ in NOTICES]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {tuple(r) for r in queries.op8_licences(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        got = {tuple(r) for r in db.execute(queries.SQL["op8_licences"]).fetchall()}
    assert got == want
