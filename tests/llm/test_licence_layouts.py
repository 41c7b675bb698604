"""Every known licence sentence and every rule, on one line and wrapped."""

import textwrap

import pytest

from logmill.llm import licences

LAYOUTS = {"line": str, "wrapped": lambda t: textwrap.fill(t, 60, break_on_hyphens=False, break_long_words=False), "comment": lambda t: textwrap.fill(t, 60, initial_indent=" * ", subsequent_indent=" * ", break_on_hyphens=False, break_long_words=False)}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_sentence_and_rule(layout):
    for name, forms in licences.SENTENCES.items():
        for form in forms:
            if name != "copyright" and not name.endswith("-short"):  # short names count after a heading alone
                assert name in licences.identifiers(LAYOUTS[layout](form + ".")), form
    for licence, names in licences.RULES:
        text = "\n\n".join(LAYOUTS[layout](licences.SENTENCES[n][0] + ".") for n in names)
        assert licences.match(licences.identifiers(text)) == licence.split(","), names


def test_standard_headers():
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law'
    assert licences.identifiers(apache) == ["apache-2-name", "apache-2-use", "apache-2-copy"]
    gpl = "    This program is free software; you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation; either version 2 of the License, or\n    (at your option) any later version.\n"
    assert licences.match(licences.identifiers(gpl)) == ["GPL-2.0-or-later"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ISC License", ["ISC"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", ["ISC"]),
        ("BSD 3-Clause License", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: AGPL-3.0", ["AGPL-3.0"]),
        ("// SPDX-License-Identifier: MPL-2.0\nint x;", ["MPL-2.0"]),
        ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0-only"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]),
        ("SPDX-License-Identifier: Nonesuch-9", ["unknown"]),
        ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Licensed under the GNU AGPLv3 or later.", ["AGPL-3.0-or-later"]),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("This code is released under the GNU General Public License v3.0 only.", ["GPL-3.0-only"]),
        ("## Licence\n\nMIT\n", ["MIT"]),
        ("MIT is a school.", []),
        ("(c) 2020 Some One. All rights reserved.", ["all-rights-reserved"]),
        ("Copyright 2001-2020 " + "A Very Long Holder " * 200 + ". All rights reserved.", ["all-rights-reserved"]),
        ("Licensed   under " + " " * 5000 + " the\tMIT License.", ["MIT"]),
        ("Licenced under the MIT Licence.", ["MIT"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("They worked under the old rules. No licence is named here.", []),
    ],
)
def test_notices_met_in_files(text, want):
    assert licences.match(licences.identifiers(text)) == want


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
ENDORSE = "may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"


@pytest.mark.parametrize("holder", ["the copyright holder", "Foo Inc.", "the University of\n   Nowhere, Dept. of Things", "Google LLC", "mypy", "the <organization>"])
@pytest.mark.parametrize("prefix", ["", " * ", "# "])
def test_a_bsd_3_text_with_any_holder_is_never_bsd_2(holder, prefix):
    dress = lambda t: "\n".join(prefix + x for x in t.split("\n"))
    assert licences.match(licences.identifiers(dress(BSD + f"3. Neither the name of {holder} nor the names of its\n   contributors {ENDORSE}"))) == ["BSD-3-Clause"]
    assert licences.match(licences.identifiers(dress(BSD + f"3. The name of {holder} may not be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"))) == ["BSD-3-Clause"]
    assert licences.match(licences.identifiers(dress(BSD))) == ["BSD-2-Clause"]


def test_foundation_header_dual_forms_and_older_tags():
    asf = "Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file\ndistributed with this work for additional information\nregarding copyright ownership.  The ASF licenses this file\nto you under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.  You may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0\n"
    assert licences.match(licences.identifiers(asf)) == ["Apache-2.0"]
    for text in ("Dual-licensed under MIT and Apache-2.0.", "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option."):
        assert sorted(licences.match(licences.identifiers(text))) == ["Apache-2.0", "MIT"]
    for name in ("LGPL-2.0", "BSD-4-Clause", "MS-PL", "CC-BY-2.0"):
        assert licences.match(licences.identifiers(f"SPDX-License-Identifier: {name}")) == [name]


def brute(text):
    """Every run of whole words of a text that is a known sentence, without the splitters: longest first, from left to right."""
    words = licences.normalise(text).split()
    lengths = sorted({len(k.split()) for k in licences.KNOWN if len(k.split()) > 1}, reverse=True)
    first = {k.split()[0] for k in licences.KNOWN}
    out, i = [], 0
    while i < len(words):
        n = next((n for n in lengths if " ".join(words[i : i + n]) in licences.KNOWN), 0) if words[i] in first else 0
        if n:
            out.append(licences.KNOWN[" ".join(words[i : i + n])])
        i += n or 1
    return [x for x in out if x not in ("copyright", "reserved", "heading")]


def test_documents_against_a_search_without_sentences(spark):
    from conftest import SF

    from logmill.llm import common

    seen = 0
    for r in common.table(spark, SF, "documents").collect():
        got = {x for x in licences.identifiers(r.text) if x not in ("copyright", "reserved", "heading") and not x.endswith("-short")}
        assert got <= set(brute(r.text or "")), r.doc_id
        seen += bool(got)
        assert got == set(brute(r.text or "")), r.doc_id
    assert seen
