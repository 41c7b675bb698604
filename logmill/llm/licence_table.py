"""Known licence sentences by identifier, and the ordered rules over identifiers.

Sentences that name a licence are built from its names; those of licence texts and notices stand as they are published.
"""

from __future__ import annotations

# Fixed values: (identifier stem, licence, full names, short names).  Short names need words before them.
NAMED = [
    ("mit", "MIT", ["MIT License"], ["MIT"]),
    ("mit-0", "MIT-0", ["MIT No Attribution License", "MIT No Attribution"], ["MIT-0"]),
    ("apache-2", "Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0"], ["Apache-2.0", "Apache 2.0", "ASL 2.0"]),
    ("bsd-2", "BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"], ["BSD-2-Clause"]),
    ("bsd-3", "BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD 3-Clause New or Revised License"], ["BSD-3-Clause"]),
    ("bsd-0", "0BSD", ["Zero-Clause BSD License", "BSD Zero Clause License", "Zero-Clause BSD"], ["0BSD"]),
    ("isc", "ISC", ["ISC License"], ["ISC"]),
    ("unlicense", "Unlicense", ["The Unlicense", "Unlicense License"], ["Unlicense"]),
    ("bsl", "BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"], ["BSL-1.0"]),
    ("zlib", "Zlib", ["zlib License", "zlib/libpng License"], ["zlib"]),
    ("mpl-1", "MPL-1.1", ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"], ["MPL-1.1", "MPL 1.1"]),
    ("mpl-2", "MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0"], ["MPL-2.0", "MPL 2.0"]),
    ("epl-1", "EPL-1.0", ["Eclipse Public License, version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"], ["EPL-1.0"]),
    ("epl-2", "EPL-2.0", ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"], ["EPL-2.0"]),
    ("cddl", "CDDL-1.0", ["Common Development and Distribution License, version 1.0", "Common Development and Distribution License 1.0"], ["CDDL-1.0"]),
    ("eupl", "EUPL-1.2", ["European Union Public License, version 1.2", "European Union Public Licence v. 1.2", "European Union Public License 1.2"], ["EUPL-1.2"]),
    ("artistic", "Artistic-2.0", ["Artistic License 2.0", "Artistic License, version 2.0"], ["Artistic-2.0"]),
    ("postgresql", "PostgreSQL", ["PostgreSQL License"], []),
    ("psf", "PSF-2.0", ["Python Software Foundation License Version 2", "Python Software Foundation License"], ["PSF-2.0"]),
    ("ncsa", "NCSA", ["University of Illinois/NCSA Open Source License"], ["NCSA"]),
    ("ofl", "OFL-1.1", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"], ["OFL-1.1"]),
    ("wtfpl", "WTFPL", ["Do What The F*ck You Want To Public License"], ["WTFPL"]),
    ("cc0", "CC0-1.0", ["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "Creative Commons Zero License"], ["CC0 1.0", "CC0-1.0", "CC0"]),
]
# Fixed values: (identifier stem, licence) of those known by their SPDX tag alone.
TAGGED = [("lgpl-2.0", "LGPL-2.0"), ("lgpl-2.0-only", "LGPL-2.0-only"), ("lgpl-2.0-or-later", "LGPL-2.0-or-later"), ("bsd-4", "BSD-4-Clause"), ("ms-pl", "MS-PL"), ("ms-rl", "MS-RL"), ("cc-by-2.0", "CC-BY-2.0"), ("cc-by-2.5", "CC-BY-2.5"), ("cc-by-sa-2.0", "CC-BY-SA-2.0"), ("cc-by-sa-2.5", "CC-BY-SA-2.5"), ("gfdl-1.3", "GFDL-1.3-or-later"), ("afl-3.0", "AFL-3.0"), ("osl-3.0", "OSL-3.0")]
# The families that are named by versions.
GNU = [("gpl", "GPL", "General", ["2", "3"]), ("lgpl", "LGPL", "Lesser General", ["2.1", "3"]), ("agpl", "AGPL", "Affero General", ["3"])]
CREATIVE_COMMONS = [("cc-by", "BY", "Attribution"), ("cc-by-sa", "BY-SA", "Attribution-ShareAlike"), ("cc-by-nc", "BY-NC", "Attribution-NonCommercial"), ("cc-by-nd", "BY-ND", "Attribution-NoDerivatives"), ("cc-by-nc-sa", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("cc-by-nc-nd", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CREATIVE_COMMONS_VERSIONS = ["3.0", "4.0"]
# Words before a name.
LEADS = [f"{who}{how} under" for who in ("", "This project is ", "This work is ", "This software is ", "This program is ", "This library is ", "This file is ", "This code is ", "Code is ") for how in ("licensed", "released", "distributed", "published", "available")]
LABELS = ["License:", "Licence:", "The license is", "License is"]

# Sentences of licence texts and notices, as published.
TEXTS = {
    "apache-2-name": ["Licensed under the Apache License, Version 2.0 (the License)", "The ASF licenses this file to You under the Apache License, Version 2.0 (the License)"],
    "apache-2-use": ["you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-warranty": [f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE" for what in ("program", "library", "software", "file")],
    "gpl-see": [f"See the GNU {kind} Public License for more details" for kind in ("General", "Lesser General", "Affero General")],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-0-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following", "Distributed under the Boost Software License, Version 1.0 (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "unlicense-release": ["This is free and unencumbered software released into the public domain"],
    "unlicense-free": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "mpl-2-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "epl-2-name": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "cc0-name": ["To the extent possible under law, the author has waived all copyright to this work"],
    "public-domain": ["This work is in the public domain", "Released into the public domain", "This file is in the public domain"],
    "reserved": ["All rights reserved"],
    "copyright": ["Copyright"],
    "mit-apache-dual": [f"{lead}{names}{tail}" for lead in ("Dual-licensed under ", "Dual licensed under ", "Licensed under either of ", "Licensed under ", "This project is dual-licensed under ") for a in ("MIT", "the MIT license", "MIT license") for b in ("Apache-2.0", "Apache 2.0", "Apache License, Version 2.0", "the Apache License, Version 2.0") for both in ("and", "or") for names in (f"{a} {both} {b}", f"{b} {both} {a}") for tail in ("", " at your option")],
    "heading": ["License", "Licence", "Licensing"],
}

# Rules over several sentences, in order of priority.
SEQUENCES = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-2-name", "apache-2-use", "apache-2-copy"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-name", "mit-grant"]),
    ("MIT-0", ["mit-0-name", "mit-grant"]),
    ("ISC", ["isc-name", "isc-grant"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("0BSD", ["bsd-0-grant", "isc-as-is"]),
    ("Unlicense", ["unlicense-release", "unlicense-free"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("MPL-2.0", ["mpl-2-name", "mpl-2-copy"]),
    ("BSL-1.0", ["bsl-name", "bsl-grant"]),
    ("all-rights-reserved", ["copyright", "reserved"]),
    ("MIT,Apache-2.0", ["mit-apache-dual"]),  # two licences
]
# Rules over one sentence of a licence text.
SINGLE = [("MIT", "mit-grant"), ("ISC", "isc-grant"), ("0BSD", "bsd-0-grant"), ("BSL-1.0", "bsl-grant"), ("Unlicense", "unlicense-release"), ("Zlib", "zlib-grant"), ("public-domain", "public-domain")]
#: Identifiers that alone are no sign of a licence.
SILENT = {"copyright", "reserved", "as-is", "isc-as-is", "zlib-as-is", "gpl-warranty", "gpl-see", "mit-notice", "mpl-2-copy", "heading", "unlicense-free"}


def _named() -> list[tuple[str, str, list[str], list[str]]]:
    out = list(NAMED)
    for stem, short, kind, versions in GNU:
        for v in versions:
            whole = v if "." in v else f"{v}.0"
            number = [v, whole] if whole != v else [v]
            names = [f"GNU {kind} Public License{x}" for n in number for x in (f" version {n}", f" v{n}", f" {n}")]
            own = stem if stem == "agpl" else f"{stem}-{v}"
            shorts = [x.format(n) for n in number for x in (f"{short} version {{}}", f"{short}v{{}}", f"{short}-{{}}", f"{short} {{}}", f"GNU {short}v{{}}", f"GNU {short} version {{}}")]
            out.append((own, f"{short}-{whole}", names, shorts))
            for end, words in (("only", ["only"]), ("or-later", ["or later", "or any later version", "or (at your option) any later version"])):
                out.append((f"{own}-{end}", f"{short}-{whole}-{end}", [f"{x} {w}" for x in names for w in words], [f"{short}-{whole}-{end}", *(f"{x} {w}" for x in shorts for w in words)]))
    for stem, short, kind in CREATIVE_COMMONS:
        for v in CREATIVE_COMMONS_VERSIONS:
            name = f"Creative Commons {kind} {v}"
            own = stem if v == "4.0" else f"{stem}-{v[0]}"
            names = [f"{a}{name}{tail}" for a in ("", "a ") for tail in ("", " License", " International", " International License", " Unported License")]
            out.append((own, f"CC-{short}-{v}", names, [f"CC {short} {v}", f"CC-{short}-{v}", f"CC {short.replace('-', ' ')} {v}"]))
    return out


def _headers() -> dict[str, tuple[str, list[str]]]:
    """The notices that the makers of the GNU licences advise: identifier to (licence, sentences)."""
    out = {}
    free = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License "
    for stem, short, kind, versions in GNU:
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            starts = [free.format(what, kind) for what in ("program", "library", "software", "file", "project")]
            later = [f"{s}as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version" for s in starts]
            only = [f"{s}{x}" for s in starts for x in (f"version {v} as published by the Free Software Foundation", f"as published by the Free Software Foundation, version {v}", f"as published by the Free Software Foundation, version {v} of the License", f"as published by the Free Software Foundation, either version {v} of the License only")]
            own = f"{stem}-free" if (stem, v) in (("gpl", "3"), ("lgpl", "2.1"), ("agpl", "3")) else f"{stem}-free-{v}"
            out[own] = (f"{name}-or-later", later)
            out[f"{own}-only"] = (f"{name}-only", only)
    return out


def build() -> tuple[dict[str, list[str]], list[tuple[str, list[str]]], dict[str, str]]:
    """(sentences by identifier, rules in order, identifier of each SPDX licence name in lower case)."""
    sentences = {k: list(v) for k, v in TEXTS.items()}
    rules, last, spdx = [*SEQUENCES], [], {}
    for name, (licence, forms) in _headers().items():
        sentences[name] = forms
        rules += [(licence, [name, "gpl-warranty", "gpl-see"]), (licence, [name])]
    for stem, licence, full, short in _named():
        led = [f"{lead} {the}{x}" for x in full + short for lead in LEADS for the in ("", "the ")] + [f"{label} {x}" for x in full + short for label in LABELS]
        sentences[f"{stem}-name"] = [*sentences.get(f"{stem}-name", []), *full, *(f"The {x}" for x in full), *led]
        last.append((licence, [f"{stem}-name"]))
        if short:
            sentences[f"{stem}-short"] = short
            rules.append((licence, ["heading", f"{stem}-short"]))
        sentences[f"spdx-{stem}"] = [f"SPDX-License-Identifier: {licence}"]
        spdx[licence.lower()] = f"spdx-{stem}"
        last.append((licence, [f"spdx-{stem}"]))
    for stem, licence in TAGGED:
        sentences[f"spdx-{stem}"] = [f"SPDX-License-Identifier: {licence}"]
        spdx[licence.lower()] = f"spdx-{stem}"
        last.append((licence, [f"spdx-{stem}"]))
    rules += [(licence, [name]) for licence, name in SINGLE] + last
    # names in use before "-only" and "-or-later"
    spdx |= {f"{k.removesuffix('-or-later')}+": v for k, v in spdx.items() if k.endswith("-or-later")}
    return sentences, rules, spdx
