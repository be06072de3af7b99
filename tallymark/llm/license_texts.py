"""Base phrases with their labels, and license statements to look for.

A statement is (label, text, key). ``key`` is a phrase of at most three words that a span must hold, which
tells licenses apart whose notices share most words; empty: none is asked for."""

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, name in notices, key)
NAMES = [
    ("mit", "MIT", "mit license"),
    ("isc", "ISC", "isc license"),
    ("bsd", "BSD", "bsd license"),
    ("bsd", "BSD 2-Clause", "bsd 2 clause"),
    ("bsd", "BSD 3-Clause", "bsd 3 clause"),
    ("bsd", "2-Clause BSD", "clause bsd"),
    ("bsd", "3-Clause BSD", "clause bsd"),
    ("zlib", "zlib", "zlib license"),
    ("gpl", "GNU General Public", "gnu general"),
    ("lgpl", "GNU Lesser General Public", "lesser general"),
    ("lgpl", "GNU Library General Public", "library general"),
    ("agpl", "GNU Affero General Public", "affero general"),
    ("mpl-2.0", "Mozilla Public", "mozilla public"),
    ("epl", "Eclipse Public", "eclipse public"),
    ("eupl", "European Union Public", "union public"),
    ("boost", "Boost Software", "boost software"),
    ("artistic", "Artistic", "artistic license"),
    ("apache-2.0", "Apache 2.0", "apache 2"),
    ("apache-2.0", "Apache", "apache license version"),
]
FORMS = [
    "Released under the {} License",
    "Licensed under the {} License",
    "Distributed under the {} License",
    "This software is licensed under the {} License",
    "This work is licensed under the {} License",
    "under the terms of the {} License",
]
#: identifier, label
IDENTIFIERS = {
    "MIT": "mit",
    "ISC": "isc",
    "0BSD": "bsd",
    "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd",
    "Zlib": "zlib",
    "Apache-2.0": "apache-2.0",
    "GPL-2.0": "gpl",
    "GPL-3.0": "gpl",
    "LGPL-2.1": "lgpl",
    "LGPL-3.0": "lgpl",
    "AGPL-3.0": "agpl",
    "MPL-2.0": "mpl-2.0",
    "EPL-2.0": "epl",
    "EUPL-1.2": "eupl",
    "BSL-1.0": "boost",
    "Artistic-2.0": "artistic",
    "CC0-1.0": "cc0",
    "Unlicense": "unlicense",
    "WTFPL": "wtfpl",
}
#: label, short name, long name, keys of both (a {} takes the first digit of the version)
COMMONS = [
    ("cc-by", "BY", "Attribution", "by {}", "attribution {}"),
    ("cc-by-sa", "BY-SA", "Attribution-ShareAlike", "by sa", "attribution sharealike"),
    ("cc-by-nc", "BY-NC", "Attribution-NonCommercial", "nc {}", "noncommercial {}"),
    ("cc-by-nd", "BY-ND", "Attribution-NoDerivatives", "by nd", "attribution noderivatives"),
    ("cc-by-nc-sa", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "nc sa", "noncommercial sharealike"),
    ("cc-by-nc-nd", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "nc nd", "noncommercial noderivatives"),
]
VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}

GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met"
)
CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts and notices of public licenses.
TEXTS = [
    ("reserved", "All rights reserved.", ""),
    ("mit", GRANT, "free of charge"),
    (
        "mit",
        f"{GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        f"the Software. {AS_IS}",
        "free of charge",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "appear in all",
    ),
    ("bsd", CONDITIONS, ""),
    ("bsd", f"{CONDITIONS}: 1. {CLAUSES} {DISCLAIMER}", ""),
    (
        "bsd",
        f"{CONDITIONS}: 1. {CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission. "
        f"{DISCLAIMER}",
        "",
    ),
    (
        "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
        "hereby granted the",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions",
        "",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered software"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
        "unencumbered software",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software",
        "covered by this",
    ),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", "boost software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license version"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "gnu general",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
        "lesser general",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "affero general",
    ),
    ("lgpl", "GNU Lesser General Public License, version 2.1", "lesser general"),
    ("lgpl", "GNU Lesser General Public License, version 3", "lesser general"),
    ("agpl", "GNU Affero General Public License, version 3", "affero general"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "mozilla public",
    ),
    (
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "eclipse public",
    ),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work.",
        "",
    ),
    ("cc0", "Dedicated to the public domain under CC0 1.0", "cc0 1"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ""),
]


def _statements() -> list[tuple[str, str, str]]:
    out = list(TEXTS)
    out += [(label, form.format(name), key) for label, name, key in NAMES for form in FORMS if key != "apache license version"]
    for name, label in IDENTIFIERS.items():
        first = " ".join(name.lower().split("-")[:1])
        out.append((label, f"SPDX-License-Identifier: {name}", f"identifier {first}"))
    for label, short, long, key, long_key in COMMONS:
        for version, scope in VERSIONS.items():
            digit = version[0]
            out.append((label, f"Licensed under CC {short} {version}", key.format(digit)))
            whole = f"This work is licensed under a Creative Commons {long} {version} {scope} License."
            out.append((label, whole, long_key.format(digit)))
            out.append((label, f"SPDX-License-Identifier: CC-{short}-{version}", key.format(digit)))
    return out


TEMPLATES = _statements()
