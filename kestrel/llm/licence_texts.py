"""Public licence texts and standard notices by SPDX identifier, without their copyright lines. Long texts are files in licence_data."""

from importlib import resources

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: (identifier, whole text)
TEXTS = [
    ("MIT", _MIT_GRANT),
    ("MIT", f"MIT License\n\n{_MIT_GRANT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT_GRANT}"),
    ("ISC", f"{_ISC_GRANT}\n\n{_ISC_DISCLAIMER}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}\n\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT.partition(', provided')[0]}.\n\n{_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_DISCLAIMER),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_DISCLAIMER}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
]

#: (identifier, notice): one-line statements that stand for a licence.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: (identifier, file) of whole texts, and the line that ends their terms; what follows it (how to apply them) is often left out.
FILES = [
    ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-only", "GPL-2"), ("GPL-3.0-only", "GPL-3"), ("LGPL-2.1-only", "LGPL-2.1"), ("LGPL-3.0-only", "LGPL-3"),
    ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
]
END = "END OF TERMS AND CONDITIONS"
for _licence, _name in FILES:
    _whole = (resources.files("kestrel.llm") / "licence_data" / f"{_name}.txt").read_text("utf-8")
    _terms, _end, _ = _whole.partition(END)
    TEXTS += [(_licence, body) for body in ([_whole, _terms, _terms + _end] if _end else [_whole])]

#: Names by which notices call a licence, each in every form below.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPLv2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPLv3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
FORMS = [f"{head}{verb} under {the}" for head, verbs in (("", ("Licensed", "Released", "Distributed")), *((f"This {thing} is ", ("licensed", "released", "distributed")) for thing in ("project", "work", "software", "file", "document", "program", "code"))) for verb in verbs for the in ("", "the ", "a ")]
NOTICES += [(licence, f"{form}{name}.") for licence, names in NAMES.items() for name in names for form in FORMS]
NOTICES += [(licence, f"SPDX-License-Identifier: {licence}") for licence in NAMES]

#: (letters without which the pattern cannot match, pattern over lower-case text, replacement): spellings that the public
#: matching guidelines hold equal.
SPELLINGS = [
    ("://", "https?://", " "),
    ("&", "&", " and "),
    ("licence", "\\blicence", "license"),
    ("licen", "\\bsub[- ]licen[cs]e", "sublicense"),
    ("acknowledgement", "\\backnowledgement", "acknowledgment"),
    ("infringement", "\\bnon[- ]infringement", "noninfringement"),
    ("merchantib", "\\bmerchantibility", "merchantability"),
    ("version", "\\bversion\\b", "v"),
]
