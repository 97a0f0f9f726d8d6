"""Public notices by which licenses are declared: headers, one-liners and full texts. Fixed values.

Full texts of long licenses lie in ``licenses``, a file each. ``TELLING`` holds, for texts that
differ from a relative's in few places, the phrases of at most five words that name the license.
"""
import itertools
import re
from pathlib import Path

TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC0 dedication": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
    "this work.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT line": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means.",
}

_GNU = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        "Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU {name} for more details.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
             "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
             "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_ADVERT = ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
               "includes software developed by ")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
             "this software without specific prior written permission. ")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
             "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
             "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
             "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
             "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
             "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
          "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
          "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")

TELLING: dict[str, tuple[str, ...]] = {
    "GPL-3.0 line": ("gnu general public license", "version 3"),
    "GPL-3.0 header": ("gnu general public license", "version 3"),
    "MPL-2.0 header": ("v 2 0",),
    "Apache-2.0 header": ("version 2 0",),
}

for _license, _name, _version, _what in (
        ("GPL-1.0", "General Public License", "1", "program"), ("GPL-2.0", "General Public License", "2", "program"),
        ("LGPL-2.0", "Library General Public License", "2", "library"), ("LGPL-2.1", "Lesser General Public License", "2.1", "library"),
        ("LGPL-3.0", "Lesser General Public License", "3", "library"), ("AGPL-3.0", "Affero General Public License", "3", "program")):
    TEMPLATES[f"{_license} header"] = _GNU.format(what=_what, name=_name, version=_version)
    TELLING[f"{_license} header"] = (f"gnu {_name.lower()}", f"version {_version.replace('.', ' ')} of")

TEMPLATES |= {
    "BSD-2-Clause text": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause text": _BSD_HEAD + "3. " + _BSD_NAME + _BSD_TAIL,
    "BSD-4-Clause text": _BSD_HEAD + _BSD_ADVERT + "the organization. 4. " + _BSD_NAME + _BSD_TAIL,
    "BSD disclaimer": _BSD_TAIL,
    "MIT text": TEMPLATES["MIT permission"] + " " + _AS_IS,
    "ISC text": TEMPLATES["ISC permission"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
    "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE "
    "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0 permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "WTFPL text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as "
    "long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You "
    "just DO WHAT THE FUCK YOU WANT TO.",
    "MPL-1.1 header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is "
    "distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing "
    "rights and limitations under the License.",
    "EPL-2.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
    "available at http://www.eclipse.org/legal/epl-2.0",
    "EPL-1.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
    "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "AGPL-3.0 title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
}
TELLING |= {
    "BSD-3-Clause text": ("neither the name of",), "BSD-4-Clause text": ("all advertising materials mentioning", "neither the name of"),
    "MPL-1.1 header": ("version 1 1",), "EPL-2.0 header": ("public license 2 0",), "EPL-1.0 header": ("public license v1 0",),
    "AGPL-3.0 title": ("gnu affero general", "version 3 19 november 2007"),
}

for _file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
    TEMPLATES[f"{_file.stem} full text"] = _file.read_text(encoding="utf-8")
TELLING |= {f"{k} full text": v for k, v in {
    "GPL-1": ("version 1 february 1989",), "GPL-2": ("version 2 june 1991", "gnu general public license"),
    "GPL-3": ("version 3 29 june 2007", "gnu general public license"), "LGPL-2": ("version 2 june 1991", "gnu library general public"),
    "LGPL-2.1": ("version 2 1 february 1999", "gnu lesser general public"),
    "LGPL-3": ("version 3 29 june 2007", "gnu lesser general public"), "GFDL-1.2": ("version 1 2 november 2002",),
    "GFDL-1.3": ("version 1 3 3 november",)}.items()}

#: Names as lines give them.
_NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "BSD": ["BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": [
        "BSD 3-Clause License", "New BSD License", "3-Clause BSD License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "Eclipse Public License 1.0"], "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    **{f"{k}-{v}": [f"GNU {n} General Public License, version {v}".replace("  ", " "), f"GNU {n} General Public License v{v}".replace("  ", " "),
                    *([f"GNU {n} General Public License, version {v[0]}".replace("  ", " ")] if v.endswith(".0") else []),
                    *([f"GNU {n} General Public License v{v[0]}".replace("  ", " "), f"{k}v{v[0]}"] if v.endswith(".0") else [f"{k}v{v}"])]
       for k, n, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser", ("2.1", "3.0")), ("AGPL", "Affero", ("3.0",))) for v in versions},
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_KINDS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _line(license: str, name: str, start: str) -> None:
    """A one-line notice; every run of three words of the name must be there."""
    body = f"{start} {name}."
    if body not in TEMPLATES.values():
        key = f"{license} line: {body[:-1]}"
        words = re.sub(r"[\W_]+", " ", name.lower()).split()
        TEMPLATES[key] = body
        TELLING[key] = tuple(" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2)))


for _license, _given in _NAMES.items():
    for _name, _start in itertools.product(_given, ("Licensed under the", "Released under the", "Distributed under the", "under the terms of the")):
        _line(_license, _name, _start)
for (_short, _long), (_version, _kind) in itertools.product(_CC.items(), _KINDS.items()):
    for _start in ("Licensed under", "Released under"):
        _line(f"CC-{_short}-{_version}", f"CC {_short} {_version}", _start)
    _line(f"CC-{_short}-{_version}", f"Creative Commons {_long} {_version} {_kind} License", "licensed under the" if _version == "4.0" else "licensed under a")
    _line(f"CC-{_short}-{_version}", f"Creative Commons {_long} {_version} License", "licensed under the")
_line("CC0-1.0", "CC0 1.0", "Licensed under")
_line("CC0-1.0", "CC0 1.0 Universal", "Released under")
