"""Words of published licence texts and notices, with the phrases that a copy has to have."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Template:
    """A licence: the words of its text and its mandatory key phrases, in the order of the text.

    ``phrases`` are (position of the first word in the text, words); ``base`` marks the phrases
    whose places are counted as such.
    """

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False
    phrases: tuple[tuple[int, str], ...] = field(init=False)

    def __post_init__(self):
        words, found, at = words_of(self.text), [], 0
        for key in self.keys:
            k = words_of(key)
            at = next((i for i in range(at, len(words) - len(k) + 1) if words[i:i + len(k)] == k), -1)
            if at < 0 or not k:
                raise ValueError(f"{self.label}: key phrase {key!r} does not stand in the text after the one before")
            found.append((at, " ".join(k)))
            at += len(k)
        if not found:
            raise ValueError(f"{self.label}: a template needs a key phrase")
        object.__setattr__(self, "phrases", tuple(found))


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def cited(label: str, *keys: str, base: bool = False) -> Template:
    """A licence named by its key phrases alone."""
    return Template(label, " ".join(keys), keys, base)


# Phrases and labels of the base.
BASE = (
    cited("mit", "under the mit license", base=True),
    cited("apache-2", "apache license version 2", base=True),
    cited("cc-by-nc", "cc by nc", base=True),
)

# Published licence texts and notices, without the lines that name a holder or a year.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
MORE = (
    Template("mit", _MIT, ("permission is hereby granted free of charge to any person obtaining a copy", "of this software and associated documentation files")),
    Template("isc", _ISC, ("permission to use copy modify and or distribute this software", "for any purpose with or without fee")),
    Template("bsd", _BSD, ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    Template("apache-2", _APACHE, ("licensed under the apache license version 2 0", "the license you may not use this file except in compliance with the license")),
    Template("gpl-3", _GPL.format(3), ("gnu general public license", "either version 3")),
    Template("gpl-2", _GPL.format(2), ("gnu general public license", "either version 2")),
    Template("zlib", _ZLIB, ("this software is provided as is", "without any express or implied warranty")),
    Template("unlicense", _UNLICENSE, ("this is free and unencumbered software released into the public domain",)),
    Template("mpl-2", _MPL, ("subject to the terms of the mozilla public license",)),
    cited("gpl-3", "gnu general public license", "version 3"),
    cited("gpl-2", "gnu general public license", "version 2"),
    cited("lgpl", "gnu lesser general public license"),
    cited("agpl-3", "gnu affero general public license"),
    cited("cc0", "cc0 1 0 universal"),
    cited("cc-by-sa", "cc by sa"),
)
TEMPLATES = BASE + MORE
