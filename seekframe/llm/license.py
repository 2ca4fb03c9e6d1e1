"""License scans by conditional compression.

The words around each cue of a candidate block are compressed alone and with each template as a zstandard raw dictionary; the templates
are ranked by how much smaller they make them, and all that do are confirmed.  These windows reach as far as a template may, so what is found doesn't depend on how long
a line or block is.  A winner is confirmed by the exact differences in wording between it and the best-matching stretch
of the window: nothing may be missing or added but what its open places ({year}, {holder}) take up, or the match is reported as modified.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT = _MIT_GRANT + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_KEEP = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GPL_END = """ This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""


def _gpl(kind: str, version: str) -> str:
    return (_GPL + _GPL_END).replace("{kind}", kind).replace("{version}", version)


#: (license, template).  {…} stands for up to eight words of any kind.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT_GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _gpl("General Public License", "3")),
    ("GPL-2.0", _gpl("General Public License", "2")),
    ("GPL", _GPL.replace("{kind}", "General Public License")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gpl("Lesser General Public License", "3")),
    ("LGPL-2.1", _gpl("Lesser General Public License", "2.1")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gpl("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("BSD", _BSD_GRANT),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_END),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", _ISC_GRANT + _ISC_KEEP),
    ("ISC", _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("0BSD", _ISC_GRANT + "." + _ISC_END),
    ("Zlib", _ZLIB),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "Copyright {year} {holder}. All rights reserved."),
)
#: A declared license; it needs no ranking, only its wording.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][\w.+-]*\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][\w.+-]*\)?)*)")
#: What every template, changed in a few words, still shows.  The JVM passes over texts without it.
CUE = r"(?i)licen[sc]e|copyright|\(c\)|©|public domain|permission|redistribut|warrant|all rights reserved|\bCC[ -]BY|\bCC0\b|SPDX"
#: Lines of a block before and after one with a cue, that are joined to it if they have cues themselves or stand between such.
GAP_LINES = 3
#: A template is confirmed as modified if at least this share of its words stand in the block in order.
LEAST_SHARE = 0.75
#: A template that takes less than this share, and fewer than so many bytes, off a window's compressed size explains none of it.
LEAST_GAIN = 0.05
LEAST_BYTES = 8
#: Templates of up to so many words share a window, and those above the last.
WINDOWS = (8, 24)

_CUE = re.compile(CUE)
_WORD = re.compile(r"\{\w+\}|[^\W_]+(?:[.'-][^\W_]+)*")


def blocks(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks of a text: lines with a cue, at most GAP_LINES apart."""
    if not text or not _CUE.search(text):
        return []
    out, at, line = [], 0, 0
    for piece in text.splitlines(keepends=True):
        if _CUE.search(piece):
            if out and line - out[-1][2] <= GAP_LINES + 1:
                out[-1] = (out[-1][0], at + len(piece), line)
            else:
                out.append((at, at + len(piece), line))
        at, line = at + len(piece), line + 1
    return [(a, b) for a, b, _ in out]


class Scanner:
    def __init__(self, templates=TEMPLATES, least_share: float = LEAST_SHARE, level: int = 3):
        self.least_share = least_share
        self.alone = zstandard.ZstdCompressor(level=level)
        self.templates = []
        for name, body in templates:
            raw = zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, body, zstandard.ZstdCompressor(level=level, dict_data=raw), [w.lower() for w in _WORD.findall(body)]))
        self.fixed = [Counter(w for w in t[3] if w[0] != "{") for t in self.templates]
        # (words to each side of a cue, templates): a template's own words, what its open places take up, and some added ones
        self.windows = []
        for k in range(len(WINDOWS) + 1):
            some = [i for i, t in enumerate(self.templates) if bisect_left(WINDOWS, len(t[3])) == k]
            if some:
                reach = max(len(t) + len(t) // 4 + 8 * sum(w[0] == "{" for w in t) + 4 for t in (self.templates[i][3] for i in some))
                self.windows.append((reach, some))

    def ranked(self, data: bytes, some: list[int]) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template) of some templates, the greatest saving first; a tie goes to the first template."""
        alone = len(self.alone.compress(data))
        saved = [(alone - len(self.templates[i][2].compress(data)), i) for i in some]
        return sorted(((n / alone, i) for n, i in saved if n >= LEAST_BYTES or n >= LEAST_GAIN * alone), key=lambda g: (-g[0], g[1]))

    def differences(self, template: int, words: list[tuple[str, int, int]]):
        """(words of the template found, missing, added, first, last) in the stretch that fits it best."""
        body = self.templates[template][3]
        match = SequenceMatcher(None, body, [w for w, _, _ in words], autojunk=False)
        runs = [m for m in match.get_matching_blocks() if m.size]
        if not runs:
            return 0, body, [], 0, 0
        # the stretch: from the first run on that isn't separated from the next by more words than the template has
        best, here = [], []
        for m in runs:
            if here and m.b - (here[-1].b + here[-1].size) > max(8, len(body) // 4):
                here = []
            here = here + [m]
            if sum(x.size for x in here) > sum(x.size for x in best):
                best = here
        found, missing, added = 0, [], []
        a = b = None
        for m in [*best, None]:
            gap_a = body[a or 0 : m.a if m else len(body)]
            gap_b = [w for w, _, _ in words[b : m.b]] if m and b is not None else []
            if not (gap_a and all(w[0] == "{" for w in gap_a) and len(gap_b) <= 8 * len(gap_a)):
                missing += [w for w in gap_a if w[0] != "{"]
                added += gap_b
            if m:
                a, b, found = m.a + m.size, m.b + m.size, found + m.size
        return found, missing, added, best[0].b, best[-1].b + best[-1].size - 1

    def scan_block(self, block: str):
        """(license, gain, share, missing, added, start, end) of each license of a block, from the best explained on."""
        out = []
        words = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
        starts = [w[1] for w in words]
        # (first word, word after the last) of what is explained, in order
        taken: list[tuple[int, int]] = []
        work = deque(max(0, bisect_right(starts, m.start()) - 1) for m in _CUE.finditer(block)) if words else deque()
        while work:
            cue = work.popleft()
            k = bisect_right(taken, (cue, len(words)))
            lo, hi = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(words)
            if cue < lo:
                continue
            best = None
            for reach, some in self.windows:
                a, b = max(lo, cue - reach), min(hi, cue + reach + 1)
                data = block[words[a][1] : words[b - 1][2]].encode("utf-8", "replace")
                here = Counter(w for w, _, _ in words[a:b])
                for gain, i in self.ranked(data, some):
                    fixed = sum(self.fixed[i].values())
                    if (self.fixed[i] & here).total() < self.least_share * fixed:
                        continue  # the words aren't even there in another order
                    # the cue's own notice: one that fits better elsewhere in the window has cues of its own
                    x, y = a, b
                    while True:
                        found, missing, added, first, last = self.differences(i, words[x:y])
                        if not found or x + first <= cue <= x + last:
                            break
                        x, y = (x, x + first) if cue < x + first else (x + last + 1, y)
                        if y - x < self.least_share * fixed:
                            found = 0
                            break
                    share = found / fixed
                    # of the confirmed the one that explains the most words wins, of these that with the fewest differences, then the greater saving
                    rank = -found, (len(missing) + len(added)) / fixed
                    if share >= self.least_share and (best is None or rank < best[0]):
                        best = rank, i, gain, share, missing, added, x + first, x + last
            if best is None:
                continue
            _, i, gain, share, missing, added, first, last = best
            out.append((self.templates[i][0], gain, share, missing, added, words[first][1], words[last][2]))
            taken.insert(k, (first, last + 1))
            # what is left on the cue's side may hold another
            work.appendleft(cue)
        return sorted(out, key=lambda x: x[5])

    def scan(self, text: str | None):
        """(license, exact, start, end, gain, share, missing, added) of all licenses of a text, by their places."""
        declared = [(m[1], True, m.start(), m.end(), 0.0, 1.0, "", "") for m in _SPDX.finditer(text or "")]
        found = [
            (name, not missing and not added, a + start, a + end, gain, share, " ".join(missing), " ".join(added))
            for a, b in blocks(text)
            for name, gain, share, missing, added, start, end in self.scan_block(text[a:b])
        ]
        return sorted(declared + [f for f in found if not any(d[2] < f[3] and f[2] < d[3] for d in declared)], key=lambda f: f[2])


_FOUND = "array<struct<license:string,exact:boolean,start:int,end:int,gain:double,share:double,missing:string,added:string>>"


def candidate(text: Column) -> Column:
    return text.rlike(CUE)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, license, exact, start, end, gain, share, missing, added): every license notice, and the wording it lacks or adds.

    start and end are characters of the text; a declared SPDX identifier is reported as it stands, with a gain of 0.  A map without a shuffle.
    Null and empty texts have none; a null id is passed on; repeated rows are each reported; equal matches go to the greater saving, then to the
    earlier template; an empty table gives no rows; other columns aren't read; texts are scanned whole, whatever their length.
    """

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.Series:
        scanner = Scanner(templates, least_share)
        names = ("license", "exact", "start", "end", "gain", "share", "missing", "added")
        return texts.map(lambda t: [dict(zip(names, f)) for f in scanner.scan(t)])

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter(candidate(F.col("text")))
    return narrow.select("doc_id", F.inline(found("text")))
