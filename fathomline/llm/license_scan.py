"""License scans by conditional compression.

Candidate blocks are compressed once alone and once with each template as raw Zstandard dictionary:
the better a template tells a block beforehand, the fewer bytes remain. Templates are ranked by the
bytes that they save, and confirmed from the best down by the exact differences in wording: these
must leave out no word that names the license, add none that names another, and deny nothing. So
"CC BY 4.0" never passes for "CC BY-NC 4.0", however alike they compress, and what is "not released
under the MIT License" isn't. The first template confirmed names the license, if it saves its share
of the confirmed stretch; words around that stretch change nothing, nor does the case of letters.

What is a candidate block follows from the confirmation, which asks for all words that name a
license: a sentence (on however many lines) that has the naming words of some template; a run of
words that mostly stand in some license's full wording (bodies have several paragraphs); and each
name in an SPDX line. No other block could be confirmed.

One narrow pass; a worker remembers the outcome of blocks that it has seen, in a table bounded by bytes.

Defined cases: a null or empty text states no license; a text may state several, in order of place;
equal savings go to the template first in the table; repeated rows give equal results; a notice is
within a paragraph, which is looked at whole, however long; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licenses by SPDX name, the words that name them (the first is the mark that candidates are
# found by), and notices that state them.
TEMPLATES = (
    ("Apache-2.0", "license apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "license apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "license mit", "Released under the MIT License."),
    ("MIT", "license mit", "This project is licensed under the terms of the MIT license."),
    ("MIT", "permission granted charge sublicense sell", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "permission granted fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "license isc", "Licensed under the ISC License."),
    ("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "gnu general 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "gnu general 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "gnu lesser 2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "gnu affero 3", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "cc by-nc-nd 4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "attribution-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "attribution-noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0", "This work is released under CC0 1.0 Universal."),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "reserved all rights", "All rights reserved."),
    ("CC-BY-ND-4.0", "attribution-noderivatives 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "attribution-noncommercial-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "attribution-noncommercial-noderivatives 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("BSL-1.0", "boost 1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "eclipse 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Zlib", "license zlib", "Licensed under the zlib License."),
)
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AD = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Full wordings of short licenses, and the words that each must have.
BODIES = (
    ("MIT", "permission granted sublicense sell", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "permission granted fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "redistribution redistributions retain reproduce", " ".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_END))),
    ("BSD-3-Clause", "redistribution redistributions retain reproduce endorse promote", " ".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, _BSD_END))),
    ("BSD-4-Clause", "redistribution redistributions retain reproduce advertising endorse promote", " ".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_AD, _BSD_3, _BSD_END))),
    ("Zlib", "misrepresented altered plainly", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "unencumbered domain dedicate", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
)
# Words that deny what follows them.
DENIALS = frozenset("not no never neither nor without isn't aren't wasn't weren't cannot can't don't doesn't didn't non".split())
#: A template must save this share of the bytes of its stretch, and share this part of its words with it.
LEAST_SAVED, LEAST_SHARED = 0.2, 0.6
#: A body must share this part of its words; its words in a text are found by so many in a row.
BODY_SHARED, GRAM = 0.8, 5
#: A notice in a longer sentence than two of these holds no more words.
REACH = 500
#: Bytes of blocks whose outcome a worker remembers.
REMEMBERED = 1 << 24
_MARKS = sorted({naming.split()[0] for _, naming, _ in (*TEMPLATES, *BODIES)} | {"spdx"})
#: The first naming word of some template, at the beginning of a word: any text that states a license has one.
_MAY = r"(?i)(?:^|[^a-z0-9])(?:" + "|".join(re.escape(m).replace("license", "licen[sc]e") for m in _MARKS) + ")"
MAY = re.compile(_MAY)
_SPDX = re.compile(r"(?i)spdx-license-identifier:[ \t]*((?:\(?[a-z0-9.+-]+\)?)(?:[ \t]+(?:and|or|with)[ \t]+\(?[a-z0-9.+-]+\)?)*)")
_WORD = re.compile(r"[^\s\"'(),;:]+")
_VARIABLE = re.compile(r"\d+(\.\d+)*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def _spans(text: str) -> list[tuple[str, int, int]]:
    """The words in lower case with their places; licence is spelled license."""
    found = ((m.group().rstrip(".").lower().replace("licence", "license"), m.start(), m.end()) for m in _WORD.finditer(text))
    return [x for x in found if x[0]]


def _words(text: str) -> list[str]:
    return [w for w, _, _ in _spans(text)]


@dataclass(frozen=True)
class Found:
    license_id: str
    saved: float
    differences: str
    first: int = 0
    last: int = 0  #: words [first, last) of the block


@dataclass(frozen=True)
class Template:
    name: str
    naming: frozenset[str]
    words: list[str]
    counts: Counter
    sentences: int
    told: zstandard.ZstdCompressor


class Scanner:
    def __init__(self, templates=TEMPLATES, bodies=BODIES, level: int = 9):
        self.plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**self.plain)
        self.templates = [self._template(*t) for t in templates]
        self.bodies = [self._template(*t) for t in bodies]
        names = sorted({name for name, _, _ in (*templates, *bodies)} - {"proprietary"})
        self.tags = [self._template(n, n.lower(), f"SPDX-License-Identifier: {n}") for n in names]
        self.naming = {w for t in self.templates for w in t.naming} - set("license all rights reserved permission granted charge fee sell sublicense by".split())
        self.grams = {tuple(t.words[i : i + GRAM]) for t in self.bodies for i in range(len(t.words) - GRAM + 1)}
        self.longest = max((len(t.words) for t in self.bodies), default=0)
        self.seen: dict[tuple[str, int], list[Found]] = {}
        self.seen_bytes = 0

    def _template(self, name: str, naming: str, text: str) -> Template:
        own = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=self.plain["level"])
        words = _words(text)
        return Template(name, frozenset(naming.split()), words, Counter(words), len(_SENTENCE.split(text)), zstandard.ZstdCompressor(dict_data=own, **self.plain))

    def ranked(self, block: str, templates: list[Template]) -> list[tuple[int, Template]]:
        """Every template with the bytes that it saves of a block, most first."""
        data = block.lower().encode()
        alone = len(self.alone.compress(data))
        return sorted(((alone - len(t.told.compress(data)), t) for t in templates), key=lambda x: -x[0])

    def _share(self, stretch: str, template: Template) -> float:
        """The share of the bytes of a stretch that the template saves."""
        data = stretch.lower().encode()
        return 1 - len(template.told.compress(data)) / len(self.alone.compress(data))

    def _around(self, text: str, spans: list, lo: int, hi: int, first: int, last: int) -> list[str]:
        """Two words of [lo, hi) on either side; those beyond the end of a line don't count where a capital begins the next."""
        ends = lambda k: "\n" in text[spans[k - 1][2] : spans[k][1]] and text[spans[k][1]].isupper() and spans[k][0] not in ("or", "and")
        out = []
        for k in range(first, max(first - 2, lo), -1):
            if ends(k):
                break
            out.append(spans[k - 1][0])
        for k in range(last, min(last + 2, hi)):
            if ends(k):
                break
            out.append(spans[k][0])
        return out

    def _denied(self, text: str, spans: list, lo: int, first: int) -> bool:
        """Do the ten words before the stretch, in its sentence, deny it? "If not" denies nothing, and "but" or "and" ends a denial."""
        for k in range(first - 1, max(first - 11, lo - 1), -1):
            if _SENTENCE.search(text[spans[k][1] : spans[k + 1][1]] + text[spans[k + 1][1]]) or spans[k][0] in ("and", "but", "instead"):
                return False
            if spans[k][0] in DENIALS:
                return not (k > lo and spans[k - 1][0] in ("if", "when", "where"))
        return False

    def _wording(self, text: str, spans: list, lo: int, hi: int, template: Template, runs: list[tuple[int, int, int]], body: bool = False) -> Found | None:
        """What the runs in common state, or None if another license may be meant or it is denied."""
        first, last = runs[0][1], runs[-1][1] + runs[-1][2]
        out, a, b = [], 0, first
        for at, own, n in [*runs, (len(template.words), last, 0)]:
            gone, new = template.words[a:at], [w for w, _, _ in spans[b:own]]
            if template.naming.intersection(gone) and not template.naming.issubset(w for w, _, _ in spans[first:last]):
                return None
            if not body and (template.naming.intersection(gone) or any(w in self.naming or w in DENIALS or _VARIABLE.match(w) for w in new)):
                return None
            if gone or new:
                out.append(f"-{' '.join(gone)}+{' '.join(new)}")
            a, b = at + n, own + n
        if not body and any(w in self.naming and w not in template.naming for w in self._around(text, spans, lo, hi, first, last)):  # the name goes on beyond the template
            return None
        if self._denied(text, spans, lo, first):
            return None
        return Found(template.name, 0.0, ";".join(out), first, last)

    def _confirmed(self, text: str, spans: list, lo: int, hi: int, part: tuple[int, int], template: Template, body: bool = False) -> Found | None:
        """The stretch in the part of words [lo, hi) that states the template's license; stray words in common before and after it are left out."""
        words = [w for w, _, _ in spans[slice(*part)]]
        least = (BODY_SHARED if body else LEAST_SHARED) * len(template.words)
        if not template.naming.issubset(words) or (template.counts & Counter(words)).total() < least:
            return None
        match = difflib.SequenceMatcher(None, template.words, words, autojunk=False)
        runs = [(m.a, m.b + part[0], m.size) for m in match.get_matching_blocks() if m.size]
        # every way to leave out runs at either end, by the words in common
        reach = [0]
        for r in runs:
            reach.append(reach[-1] + r[2])
        parts = sorted((reach[i] - reach[j], i, j) for i in range(len(runs)) for j in range(bisect_left(reach, reach[i] + least), len(runs) + 1) if j > i)
        for _, i, j in parts:
            found = self._wording(text, spans, lo, hi, template, runs[i:j], body)
            if found:
                return found
        return None

    def _best(self, text: str, spans: list, lo: int, hi: int, sentences: int) -> Found | None:
        """The best-ranked statement in words [lo, hi), or else in a line of them; of templates of so many sentences, or any for 0."""
        words = {w for w, _, _ in spans[lo:hi]}
        templates = [t for t in self.templates if not sentences or t.sentences == sentences]
        if not any(t.naming <= words for t in templates):
            return None
        cuts = [lo, *(k for k in range(lo + 1, hi) if "\n" in text[spans[k - 1][2] : spans[k][1]]), hi]
        lines = [*zip(cuts, cuts[1:], strict=False)] if len(cuts) > 2 else []
        return self._winner(text, spans, self.ranked(self._plain(text, spans, lo, hi), templates), lambda t: next((f for part in [(lo, hi), *lines] if (f := self._confirmed(text, spans, lo, hi, part, t))), None))

    def _winner(self, text: str, spans: list, ranking: list[tuple[int, Template]], confirmed) -> Found | None:
        """The first template down the whole ranking that is confirmed and saves its share of its stretch."""
        for _, template in ranking:
            found = confirmed(template)
            if found:
                share = self._share(self._plain(text, spans, found.first, found.last), template)
                if share >= LEAST_SAVED:
                    return replace(found, saved=share)
        return None

    def _plain(self, text: str, spans: list, lo: int, hi: int) -> str:
        """Words [lo, hi) as they stand, with single spaces."""
        return " ".join(text[spans[lo][1] : spans[hi - 1][2]].split())

    def block(self, text: str) -> Found | None:
        """The statement in a text, whatever its sentences, that is ranked best."""
        spans = _spans(text)
        return self._best(text, spans, 0, len(spans), 0) if spans else None

    def all_in(self, text: str, sentences: int = 0) -> list[Found]:
        """All statements in a sentence, or across so many, in order: what is beside a find is looked at again."""
        if (text, sentences) in self.seen:
            return self.seen[text, sentences]
        if self.seen_bytes >= REMEMBERED:
            self.seen, self.seen_bytes = {}, 0
        spans, found = _spans(text), []
        todo = [(0, len(spans))]
        while todo:
            lo, hi = todo.pop()
            if lo < hi and (own := self._best(text, spans, lo, hi, sentences)):
                found.append(own)
                todo += [(lo, own.first), (own.last, hi)]
        self.seen[text, sentences] = found = sorted(found, key=lambda f: f.first)
        self.seen_bytes += 4 * len(text) + 200
        return found

    def sentence(self, text: str) -> list[Found]:
        """All statements in a sentence, however long."""
        spans = _spans(text)
        out, at = [], 0
        while at < len(spans):
            piece = spans[at : at + 2 * REACH]
            to_end = at + len(piece) == len(spans)
            begin, end = piece[0][1], piece[-1][2]
            reached = len(spans) if to_end else at + REACH
            for f in self.all_in(text[begin:end]):
                if to_end or f.first < REACH:  # later ones are met again, with all that follows them
                    out.append(f)
                    reached = max(reached, at + f.last)
            at = reached
        return out

    def _across(self, parts: list[str], n: int) -> Found | None:
        """What a template of so many sentences states in all of these, by words of the joined parts."""
        inner = [len(_spans(x)) for x in parts]
        if not all(inner):
            return None
        # of a long sentence at an end only the near words; _best looks at no others
        skip = max(inner[0] - REACH, 0)
        joined = " ".join(parts)
        spans = _spans(joined)[skip : sum(inner[:-1]) + REACH]
        whole = next((f for f in self.all_in(joined[spans[0][1] : spans[-1][2]], n) if f.first + skip < inner[0] and f.last + skip > sum(inner[:-1])), None)
        return whole and replace(whole, first=whole.first + skip, last=whole.last + skip)

    def whole_bodies(self, text: str) -> list[tuple[int, int, Found]]:
        """(begin, end, find) of full wordings: runs of words of a body, each run compressed with all bodies."""
        spans = _spans(text)
        words = [w for w, _, _ in spans]
        hits = [i for i in range(len(words) - GRAM + 1) if tuple(words[i : i + GRAM]) in self.grams]
        out, k, at = [], 0, 0
        while k < len(hits):
            lo = max(hits[k], at)
            hi = min(lo + 2 * self.longest, len(words))  # the block: room for any body that begins here
            ranking = self.ranked(self._plain(text, spans, lo, hi), self.bodies)
            found = self._winner(text, spans, ranking, lambda t, lo=lo, hi=hi: self._confirmed(text, spans, max(0, lo - 6), hi, (lo, hi), t, body=True))
            if found:
                out.append((spans[found.first][1], spans[found.last - 1][2], found))
                at = found.last
            else:  # no body begins near; go on beyond this run of hits or by a sentence of it
                at = lo + GRAM * 4
            k = bisect_left(hits, at)
        return out

    def tagged(self, text: str) -> list[tuple[int, int, list[Found]]]:
        """(begin, end, finds) of SPDX lines; each name of an expression is a block."""
        out = []
        for m in _SPDX.finditer(text):
            found = []
            names = re.split(r"[ \t]+", m.group(1))
            for before, name in zip(["", *names], names, strict=False):
                name = re.sub(r"-only$", "", name.strip("()").rstrip("."), flags=re.I)
                if before.lower() == "with" or name.lower() in ("and", "or", "with"):
                    continue
                block = f"SPDX-License-Identifier: {name}"
                spans = _spans(block)
                sure = lambda t, spans=spans: Found(t.name, 0.0, "", 0, len(spans)) if t.words == [w for w, _, _ in spans] else None
                if own := self._winner(block, spans, self.ranked(block, self.tags), sure):
                    found.append(own)
            out.append((m.start(), m.end(), found))
        return out

    def text(self, text: str) -> tuple[int, list[Found]]:
        """The number of candidate blocks, and what they state, in order of place."""
        if not MAY.search(text):
            return 0, []
        taken = [(a, b, [f]) for a, b, f in self.whole_bodies(text)] + self.tagged(text)
        n, found, at = len(taken), [], 0
        for a, b, own in [*sorted(taken, key=lambda x: x[0]), (len(text), len(text), [])]:
            more, between = self._sentences(text[at:a])
            n, found, at = n + more, found + between + own, max(at, b)
        return n, found

    def _sentences(self, text: str) -> tuple[int, list[Found]]:
        """The number of sentences that may state a license, and what they state. A sentence is within a paragraph, on however many lines."""
        found: list[Found] = []
        n = 0
        several = sorted({t.sentences for t in self.templates} - {1}, reverse=True)
        for paragraph in re.split(r"\n[ \t\r]*\n", text):
            if not MAY.search(paragraph):
                continue
            rest = _SENTENCE.split(paragraph.strip())[::-1]
            while rest:
                sentence = rest.pop()
                if not MAY.search(sentence):
                    continue
                n += 1
                for k in several:
                    parts = [sentence, *rest[: -k : -1]]
                    if len(parts) == k and (whole := self._across(parts, k)):
                        spans = _spans(" ".join(parts))
                        found += self.sentence(sentence[: spans[whole.first][1]])
                        found.append(whole)
                        del rest[1 - k :]
                        rest.append(" ".join(parts)[spans[whole.last - 1][2] :])
                        break
                else:
                    found += self.sentence(sentence)
        return n, found


SCHEMA = "doc_id long, n_blocks long, n_found long, licenses string, best_license string, saved double, differences string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    for batch in batches:
        may = pc.fill_null(pc.match_substring_regex(batch.column(1), _MAY), False).to_pylist()
        out: list[list] = [[] for _ in names]
        for i, doc in enumerate(batch.column(0).to_pylist()):
            n, found = scanner.text(batch.column(1)[i].as_py()) if may[i] else (0, [])
            best = max(found, key=lambda f: f.saved, default=None)
            row = (doc, n, len(found), ",".join(dict.fromkeys(f.license_id for f in found)), best and best.license_id, best and round(best.saved, 6), best and best.differences)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the licenses stated (comma-joined, by place), and the best-saving one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run, SCHEMA)
