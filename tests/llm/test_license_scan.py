import random
import re

from fathomline.llm import license_scan as L
from fathomline.llm.license_scan import BODIES, TEMPLATES, Scanner, scan

PROSE = "The quick brown fox and the lazy dog went over the hill to see what the others were doing there."


def test_each_template_is_found_and_no_other():
    s = Scanner()
    for name, _, text in TEMPLATES:
        found = s.block(text)
        assert found and found.license_id == name and found.differences == "", (name, found)
        n, many = s.text(f"{PROSE}\n{PROSE}\n\n{text}\n\n{PROSE}")
        assert [f.license_id for f in many] == [name]


def test_changed_wording():
    s = Scanner()
    assert s.block("This software is licensed under the Apache License, Version 2.0.").license_id == "Apache-2.0"
    assert s.block("Licensed under CC BY-NC 3.0.") is None
    assert s.block("This work is licensed under the GNU General Public License, version 1.") is None
    assert s.block("Released under the NIT License.") is None
    assert s.block("A license plate and a driving licence were found in the public house.") is None
    broken = TEMPLATES[1][2].replace(" ", "\n", 12)
    assert [f.license_id for f in s.text(broken)[1]] == ["Apache-2.0"]


def test_templates_far_down_the_ranking():
    s = Scanner()
    for name, _, text in TEMPLATES:
        if text.startswith("Licensed under") and len(text) < 60:
            for opening in ("This program is", "This work is", "This file is", "This package is distributed and"):
                found = s.block(f"{opening} l{text[1:]}")
                assert found and found.license_id == name, (opening, text, found)


def test_other_text_on_the_line():
    s = Scanner()
    for name, _, text in TEMPLATES:
        for n in (1, 3, 7, 60):
            for line in (f"{PROSE} " * n + text, f"{text} " + f"{PROSE} " * n, f"{PROSE} " * n + f"{text} {PROSE}", f"{PROSE[:-1]}, " * 10 * n + text):
                found = s.text(line)[1]
                assert [f.license_id for f in found] == [name], (n, line, found)
    line = "This text may be copied by anyone who keeps this line. Released under the MIT License. Questions go to the editors."
    assert [f.license_id for f in s.text(line)[1]] == ["MIT"]
    line = "Photos are licensed under CC BY 4.0, code is released under the MIT License, all rights reserved otherwise."
    assert [f.license_id for f in s.text(line)[1]] == ["CC-BY-4.0", "MIT", "proprietary"]
    assert s.text("Released under the NIT License. MIT is a school.")[1] == []


def test_wrapped_lines():
    s = Scanner()
    for name, _, text in TEMPLATES:
        for before, after in ((0, 0), (3, 3), (60, 60), (2000, 50)):
            for width in (1, 2, 3, 5, 9):
                words = f"{PROSE} ".split() * before + text.split() + f"{PROSE} ".split() * after
                for mark in ("", "# "):
                    lines = "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))
                    if mark and before:
                        continue
                    found = s.text(lines)[1]
                    assert [f.license_id for f in found] == [name], (text, before, width, mark, found)
                    assert mark or found[0].differences == ""
    assert [f.license_id for f in s.text("Licensed under the Apache License, Version 2.0.\nSome data tables come from elsewhere.\nReleased under the MIT License.")[1]] == ["Apache-2.0", "MIT"]
    assert [f.license_id for f in s.text("Photos: licensed under CC BY 4.0\nGNU Emacs drew them\nLicensed under CC BY-SA 4.0\nAll rights\nreserved")[1]] == ["CC-BY-4.0", "CC-BY-SA-4.0", "proprietary"]
    assert [f.license_id for f in s.text(f"{TEMPLATES[1][2]}\n{TEMPLATES[2][2]} {TEMPLATES[1][2]} {PROSE}\n{TEMPLATES[28][2]}")[1]] == ["Apache-2.0", "MIT", "Apache-2.0", "proprietary"]
    assert s.text("This work is licensed under the GNU General Public License, version 3\nor later.")[1] == []


def test_case_of_letters():
    s = Scanner()
    for name, _, text in TEMPLATES:
        for cased in (text.upper(), text.lower(), text.title(), text.swapcase()):
            assert (found := s.block(cased)) and (found.license_id, found.saved, found.differences) == (name, s.block(text).saved, ""), (cased, found)
            assert [f.license_id for f in s.text(f"{PROSE}\n{cased}\n{PROSE.upper()}")[1]] == [name], cased


def test_lines_within_prose():
    s, r = Scanner(), random.Random(3)
    for name, _, text in TEMPLATES:
        lines = [PROSE] * r.randint(1, 5) + [text] + [PROSE] * r.randint(1, 5)
        assert [f.license_id for f in s.text("\n".join(lines))[1]] == [name], name


def names(s, text):
    return [f.license_id for f in s.text(text)[1]]


def test_ranking_is_by_compression():
    """A template saves most of its own text, ahead of its closest relatives; ties keep the table's order."""
    s = Scanner()
    for name, _, text in TEMPLATES:
        ranking = s.ranked(f"{PROSE} {text}", s.templates)
        assert len(ranking) == len(TEMPLATES) and [x for x, _ in ranking] == sorted((x for x, _ in ranking), reverse=True)
        best = [t.name for saved, t in ranking if saved == ranking[0][0]]
        assert name in best, (text, best)
        assert [s.templates.index(t) for saved, t in ranking if saved == ranking[0][0]] == sorted(s.templates.index(t) for saved, t in ranking if saved == ranking[0][0])


def test_full_wordings():
    s = Scanner()
    for name, _, text in BODIES:
        words = text.split()
        paragraphs = "\n\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))
        wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
        for shown in (text, paragraphs, wrapped, text.upper()):
            for around in ("{}", PROSE + "\n\n{}\n\n" + PROSE, "x y " * 5000 + "{}" + f"\n{PROSE}" * 300):
                assert names(s, around.format(shown)) == [name], (name, around[:20])
    both = f"{BODIES[0][2]}\n\n{BODIES[3][2]}\n\n{PROSE}\n{BODIES[2][2]}\n\nReleased under the MIT License.\nSPDX-License-Identifier: ISC"
    assert names(s, both) == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC"]
    named = BODIES[3][2].replace("the copyright holder nor", "Apache Example 2.0 GmbH nor")
    assert names(s, named) == ["BSD-3-Clause"]
    assert names(s, f"Copyright 2020 A. Person\n\n{BODIES[0][2]}".replace("COPYRIGHT HOLDERS", "PERSONS")) == ["MIT"]
    half = " ".join(BODIES[3][2].split()[:60])
    assert names(s, half) == []


def test_spdx_lines():
    s = Scanner()
    for line, wanted in (
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// spdx-license-identifier: apache-2.0\nint x;", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", ["GPL-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later AND BSD-3-Clause.", ["GPL-2.0-or-later", "BSD-3-Clause"]),
        ("SPDX-License-Identifier: LicenseRef-Own", []),
        ("The SPDX list names MIT and others.", []),
    ):
        assert names(s, f"{PROSE}\n{line}\n{PROSE}") == wanted, line


def test_denied_statements():
    s = Scanner()
    for text in (
        "This software is not released under the MIT License.",
        "This is not, in any way, licensed under CC BY 4.0.",
        "The work was never licensed under the Apache License, Version 2.0.",
        "This project is not licensed under the terms of the MIT license.",
        "Neither this file nor that one is licensed under CC BY-SA 4.0.",
        "Permission is hereby not granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ):
        assert names(s, text) == [], text
        assert names(s, text.replace(" ", "\n", 3)) == [], text
    assert names(s, "This is not released under the MIT License, but licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names(s, "If not stated otherwise, licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names(s, "It is not finished. Released under the MIT License.") == ["MIT"]


SAME = {"software": "program", "licensed": "distributed and licensed", "released": "made available", "work": "picture", "project": "package", "library": "module"}


def mutated(r, text, name):
    """(changed notice, does it still state the license?)."""
    kind = r.randrange(8)
    words = text.split()
    if kind == 0:
        return text.upper(), True
    if kind == 1:
        return "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4)), True
    if kind == 2:
        return re.sub(r"\w+", lambda m: SAME.get(m.group(), m.group()) if len(words) > 7 else m.group(), text), True
    if kind == 3:
        return re.sub(r"[\"(),;]", "", text), True
    if kind == 4:
        return "This file is not " + text[0].lower() + text[1:] if text.startswith(("Licensed", "Released")) else "It is not true: " + text.split(".")[0][0].lower() + text[1:], False
    if kind == 5 and re.search(r"\d\.\d|version \d", text):
        return re.sub(r"\d(?=\.\d|\b)", "7", text), False
    if kind == 6:
        swap = [("MIT", "NIT"), ("Apache", "Navajo"), ("GNU", "GNAT"), ("Mozilla", "Gozilla"), ("ISC", "ISO"), ("CC BY", "CC GO"), ("BSD", "LSD"), ("Attribution", "Retribution")]
        for a, b in swap:
            if a in text:
                return text.replace(a, b), False
    return text, True


def test_mutated_notices():
    """Precision and recall of statements in documents of prose with changed notices."""
    s, r = Scanner(), random.Random(8)
    right = found = wanted = 0
    for _ in range(600):
        name, _, text = r.choice(TEMPLATES)
        shown, states = mutated(r, text, name)
        gap = "\n\n" if r.random() < 0.5 else "\n"
        got = names(s, f"{PROSE}{gap}{shown}{gap}{PROSE}" if r.random() < 0.7 else shown)
        right += states and name in got
        found, wanted = found + len(got), wanted + states
    print(f"precision {right / found:.4f} recall {right / wanted:.4f}")
    assert right / found > 0.95 and right / wanted > 0.95


def test_no_gate_loses_a_statement(monkeypatch):
    """Brute force: every sentence is a block, compressed with and compared to every template; nothing is remembered."""
    r = random.Random(4)
    texts = []
    for _ in range(60):
        parts = [PROSE, "Was mit der Lizenz gemeint ist, steht dort.", "All permission reserved rights.", "GNU and Apache 2.0 are names.", "A license of MIT make."]
        parts += [mutated(r, *r.choice(TEMPLATES)[::-2])[0] for _ in range(4)]
        r.shuffle(parts)
        texts.append(r.choice((" ", "\n", "\n\n")).join(parts))
    gated = [Scanner().text(t)[1] for t in texts]

    class Everything:
        def search(self, *a):
            return True

    class Brute(Scanner):
        def _best(self, text, spans, lo, hi, sentences):
            self.seen = {}
            cuts = [lo, *(k for k in range(lo + 1, hi) if "\n" in text[spans[k - 1][2] : spans[k][1]]), hi]
            parts = [(lo, hi), *zip(cuts, cuts[1:])]
            ranking = self.ranked(self._plain(text, spans, lo, hi), [t for t in self.templates if not sentences or t.sentences == sentences])
            for _, t in ranking:
                for part in parts:
                    if f := self._confirmed(text, spans, lo, hi, part, t):
                        share = self._share(self._plain(text, spans, f.first, f.last), t)
                        if share >= L.LEAST_SAVED:
                            return L.replace(f, saved=share)
                        break
            return None

    monkeypatch.setattr(L, "MAY", Everything())
    assert [Brute().text(t)[1] for t in texts] == gated and sum(map(len, gated)) > 100


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, f"{PROSE}\nReleased under the MIT License.\n{PROSE}", "x"), (3, f"{PROSE}\nReleased under the MIT License.\n{PROSE}", "x"), (None, "All rights reserved.", "x"), (4, "word " * 100000 + "\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted(((g.doc_id, g.licenses, g.best_license) for g in scan(docs).collect()), key=str)
    assert got == sorted([(1, "", None), (2, "", None), (3, "MIT", "MIT"), (3, "MIT", "MIT"), (None, "proprietary", "proprietary"), (4, "CC-BY-NC-4.0,proprietary", "CC-BY-NC-4.0")], key=str)
    assert scan(docs.limit(0)).count() == 0
