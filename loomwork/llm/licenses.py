"""Operator 10, license scans by template-markup matching.

A template is a license's wording with markup: ``<<optional>> ... <<end>>`` may be missing, and ``<<any:n>>`` stands for
up to n words of any kind. Each template is compiled into an automaton over words; a text has the license if the
automaton reaches its end somewhere in the text, with every mandatory word in its place. A scan starts the automaton only
where the template's anchor, its longest run of fixed words, stands.

Words are runs of ASCII letters and digits and of characters outside ASCII, with A-Z lower-cased. Beside the templates,
fixed phrases are looked for and counted at every place. Null texts have no words. Texts of any length are read whole, in a
time that grows with them. Repeated rows are scanned each; an empty table gives no rows; a column that has the name of an
added one gives way to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import common

#: Bytes of words, lower-cased; all others become spaces.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that name a license, and their labels.
NOTICES = {
    "apache-2.0": "<<optional>>This work is<<end>> licensed under the Apache License, Version 2.0",
    "mit": "Released under <<optional>>the terms of<<end>> the MIT License",
    "gpl-3.0": "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation, either<<end>> version 3",
    "gpl-2.0": "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation, either<<end>> version 2",
    "gpl-3.0-or-later": """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version""",
    "gpl-2.0-or-later": """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation<<optional>>, either<<end>> version 2 of the License, or (at your option) any later version""",
    "lgpl-2.1-or-later": """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation<<optional>>, either<<end>> version 2.1 of the License, or (at your option) any later version""",
    "agpl-3.0-or-later": """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "epl-2.0": "made available under the terms of the Eclipse Public License <<optional>>v<<end>> 2.0",
    "cc-by-nc-4.0": "licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY-SA 4.0",
    "cc-by-4.0": "licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY 4.0",
    "cc-by-4.0#name": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "dedicated <<any:8>> to the public domain <<optional>>worldwide<<end>> under <<optional>>the<<end>> CC0 1.0",
    "all-rights-reserved": "All rights reserved",
}
#: Whole license texts, and their labels.
TEXTS = {
    "mit": """<<optional>>The MIT License <<optional>>(MIT)<<end>><<end>> <<optional>>Copyright <<any:12>><<end>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>>
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<any:8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc": """<<optional>>ISC License<<end>> <<optional>>Copyright <<any:12>><<end>>
        Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<any:4>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<any:4>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "bsd-2-clause": """<<optional>>Copyright <<any:12>><<end>> <<optional>>All rights reserved.<<end>>
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<any:10>> "AS IS" AND
        ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "bsd-3-clause": """<<optional>>Copyright <<any:12>><<end>> <<optional>>All rights reserved.<<end>>
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. <<optional>>3.<<end>> Neither the name of <<any:10>> nor the names of
        <<optional>>its<<end>> <<any:2>> contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY <<any:10>> "AS IS" AND
        ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: <<optional>>1.<<end>> The origin of this software must
        not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
        in the product documentation would be appreciated but is not required. <<optional>>2.<<end>> Altered source versions must be plainly marked as such, and
        must not be misrepresented as being the original software. <<optional>>3.<<end>> This notice may not be removed or altered from any source distribution""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at""",
    "apache-2.0#header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<any:8>> Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License""",
}
#: All templates; a label ends before any ``#``.
TEMPLATES = {f"{k}#notice": v for k, v in NOTICES.items()} | {f"{k}#text": v for k, v in TEXTS.items()}
MARKUP = re.compile(r"<<(optional|end|any:\d+)>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """States are numbered; a state has words that lead on, a state that any word leads to, and states reached without a word."""

    label: str
    on_word: list[dict[bytes, int]] = field(default_factory=list)
    on_any: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    final: int = 0
    anchor: bytes = b""
    before: int = 0  # words that may stand before the anchor

    def state(self) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts_at(self, words: list[bytes], start: int) -> int | None:
        """The end of the shortest match that starts at word ``start``; None without one."""
        now = self.closure({0})
        for i in range(start, len(words) + 1):
            if self.final in now:
                return i
            if i == len(words) or not now:
                return None
            w = words[i]
            after = {t for s in now for t in (self.on_word[s].get(w), self.on_any[s]) if t is not None}
            now = self.closure(after)
        return None

    def found(self, words: list[bytes], line: bytes) -> bool:
        """``line``: the words, each between single spaces. Every place is tried once, and the line is read once."""
        at, place, counted, tried = line.find(self.anchor), 0, 0, 0
        while at >= 0:
            place, counted = place + line.count(b" ", counted, at), at
            for start in range(max(tried, place - self.before), place + 1):
                if self.accepts_at(words, start) is not None:
                    return True
            tried = place + 1
            at = line.find(self.anchor, at + 1)
        return False


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template, with the longest run of words that stand outside optional and replaceable regions as anchor."""
    a = Automaton(label)
    now, opened, runs, at = a.state(), [], [[0, []]], 0
    for i, part in enumerate(MARKUP.split(template)):
        if i % 2 == 0:  # plain words
            for word in words_of(part):
                nxt = a.state()
                a.on_word[now][word] = nxt
                if not opened:
                    runs[-1][1].append(word)
                now, at = nxt, at + 1
            if opened:
                runs.append([at, []])
        elif part == "optional":
            opened.append(now)
            runs.append([at, []])
        elif part == "end":
            a.free[opened.pop()].append(now)
            runs.append([at, []])
        else:
            start = now
            for _ in range(int(part.removeprefix("any:"))):
                nxt = a.state()
                a.on_any[now] = nxt
                now, at = nxt, at + 1
            end = a.state()
            for s in range(start, end):
                a.free[s].append(end)
            now = end
            runs.append([at, []])
    a.final = now
    before, words = max(runs, key=lambda r: len(r[1]))
    if not words:
        raise ValueError(f"template {label} has no mandatory words")
    a.anchor, a.before = b" " + b" ".join(words) + b" ", before
    return a


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = [compile_template(k.split("#")[0], v) for k, v in templates.items()]
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.heads = sorted({a.anchor for a in self.automata} | {p for p, _ in self.phrases})

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        if not any(h in line for h in self.heads):
            return len(words), 0, None, None, "", "", 0.0
        n, first, last, base = 0, len(words), -1, set()
        for phrase, label in self.phrases:
            at, place, counted = line.find(phrase), 0, 0
            while at >= 0:
                place, counted = place + line.count(b" ", counted, at), at
                n, first, last = n + 1, min(first, place), max(last, place)
                base.add(label)
                at = line.find(phrase, at + 1)
        full = {a.label for a in self.automata if a.found(words, line)}
        score = 1.0 if full else 0.5 if base else 0.0
        return len(words), n, first if n else None, last if n else None, ",".join(sorted(base)), ",".join(sorted(base | full)), score


FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with words, base places, labels and score (1: a template, 0.5: phrases alone)."""

    def make():
        one = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases).scan
        return lambda texts: list(map(list, zip(*map(one, texts), strict=True)))

    return common.map_texts(docs, text, make, FIELDS, keep=keep)
