"""License scans by template-markup matching (operator 5).

A template is license wording in a small markup:

    word          mandatory
    [ ... ]       optional region, may nest
    ( a | b )     one of several wordings
    {name lo hi}  replaceable region of lo to hi words

Each template compiles into a token automaton over lower-cased words. A text is
accepted where a run of its words leads from the start to the final state, so
all mandatory wording matches exactly and in order.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.llm.common import alnum_words, append_columns, text_slices

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Published wording of licenses and license notices, in the markup above.
_AS_IS = "including but not limited to the {implied 0 1} warranties of merchantability"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [ 1 ] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [ 2 ] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
_BSD_END = "this software is provided by {holder 1 12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {holder 1 12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu "
_FSF = " public license as published by the free software foundation either version {version 1 2} of the license or at your option any later version [ this ( program | library | software ) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose ]"

TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0 [ the license ]",
        "licensed under the apache 2 0 license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at ( http | https ) www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "mit": [
        "( released | licensed | distributed | available ) under the [ terms of the ] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [ including the next paragraph ] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied " + _AS_IS + " fitness for a particular purpose and noninfringement in no event shall {holders 1 8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "bsd": ["( released | licensed | distributed ) under the [ terms of the ] [ {clauses 1 2} clause ] bsd license"],
    "bsd-2-clause": [_BSD + _BSD_END],
    "bsd-3-clause": [_BSD + "[ 3 ] neither the name of {holder 1 12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {holder 1 8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {holder 1 8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [ 1 ] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [ 2 ] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [ 3 ] this notice may not be removed or altered from any source distribution"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "gpl": [
        "( licensed | released | distributed ) under the [ terms of the ] gnu general public license [ [ as published by the free software foundation [ either ] ] version {version 1 2} ]",
        "this {program 1 2} " + _FREE + "general" + _FSF,
    ],
    "lgpl": ["under the [ terms of the ] gnu lesser general public license [ version {version 1 2} ]", "this {library 1 2} " + _FREE + "lesser general" + _FSF],
    "agpl": ["under the [ terms of the ] gnu affero general public license [ version {version 1 2} ]", "this {program 1 2} " + _FREE + "affero general" + _FSF],
    "mpl-2.0": [
        "under the mozilla public license [ version ] 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at ( http | https ) [ www ] mozilla org mpl 2 0",
    ],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license [ v ] {version 1 2} which [ accompanies this distribution and ] is available at"],
    "cc-by-nc": ["licensed under [ a ] ( cc by nc | creative commons attribution noncommercial | creative commons attribution non commercial ) [ {version 1 2} ] [ international ] [ license ]"],
    "cc-by-sa": ["licensed under [ a ] ( cc by sa | creative commons attribution sharealike | creative commons attribution share alike ) [ {version 1 2} ] [ international ] [ license ]"],
    "cc-by-4.0": ["licensed under [ a ] ( cc by | creative commons attribution ) 4 0 [ international ] [ license ]"],
    "cc0": ["( released | dedicated ) ( under | to ) [ the ] ( cc0 | public domain ) [ 1 0 ] [ universal ]", "to the extent possible under law {holder 1 12} has waived all copyright and related or neighboring rights to"],
    "reserved": ["copyright {holder 1 12} all rights reserved"],
}
# Identifiers in source files, after the words "SPDX-License-Identifier".
_IDENTIFIER = "spdx license identifier "
_ANY = " {version 1 2} [ ( only | or later ) ]"
IDENTIFIERS = {
    "apache-2.0": "apache 2 0", "mit": "mit", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "gpl": "gpl" + _ANY, "lgpl": "lgpl" + _ANY, "agpl": "agpl" + _ANY,
    "mpl-2.0": "mpl 2 0", "epl": "epl {version 1 2}", "cc-by-4.0": "cc by 4 0", "cc-by-sa": "cc by sa {version 1 2}", "cc-by-nc": "cc by nc {version 1 2}", "cc0": "cc0 1 0",
}
# How the terms themselves begin.
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed "
_COPYRIGHT = " copyright c {years 1 2} free software foundation inc {address 0 16} "
TERMS = {
    "apache-2.0": "terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "gpl": "gnu general public license version {version 1 4}" + _COPYRIGHT + _VERBATIM + "preamble ( the gnu general public license is a free copyleft license for software and other kinds of works | the licenses for most software are designed to take away your freedom to share and change it )",
    "lgpl": "gnu lesser general public license version {version 1 4}" + _COPYRIGHT + _VERBATIM + "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
    "agpl": "gnu affero general public license version {version 1 4}" + _COPYRIGHT + _VERBATIM + "preamble the gnu affero general public license is a free copyleft license for software and other kinds of works",
    "mpl-2.0": "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "cc-by-4.0": "creative commons attribution 4 0 international public license by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license",
}
for _label, _text in IDENTIFIERS.items():
    TEMPLATES.setdefault(_label, []).append(_IDENTIFIER + _text)
for _label, _text in TERMS.items():
    TEMPLATES[_label].append(_text)
#: A run that is not accepted counts for the score from so many matched words on.
LEAST_RUN = 8


@dataclass
class Automaton:
    """Words lead from a set of states to the next; ``None`` stands for any word."""

    label: str
    steps: list[dict] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    final: int = 0

    def state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.free[s]
        return frozenset(seen)

    def first_words(self) -> set[bytes]:
        """Words with which an accepted run can begin; a template never begins with a replaceable region."""
        return {w for s in self.closed({0}) for w in self.steps[s]}

    def left(self) -> list[int]:
        """For each state the fewest words that lead from it to the final one."""
        back: list[list[tuple[int, int]]] = [[] for _ in self.steps]
        for s, (steps, free) in enumerate(zip(self.steps, self.free)):
            for t in free:
                back[t].append((s, 0))
            for targets in steps.values():
                for t in targets:
                    back[t].append((s, 1))
        out, todo = [len(self.steps)] * len(self.steps), deque([(self.final, 0)])
        while todo:
            s, n = todo.popleft()
            if n < out[s]:
                out[s] = n
                for t, cost in back[s]:
                    (todo.append if cost else todo.appendleft)((t, n + cost))
        return out

    def match(self, words: list[bytes], at: int, memo: dict) -> tuple[int, float]:
        """End of the longest accepted run from ``at``, or -1, and the share of the mandatory wording that a run from there matched. memo: this automaton's known state sets (it turns deterministic as it goes)."""
        states, best = memo.setdefault("start", self.closed({0})), -1
        for i in range(at, len(words)):
            key = (states, w := words[i])
            nxt = memo.get(key)
            if nxt is None:
                nxt = self.closed(t for s in states for k in (w, None) for t in self.steps[s].get(k, ()))
                if len(memo) < 20_000:
                    memo[key] = nxt
            if not nxt:
                break
            states = nxt
            if self.final in states:
                best = i + 1
        else:
            i = len(words)
        if best > 0:
            return best, 1.0
        if i - at < LEAST_RUN:
            return best, 0.0
        left = memo.setdefault("left", self.left())
        return best, 1 - min(left[s] for s in states) / left[0]


def compile_template(label: str, template: str) -> Automaton:
    tokens = re.findall(r"\{\w+ \d+ \d+\}|[\[\]()|]|[^\s\[\](){}|]+", template)
    a, at = Automaton(label), 0

    def sequence(frm: int, closing: str) -> int:
        """Parse until ``closing``; gives the state reached."""
        nonlocal at
        begin, ends, here = frm, [], frm
        while at < len(tokens) and tokens[at] != closing:
            t = tokens[at]
            at += 1
            if t == "|":
                ends.append(here)
                here = begin
            elif t in "[(":
                inner = a.state()
                a.free[here].add(inner)
                end, out = sequence(inner, "]" if t == "[" else ")"), a.state()
                a.free[end].add(out)
                if t == "[":
                    a.free[here].add(out)
                here = out
            elif t[0] == "{":
                low, high = map(int, t[1:-1].split()[1:])
                out = a.state()
                for k in range(high):
                    if k >= low:
                        a.free[here].add(out)
                    nxt = a.state()
                    a.steps[here].setdefault(None, set()).add(nxt)
                    here = nxt
                a.free[here].add(out)
                here = out
            else:
                nxt = a.state()
                a.steps[here].setdefault(t.encode(), set()).add(nxt)
                here = nxt
        at += 1
        if ends:
            out = a.state()
            for e in [*ends, here]:
                a.free[e].add(out)
            here = out
        return here

    a.final = sequence(0, "")
    return a


@lru_cache(maxsize=1)
def _automata() -> dict[bytes, list[tuple[Automaton, dict]]]:
    by_first: dict[bytes, list[tuple[Automaton, dict]]] = {}
    for label, templates in TEMPLATES.items():
        for t in templates:
            pair = (compile_template(label, t), {})
            for w in pair[0].first_words():
                by_first.setdefault(w, []).append(pair)
    return by_first


_PHRASES = [(p.encode().split(), label) for p, label in BASE.items()]


def scan_words(words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]], float]:
    """(start, label) of base phrases; (start, end, label) of accepted templates; the largest share of a template's mandatory wording."""
    base, accepted, share = [], [], 0.0
    vocabulary = set(words)
    for phrase, label in _PHRASES:
        if vocabulary.issuperset(phrase):
            first, n, at = phrase[0], len(phrase), -1
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                if words[at : at + n] == phrase:
                    base.append((at, label))
    by_first = _automata()
    for first in by_first.keys() & vocabulary:
        at = -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            for automaton, memo in by_first[first]:
                end, part = automaton.match(words, at, memo)
                share = max(share, part)
                if end > 0:
                    accepted.append((at, end, automaton.label))
    return base, accepted, share


def scan_licenses(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per document: ``n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``spans``.

    score is the largest share of a template's mandatory wording that the text
    matches from the template's start on: 1 where an automaton accepts, less where
    a license breaks off or departs from its wording; runs of fewer than
    ``LEAST_RUN`` words do not count. A base phrase alone has 0.5. Null and empty
    texts have 0 words, no labels (empty strings), null first and last words and
    score 0. Repeated rows give repeated rows, an empty table an empty result; texts
    of any length are scanned whole. Columns named like the results stay apart, in
    ``_row``.
    """

    def compute(batches):
        for (texts,) in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in (t for part in text_slices(texts) for t in part.to_pylist()):
                words = alnum_words(t)
                base, accepted, share = scan_words(words)
                starts = [s for s, _ in base]
                own = {label for _, label in base}
                row = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {a[2] for a in accepted})), max(share, 0.5) if base else share, [{"start": s, "end": e, "label": label} for s, e, label in accepted])
                for column, value in zip(out, row):
                    column.append(value)
            yield out, None

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "spans": T.ArrayType(span)}
    return append_columns(docs, [text], [T.StructField(k, v) for k, v in kinds.items()], compute, carry, "licenses")
