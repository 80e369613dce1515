"""License scans: template-markup matching with token automata.

A template is plain wording with optional regions ``[[...]]`` and replaceable
regions ``<<name:n>>`` (up to ``n`` words of any kind). It is compiled into a
nondeterministic automaton over words; a text is accepted where all mandatory
words stand in order with nothing between but those regions. The base also counts
the places of three fixed phrases.

Words are ``[0-9a-z]`` and non-ASCII characters of the text with A-Z lower-cased.
The score grows with the length of the wording that was found: ``n / (n + HALF)`` for
the ``n`` mandatory words of the longest accepted template or base phrase, else 0.

Defined cases: null and empty texts have no words and no labels; whole texts are
read, however long; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import ALNUM_WORD, lowered, map_chunks

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words of wording that give a score of a half.
HALF = 5

_AS_IS = "this software is provided by <<holders:6>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain "
    "the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution "
)
#: Labels and the wording of license notices and bodies.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[version]] 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] "
    "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
    "kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]",
    "bsd-2-clause": _BSD + _AS_IS,
    "bsd-3-clause": _BSD + "[[3]] neither the name of <<holder:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _AS_IS,
    "cc-by-nc": "<<verb:1>> under [[the]] [[creative commons]] cc by nc [[<<version:2>>]]",
    "cc-by-sa": "<<verb:1>> under [[the]] [[creative commons]] cc by sa [[<<version:2>>]]",
    "gpl-3.0": "licensed under the gnu general public license [[as published by the free software foundation either]] version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation "
    "either version <<number:2>> of the license or at your option any later version",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
    "all copies the software is provided as is and <<holder:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
    "<<holder:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
    "tortious action arising out of or in connection with the use or performance of this software",
    "mit": "<<verb:1>> under the [[terms of the]] mit license",
    "mit-body": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
    "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the "
    "following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided "
    "as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<holders:8>> "
    "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
    "binary for any purpose commercial or non commercial and by any means",
}

_RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_MARKUP = re.compile(r"\[\[|\]\]|<<[^:>]*:(\d+)>>|[^\s\[\]<>]+")


@dataclass
class Automaton:
    """States with moves by word, by any word, and without a word; ``wording`` counts the mandatory words."""

    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[int | None] = field(default_factory=lambda: [None])
    skips: list[set[int]] = field(default_factory=lambda: [set()])
    anchor: tuple[bytes, int, int] = (b"", 0, 0)
    wording: int = 0

    def state(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.skips.append(set())
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.skips[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    def accepts(self, tokens: list[bytes], at: int) -> bool:
        """Whether some run of words from ``at`` on is accepted."""
        last, states = len(self.words) - 1, self.closure({0})
        while last not in states:
            if at >= len(tokens) or not states:
                return False
            word = tokens[at]
            moved = {self.words[s][word] for s in states if word in self.words[s]} | {self.free[s] for s in states if self.free[s] is not None}
            states, at = self.closure(moved), at + 1
        return True


def compile_template(text: str) -> Automaton:
    """The automaton of a template, with its longest mandatory word as the anchor."""
    out, now, opened, least, most, best = Automaton(), 0, [], 0, 0, None
    for m in _MARKUP.finditer(text):
        if m[0] == "[[":
            opened.append((now, least))
        elif m[0] == "]]":
            start, least = opened.pop()
            out.skips[start].add(now)
        elif m[0].startswith("<<"):
            start = now
            for _ in range(int(m[1])):
                nxt = out.state()
                out.free[now] = nxt
                now, most = nxt, most + 1
                out.skips[start].add(now)
        else:
            word = m[0].lower().encode()
            nxt = out.state()
            out.words[now][word] = nxt
            # a rare word whose distance from the start is known within few words
            if not opened and (best is None or (min(len(word), 12), best[2] - best[1]) > (min(len(best[0]), 12), most - least)):
                best = (word, least, most)
            out.wording += not opened
            now, least, most = nxt, least + 1, most + 1
    if opened or best is None:
        raise ValueError(f"a template needs closed regions and a mandatory word: {text!r}")
    end = out.state()
    out.skips[now].add(end)
    out.anchor = best
    return out


def _places(tokens: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = tokens.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Base places and labels of every document, and the templates it accepts."""
    compiled = {label: compile_template(t) for label, t in templates.items()}
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]

    def scan(columns: list[list]) -> list[list]:
        rows = []
        for doc, text in zip(*columns):
            data = lowered(text)
            tokens = ALNUM_WORD.findall(data)
            places, base, labels, longest = [], set(), set(), 0
            for words, label in wanted:
                rare = max(words, key=len)
                if rare in data:
                    shift = words.index(rare)
                    found = [at - shift for at in _places(tokens, rare) if at >= shift and tokens[at - shift : at - shift + len(words)] == words]
                    places += found
                    if found:
                        base.add(label)
                        longest = max(longest, len(words))
            for label, auto in compiled.items():
                word, least, most = auto.anchor
                if word in data and any(auto.accepts(tokens, s) for at in _places(tokens, word) for s in range(max(0, at - most), at - least + 1)):
                    labels.add(label)
                    longest = max(longest, auto.wording)
            score = longest / (longest + HALF)
            rows.append((doc, len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
        return [list(x) for x in zip(*rows)]

    return map_chunks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), _RESULT, scan)
