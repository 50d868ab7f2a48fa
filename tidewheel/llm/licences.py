"""License scans: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewheel.llm.blocks import ALNUM, Words
from tidewheel.llm.common import UPPER, map_texts, prepare

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What an accepted template says: a whole licence text, the whole notice that a licence asks for, or a sentence (one that names a licence, or the first of its text).
SCORES = {"text": 1.0, "notice": 0.9, "sentence": 0.7}
#: Words that, among the three before it, take a sentence back.
DENIALS = {"not", "never", "no", "nor", "cannot", "isn", "aren", "wasn", "weren", "neither", "without", "unless", "longer"}

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "{1} neither the name of {10} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"


def _gnu(name: str) -> list[tuple[str, str]]:
    """The notice of a GNU licence, its first sentence, and a sentence that names it."""
    first = f"free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
    rest = f"[[either]] version {{1}} [[0]] of the license [[or [[at your option]] any later version]] {{4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details"
    own = f"you should have received a copy of the {name} along with {{6}} if not [[see]] [[write to the free software foundation [[inc]]]] {{12}}"
    return [("notice", f"{first} {rest} [[{own}]]"), ("sentence", first), ("sentence", f"licensed under the [[terms of the]] {name.replace('gnu', '[[gnu]]')} [[version {{1}} [[0]]]] [[or [[at your option]] any later version]]")]


#: Templates: plain words are mandatory, [[...]] is optional, {n} stands for up to n words. The wordings are the licences' own and fixed.
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "mit": [
        (
            "text",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
            + _WARRANTY,
        ),
        ("sentence", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
        ("sentence", "released under the mit license"),
        ("sentence", "licensed under the [[terms of the]] mit license"),
    ],
    "apache": [
        (
            "notice",
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {12} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ),
        ("sentence", "licensed under the [[terms of the]] apache license [[version 2 0 [[the license]]]]"),
    ],
    "gpl": _gnu("gnu general public license"),
    "lgpl": _gnu("gnu lesser general public license") + _gnu("gnu library general public license"),
    "agpl": _gnu("gnu affero general public license"),
    "bsd-3-clause": [("text", f"{_BSD} {_BSD_NAMES} {_BSD_END}")],
    "bsd-2-clause": [("text", f"{_BSD} {_BSD_END}")],
    "bsd": [("sentence", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"), ("sentence", "licensed under the [[terms of the]] bsd [[{1} clause]] license")],
    "isc": [("text", f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"), ("sentence", _ISC), ("sentence", "licensed under the [[terms of the]] isc license")],
    "0bsd": [("text", f"{_ISC} {_ISC_END}")],
    "zlib": [
        (
            "text",
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {1} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {1} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {1} this notice may not be removed or altered from any source distribution",
        ),
        ("sentence", "licensed under the [[terms of the]] zlib license"),
    ],
    "bsl": [
        (
            "text",
            "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ),
        ("sentence", "distributed under the boost software license [[version 1 0]]"),
    ],
    "unlicense": [
        (
            "text",
            "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
            + _WARRANTY,
        ),
        ("sentence", "free and unencumbered software released into the public domain"),
    ],
    "mpl": [
        ("notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {8}"),
        ("sentence", "subject to the terms of the mozilla public license [[v {1} 0]] [[version {1} 0]]"),
        ("sentence", "licensed under the [[terms of the]] mozilla public license [[version {1} 0]]"),
    ],
    "epl": [("notice", "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] {1} 0 which is available at {8}"), ("sentence", "licensed under the [[terms of the]] eclipse public license [[v {1} 0]] [[version {1} 0]]")],
    "cc0": [("sentence", "[[released]] under [[the]] [[creative commons]] cc0 [[1 0]] [[universal]]"), ("sentence", "dedicated to the public domain under [[the]] [[creative commons]] cc0")],
    "cc-by-nc": [("sentence", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[sa]] [[nd]] {1} 0"), ("sentence", "licensed under [[a]] [[the]] creative commons attribution noncommercial [[{2}]] {1} 0 [[international]] license"), ("sentence", "licensed under [[a]] [[the]] creative commons attribution non commercial [[{2}]] {1} 0 [[international]] license")],
    "cc-by-sa": [("sentence", "licensed under [[a]] [[the]] [[creative commons]] cc by sa {1} 0"), ("sentence", "licensed under [[a]] [[the]] creative commons attribution share alike {1} 0 [[international]] license"), ("sentence", "licensed under [[a]] [[the]] creative commons attribution sharealike {1} 0 [[international]] license")],
    "cc-by": [("sentence", "licensed under [[a]] [[the]] [[creative commons]] cc by [[nd]] {1} 0"), ("sentence", "licensed under [[a]] [[the]] creative commons attribution {1} 0 [[international]] license")],
    "proprietary": [("sentence", "[[copyright {6}]] all rights reserved")],
}
#: A text without any of these can hold neither a phrase nor a template.
ANCHORS = regex.compile(rb"licen[sc]e|permission|redistribution|free software|unencumbered|provided as is|mozilla|eclipse|cc0|reserved")
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """`steps[state]` maps a word to the next states; `any_[state]` are those reached by any word; `skip[state]` by none. The last state accepts."""

    steps: list[dict[str, set[int]]]
    any_: list[set[int]]
    skip: list[set[int]]

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)


def compile_template(markup: str) -> Automaton:
    """One automaton of a template; optional regions may nest."""
    a = Automaton([{}], [set()], [set()])

    def state() -> int:
        a.steps.append({})
        a.any_.append(set())
        a.skip.append(set())
        return len(a.steps) - 1

    now, opened = 0, []
    for token in regex.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup.lower()):
        if token == "[[":
            opened.append(now)
        elif token == "]]":
            a.skip[opened.pop()].add(now)
        elif token[0] == "{":
            begin, steps = now, []
            for _ in range(int(token[1:-1])):
                new = state()
                a.any_[now].add(new)
                steps.append(now := new)
            for s in [begin, *steps[:-1]]:
                a.skip[s].add(now)
        else:
            new = state()
            a.steps[now].setdefault(token, set()).add(new)
            now = new
    return a


class Matcher:
    """All templates as one lazily determinised automaton: sets of states are numbered as they appear."""

    def __init__(self, templates: dict[str, list]):
        """Templates by label; each is a markup, or its kind and the markup."""
        kinds = [(label, *(t if isinstance(t, tuple) else ("text", t))) for label, ts in templates.items() for t in ts]
        self.kinds = [kind for _, kind, _ in kinds]
        self.parts = [(label, compile_template(t)) for label, _, t in kinds]
        self.begin = [a.closed({0}) for _, a in self.parts]
        self.first: dict[str, list[int]] = {}
        for i, (_, a) in enumerate(self.parts):
            for w in {w for s in self.begin[i] for w in a.steps[s]}:
                self.first.setdefault(w, []).append(i)
        self.memo: dict[tuple, frozenset[int]] = {}

    def _step(self, i: int, states: frozenset[int], word: str) -> frozenset[int]:
        a = self.parts[i][1]
        key = (i, states, word if any(word in a.steps[s] for s in states) else None)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            out: set[int] = set()
            for s in states:
                out |= a.steps[s].get(word, set()) | a.any_[s]
            self.memo[key] = a.closed(out)
        return self.memo[key]

    def spans(self, words: list[str]) -> list[tuple[int, int, str, str]]:
        """Longest accepted run from each first word: (start, end exclusive, label, kind). Sentences that are denied don't count."""
        out = []
        for at, w in enumerate(words):
            for i in self.first.get(w, ()):
                label, a = self.parts[i]
                states, end, k = self.begin[i], 0, at
                while states and k < len(words):
                    states = self._step(i, states, words[k])
                    k += 1
                    if len(a.steps) - 1 in states:
                        end = k
                if end and not (self.kinds[i] == "sentence" and DENIALS.intersection(words[max(0, at - 3) : at])):
                    out.append((at, end, label, self.kinds[i]))
        return out


def phrase_starts(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i : i + len(p)] == p]
    return sorted(out)


_matcher: list[Matcher] = []


def scan(texts: list[str | None]) -> list:
    """Columns of `scan_licences` for a batch of texts."""
    if not _matcher:
        _matcher.append(Matcher(TEMPLATES))
    words = Words(texts, lower=True, inside=ALNUM)
    first, last, n_base = [None] * len(texts), [None] * len(texts), np.zeros(len(texts), np.int64)
    base, labels, spans, score = [""] * len(texts), [""] * len(texts), [[] for _ in texts], np.zeros(len(texts))
    for i, (a, b) in enumerate(pairwise(words.begin.tolist())):
        if not ANCHORS.search(words.raw, a, b):
            continue
        own = _WORD.findall(words.raw[a:b].decode())
        found, matched = phrase_starts(own), _matcher[0].spans(own)
        if found:
            first[i], last[i], n_base[i] = found[0][0], found[-1][0], len(found)
            base[i] = ",".join(sorted({x for _, x in found}))
        spans[i] = [{"start": s, "end": e, "label": x, "kind": k} for s, e, x, k in matched]
        labels[i] = ",".join(sorted({x for _, x in found} | {x for _, _, x, _ in matched}))
        score[i] = max((SCORES[k] for *_, k in matched), default=0.5 if found else 0.0)
    return [words.counts, n_base, first, last, base, labels, score, spans]


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans of words.

    score: 1 where the mandatory wording of a whole licence text matches exactly, 0.9 for a
    whole notice, 0.7 for a sentence that no word before it denies, 0.5 where only a phrase
    stands, else 0; of several the highest. Null and empty texts have no words and no
    labels; texts of any length are scanned whole. Other columns and repeated rows stay;
    columns named as an added one are replaced.
    """
    prepare(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("kind", T.StringType())]))
    added = [T.StructField(c, k) for c, k in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", span))]
    return map_texts(docs, text, added, scan)


def op10(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan_licences(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def expression(markup: str, sentence: bool) -> str:
    """A template as a regular expression over words that a blank precedes, `~` before those that a denial stands close before; a sentence must not begin with one of these."""
    tokens = regex.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup.lower())
    if tokens[0] == "[[":  # with the optional beginning, or without it
        depth, end = 0, 0
        for end, t in enumerate(tokens):
            depth += (t == "[[") - (t == "]]")
            if not depth:
                break
        return "|".join(expression(" ".join(part), sentence) for part in (tokens[1:end] + tokens[end + 1 :], tokens[end + 1 :]))
    out = [f" {'' if sentence else '~?'}{tokens[0]}"]
    for t in tokens[1:]:
        out.append("(?:" if t == "[[" else ")?" if t == "]]" else f"(?: [^ ]+){{0,{t[1:-1]}}}" if t[0] == "{" else f" ~?{t}")
    return f"(?:{''.join(out)} )"


def sql() -> str:
    """DuckDB SQL of `op10`, from the templates as regular expressions."""
    cases = [(label, SCORES[kind], f"regexp_matches(s, '{expression(t, kind == 'sentence')}')") for label, ts in TEMPLATES.items() for kind, t in ts]
    places = {label: f"list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))})" for p, label in PHRASES.items()}
    denials = ", ".join(f"'{x}'" for x in sorted(DENIALS))
    near = " OR ".join(f"coalesce(w[i - {k}] IN ({denials}), false)" for k in (1, 2, 3))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT r, doc_id, w, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {near} THEN ' ~' ELSE ' ' END || w[i]), '') || ' ' ELSE '' END AS s FROM d
), p AS (
  SELECT r, doc_id, len(w) AS n_words, s, {', '.join(f'{x} AS at_{label}' for label, x in places.items())} FROM f
), m AS (
  SELECT r, doc_id, n_words, {' || '.join(f'[x - 1 for x in at_{label}]' for label in places)} AS found,
    list_filter([{', '.join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for label in places)}], lambda x: x IS NOT NULL) AS base,
    list_filter([{', '.join(f"CASE WHEN {c} THEN '{label}' END" for label, _, c in cases)}], lambda x: x IS NOT NULL) AS own,
    list_max([{', '.join(f'CASE WHEN {c} THEN {score} ELSE 0 END' for _, score, c in cases)}]) AS best
  FROM p
)
SELECT doc_id, n_words, len(found) AS n_base, list_min(found) AS first_word, list_max(found) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || own)), ',') AS labels, CAST(CASE WHEN best > 0 THEN best WHEN len(found) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM m
"""
