"""License scans with a generalised suffix automaton of license tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays

#: The phrases of the base scan and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Wordings of public licenses and of the notices that files carry, by label. Unlike the phrases they tell versions and variants apart.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, "
        "including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright "
        "holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the "
        "Software or the use or other dealings in the Software.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the "
        "GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential "
        "damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of "
        "liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential "
        "damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of "
        "liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, "
        "data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be "
        "removed or altered from any source distribution.",
    ),
    (
        "lgpl-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License v3.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License v2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
)

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: How a text states a version: after a word for it, joined to a `v`, or as two numbers with a point.
VERSION = re.compile(rb"(?:\bversions?|\bv\.?|v)\s*([0-9]{1,2})(?:\.([0-9]{1,2}))?(?![0-9])|(?<![0-9.])([0-9]{1,2})\.([0-9]{1,2})(?![0-9])")
#: Tokens after a span in which its version may stand.
AFTER = 6
VARIANTS = (b"nc", b"nd", b"sa")


def needs(label: str) -> tuple[tuple[int, int] | None, frozenset[bytes]]:
    """The version that a label names, if any, and its variants."""
    version = re.search(r"-([0-9]+)\.([0-9]+)$", label)
    return (int(version[1]), int(version[2])) if version else None, frozenset(x for x in label.encode().split(b"-") if x in VARIANTS)


def states(label: str, tokens: list[bytes], words: bytes) -> bool:
    """Whether a place, as tokens and as lower-case text, states the version and just the variants that a label names."""
    version, variants = needs(label)
    if version and label.startswith("cc-") and variants != frozenset(t for t in tokens if t in VARIANTS):
        return False
    said = [(int(a or c), int(b or d or 0)) for a, b, c, d in VERSION.findall(words)]
    return version is None or version in said


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return WORD.findall(text.lower())


class SuffixAutomaton:
    """All substrings of several token sequences in one automaton.

    length[s] is the length of the state's longest substring, link[s] its suffix link, ends[s] every
    (sequence, place) at which the state's substrings end; phrases[s] the whole sequences of `marked`
    that are suffixes of it.
    """

    def __init__(self, sequences: list[list[bytes]], marked: int = 0):
        self.next: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        own: dict[int, list[tuple[int, int]]] = {}
        finals: dict[int, list[int]] = {}
        for k, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens):
                last = self._add(last, token)
                own.setdefault(last, []).append((k, place))
        for k, tokens in enumerate(sequences[:marked]):
            state = 0
            for token in tokens:
                state = self.next[state][token]
            finals.setdefault(state, []).append(k)
        self.ends: list[list[tuple[int, int]]] = [own.get(s, []) for s in range(len(self.next))]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        by_length = sorted(range(1, len(self.next)), key=lambda s: self.length[s])
        for s in by_length:
            self.phrases[s] = [(k, len(sequences[k])) for k in finals.get(s, [])] + self.phrases[self.link[s]]
        for s in reversed(by_length):
            if self.link[s] > 0:
                self.ends[self.link[s]] = self.ends[self.link[s]] + self.ends[s]

    def _add(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def _clone(self, p: int, q: int, token: bytes) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int) -> int:
        self.next.append({})
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def matches(self, tokens: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the matching statistic wherever it isn't zero: the longest substring
        of any sequence that ends at that token."""
        known, step, link, length = self.next[0], self.next, self.link, self.length
        state = size = 0
        for place, token in enumerate(tokens):
            if token not in known:
                state = size = 0
                continue
            while token not in step[state]:
                state = link[state]
                size = length[state]
            state, size = step[state][token], size + 1
            yield place, state, size


class Scanner:
    """phrases and templates as token sequences in one automaton."""

    def __init__(self, phrases, templates, least: int = 3, gap: int = 8):
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.sequences = [words_of(p.encode()) for p, _ in phrases] + [words_of(t.encode()) for _, t in templates]
        self.marked, self.least, self.gap = len(phrases), least, gap
        self.automaton = SuffixAutomaton(self.sequences, self.marked)

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[dict]]:
        """([(start, phrase)], template spans {template, start, end, covered}).

        Maximal matches of `least` tokens or more that follow each other both in the text and in a template, with
        at most `gap` tokens between, are chained into one span. A match counts for every template that has it,
        and at every place where it has it; a template's last tokens count though they are fewer, if they stand where they are due.
        """
        a = self.automaton
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        before = (-2, 0, 0)
        for place, state, size in a.matches(tokens):
            for k, n in a.phrases[state]:
                if size >= n:
                    places.append((place - n + 1, k))
            if before[2] and (place != before[0] + 1 or size <= before[2]):
                matches.append(before)
            before = (place, state, size)
        if before[2]:
            matches.append(before)
        spans: list[dict] = []
        open_: dict[int, dict] = {}
        for place, state, size in matches:
            start, end = place - size + 1, place + 1
            by: dict[int, list[int]] = {}
            for template, last in a.ends[state]:
                if template >= self.marked and (size >= self.least or last == len(self.sequences[template]) - 1):
                    by.setdefault(template, []).append(last - size + 1)
            for template, owns in by.items():
                s = open_.get(template)
                if s is not None and start - s["end"] <= self.gap and end > s["end"]:
                    overlap = max(0, s["end"] - start)
                    due = s["own"] + max(0, start - s["end"])  # where the template goes on if the text was altered word by word
                    fits = [own + overlap for own in owns if 0 <= own + overlap - s["own"] <= 4 * self.gap and (size >= self.least or own + overlap == due)]
                    if fits:
                        fresh = end - start - overlap
                        s["own"] = min(fits, key=lambda x: (abs(x - due), x)) + fresh
                        s["end"], s["covered"] = end, s["covered"] + fresh
                        continue
                if size >= self.least:
                    s = open_[template] = {"template": template, "start": start, "end": end, "covered": size, "own": min(owns) + size}
                    spans.append(s)
        return sorted(places), spans

    def _stated(self, span: dict, tokens: list[bytes], lower: bytes, words: list[re.Match]) -> bool:
        end = min(span["end"] + AFTER, len(tokens))
        return states(self.labels[span["template"]], tokens[span["start"] : end], lower[words[span["start"]].start() : words[end - 1].end()])

    def result(self, text: bytes, share: float) -> dict:
        lower = text.lower()
        tokens = WORD.findall(lower)
        places, spans = self.scan(tokens)
        base = {self.labels[k] for _, k in places}
        found, score = set(base), 0.5 if base else 0.0
        for s in spans:
            s["share"] = min(1.0, s["covered"] / len(self.sequences[s["template"]]))
        kept, reach = [], -1  # groups of spans that overlap
        for s in sorted(spans, key=lambda s: (s["start"], -s["covered"])):
            if s["share"] < share:
                score = max(score, s["share"])
                continue
            if s["start"] >= reach:
                kept.append([])
            reach = max(reach, s["end"])
            kept[-1].append(s)
        said, words = [], []
        for group in kept:  # of each, the spans with most tokens covered count, and of these such that cover most of their template
            words = words or list(WORD.finditer(lower))  # their places, where a template was found
            stated = [s for s in group if self._stated(s, tokens, lower, words)]
            most = max(((s["covered"], s["share"]) for s in stated), default=None)
            score = max([score, *(s["share"] for s in group)])
            for s in stated:
                if (s["covered"], s["share"]) == most:
                    label = self.labels[s["template"]]
                    found.add(label)
                    score = max(score, 0.5 + s["share"] / 2 if base else s["share"])
                    said.append({"label": label, "start": s["start"], "end": s["end"], "covered": s["share"]})
        starts = [p for p, _ in places]
        return {
            "n_words": len(tokens),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": sorted(base),
            "labels": sorted(found),
            "score": score,
            "spans": said,
        }


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "spans array<struct<label: string, start: long, end: long, covered: double>>"
)
ARROW_RESULT = pa.struct(
    [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])))]
)


def scan_licenses(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES, share: float = 0.75) -> DataFrame:
    """docs with `licenses`: counts, places and labels of the phrases, template spans (words, end exclusive) and a score.

    A template's label is given from `share` of its tokens in one chained span, if the text states the version and the variant that the label
    names, in the span or right behind it. Of templates whose spans overlap those with most tokens covered are named, at a tie those of which
    most is covered, and all of them at a further tie. score: the largest covered share of a template, 0.5 or more where a phrase stands. The
    automaton has the size of the given wordings and goes to the tasks with the code; each text is streamed through it once, without
    a shuffle. Null and empty texts have no words and score 0; repeated rows are alike; an empty table gives no rows; other
    columns pass through (one named `licenses` is replaced).
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))
    names = [c for c in docs.columns if c.lower() != "licenses"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("licenses", T.StructType.fromDDL(RESULT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner.value
        for batch in batches:
            texts = arrays.plain(batch.column(batch.schema.get_field_index("text"))).cast(pa.large_binary())
            results = [scan.result(t.as_py(), share) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(results, type=ARROW_RESULT)], names=[*names, "licenses"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_licenses(docs)
    r = F.col("licenses")
    return out.select(
        "doc_id",
        *(r[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word")),
        F.array_join(r["base_labels"], ",").alias("base_labels"),
        F.array_join(r["labels"], ",").alias("labels"),
        r["score"].alias("score"),
    )
