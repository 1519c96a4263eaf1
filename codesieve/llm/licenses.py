"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Units are the whole text, its paragraphs (parted by blank lines) if there are several, and its lines if there are
several. Normalising lower-cases, drops lines that begin with a copyright mark, and keeps words: runs of ASCII letters
and digits and of non-ASCII characters. With |A| and |T| different bigrams and threshold t, a Dice coefficient of t or more
needs t/(2-t) <= |A|/|T| <= (2-t)/t; only templates within these bounds are compared.

Cases: a null or blank text has no unit; a unit or template with fewer than two words has no bigram and matches
nothing; of templates with equal score the first name wins; repeated rows give repeated results; an empty table gives
no rows; null ids stay null; other columns are not used.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import slices

FOUND = "doc_id long, unit string, position long, license string, score double"

_COPYRIGHT = re.compile(r"^\s*(copyright|\(c\)|©).*$", re.MULTILINE)
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. ")
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Public licence texts and usual notices; a bounded table that ships with every task.
TEMPLATES = {
    "all-rights-reserved notice": "All rights reserved.",
    "apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + _BSD_NAME + _BSD_TAIL,
    "bsd-3-clause notice": "Released under the BSD 3-Clause License.",
    "cc-by-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>."),
    "gpl-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."),
    "mit": "MIT License " + _MIT_GRANT + _MIT_DISCLAIMER,
    "mit notice": "Released under the MIT License.",
    "mpl-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}


def bigrams(unit: str) -> set[tuple[str, str]]:
    words = _WORD.findall(_COPYRIGHT.sub("", unit.lower()))
    return set(zip(words, words[1:]))


def units(text: str) -> Iterator[tuple[str, int, str]]:
    """Kind, position from 0 and text of each unit."""
    yield "text", 0, text
    for kind, parts in (("paragraph", _PARAGRAPH.split(text)), ("line", text.split("\n"))):
        if len(parts) > 1:
            for position, part in enumerate(parts):
                yield kind, position, part


class Matcher:
    """The best template of a unit, by an inverted list from bigrams to templates."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sizes = {name: len(bigrams(text)) for name, text in sorted(templates.items())}
        self.posted: dict[tuple[str, str], list[str]] = defaultdict(list)
        for name in self.sizes:
            for pair in bigrams(templates[name]):
                self.posted[pair].append(name)
        self.vocabulary = frozenset(self.posted)
        # fewer words can hold no set of bigrams within the bounds of any template
        self.least = min((n for n in self.sizes.values() if n), default=0) * threshold / (2 - threshold)

    def best(self, unit: str) -> tuple[str, float] | None:
        if len(unit) < 2 * self.least:
            return None
        own = bigrams(unit)
        t, shared = self.threshold, own & self.vocabulary
        # a Dice coefficient of t needs at least t / 2 of the unit's bigrams
        if not shared or len(shared) < t / 2 * len(own):
            return None
        within = {name for name, n in self.sizes.items() if t / (2 - t) * n <= len(own) <= (2 - t) / t * n}
        common: dict[str, int] = defaultdict(int)
        for pair in shared:
            for name in self.posted[pair]:
                if name in within:
                    common[name] += 1
        scores = [(-2 * n / (len(own) + self.sizes[name]), name) for name, n in common.items()]
        score, name = min(scores, default=(0.0, ""))
        return (name, -score) if -score >= t else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """doc_id, unit (text, paragraph, line), position (from 0), license, score: units that match a template."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, position, unit in units(text or ""):
                    if found := matcher.best(unit):
                        for column, value in zip(out, (doc, kind, position, *found)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()))],
                names=["doc_id", "unit", "position", "license", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, FOUND)
