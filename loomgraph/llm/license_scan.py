"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.

A file's licence statements lie around its signals, the words that open or name a
licence: every run of consecutive lines that touches one and has at most ``REACH``
words, its line and its paragraph whatever their length; a licence file (by its
name) is compared as a whole as well.  So a notice counts however it is wrapped.
Statements are sparse vectors of lower-cased words, weighted by ``tf * idf``; the
document frequency of every word comes from all files.  The best template with a
cosine of ``MIN_COSINE`` or more is the file's declared licence.  An SPDX tag is
read as such: it declares its identifiers with a cosine of 1.

Statements are reduced to the distinct ones, which meet the frequencies of their
words in a join, so neither has to fit the driver.

A file without one inherits from the nearest directory above it (its own first)
that holds a licence file with a licence.  Directories are reduced to the distinct
ones before their ancestors are joined, so a directory with many files weighs no
more than any other there.

Defined results: null and empty texts declare nothing; a null path declares but
does not inherit; of licence files in one directory the best match counts, then
the least path; repeated rows are each answered; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import slices
from .workspace import cut

MIN_COSINE = 0.5
#: Short public notices by licence identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 of the License, or any later version"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License, or any later version"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License, or any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 2.1 of the License, or any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, either version 3 of the License, or any later version"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions of the BSD License are met"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright, CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole public licences, which licence files and long paragraphs hold.
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)
TEMPLATES = NOTICES + TEXTS
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: In lower-cased text; its words can stand in two lines.
_SIGNAL = re.compile(r"licen[cs]e|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|\bcc[^a-z0-9]+(?:by|0)|\bcc0|copyright|spdx|permission|redistribut|free[^a-z0-9]+software|unencumbered")
_ID = r"\(*[a-z0-9][a-z0-9.+-]*\)*"
_SPDX = re.compile(rf"spdx-license-identifier:[ \t]*({_ID}(?:[ \t]+(?:and|or|with)[ \t]+{_ID})*)", re.IGNORECASE)
_NAMES = {n.lower(): n for n, _ in TEMPLATES}
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


VOCABULARY = sorted({w for _, t in TEMPLATES for w in tokens(t)})
#: Words of a run of lines: twice those of the longest notice.
REACH = 2 * max(len(tokens(t)) for _, t in NOTICES)
#: Distinct words that a worker counts before it passes them on.
COUNTED = 50_000
#: Bits of the hashed words that are asked for: 8 MB.
BITS = 26


def spdx(text: str) -> str | None:
    """The licence that the first SPDX tag names, an expression as it stands; known names without -only, -or-later and +."""
    for m in _SPDX.finditer(text):
        short = lambda x: _NAMES.get(re.sub(r"(-only|-or-later|\+)$", "", x[0].lower()), x[0])
        name = re.sub(r"[A-Za-z0-9][A-Za-z0-9.+-]*", short, m[1])
        if name.upper() not in ("NONE", "NOASSERTION"):
            return name
    return None


def signals(text: str) -> list[tuple[int, int]]:
    """First and last line of each signal."""
    low = text.lower()
    found = [m.span() for m in _SIGNAL.finditer(low)]
    if not found:
        return []
    starts, at = [0], low.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = low.find("\n", at + 1)
    return [(bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1) for a, b in found]


def excerpt(text: str | None, whole: bool) -> str | None:
    """What of a text its statements can lie in: the lines within reach of a signal and its paragraph, parted by NUL where lines are left out."""
    if not text:
        return None
    text = text.replace("\0", " ")
    if whole:
        return text
    found = signals(text)
    if not found:
        return None
    lines = text.split("\n")
    sizes = [len(_WORD.findall(x.lower())) for x in lines]
    keep, reached, spread = [False] * len(lines), -1, -1
    for first, last in found:
        if last > spread:  # its paragraph, once
            low, spread = first, last
            while low and sizes[low - 1]:
                low -= 1
            while spread + 1 < len(lines) and sizes[spread + 1]:
                spread += 1
            keep[low : spread + 1] = [True] * (spread + 1 - low)
        if last > reached:
            reached = last
            for step, at in ((-1, first - 1), (1, last + 1)):
                words = 0
                while 0 <= at < len(lines) and (words := words + sizes[at]) <= REACH:
                    keep[at] = True
                    at += step
    out: list[str] = []
    for i, line in enumerate(lines):
        if keep[i]:
            out.append(line)
        elif out and out[-1] != "\0":
            out.append("\0")
    return "\n".join(out)


class Matcher:
    def __init__(self, n_files: int, frequency: dict[str, int]):
        self.n_files = n_files
        self.known = {w: self.weight(frequency.get(w, 0)) for w in VOCABULARY}
        self.names = [name for name, _ in TEMPLATES]
        #: per word, the templates that have it, with their unit vectors' entries
        self.entries: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(TEMPLATES):
            raw = {w: n * self.known[w] for w, n in Counter(tokens(text)).items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            for w, x in raw.items():
                self.entries.setdefault(w, []).append((k, x / norm))

    def weight(self, n: int) -> float:
        return math.log((1 + self.n_files) / (1 + n)) + 1

    def declared(self, text: str, whole: bool, frequency: dict[str, int]) -> tuple[float, str | None]:
        """The best match of any statement of an ``excerpt``; ties go to the earlier statement."""
        if name := spdx(text):
            return 1.0, name
        idf = {w: self.weight(n) for w, n in frequency.items()} | self.known
        unseen = self.weight(0)
        best, found = 0.0, None

        def grow(lines: list[list[str]], report: list[bool], limit: bool) -> None:
            """Scores the runs that start with the first line and end where ``report`` says."""
            nonlocal best, found
            have: dict[str, int] = {}
            square, words, dots = 0.0, 0, [0.0] * len(self.names)
            for j, line in enumerate(lines):
                words += len(line)
                if limit and j and words > REACH:
                    break
                for w in line:
                    x, n = idf.get(w, unseen), have.get(w, 0)
                    square += (2 * n + 1) * x * x
                    have[w] = n + 1
                    for k, y in self.entries.get(w, ()):
                        dots[k] += x * y
                if report[j] and square:
                    score = max(dots) / math.sqrt(square)
                    if score >= MIN_COSINE and score > best + 1e-12:
                        best, found = min(score, 1.0), self.names[dots.index(max(dots))]

        if whole:
            every = [tokens(text)]
            grow(every, [True], False)
        for region in text.split("\0"):
            near = signals(region)
            if not near:
                continue
            lines = [tokens(x) for x in region.split("\n")]
            hit = [False] * len(lines)
            for first, last in near:
                hit[first : last + 1] = [True] * (last + 1 - first)
            full = [i for i, x in enumerate(lines) if x]
            for p, i in enumerate(full):
                if p == 0 or full[p - 1] < i - 1:  # a paragraph starts
                    end = p
                    while end + 1 < len(full) and full[end + 1] == full[end] + 1:
                        end += 1
                    own = full[p : end + 1]
                    if any(hit[k] for k in own):
                        grow([lines[k] for k in own], [False] * (len(own) - 1) + [True], False)
                run, report, touched, words = [], [], False, 0
                for k in full[p:]:
                    words += len(lines[k])
                    if run and words > REACH:
                        break
                    touched = touched or hit[k]
                    run.append(lines[k])
                    report.append(touched)
                if touched:
                    grow(run, report, True)
        return best, found


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << BITS) - 1)


def _frequencies(files: DataFrame, text_col: str, asked: DataFrame) -> DataFrame:
    """(word, n): the files that have the word, of the ``asked`` words at least; that of the empty word is the number of all files."""
    bit = F.crc32(F.encode("word", "utf-8")).bitwiseAND(F.lit((1 << BITS) - 1))
    # A bitmap of the words comes to the driver; with many words it lets more of them through, it loses none.
    parts = asked.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(F.lit(32767)).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = bytearray(1 << (BITS - 3))
    for r in parts.collect():
        bits[r["part"] << 12 : (r["part"] + 1) << 12] = r["bits"]
    for h in map(_bit, VOCABULARY):
        bits[h >> 3] |= 1 << (h & 7)
    shared = files.sparkSession.sparkContext.broadcast(bytes(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        bits, crc32, mask = shared.value, zlib.crc32, (1 << BITS) - 1
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for w in set(tokens(text or "")):
                    h = crc32(w.encode()) & mask
                    if bits[h >> 3] >> (h & 7) & 1:
                        count[w] += 1
            count[""] += batch.num_rows
            if len(count) > COUNTED:
                yield pa.RecordBatch.from_pydict({"word": list(count), "n": list(count.values())})
                count.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})

    return files.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _scored(heads: DataFrame, files: DataFrame, text_col: str) -> DataFrame:
    """(statement, declared, cosine) of the distinct (statement, named, text), with frequencies of ``files``."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, word = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = sorted(set(tokens(text)) | {""})
                owner += [i] * len(own)
                word += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(word, pa.string())], ["statement", "word"])

    asked = heads.select("statement", "text").mapInArrow(words, "statement binary, word string")
    frequencies = cut(_frequencies(files, text_col, asked))
    frequency = {r["word"]: r["n"] for r in frequencies.where(F.col("word").isin("", *VOCABULARY)).collect()}  # a fixed vocabulary
    shared = heads.sparkSession.sparkContext.broadcast((frequency.get("", 0), frequency))
    known = asked.join(frequencies, "word").groupBy("statement").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        for batch in slices(batches):
            found = [matcher.declared(t, w, {x["word"]: x["n"] for x in k}) for w, t, k in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.float64())], ["statement", "declared", "cosine"])

    return heads.join(known, "statement").select("statement", "named", "text", "known").mapInArrow(run, "statement binary, declared string, cosine double")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """Per file (keys, path, declared, cosine, license, inherited_from): ``license`` is the declared or else the inherited one."""
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("none"))
    rows = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(path_col).rlike(_FILE_NAME), F.lit(False)).alias("named"), F.col(text_col).alias("text"), key.alias("key"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [excerpt(t, w) for t, w in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            names = [None if t is None else hashlib.blake2b(t.encode(), digest_size=16, salt=b"named" * w).digest() for t, w in zip(parts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(names, pa.binary()), pa.array(parts, pa.string())], ["path", "named", "key", "statement", "text"])

    read = cut(rows.mapInArrow(run, f"path string, named boolean, key {key_type}, statement binary, text string"))
    heads = cut(read.where("statement IS NOT NULL").groupBy("statement").agg(F.first("named").alias("named"), F.first("text").alias("text")))
    scored = _scored(heads, files, text_col)
    # A common statement's rows can be split, its other side has one row.
    held = read.where("statement IS NOT NULL").drop("text").join(scored, "statement", "left").select("path", "named", "key", "declared", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    found = cut(held.union(read.where("statement IS NULL").select("path", "named", "key", F.lit(None).cast("string").alias("declared"), F.lit(0.0).alias("cosine"))))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    found = found.withColumn("folder", folder)
    best = F.struct(-F.col("cosine"), F.col("path").alias("p"), F.col("declared").alias("d"))
    holders = found.where("named AND declared IS NOT NULL").groupBy(F.col("folder").alias("above")).agg(F.min(best).alias("best"))
    holders = holders.select("above", F.col("best.p").alias("source"), F.col("best.d").alias("given"))
    folders = found.where("folder IS NOT NULL AND declared IS NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), ""))).alias("above"))
    nearest = ancestors.join(holders, "above").groupBy("folder").agg(F.max_by(F.struct("given", "source"), F.length("above")).alias("from"))
    # Only files that look for one meet the directories; a hot directory's rows can be split, its other side has one row.
    seeking = found.where("declared IS NULL").join(nearest, "folder", "left")
    columns = [*(F.col("key")[k].alias(k) for k in keys), F.col("path"), F.col("declared"), F.col("cosine")]
    out = seeking.select(*columns, F.col("from.given").alias("license"), F.col("from.source").alias("inherited_from"))
    return out.union(found.where("declared IS NOT NULL").select(*columns, F.col("declared").alias("license"), F.lit(None).cast("string").alias("inherited_from")))
