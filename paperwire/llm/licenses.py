"""Licence scans: notices by TF-IDF cosine to templates, then inheritance along folders.

Lines and paragraphs of a file are held against short notices, paragraphs and the whole file against longer licence
texts, as sparse TF-IDF vectors. A part that denies a licence is no notice of it. The vectorizer is fixed by the templates: words they do not have weigh as much as the
rarest. A file without a notice inherits the licence of the nearest folder above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import checkpointed, forget_at_new_stage, join_groups, on_workers

# Customary public wordings of licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_HOLDERS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
    "for more details."
)
# Whole texts of short licences, and of long ones their title and the header they ask files to carry.
WHOLE: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.format(name="Affero General Public License", version=3)),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License Copyright (c) All rights reserved. " + _REDISTRIBUTION + _HOLDERS,),
    "BSD-3-Clause": ("BSD 3-Clause License Copyright (c) All rights reserved. " + _REDISTRIBUTION + _ENDORSEMENT + _HOLDERS,),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format(name="General Public License", version=2)),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format(name="General Public License", version=3)),
    "ISC": (
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format(name="Lesser General Public License", version=3)),
    "MIT": (
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. " + _WARRANTY + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. This notice may not be removed or altered from any source distribution.",
    ),
}
#: Words that turn a notice into its opposite, unless the template has them.
DENIALS = {"not", "never", "no", "isn", "cannot", "without", "unlike", "instead", "formerly", "previously"}
#: Least cosine of a notice; least share of a file's words that makes its notice the folder's licence.
THRESHOLD, FOLDER_SHARE = 0.8, 0.25
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|notice)([._-].*)?$"


class Templates:
    """Unit TF-IDF vectors of the templates, by term."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        texts = [(name, Counter(TERM.findall(text.lower()))) for name in sorted(templates) for text in templates[name]]
        seen = Counter(term for _, terms in texts for term in terms)
        self.weight = {term: math.log((1 + len(texts)) / (1 + n)) + 1 for term, n in seen.items()}
        self.other = math.log(1 + len(texts)) + 1
        self.names = [name for name, _ in texts]
        self.denied = [DENIALS - terms.keys() for _, terms in texts]
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, terms) in enumerate(texts):
            norm = math.sqrt(sum((n * self.weight[t]) ** 2 for t, n in terms.items()))
            for term, n in terms.items():
                self.postings[term].append((at, n * self.weight[term] / norm))

    def nearest(self, text: str, least: float = 0.0) -> tuple[str | None, float]:
        """The licence of highest cosine, ties to the first name; None below ``least``."""
        terms = Counter(TERM.findall(text.lower()))
        square, known = 0.0, 0.0
        for term, n in terms.items():
            part = (n * self.weight.get(term, self.other)) ** 2
            square += part
            known += part * (term in self.weight)
        # No cosine is above the root of the known terms' share: most lines end here.
        if not square or known / square < least**2 - 1e-9:
            return None, 0.0
        dots: dict[int, float] = defaultdict(float)
        for term, n in terms.items():
            for at, value in self.postings.get(term, ()):
                dots[at] += n * self.weight[term] * value
        if least:  # what denies a licence is no notice of it
            dots = {at: d for at, d in dots.items() if self.denied[at].isdisjoint(terms)}
        score, at = max(((round(d / math.sqrt(square), 9), -at) for at, d in dots.items()), default=(0.0, 0))
        return (self.names[-at], score) if dots and score >= least else (None, 0.0)


@lru_cache(maxsize=2)
def _templates(items: tuple[tuple[str, tuple[str, ...]], ...]) -> Templates:
    return Templates(dict(items))


def paragraphs(text: str) -> list[str]:
    """Parts between lines that hold no word or digit, as empty lines and lines of comment marks are."""
    return [p for p in re.split(r"\n(?:[^\w\n]*\n)+", text) if p.strip()]


def notices(
    text: Column, whole: Column, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = THRESHOLD, texts: dict[str, tuple[str, ...]] = WHOLE
) -> Column:
    """Struct of ``licence`` and ``score`` of the best part, and ``share`` of the file's words in it.

    Each line and paragraph is held against the short notices (a licence file also as a whole), each paragraph and
    the whole file against the longer texts, in a space of their own.
    """
    items, longer = tuple(sorted(templates.items())), tuple(sorted(texts.items()))

    @F.arrow_udf("struct<licence: string, score: double, share: double>")
    def found(texts: pa.Array, files: pa.Array) -> pa.Array:
        forget_at_new_stage(_templates.cache_clear)
        held, wide, names, scores, shares = _templates(items), _templates(longer), [], [], []
        for text, file in zip(texts, files):
            text = text.as_py() or ""
            best, words, some = (None, 0.0, 0), len(text.split()), paragraphs(text)
            several = [p for p in some if "\n" in p.strip()]
            short, long = [*text.split("\n"), *several, *[text] * bool(file.as_py())], [*some, *[text] * (len(some) != 1)]
            for space, parts in ((held, short), (wide, long)):
                for part in parts:
                    name, score = space.nearest(part, least)
                    if name and score > best[1]:
                        best = name, score, len(part.split())
            names.append(best[0])
            scores.append(best[1])
            shares.append(best[2] / words if words else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], ["licence", "score", "share"])

    return found(text, whole)


def folders_above(folder: Column) -> Column:
    """The folder and all folders above it, up to the root (the empty string), as structs of depth and path."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("path")))


def scan(
    df: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES,
    least: float = THRESHOLD, share: float = FOLDER_SHARE,
) -> DataFrame:
    """``key``, ``path``, ``licence``, ``score``, ``how`` (``notice``, ``inherited`` or ``none``) and ``folder`` it came from.

    A file is a folder's licence file if it has a notice and either a licence file's name or a notice that makes up ``share`` of
    its words; of several the highest score counts, then the first path, then the first licence. NULL and empty texts have
    no notice. Whole texts are looked at, also very long ones. A NULL path is a file without a name in the root folder. Repeated rows are each answered; an empty table
    stays empty. Other columns are not read.
    """
    on_workers(df.sparkSession)
    full = F.coalesce(F.col(path), F.lit(""))
    name = F.substring_index(full, "/", -1)
    parts = F.filter(F.split(full, "/"), lambda x: x != "")
    rows = df.select(
        F.col(key).alias("_key"), F.col(path).alias("_path"), F.col(text).alias("_text"), name.rlike(FILE_NAME).alias("_named"),
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("_folder"),
    )
    rows = rows.select("_key", "_path", "_folder", "_named", notices(F.col("_text"), F.col("_named"), templates, least).alias("_n"))
    rows = checkpointed(rows.select("_key", "_path", "_folder", "_named", "_n.*"))
    # One licence per folder, from few rows per task.
    best = F.min(F.struct((-F.col("score")).alias("s"), F.coalesce("_path", F.lit("")).alias("p"), F.col("licence").alias("l")))
    files = rows.where(F.col("licence").isNotNull() & (F.col("_named") | (F.col("share") >= share)))
    licences = files.groupBy("_folder").agg(best.alias("b")).select(F.col("_folder").alias("folder"), F.col("b.l").alias("given"), (-F.col("b.s")).alias("given_score"))
    licences = checkpointed(licences)
    # Each folder with files looks upwards; files follow their folder.
    folders = checkpointed(rows.groupBy("_folder").agg(F.count(F.lit(1)).alias("_files")))
    upward = folders.select("_folder", F.explode(folders_above(F.col("_folder"))).alias("_up"))
    met = upward.join(licences, F.col("_up.path") == F.col("folder")).groupBy("_folder")
    nearest = met.agg(F.max(F.struct(F.col("_up.depth").alias("d"), "folder", "given", "given_score")).alias("_given"))
    held = checkpointed(folders.join(nearest, "_folder", "left").select("_folder", "_files", "_given"))
    found = join_groups(rows, held, "_folder", "_files")
    own, given = F.col("licence").isNotNull(), F.col("_given").isNotNull()
    return found.select(
        F.col("_key").alias(key),
        F.col("_path").alias("path"),
        F.coalesce("licence", "_given.given").alias("licence"),
        F.when(own, F.col("score")).otherwise(F.coalesce("_given.given_score", F.lit(0.0))).alias("score"),
        F.when(own, "notice").when(given, "inherited").otherwise("none").alias("how"),
        F.when(~own, F.col("_given.folder")).alias("folder"),
    )
