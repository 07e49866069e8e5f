"""License scans with DataFrame operations only: known sentences, then ordered rules over them.

A text is normalised, with marks where sentences end and where they may end, and the known licence
sentences between two marks give their identifiers. A licence is found where its rule, a sequence of
identifiers, occurs in a row among the identifiers of the document in the order of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, text_or_empty

# Known licence sentences by identifier, as published; they are compared in lower case, without signs.
TEXTS = {
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the License)",
    "apache-limits": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache1-title": "The Apache Software License, Version 1.1",
    "apache1-product": "This product includes software developed by the Apache Software Foundation",
    "asf-grant": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "asf-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "asf-files": "The ASF licenses this file to You under the Apache License, Version 2.0 (the License)",
    "by-line": "Licensed under CC BY 4.0",
    "by-sa-line": "Licensed under CC BY-SA 4.0",
    "by-nc-line": "Licensed under CC BY-NC 4.0",
    "by-nd-line": "Licensed under CC BY-ND 4.0",
    "by-nc-sa-line": "Licensed under CC BY-NC-SA 4.0",
    "by-nc-nd-line": "Licensed under CC BY-NC-ND 4.0",
    "by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "by3-work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "by-sa3-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "cc0-line": "Licensed under CC0 1.0",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law",
    "gpl2-line": "This work is licensed under the GNU General Public License, version 2",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3-free-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl2-free-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "gpl-copy-write": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc",
    "gpl-copy-url": "If not, see https://www.gnu.org/licenses/",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "fdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "mit-line": "Released under the MIT License",
    "mit-line-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-title-short": "MIT License",
    "mit-title-sign": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "x11-names": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-line": "Released under the BSD 3-Clause License",
    "bsd2-line": "Released under the BSD 2-Clause License",
    "bsd3-title": "BSD 3-Clause License",
    "bsd2-title": "BSD 2-Clause License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl1-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl2-url": "which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-title": "Eclipse Public License - v 1.0",
    "eupl-line": "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence)",
    "eupl-short": "Licensed under the EUPL",
    "eupl-title": "European Union Public Licence v. 1.2",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License)",
    "zlib-asis": "This software is provided as-is, without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-line": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic-title": "The Artistic License 2.0",
    "artistic-perl": "This is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    "python-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "postgres-title": "PostgreSQL License",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ofl-line": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "odbl-line": "This database is made available under the Open Database License",
    "pddl-line": "This data is made available under the Public Domain Dedication and License",
    "ms-pl-title": "Microsoft Public License (Ms-PL)",
    "reserved": "All rights reserved",
    "confidential": "This document is confidential and proprietary",
    "no-copies": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
}
# Rules in their order, as licence and the sentences that must follow each other. What one has matched
# is not there for those after it.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-ads")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-asis", "zlib-liability", "zlib-grant")),
    ("X11", ("mit-grant", "mit-notice", "mit-asis", "mit-liability", "x11-names")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit0-grant", "mit-asis")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-title", "isc-grant")),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("Apache-2.0", ("asf-grant", "asf-notice", "asf-files")),
    ("Apache-2.0", ("apache-grant", "apache-limits")),
    ("Apache-1.1", ("apache1-title",)),
    ("Apache-1.1", ("apache1-product",)),
    ("AGPL-3.0", ("agpl-free", "gpl-hope")),
    ("AGPL-3.0", ("agpl-title", "gpl-verbatim")),
    ("LGPL-2.1", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-2.1", ("lgpl21-title", "gpl-verbatim")),
    ("LGPL-3.0", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-3.0", ("lgpl3-title", "gpl-verbatim")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-free-only", "gpl-hope")),
    ("GPL-3.0", ("gpl3-title", "gpl-verbatim")),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0", ("gpl2-free-only", "gpl-hope")),
    ("GPL-2.0", ("gpl2-title", "gpl-verbatim")),
    ("CC0-1.0", ("cc0-title", "cc0-dedication")),
    ("EPL-2.0", ("epl2-available", "epl2-url")),
    ("PostgreSQL", ("postgres-title", "postgres-grant")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("MIT", ("mit-title", "mit-notice")),
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("asf-files",)),
    ("Apache-2.0", ("apache-title",)),
    ("CC-BY-4.0", ("by-line",)),
    ("CC-BY-4.0", ("by-work",)),
    ("CC-BY-3.0", ("by3-work",)),
    ("CC-BY-NC-4.0", ("by-nc-line",)),
    ("CC-BY-NC-4.0", ("by-nc-work",)),
    ("CC-BY-ND-4.0", ("by-nd-line",)),
    ("CC-BY-ND-4.0", ("by-nd-work",)),
    ("CC-BY-NC-SA-4.0", ("by-nc-sa-line",)),
    ("CC-BY-NC-SA-4.0", ("by-nc-sa-work",)),
    ("CC-BY-NC-ND-4.0", ("by-nc-nd-line",)),
    ("CC-BY-NC-ND-4.0", ("by-nc-nd-work",)),
    ("CC-BY-SA-4.0", ("by-sa-line",)),
    ("CC-BY-SA-4.0", ("by-sa-work",)),
    ("CC-BY-SA-3.0", ("by-sa3-work",)),
    ("CC0-1.0", ("cc0-line",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("GPL-2.0", ("gpl2-line",)),
    ("GPL-3.0", ("gpl3-line",)),
    ("GFDL-1.3", ("fdl-grant",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-licensed",)),
    ("BSD-3-Clause", ("bsd-line",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("BSD-2-Clause", ("bsd2-line",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd-grant",)),
    ("MPL-2.0", ("mpl-form",)),
    ("MPL-2.0", ("mpl-title",)),
    ("MPL-1.1", ("mpl1-subject",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("EUPL-1.2", ("eupl-line",)),
    ("EUPL-1.2", ("eupl-title",)),
    ("CDDL-1.0", ("cddl-subject",)),
    ("BSL-1.0", ("boost-line",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("WTFPL", ("wtfpl-title",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("Artistic-1.0-Perl", ("artistic-perl",)),
    ("Python-2.0", ("python-title",)),
    ("OFL-1.1", ("ofl-line",)),
    ("ODbL-1.0", ("odbl-line",)),
    ("PDDL-1.0", ("pddl-line",)),
    ("MS-PL", ("ms-pl-title",)),
    ("Proprietary", ("reserved",)),
    ("Proprietary", ("confidential",)),
    ("Proprietary", ("no-copies",)),
)


def plain(sentence: str) -> str:
    """Lower case, letters and digits, single blanks."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


SENTENCES = {name: plain(text) for name, text in TEXTS.items()}
# Where sentences end if each line is read by itself: line ends, and closing signs before a blank.
SENTENCE_END = r"[.!?;]+[ \t]+|[\n\r]+"
NOT_WORD = r"[^a-z0-9]+"
# Steps from a lower-case text to its marked words. No capitals are left in it, so H marks where a sentence
# ends (closing signs, lines without words) and S where it may end or go on (line ends, semicolons).
MARKS = (
    (r"\r\n?", "\n"),
    (r"(?<![a-z0-9])v\.(?=(?:[ \t\n]+|[ \t]*\n[^a-z0-9\n]*)[0-9])", "v"),
    (r";*[.!?][.!?;]*(?=[ \t\nH])", "H"),
    (r"\n[^a-z0-9]*\n", "H"),
    (r";+(?=[ \t\nH])|\n", "S"),
    (r"[^a-z0-9HS]+", " "),
    (r" ?S[ S]*", "S"),
    (r"[ S]?H[ HS]*", "H"),
)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def marked_words(text: Column) -> Column:
    """Lower-case words with single blanks or marks between them, and marks at both ends."""
    out = F.concat(F.lit("H"), F.lower(text), F.lit("H"))
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def any_sentence(sentences: Iterable[str]) -> str:
    """A pattern of all sentences as one tree of words: beginnings that they share are tried once, longer ones go first."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        words = sorted(w for w in node if w)
        one = [w + (f"(?:[ S]{pattern(node[w])})?" if "" in node[w] and len(node[w]) > 1 else f"[ S]{pattern(node[w])}" if "" not in node[w] else "") for w in words]
        return one[0] if len(one) == 1 else f"(?:{'|'.join(one)})"

    return pattern(tree)


def signal_words(sentences: Iterable[str]) -> list[str]:
    """Few pieces of words of which every sentence has one; a text without any of them has no sentence."""
    left, out = [s.split() for s in sentences], []
    while left:
        # Long ones, which other texts seldom have.
        words = sorted({w for s in left for w in s if len(w) > 5 or all(len(x) <= 5 for x in s)})
        best = max(words, key=lambda w: sum(any(w in x for x in s) for s in left))
        out.append(best)
        left = [s for s in left if not any(best in x for x in s)]
    return out


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """``doc_id, licenses, sentences`` per row: found licences, sorted and comma-joined, and the known
    sentences in text order, comma-joined.

    A sentence may run over single line ends and semicolons, but not over other closing signs before a
    blank ("v." before a digit is none, nor at a line's end where the next line begins with one) or lines without words; of overlapping ones the first, then the
    longest counts. Rules also hold on the text read line by line, so a one-line form is found even
    where it begins a longer sentence. Rules are tried in their order, and the sentences that one has matched, wherever they
    stand in the document, are not there for the next.

    Null and empty texts, and texts without a licence, have empty strings; a known sentence that is part
    of no matching rule is listed but gives no licence. Null and repeated ids are kept, each row by
    itself, whole texts of any length are read, other columns are ignored, and an empty table gives an empty result.
    """
    known = F.create_map(*[F.lit(x) for name, text in sentences.items() for x in (text, name)])
    anywhere = "(?<=[HS])" + any_sentence(sentences.values()) + "(?=[HS])"
    matches = F.regexp_extract_all(marked_words(text_or_empty()), F.lit(anywhere), F.lit(0))
    names = F.transform(matches, lambda s: F.try_element_at(known, F.translate(s, "S", " ")))
    pieces = F.filter(F.split(text_or_empty(), SENTENCE_END), lambda s: F.length(s) >= min(map(len, sentences.values())))
    by_line = F.filter(F.transform(pieces, lambda s: F.try_element_at(known, normalised(s))), lambda x: x.isNotNull())
    # Most texts have no word of a licence; they are looked through once and not marked.
    hopeful = F.lower(text_or_empty()).rlike("|".join(signal_words(sentences.values())))
    found = F.when(hopeful, F.struct(names.alias("names"), by_line.alias("by_line")))
    rows = columns_apart(docs, ["doc_id", "text"]).select("doc_id", found.alias("found"))
    # Every name has commas of its own, so that neighbours share none, and a bar parts what does not follow each other.
    line = F.concat(*[x for n in ("found.names", "found.by_line") for x in (F.lit("|,"), F.array_join(n, ",,"), F.lit(",|"))])
    some = F.coalesce(F.size("found.names") + F.size("found.by_line") > 0, F.lit(False))
    rows = rows.select("doc_id", F.coalesce(F.array_join("found.names", ","), F.lit("")).alias("sentences"), F.when(some, line).alias("line"))
    ordered = F.array(*[F.struct(F.lit(license).alias("license"), F.lit("," + ",,".join(seq) + ",").alias("seq")) for license, seq in rules])

    def tried(state: Column, rule: Column) -> Column:
        hit = F.contains(state["line"], rule["seq"])
        rest = F.when(hit, F.replace(state["line"], rule["seq"], F.lit("|"))).otherwise(state["line"])
        return F.struct(rest.alias("line"), F.when(hit, F.concat(state["licenses"], F.array(rule["license"]))).otherwise(state["licenses"]).alias("licenses"))

    first = F.struct(F.col("line").alias("line"), F.array().cast("array<string>").alias("licenses"))
    licenses = F.when(F.col("line").isNotNull(), F.aggregate(ordered, first, tried, lambda s: s["licenses"]))
    return rows.select("doc_id", F.coalesce(F.array_join(F.array_sort(F.array_distinct(licenses)), ","), F.lit("")).alias("licenses"), "sentences")
