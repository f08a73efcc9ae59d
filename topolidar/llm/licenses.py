"""License scans: sentences known by their normal form, and ordered rules over the sequence of known sentences."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolidar.llm.batches import text_table

# Sentences of licences and of notices that grant one, as (identifier, sentence).
SENTENCES = [
    ("CcByNcBrief", "Licensed under CC BY-NC 4.0."),
    ("CcByBrief", "Licensed under CC BY 4.0."),
    ("CcBySaBrief", "Licensed under CC BY-SA 4.0."),
    ("CcZeroBrief", "Released under CC0 1.0."),
    ("CcByWork", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CcBySaWork", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CcByNcWork", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Gpl3Work", "This work is licensed under the GNU General Public License, version 3."),
    ("Gpl2Work", "This work is licensed under the GNU General Public License, version 2."),
    ("Gpl3Grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Gpl2Grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GnuHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GplSee", "See the GNU General Public License for more details."),
    ("GplCopy", "You should have received a copy of the GNU General Public License along with this program."),
    ("Apache2Brief", "Licensed under the Apache License, Version 2.0."),
    ("Apache2Grant", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache2Copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache2Obtain", "You may obtain a copy of the License at"),
    ("Apache2Obtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache2Obtain", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache2Url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache2Url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache2Unless", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache2See", "See the License for the specific language governing permissions and limitations under the License."),
    ("MitBrief", "Released under the MIT License."),
    ("MitBrief", "Licensed under the MIT License."),
    ("MitGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MitGrantOpen", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("AsIsSoftware", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MitLiable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1."),
    ("BsdGrantSource", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BsdName", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdAsIs", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BsdLiable", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscAsIs", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("IscLiable", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Mpl2Subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("Mpl2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Mpl2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Lgpl21Grant", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Lgpl3Grant", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Lgpl3Grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GnuHope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LgplSee", "See the GNU Lesser General Public License for more details."),
    ("Agpl3Grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AgplSee", "See the GNU Affero General Public License for more details."),
    ("AgplCopy", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("Epl2Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Epl2Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("AllRights", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: The normal form of a notice of copyright: its word or sign, then a year or a sign. "Copyright law" is none.
COPYRIGHT = r"^(copyright (c |© |by )*[0-9][0-9][0-9][0-9]|copyright (c|©) |© )"

# Rules in the order in which they are tried, as (licence, sequence of identifiers).
RULES = [
    ("GPL-3.0-or-later", ["Gpl3Grant", "GnuHope", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Grant", "GnuHope", "GplSee"]),
    ("GPL-3.0-or-later", ["Gpl3Grant"]),
    ("GPL-2.0-or-later", ["Gpl2Grant", "GnuHope", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["Gpl2Grant", "GnuHope", "GplSee"]),
    ("GPL-2.0-or-later", ["Gpl2Grant"]),
    ("AGPL-3.0-or-later", ["Agpl3Grant", "GnuHope", "AgplSee", "AgplCopy"]),
    ("AGPL-3.0-or-later", ["Agpl3Grant", "GnuHope", "AgplSee"]),
    ("AGPL-3.0-or-later", ["Agpl3Grant"]),
    ("LGPL-2.1-or-later", ["Lgpl21Grant", "GnuHope", "LgplSee"]),
    ("LGPL-2.1-or-later", ["Lgpl21Grant"]),
    ("LGPL-3.0-or-later", ["Lgpl3Grant", "GnuHope", "LgplSee"]),
    ("LGPL-3.0-or-later", ["Lgpl3Grant"]),
    ("Apache-2.0", ["Apache2Grant", "Apache2Copy", "Apache2See"]),
    ("Apache-2.0", ["Apache2Grant", "Apache2Obtain", "Apache2Url", "Apache2Unless", "Apache2See"]),
    ("Apache-2.0", ["Apache2Grant", "Apache2Obtain", "Apache2Unless", "Apache2See"]),
    ("Apache-2.0", ["Apache2Grant"]),
    ("MIT", ["MitGrant", "AsIsSoftware", "MitLiable"]),
    ("MIT", ["MitGrant", "AsIsSoftware"]),
    ("MIT", ["MitGrantOpen", "MitNotice", "AsIsSoftware", "MitLiable"]),
    ("MIT", ["MitGrantOpen", "MitNotice", "AsIsSoftware"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdName", "BsdAsIs", "BsdLiable"]),
    ("BSD-3-Clause", ["BsdGrantSource", "BsdBinary", "BsdName", "BsdAsIs", "BsdLiable"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdName"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiable"]),
    ("BSD-2-Clause", ["BsdGrantSource", "BsdBinary", "BsdAsIs", "BsdLiable"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("ISC", ["IscGrant", "IscAsIs", "IscLiable"]),
    ("ISC", ["IscGrant"]),
    ("MPL-2.0", ["Mpl2Subject", "Mpl2Copy"]),
    ("EPL-2.0", ["Epl2Terms"]),
    ("GPL-3.0", ["Gpl3Work"]),
    ("GPL-2.0", ["Gpl2Work"]),
    ("Apache-2.0", ["Apache2Brief"]),
    ("MIT", ["MitBrief"]),
    ("CC-BY-NC-4.0", ["CcByNcBrief"]),
    ("CC-BY-NC-4.0", ["CcByNcWork"]),
    ("CC-BY-SA-4.0", ["CcBySaBrief"]),
    ("CC-BY-SA-4.0", ["CcBySaWork"]),
    ("CC-BY-4.0", ["CcByBrief"]),
    ("CC-BY-4.0", ["CcByWork"]),
    ("CC0-1.0", ["CcZeroBrief"]),
    ("Unlicense", ["Unlicense"]),
]

#: Licences that a line "SPDX-License-Identifier: ..." may name, after all others.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"]
SENTENCES += [(f"Spdx-{name}", f"SPDX-License-Identifier: {name}") for name in SPDX]
RULES += [(name, [f"Spdx-{name}"]) for name in SPDX]

#: The end of a sentence, and what a normal form has a space for: ASCII that is no letter, digit or line feed.
#: Marks of comments and lists that a line may begin with.
LEADERS = r"(^|\n)[\x20\x09]*(//+|#+|\*+|;+)[\x20\x09]*"
END, OTHER = r"([.!?])[\x09\x0B-\x0D\x20]+", r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(sentence: str) -> str:
    lower = sentence.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return re.sub(OTHER.replace(r"\x09\x0B", r"\x09\x0A\x0B"), " ", lower).strip(" ")


def known_sentences() -> dict[str, str]:
    return {normal(s): i for i, s in SENTENCES}


def sentences(text: Column, unwrap: bool) -> Column:
    """The normal forms of a text's sentences. Lines are sentences or more; with ``unwrap`` only blank lines and full stops
    at a line's end divide, so that a sentence may go on over lines; marks that lines begin with are left out."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    if unwrap:
        lower = F.regexp_replace(lower, LEADERS, "$1")
        # A line break that ends neither a sentence nor a paragraph becomes a space.
        lower = F.regexp_replace(lower, r"([^.!?\n\x20\x09\x0D])[\x20\x09\x0D]*\n[\x20\x09\x0D]*([^\n\x20\x09\x0D])", "$1 $2")
    marked = F.regexp_replace(F.regexp_replace(lower, END, "$1\n"), OTHER, " ")
    return F.transform(F.split(marked, "\n"), lambda s: F.trim(s))


def _identified(found: Column, known: dict[str, str]) -> Column:
    ids = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    some = F.filter(found, lambda s: s.isin(list(known)) | s.rlike(COPYRIGHT))
    return F.transform(some, lambda s: F.coalesce(F.try_element_at(ids, s), F.lit("Copyright")))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_unmatched) for each row of ``df``: identifiers of the known sentences in order, the
    licences of the rules that match, in the rules' order, and known sentences, copyright notices aside, that no rule takes.

    Texts are read with lines as they are and unwrapped, and the reading with more known sentences counts, the unwrapped
    one in a tie. A rule takes every run of its sequence that earlier rules left; what was taken divides what is left. A
    null or empty text has no sentences. Repeated rows and null ids are rows like others; an empty table gives no rows;
    further columns are not read. One pass in DataFrame functions, without a shuffle.
    """
    known = known_sentences()
    docs = text_table(df, id_col, text_col)
    both = docs.select("doc_id", _identified(sentences(F.col("text"), False), known).alias("lines"), _identified(sentences(F.col("text"), True), known).alias("flowing"))
    ids = both.select("doc_id", F.when(F.size("flowing") >= F.size("lines"), F.col("flowing")).otherwise(F.col("lines")).alias("sentence_ids"))
    # One letter wide marks: <id> for a sentence, # for what a rule took.
    left = ids.withColumn("left", F.array_join(F.transform(F.filter("sentence_ids", lambda s: s != "Copyright"), lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    taken = []
    for name, sequence in RULES:
        mark = "".join(f"<{s}>" for s in sequence)
        taken.append(F.when(F.contains("left", F.lit(mark)), F.lit(name)))
        left = left.withColumn(f"rule_{len(taken)}", taken[-1]).withColumn("left", F.replace("left", F.lit(mark), F.lit("#")))
    found = F.array_distinct(F.array_compact(F.array(*(f"rule_{i + 1}" for i in range(len(RULES))))))
    return left.select("doc_id", "sentence_ids", found.alias("licenses"), F.regexp_count("left", F.lit("<")).cast("long").alias("n_unmatched"))
