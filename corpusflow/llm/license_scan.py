"""License scans by canonical digest lookup.

A text is normalised (case, copyright lines, equivalent spellings, punctuation
and white space), and the digest of all of it is looked up among the digests of
known licences, which go through the same normalisation. The known texts are a
fixed table: the files in ``licenses`` beside this module (each also without what follows its end
mark, such as instructions to apply it), and the short texts and notices below. They are
some dozen rows, so their side of the hash join is broadcast.

Defined cases: null and empty texts, and texts of copyright lines and
punctuation only, have the digest of the empty text, which is no licence's;
repeated rows are looked up each; two licences with one digest count as the one
whose name sorts first; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import documents

#: Licence texts and customary notices, without their copyright lines.
SHORT = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}
#: Fixed value: what follows this line of a licence is no part of it.
END = re.compile(r"END OF (?:THE )?TERMS AND CONDITIONS")


@cache
def known_licenses() -> list[tuple[str, str]]:
    """``(license id, text)`` of all known texts; some licences have several."""
    out = list(SHORT.items())
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
            out.append((name, text))
            if end := END.search(text):
                out += [(name, text[: end.start()]), (name, text[: end.end()])]
    return out


#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("http://", "https://"), ("&", " and ")]
#: A line that states a copyright by sign, year or formula; a wrapped "copyright notice" is none.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by[ \t])|\(c\)[ \t]*(copyright[ \t]*)?[0-9]{4}|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The text without what may differ between copies of one licence."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, license_id, is_license, digest`` of ``docs`` (doc_id, text) against ``known`` (license id, text)."""
    digest = lambda text: F.sha2(canonical(text).cast("binary"), 256)
    table = docs.sparkSession.createDataFrame(known_licenses() if known is None else known, "license_id string, known string")
    table = table.where(canonical(F.col("known")) != "").groupBy(digest(F.col("known")).alias("digest")).agg(F.min("license_id").alias("license_id"))
    found = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(F.broadcast(table), "digest", "left")
    return found.select("doc_id", "license_id", F.col("license_id").isNotNull().alias("is_license"), "digest")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _op6_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    def canon(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known_licenses())
    return f"""
WITH k AS (SELECT sha256({canon("known")}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) v(license_id, known) GROUP BY 1),
d AS (SELECT doc_id, sha256({canon("text")}) AS digest FROM documents)
SELECT d.doc_id, k.license_id, k.license_id IS NOT NULL AS is_license, d.digest FROM d LEFT JOIN k USING (digest)
"""


OP6_SQL = _op6_sql()
