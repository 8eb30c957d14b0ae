"""Licence scans by canonical digest lookup."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, ascii_lower, broadcast_if_small

# Public licence texts and the usual one-sentence notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
LICENSES: list[tuple[str, str]] = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _ISC_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
]
LICENSES.append(
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
        + "\n\nFor more information, please refer to <http://unlicense.org/>",
    )
)
#: Title lines that usual files of a licence begin with.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "Unlicense": ("The Unlicense",),
}


def _variants() -> list[tuple[str, str]]:
    """Full texts from files, without appendices and with bullets for clause numbers where such forms are usual; then titles."""
    texts = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        texts.append((path.stem, text))
        if path.stem.startswith("BSD"):
            texts.append((path.stem, re.sub(r"(?m)^[1-3][.] ", "* ", text)))
        if "END OF TERMS AND CONDITIONS" in text:
            head = text[: text.index("END OF TERMS AND CONDITIONS")]
            texts += [(path.stem, head), (path.stem, head + "END OF TERMS AND CONDITIONS")]
    titled = [(i, f"{title}\n\n{text}") for i, text in [*LICENSES, *texts] for title in TITLES.get(i, ())]
    return [*titled, *texts]


LICENSES[:0] = _variants()
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]

#: Regular expressions applied in this order to lower-cased text, which mean the same to Java and RE2. Each comes with the
#: strings of which a text must hold one for the rule to change it; without any, the rule is for every text.
CANONICAL_RULES: list[tuple[tuple[str, ...], str, str]] = [
    # lines that hold nothing but a copyright statement, and "all rights reserved"
    (("copyright", "(c)", "©"), r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4}|<|\[)[^\n]*$", " "),
    (("all rights reserved",), r"(?m)^[ \t#*/;-]*all rights reserved[.]?[ \t\r]*$", " "),
    # equivalent spellings
    (("https",), r"\bhttps\b", "http"),
    (("licence",), r"\blicence", "license"),
    (("sub licen", "sub-licen", "sublicen"), r"\bsub[ -]licen[cs]e", "sublicense"),
    (("acknowledgement",), r"\backnowledgement", "acknowledgment"),
    (("infringement",), r"\bnon[ -]infringement", "noninfringement"),
    (("copyright owner",), r"\bcopyright owner", "copyright holder"),
    (("per cent",), r"\bper cent\b", "percent"),
    (("&",), r"&", " and "),
    # ASCII punctuation, typographic quotes, dashes and white space
    ((), r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{2018}\x{2019}\x{201C}\x{201D}\x{2013}\x{2014}\x{2026}\x{00A9}\x{00A0}]+", " "),
]


def canonical(text: Column) -> Column:
    """A text in lower case, without copyright lines or punctuation, in one spelling and spacing; blank for null.

    A rule's regular expression only sees texts that hold a string it is about. Each rule takes its text as the one element
    of an array, so that the expression names its input once, however often the rule does.
    """
    out = ascii_lower(F.coalesce(text, F.lit("")))
    for needles, pattern, to in CANONICAL_RULES:
        if needles:
            out = _guarded(out, needles, pattern, to)
        else:
            out = F.regexp_replace(out, pattern, to)
    return F.coalesce(F.trim(out), F.lit(""))


def _guarded(text: Column, needles: tuple[str, ...], pattern: str, to: str) -> Column:
    def rule(t: Column) -> Column:
        found = t.contains(needles[0])
        for needle in needles[1:]:
            found = found | t.contains(needle)
        return F.when(found, F.regexp_replace(t, pattern, to)).otherwise(t)

    return F.transform(F.array(text), rule)[0]


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def license_table(spark, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """license_id and digest of each known text that is not blank; of two ids with equal texts the first in order stays.

    The given texts are on the driver already, and so are their digests: as a table of values they impose no conditions on
    what they are joined to.
    """
    known = spark.createDataFrame([*texts], "license_id string, text string").select("license_id", canonical(F.col("text")).alias("c"))
    rows = known.filter("c <> ''").groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id")).collect()
    return spark.createDataFrame([tuple(r) for r in rows], "digest string, license_id string")


def scan_licenses(
    docs: DataFrame,
    *,
    licenses: Sequence[tuple[str, str]] = tuple(LICENSES),
    notices: Sequence[tuple[str, str]] = tuple(NOTICES),
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license_id, notices, n_notice_lines.

    ``license_id``: the known licence (or notice) whose canonical digest equals that of the whole text, else null.
    ``notices``: ids of the known texts that make up a whole line, sorted and comma-joined, else null;
    ``n_notice_lines`` counts those lines. The digests of known texts are broadcast only where their count, 100 bytes
    each, is within ``broadcast_limit``.

    Defined cases: a null text counts as empty; a canonically empty text or line matches nothing. Every input row has a row of
    its own, repeated ids and repeated rows too, with what its own text holds; null ids stay null. Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = license_table(spark, [*licenses, *notices])
    if 100 * (len(licenses) + len(notices)) <= broadcast_limit:
        known = F.broadcast(known)
    # equal texts hold equal notices, so a text's digest stands for it
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    whole = rows.select("doc_id", "key", canonical_digest(F.col("text")).alias("canonical_sha256"))
    found = whole.join(known, F.col("canonical_sha256") == F.col("digest"), "left").drop("digest")
    lines = rows.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("key", "pos", canonical_digest(F.col("line")).alias("d"))
    hits = (
        lines.join(known, F.col("d") == F.col("digest"))
        .select("key", "pos", "license_id")
        .distinct()
        .groupBy("key")
        .agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.count("*").alias("n_notice_lines"))
    )
    hits = Scratch(spark, "licenses").save(hits, "hits")
    return found.join(broadcast_if_small(hits, 32, broadcast_limit), "key", "left").select(
        "doc_id", "canonical_sha256", "license_id", "notices", F.coalesce("n_notice_lines", F.lit(0).cast("long")).alias("n_notice_lines")
    )


def license_sql(docs: str = "documents") -> str:
    """The same result in DuckDB SQL, over the known texts given as values."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canon(expr: str) -> str:
        out = f"translate(coalesce({expr}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for _, pattern, to in CANONICAL_RULES:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
        return f"trim({out}, ' ')"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in [*LICENSES, *NOTICES])
    return f"""
    WITH given(license_id, text) AS (VALUES {values}),
    known AS (SELECT sha256({canon("text")}) digest, min(license_id) license_id FROM given GROUP BY 1),
    whole AS (SELECT doc_id, coalesce(text, '') body, sha256({canon("text")}) canonical_sha256 FROM {docs}),
    lines AS (SELECT text body, unnest(string_split(text, chr(10))) line FROM (SELECT DISTINCT text FROM {docs})),
    hits AS (SELECT body, string_agg(DISTINCT license_id, ',' ORDER BY license_id) notices, count(*) n_notice_lines
             FROM (SELECT body, sha256({canon("line")}) d FROM lines) JOIN known ON d = digest AND digest <> sha256('') GROUP BY body)
    SELECT w.doc_id, canonical_sha256, license_id, notices, coalesce(n_notice_lines, 0)::BIGINT n_notice_lines
    FROM whole w LEFT JOIN known k ON w.canonical_sha256 = k.digest AND k.digest <> sha256('')
    LEFT JOIN hits h ON h.body = w.body
    """
