"""Licence scan by canonical digests, in DataFrame expressions only.

A text is canonicalised (case, punctuation, copyright lines, equivalent spellings, white space), hashed as a
whole and joined with the digests of known licence texts. The same is done with each of its lines against
known one-line notices, since most files only carry a notice. Both tables are a parameter. They are looked up
in a map or broadcast behind a count; larger ones are joined by a shuffle.

Whole texts known: MIT, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause by their text, and those of ``DIGESTS`` by the digest of
their canonical text. Every name of ``_NAMES`` is known in one-line notices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.common import sized, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name a copyright holder do not tell licences apart.
COPYRIGHT = r"(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*"
#: Spellings that count as equal, after punctuation has become spaces.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("gpl", "gnu general public license"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("maximise", "maximize"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: The same for several words.
PHRASES = (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright holder s", "copyright holders"))

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
#: Fixed values: ``(licence, text)``; whole texts first, then notices.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3 + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_3 + _BSD_TAIL),
    ("Unlicense", _UNLICENSE),
]
_NAMES = {
    "MIT": ["the MIT License", "MIT", "the MIT License (MIT)", "an MIT-style license"],
    "ISC": ["the ISC License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "the Apache-2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPLv2", "the GPL version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPLv3", "the GPL version 3", "the GNU General Public License v3.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "CC-BY-4.0": ["a Creative Commons Attribution 4.0 International License", "CC BY 4.0", "the Creative Commons Attribution 4.0 License", "a Creative Commons Attribution 4.0 license"],
    "CC-BY-SA-4.0": ["a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA 4.0"],
    "CC-BY-NC-4.0": ["a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["the Unlicense"],
}
_FRAMES = [
    "Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "This work is released under {}.", "This file is licensed under {}.",
    "This software is licensed under {}.", "This project is licensed under {}.", "Distributed under {}.", "Published under {}.", "This software is distributed under {}.",
    "This software is released under {}.", "This content is licensed under {}.", "Available under {}.", "This text is available under {}.", "License: {}", "This is free software under {}.",
]
NOTICES = [(k, frame.format(name)) for k, names in _NAMES.items() for name in names for frame in _FRAMES] + [(k, f"SPDX-License-Identifier: {k}") for k in _NAMES]
#: SHA-256 of the canonical whole text, for licences that are too long to be held here.
DIGESTS = [
    ("Apache-2.0", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("Artistic-1.0-Perl", "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "de658317cc464554c39d35a3bf75b5844ac763ce4625dde0a935c19c2221b483"),
    ("LGPL-2.0", "0c343d0ce153b10663d1df73c62c82f741aec01b15b9ea8e46b70b3ed84def02"),
    ("LGPL-2.1", "3b1aa54c4f39e76c257742e6a7fc39125a76e4a65ef8bb50b6ec5df9c02d4823"),
    ("LGPL-3.0", "3ede7494a82fe6f9c1d0a28646ae309d51b9cc301b39d60d0de3be5c1869bd38"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
KNOWN = [(k, "text", t) for k, t in TEXTS] + [(k, "digest", d) for k, d in DIGESTS] + [(k, "notice", t) for k, t in NOTICES]


def _lines(text: Column) -> Column:
    """A text with its lines kept, without copyright lines, case, punctuation and variants of spelling; every word between spaces of its own."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}\n]+", "  "), "\n", " \n "), F.lit(" "))
    return reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, out)


def _joined(lines: Column) -> Column:
    """Words by single spaces, and phrases of equal meaning made equal."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, r"[ \n]+", " ")), F.lit(" "))
    return F.trim(reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), PHRASES, out))


def canonical(text: Column) -> Column:
    """A text without copyright lines, case, punctuation and variants of spelling; words by single spaces."""
    return _joined(_lines(text))


def known_licences(spark: SparkSession) -> DataFrame:
    """``license, kind, text``: what comes with the operator. ``kind``: whole ``text``, the ``digest`` of one, or one-line ``notice``."""
    return spark.createDataFrame(KNOWN, "license string, kind string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text_license, n_notices, notice_licenses, digest`` of each row of ``docs(doc_id, text, ...)``.

    ``text_license``: the licence whose whole text the row is, else null; ``n_notices``: lines that are a known
    notice; ``notice_licenses``: their licences, sorted and joined by commas (empty if there are none);
    ``digest``: SHA-256 of the canonical text. Null and empty texts match nothing and have the empty text's
    digest. If two known texts have one digest, the smaller licence name stands. Repeated rows are scanned each
    for themselves; other columns are ignored. A notice of several lines matches none.
    """
    # The empty canonical text, e.g. of a copyright line alone, is no licence.
    table = known.withColumn("c", F.when(F.col("kind") != "digest", canonical(F.col("text")))).where("kind = 'digest' or c <> ''")
    table = table.withColumn("digest", F.when(F.col("kind") == "digest", F.lower("text")).otherwise(F.sha2("c", 256)))
    table = table.groupBy("digest", F.when(F.col("kind") == "notice", "notice").otherwise("text").alias("kind"))
    table = stored(table.agg(F.min("license").alias("license"), F.min(F.length("c")).alias("n")))
    whole = sized(table.where("kind = 'text'").select("digest", F.col("license").alias("text_license")))
    notices = table.where("kind = 'notice'")
    total, least, most = notices.agg(F.count(F.lit(1)), F.coalesce(F.min("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(-1))).first()
    # Only lines as long as some notice are hashed.
    lines = F.filter(F.transform(F.split("lines", "\n"), _joined), lambda x: F.length(x).between(least, most))
    rows = docs.select("doc_id", _lines(F.coalesce(F.col("text"), F.lit(""))).alias("lines"))
    rows = rows.select("doc_id", F.sha2(_joined(F.col("lines")), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("l"))
    if total <= NOTICE_MAP:
        notices = notices.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("notices"))
        rows = rows.crossJoin(F.broadcast(notices))  # one row of at most NOTICE_MAP entries
        rows = rows.withColumn("found", F.filter(F.transform("l", lambda x: F.try_element_at(F.col("notices"), x)), lambda x: x.isNotNull()))
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        met = rows.select("row", F.explode("l").alias("digest")).join(notices.select("digest", "license"), "digest").groupBy("row").agg(F.collect_list("license").alias("found"))
        rows = rows.join(met, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return rows.join(whole, "digest", "left").select(
        "doc_id",
        "text_license",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_licenses"),
        "digest",
    )


#: Notices that are looked up in one map.
NOTICE_MAP = 20_000


def _oracle() -> str:
    def swap(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
        for ours, theirs in pairs:
            text = f"replace({text}, ' {ours} ', ' {theirs} ')"
        return text

    def split(text: str) -> str:
        out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '\\1', 'g')"
        return swap(f"' ' || replace(regexp_replace({out}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '", SPELLINGS)

    def joined(lines: str) -> str:
        return "trim(" + swap(f"' ' || trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'), ' ') || ' '", PHRASES) + ", ' ')"

    values = ", ".join("('{}', '{}', '{}')".format(k, kind, t.replace("'", "''")) for k, kind, t in KNOWN)
    return (
        f"WITH v AS (SELECT license, kind, t, {split('t')} AS s FROM (VALUES {values}) AS v(license, kind, t)), "
        f"k AS (SELECT CASE WHEN kind = 'digest' THEN t ELSE sha256({joined('s')}) END AS digest, CASE kind WHEN 'notice' THEN 'notice' ELSE 'text' END AS kind, min(license) AS license "
        f"FROM v WHERE {joined('s')} <> '' GROUP BY 1, 2), "
        f"d AS (SELECT doc_id, {split("coalesce(text, '')")} AS s FROM documents), "
        f"l AS (SELECT doc_id, {joined('line')} AS line FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS line FROM d)), "
        f"n AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS found FROM l JOIN k ON kind = 'notice' AND k.digest = sha256(line) WHERE line <> '' GROUP BY 1) "
        f"SELECT d.doc_id, t.license AS text_license, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.found, '') AS notice_licenses, d.digest "
        f"FROM (SELECT doc_id, sha256({joined('s')}) AS digest FROM d) d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k t ON t.kind = 'text' AND t.digest = d.digest"
    )


ORACLE = _oracle()
