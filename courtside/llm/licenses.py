"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its words, each as <word>. Rules are regular expressions over that form: signatures of the licenses' own
headers and texts, and each license name under each template. A rule runs only on texts that hold its keyword; its hits
carry word positions. A hit inside another hit of the same or a better priority is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import stored, table, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases with a label of their own, wherever their words stand in a row.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label, names, version. "2.0" also stands for "2".
NAMES = [
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", ""),
    ("afl-3", "academic free license|afl", "3.0"),
    ("agpl", "gnu affero general public license|gnu agpl|agpl", ""),
    ("agpl-3", "gnu affero general public license|gnu agpl|agpl", "3.0"),
    ("apache", "apache software|apache", ""),
    ("apache-1.1", "apache license|apache software license|apache", "1.1"),
    ("apache-2", "apache license|apache software license|apache", "2.0"),
    ("artistic-1", "artistic license|artistic", "1.0"),
    ("artistic-2", "artistic license|artistic", "2.0"),
    ("boost-1", "boost software license|boost|bsl", "1.0"),
    ("bsd", "bsd", ""),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", ""),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", ""),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", ""),
    ("bsl-1.1", "business source license|busl", "1.1"),
    ("cc-by", "cc by|creative commons attribution", ""),
    ("cc-by-nc", "cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial", ""),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution noncommercial noderivatives", ""),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution noncommercial sharealike", ""),
    ("cc-by-nd", "cc by nd|creative commons attribution noderivatives|creative commons attribution no derivatives", ""),
    ("cc-by-sa", "cc by sa|creative commons attribution sharealike|creative commons attribution share alike", ""),
    ("cc0", "cc0|creative commons zero", ""),
    ("cddl-1", "common development and distribution license|cddl", "1.0"),
    ("elastic-2", "elastic license", "2.0"),
    ("epl-1", "eclipse public license|epl", "1.0"),
    ("epl-2", "eclipse public license|epl", "2.0"),
    ("eupl-1.2", "european union public licence|eupl", "1.2"),
    ("gfdl", "gnu free documentation license|gfdl", ""),
    ("gpl", "gnu general public license|gnu gpl|gpl", ""),
    ("gpl-1", "gnu general public license|gnu gpl|gpl", "1.0"),
    ("gpl-2", "gnu general public license|gnu gpl|gpl", "2.0"),
    ("gpl-3", "gnu general public license|gnu gpl|gpl", "3.0"),
    ("isc", "isc", ""),
    ("lgpl", "gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl", ""),
    ("lgpl-2", "gnu library general public license|gnu lgpl|lgpl", "2.0"),
    ("lgpl-2.1", "gnu lesser general public license|gnu lgpl|lgpl", "2.1"),
    ("lgpl-3", "gnu lesser general public license|gnu lgpl|lgpl", "3.0"),
    ("mit", "mit|expat", ""),
    ("mit-0", "mit 0|mit no attribution", ""),
    ("mpl", "mozilla public license|mpl", ""),
    ("mpl-1.1", "mozilla public license|mpl", "1.1"),
    ("mpl-2", "mozilla public license|mpl", "2.0"),
    ("ms-pl", "microsoft public license|ms pl", ""),
    ("ms-rl", "microsoft reciprocal license|ms rl", ""),
    ("odbl", "open database license|odbl", ""),
    ("ofl-1.1", "sil open font license|ofl", "1.1"),
    ("openssl", "openssl", ""),
    ("osl-3", "open software license|osl", "3.0"),
    ("php-3", "php license|php", "3.0"),
    ("postgresql", "postgresql", ""),
    ("python-2", "python software foundation license|python software foundation|psf", "2.0"),
    ("ruby", "ruby", ""),
    ("sspl-1", "server side public license|sspl", "1.0"),
    ("unlicense", "unlicense", ""),
    ("upl-1", "universal permissive license|upl", "1.0"),
    ("vim", "vim", ""),
    ("wtfpl", "wtfpl", ""),
    ("zlib", "zlib|zlib libpng", ""),
]

#: Priority (1 is best), score of a hit, pattern of the words around the name.
TEMPLATES = [
    (1, 1.0, "<spdx><licen[cs]e><identifier>NAME"),
    (2, 0.95, "<licen[cs]ed><under>(?:<the>|<a>)?(?:<terms><of>)?(?:<the>)?NAME(?:<licen[cs]e>)?"),
    (2, 0.9, "<(?:released|distributed|available|published|provided|covered)><under>(?:<the>|<a>)?(?:<terms><of>)?(?:<the>)?NAME(?:<licen[cs]e>)?"),
    (2, 0.9, "<subject><to><the><terms><of><the>NAME(?:<licen[cs]e>)?"),
    (3, 0.8, "<licen[cs]e>NAME"),
    (3, 0.7, "NAME<licen[cs]ed?>"),
]

#: Label, priority, score, keyword, words. "a|b" is either word, "word?" may be missing, "*" is any one word.
#: Priority 2 names a license by its header, 3 by a passage of its text, 4 is a notice of many licenses.
SIGNATURES = [
    # headers
    ("gpl", 2, 0.95, "gnu", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2-or-later", 2, 1.0, "gnu", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", 2, 1.0, "gnu", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2-only", 2, 1.0, "gnu", "gnu general public license version 2 only"),
    ("gpl-2-only", 2, 1.0, "gnu", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3-only", 2, 1.0, "gnu", "gnu general public license version 3 only"),
    ("gpl-3-only", 2, 1.0, "gnu", "gnu general public license version 3 as published by the free software foundation"),
    ("lgpl", 2, 0.95, "gnu", "it under the terms of the gnu lesser|library general public license as published by the free software foundation"),
    ("lgpl-2.1-or-later", 2, 1.0, "gnu", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3-or-later", 2, 1.0, "gnu", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2-or-later", 2, 1.0, "gnu", "gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl", 2, 0.95, "gnu", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3-or-later", 2, 1.0, "gnu", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", 2, 1.0, "gnu", "copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("apache-2", 2, 1.0, "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http|https www apache org licenses license 2 0"),
    ("apache-2", 2, 1.0, "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 2, 0.9, "apache", "www apache org licenses license 2 0"),
    ("mpl-2", 2, 1.0, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 2, 1.0, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 2, 1.0, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", 2, 0.9, "mozilla", "mozilla org mpl 2 0"),
    ("epl-1", 2, 1.0, "eclipse", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", 2, 1.0, "eclipse", "made available under the terms of the eclipse public license v? 2 0"),
    ("epl-1", 2, 0.9, "eclipse", "www eclipse org legal epl v10"),
    ("epl-2", 2, 0.9, "eclipse", "www eclipse org legal epl 2 0"),
    ("cddl-1", 2, 1.0, "cddl", "subject to the terms of the common development and distribution license * cddl"),
    ("cddl-1", 2, 1.0, "development", "subject to the terms of the common development and distribution license the license"),
    ("eupl-1.2", 2, 1.0, "eupl", "licensed under the eupl version 1 2"),
    ("eupl-1.2", 2, 1.0, "eupl", "licensed under the eupl v? 1 2 or as soon they will be approved by the european commission"),
    ("boost-1", 2, 1.0, "boost", "distributed under the boost software license version 1 0"),
    ("boost-1", 2, 0.9, "boost", "www boost org license"),
    ("mit", 2, 1.0, "mit", "use of this source code is governed by an mit style license"),
    ("bsd", 2, 1.0, "bsd", "use of this source code is governed by a bsd style license"),
    ("mit", 2, 1.0, "mit", "this project|software|library|package|code is licensed|released under the terms? of? the mit license"),
    ("mit", 2, 0.9, "opensource", "opensource org licenses mit"),
    ("bsd-3-clause", 2, 0.9, "opensource", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 2, 0.9, "opensource", "opensource org licenses bsd 2 clause"),
    ("isc", 2, 0.9, "opensource", "opensource org licenses isc"),
    ("gpl", 2, 0.8, "gnu", "www gnu org licenses gpl"),
    ("gpl-2", 2, 0.9, "gnu", "www gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", 2, 0.9, "gnu", "www gnu org licenses gpl 3 0"),
    ("lgpl", 2, 0.8, "gnu", "www gnu org licenses lgpl"),
    ("agpl", 2, 0.8, "gnu", "www gnu org licenses agpl"),
    ("gfdl", 2, 0.8, "gnu", "www gnu org licenses fdl"),
    ("cc-by", 2, 0.9, "creativecommons", "creativecommons org licenses by"),
    ("cc-by-sa", 2, 0.95, "creativecommons", "creativecommons org licenses by sa"),
    ("cc-by-nd", 2, 0.95, "creativecommons", "creativecommons org licenses by nd"),
    ("cc-by-nc", 2, 0.95, "creativecommons", "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", 2, 1.0, "creativecommons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", 2, 1.0, "creativecommons", "creativecommons org licenses by nc nd"),
    ("cc0", 2, 1.0, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, 0.9, "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", 2, 0.95, "creative", "licensed under a creative commons attribution 2|3|4 0|5 international|unported|generic? license"),
    ("cc-by-sa", 2, 1.0, "creative", "licensed under a creative commons attribution sharealike 2|3|4 0|5 international|unported|generic? license"),
    ("cc-by-nc", 2, 1.0, "creative", "licensed under a creative commons attribution noncommercial 2|3|4 0|5 international|unported|generic? license"),
    ("cc-by-nc-sa", 2, 1.0, "creative", "licensed under a creative commons attribution noncommercial sharealike 2|3|4 0|5 international|unported|generic? license"),
    ("cc-by-nc-nd", 2, 1.0, "creative", "licensed under a creative commons attribution noncommercial noderivatives 2|3|4 0|5 international|unported|generic? license"),
    ("cc0", 2, 0.95, "copyright", "waived all copyright and related or neighboring rights to"),
    ("ofl-1.1", 2, 1.0, "sil", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 2, 0.9, "sil", "scripts sil org ofl"),
    ("odbl", 2, 1.0, "database", "made available under the open database license"),
    ("elastic-2", 2, 1.0, "elastic", "licensed under the elastic license 2 0"),
    ("sspl-1", 2, 1.0, "mongodb", "server side public license version 1 as published by mongodb inc"),
    ("bsl-1.1", 2, 1.0, "business", "use of this software is governed by the business source license"),
    ("upl-1", 2, 1.0, "universal", "licensed under the universal permissive license v? 1 0"),
    ("python-2", 2, 1.0, "psf", "licensed to psf under a contributor agreement"),
    ("zlib", 2, 0.95, "zlib", "for conditions of distribution and use see copyright notice in zlib h"),
    ("php-3", 2, 1.0, "php", "this source file is subject to version 3 01|0 of the php license"),
    ("afl-3", 2, 1.0, "academic", "licensed under the academic free license version 3 0"),
    ("osl-3", 2, 1.0, "open", "licensed under the open software license version 3 0"),
    ("artistic-1", 2, 0.95, "perl", "under the same terms as perl itself"),
    ("ruby", 2, 0.95, "ruby", "under the same terms as ruby itself"),
    ("vim", 2, 0.95, "vim", "under the same terms as vim itself"),
    # exceptions and choices
    ("classpath-exception", 2, 1.0, "exception", "classpath exception"),
    ("classpath-exception", 3, 0.9, "exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("linking-exception", 3, 0.8, "exception", "as a special exception * * * * permission to link"),
    ("autoconf-exception", 3, 0.9, "exception", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script"),
    ("bison-exception", 3, 0.9, "exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gcc-exception", 2, 1.0, "gcc", "gcc runtime library exception"),
    ("openssl-exception", 3, 0.9, "openssl", "permission to link the? code of? * * * with the openssl"),
    ("llvm-exception", 2, 1.0, "llvm", "apache license v2 0 with llvm exceptions"),
    ("dual-license", 3, 0.7, "dual", "dual licensed under"),
    ("dual-license", 3, 0.7, "licensed", "licensed under either of"),
    ("dual-license", 2, 0.9, "mit", "mit or apache 2 0"),
    ("dual-license", 2, 0.9, "apache", "apache 2 0 or mit"),
    # passages of license texts
    ("mit", 3, 0.9, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, 0.8, "copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", 3, 0.7, "advertising", "except as contained in this notice the name of the? * * * shall not be used in advertising"),
    ("isc", 3, 0.9, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("isc", 3, 0.9, "hereby", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", 3, 0.9, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", 3, 0.9, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", 3, 0.8, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 3, 0.7, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, 0.7, "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 3, 0.9, "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 3, 0.9, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", 3, 0.9, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 3, 0.8, "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1", 3, 0.9, "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", 3, 0.9, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, 0.9, "unlicense", "for more information please refer to http|https unlicense org"),
    ("wtfpl", 3, 0.9, "fuck", "do what the fuck you want to public license"),
    ("apache-2", 3, 0.8, "license", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2", 3, 0.8, "irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", 3, 0.8, "gpl", "gnu gpl"),
    ("gpl", 3, 0.8, "gnu", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 3, 0.8, "gnu", "you should have received a copy of the gnu lesser|library general public license along with this library|program"),
    ("agpl", 3, 0.8, "gnu", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gpl", 3, 0.7, "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", 3, 0.9, "gnu", "gnu general public license version 2 june 1991"),
    ("gpl-3", 3, 0.9, "gnu", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", 3, 0.9, "gnu", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", 3, 0.9, "gnu", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", 3, 0.9, "gnu", "gnu affero general public license version 3 19 november 2007"),
    ("mpl-2", 3, 0.8, "mozilla", "mozilla public license version 2 0 1 definitions"),
    ("cc0", 3, 0.9, "creative", "creative commons corporation is not a law firm and does not provide legal services"),
    ("postgresql", 3, 0.9, "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python-2", 3, 0.9, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", 3, 0.9, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("elastic-2", 3, 0.9, "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 3, 0.9, "sell", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("json", 3, 0.9, "evil", "the software shall be used for good not evil"),
    ("beerware", 3, 0.9, "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("ms-pl", 3, 0.9, "microsoft", "microsoft public license ms pl this license governs use of the accompanying software"),
    ("ofl-1.1", 3, 0.8, "font", "the font software may be sold by itself neither"),
    # notices of many licenses
    ("permission-notice", 3, 0.6, "permission", "permission is hereby granted free of charge"),
    ("redistribution-notice", 3, 0.6, "redistribution", "redistribution and use in source and binary forms"),
    ("public-domain", 3, 0.6, "released", "released into the public domain"),
    ("public-domain", 3, 0.6, "dedicate", "dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", 3, 0.6, "placed", "this file|code|software|program|work is|was|has been? placed in the public domain"),
    ("warranty-disclaimer", 4, 0.3, "without", "without warranty of any kind"),
    ("warranty-disclaimer", 4, 0.3, "merchantability", "warranty|warranties of merchantability"),
    ("warranty-disclaimer", 4, 0.3, "warranty", "but without any warranty"),
    ("warranty-disclaimer", 4, 0.3, "warranties", "without warranties or conditions of any kind"),
    ("liability-disclaimer", 4, 0.3, "liable", "in no event shall|will the authors|author|copyright * * be liable for any"),
    ("rights-reserved", 4, 0.3, "reserved", "all rights reserved"),
    ("rights-reserved", 4, 0.3, "reserved", "some rights reserved"),
    ("proprietary", 3, 0.6, "proprietary", "confidential and proprietary"),
    ("proprietary", 3, 0.6, "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("non-commercial", 3, 0.5, "commercial", "for non commercial use only"),
    ("non-commercial", 3, 0.5, "noncommercial", "for noncommercial use only"),
    ("research-only", 3, 0.5, "research", "for research purposes only"),
]

#: Every rule holds one of these, so a text without any has no hit.
ANCHORS = ["<licens", "<licenc", "<under>", "<subject>", *sorted({f"<{key}>" for _, _, _, key, words in SIGNATURES if not {"license", "licensed", "licenses", "under", "subject"} & set(words.split())})]
PRIORITIES = sorted({t[0] for t in TEMPLATES} | {n[1] for n in SIGNATURES})


def marked(words: str) -> str:
    return "".join(f"<{w}>" for w in words.split())


def _signature(words: str) -> str:
    """The pattern of a signature's words."""
    one = lambda w: "<[^<>]+>" if w == "*" else f"<(?:{w})>" if "|" in w else f"<{w}>"
    return "".join(f"(?:{one(w[:-1])})?" if w.endswith("?") else one(w) for w in words.split())


def _named(name: str, version: str) -> tuple[str, str]:
    """The pattern of a name and its version, and the keyword. A single word may be fused with the version: gplv3, apache2."""
    if not version:
        return marked(name), f"<{name.split()[0]}>"
    (major, minor), single = version.split("."), " " not in name
    head = f"<{name}(?:>(?:<version>)?<)?v?{major}>" if single else marked(name) + f"(?:<version>)?<v?{major}>"
    return head + ("(?:<0>)?" if minor == "0" else f"<{minor}>"), f"<{name}" if single else f"<{name.split()[0]}>"


def signature_rules() -> list[tuple[int, str, int, float, str, str]]:
    """(rule, label, priority, score, pattern, keyword), in order: each name under each template, then the signatures.

    The keyword is a piece of the marked text that every hit holds.
    """
    made = []
    for priority, score, frame in TEMPLATES:
        for label, names, version in NAMES:
            for pattern, keyword in (_named(name, version) for name in names.split("|")):
                made.append((label, priority, score, frame.replace("NAME", pattern), keyword))
    made += [(label, priority, score, _signature(words), f"<{key}>") for label, priority, score, key, words in SIGNATURES]
    return [(i, *rule) for i, rule in enumerate(made)]


def _count(text: Column) -> Column:
    """Words in a marked text."""
    return (F.length(text) - F.length(F.replace(text, F.lit("<")))).cast("long")


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """l_row, l_id, n_words, n_base, first_word, last_word, l_base (labels), l_text (marked text if it has an anchor)."""
    lower = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = docs.select(F.monotonically_increasing_id().alias("l_row"), F.col(id_col).alias("l_id"), F.btrim(F.regexp_replace(lower, SEPARATORS, "><"), F.lit("<>")).alias("l_text"))
    out = out.withColumn("l_text", F.when(F.col("l_text") == "", "").otherwise(F.concat(F.lit("<"), "l_text", F.lit(">"))))
    out = out.withColumn("n_words", _count(F.col("l_text")))
    out = out.withColumns({f"l_parts{i}": F.when(F.col("l_text").contains(marked(words)), F.split("l_text", marked(words))) for i, (words, _) in enumerate(PHRASES)})
    found = [(F.col(f"l_parts{i}"), words, label) for i, (words, label) in enumerate(PHRASES)]
    return out.select(
        "l_row", "l_id", "n_words", sum((F.coalesce(F.size(parts) - 1, F.lit(0)) for parts, _, _ in found), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(_count(parts[0]) for parts, _, _ in found)).alias("first_word"),
        F.greatest(*(F.col("n_words") - _count(F.element_at(parts, -1)) - len(words.split()) for parts, words, _ in found)).alias("last_word"),
        F.array_compact(F.array(*(F.when(parts.isNotNull(), label) for parts, _, label in found))).alias("l_base"),
        F.when(F.greatest(*(F.col("l_text").contains(x) for x in ANCHORS)), F.col("l_text")).alias("l_text"),
    )


def detections(spark: SparkSession, marked_texts: DataFrame) -> DataFrame:
    """l_row, label, priority, score, start, end of all hits of all rules that are not suppressed; start and end in words."""
    table_of_rules = spark.createDataFrame(signature_rules(), "rule int, label string, priority int, score double, pattern string, keyword string")
    keywords = sorted({r[-1] for r in signature_rules()})
    gated = marked_texts.filter(F.col("l_text").isNotNull()).select("l_row", "l_text", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.col("l_text").contains(k))).alias("keyword"))
    tried = gated.join(F.broadcast(table_of_rules), "keyword")  # a few hundred rules, whatever the input
    tried = tried.withColumn("hits", F.regexp_extract_all("l_text", F.col("pattern"), F.lit(0))).filter(F.size("hits") > 0)
    tried = tried.withColumn("gaps", F.expr("split(l_text, pattern)")).select("l_row", "rule", "label", "priority", "score", F.posexplode(F.arrays_zip("gaps", "hits")).alias("pos", "piece"))
    tried = tried.select("l_row", "rule", "label", "priority", "score", "pos", _count(F.col("piece.gaps")).alias("gap"), _count(F.col("piece.hits")).alias("hit"))
    tried = tried.repartition("l_row")  # both windows below then need no other exchange
    along = Window.partitionBy("l_row", "rule").orderBy("pos")
    found = tried.withColumn("end", F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(along)).filter(F.col("hit").isNotNull()).withColumn("start", F.col("end") - F.col("hit"))
    before = Window.partitionBy("l_row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*(F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before)) for p in PRIORITIES), F.lit(-1))
    return found.withColumn("reach", reach).filter(F.col("reach") < F.col("end")).select("l_row", "rule", "label", "priority", "score", "start", "end")


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all PHRASES; first_word and last_word are their smallest and largest start, in words
    from 0. labels adds the labels of the signature rules' hits; score is the best hit's, 0.5 if only a phrase is found,
    else 0. Null or empty text: no words, no labels, null places, score 0. Repeated rows and null ids pass through, one
    result row each. An empty table gives an empty result. Other columns of the input are not read.
    """
    scanned = stored(_scan(docs, id_col, text_col))  # texts without an anchor stay behind here
    hits = detections(docs.sparkSession, scanned).groupBy("l_row").agg(F.collect_set("label").alias("l_labels"), F.max("score").alias("l_score"))
    out = scanned.drop("l_text").join(hits, "l_row", "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        F.col("l_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("l_base")).alias("base_labels"),
        joined(F.concat("l_base", F.coalesce("l_labels", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("l_score", F.when(F.col("n_base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda x: f"(length({x}) - length(replace({x}, '<', '')))"
    marks = [text(marked(words)) for words, _ in PHRASES]
    rows = ", ".join(f"({i}, {text(label)}, {priority}, {score}::DOUBLE, {text(pattern)}, {text(key)})" for i, label, priority, score, pattern, key in signature_rules())
    reach = "CASE priority " + " ".join(f"WHEN {p} THEN max(CASE WHEN priority <= {p} THEN stop END) OVER before" for p in PRIORITIES) + " END"
    return f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}', '><', 'g'), '<>') AS t FROM documents),
 d AS (SELECT r, doc_id, CASE WHEN t = '' THEN '' ELSE '<' || t || '>' END AS t FROM raw),
 b AS (SELECT r, doc_id, t, {count("t")} AS n_words, {", ".join(f"CASE WHEN contains(t, {m}) THEN string_split(t, {m}) END AS p{i}" for i, m in enumerate(marks))} FROM d),
 base AS (SELECT r, doc_id, n_words, {" + ".join(f"coalesce(len(p{i}) - 1, 0)" for i in range(len(marks)))} AS n_base,
   least({", ".join(count(f"p{i}[1]") for i in range(len(marks)))}) AS first_word,
   greatest({", ".join(f"n_words - {count(f'p{i}[-1]')} - {len(words.split())}" for i, (words, _) in enumerate(PHRASES))}) AS last_word,
   list_filter([{", ".join(f"CASE WHEN p{i} IS NOT NULL THEN {text(label)} END" for i, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS labels FROM b),
 rules(rule, label, priority, score, pattern, keyword) AS (VALUES {rows}),
 tried AS (SELECT r, rule, label, priority, score, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS gaps FROM (SELECT * FROM d WHERE {" OR ".join(f"contains(t, {text(x)})" for x in ANCHORS)}) JOIN rules ON contains(t, keyword) AND regexp_matches(t, pattern)),
 flat AS (SELECT r, rule, label, priority, score, i, {count("gaps[i]")} + coalesce({count("hits[i]")}, 0) AS step, {count("hits[i]")} AS hit FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM tried)),
 placed AS (SELECT *, sum(step) OVER (PARTITION BY r, rule ORDER BY i) AS stop FROM flat),
 found AS (SELECT *, stop - hit AS start FROM placed WHERE hit IS NOT NULL),
 kept AS (SELECT *, {reach} AS reach FROM found WINDOW before AS (PARTITION BY r ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 hits AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM kept WHERE coalesce(reach, -1) < stop GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, n_base::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(list_aggregate(list_sort(base.labels), 'string_agg', ','), '') AS base_labels,
 coalesce(list_aggregate(list_sort(list_distinct(list_concat(base.labels, coalesce(hits.labels, [])))), 'string_agg', ','), '') AS labels,
 coalesce(hits.score, CASE WHEN n_base > 0 THEN 0.5 END, 0)::DOUBLE AS score
FROM base LEFT JOIN hits USING (r)"""
