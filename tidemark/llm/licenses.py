"""License scans: ordered signature rules with a keyword prefilter, with DataFrame functions alone.

Only texts that hold a rule's keyword are looked at. Such a text becomes its lower-case words joined by single spaces,
and of the rules those run whose keyword is among its words. A rule is a regular expression over words with a label and
a priority. A detection falls away when one of higher priority covers its words, or a longer one of the same priority,
so that "GNU General Public License, version 3" doesn't also count as an unversioned one: a sweep over the detections
in the order of their starts keeps, for each priority, how far those before have reached.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families of licenses as label, name in words (a pattern), keyword that every mention holds, versions.
FAMILIES = (
    ("apache", "apache(?: software)? license", "license", ("1 0", "1 1", "2 0")),
    ("gpl", "gnu general public license", "license", ("1 0", "2 0", "3 0")),
    ("gpl", "gnu gpl|gpl", "gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", "gnu (?:lesser|library) general public license", "license", ("2 0", "2 1", "3 0")),
    ("lgpl", "gnu lgpl|lgpl", "lgpl", ("2 0", "2 1", "3 0")),
    ("agpl", "gnu affero general public license", "license", ("1 0", "3 0")),
    ("agpl", "gnu agpl|agpl", "agpl", ("1 0", "3 0")),
    ("gfdl", "gnu free documentation license", "license", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla public license", "license", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public license", "license", ("1 0", "2 0")),
    ("cddl", "common development and distribution license", "license", ("1 0", "1 1")),
    ("eupl", "european union public licen[cs]e", "union", ("1 0", "1 1", "1 2")),
    ("osl", "open software license", "license", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free license", "license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic license", "license", ("1 0", "2 0")),
    ("zpl", "zope public license", "license", ("1 1", "2 0", "2 1")),
    ("lppl", "latex project public license", "license", ("1 0", "1 1", "1 2", "1 3")),
    ("php", "php license", "license", ("3 0", "3 01")),
    ("ecl", "educational community license", "license", ("1 0", "2 0")),
    ("odc-by", "open data commons attribution license", "license", ("1 0",)),
    ("odbl", "open database license", "license", ("1 0",)),
    ("cc-by", "creative commons attribution|cc by", "", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", "", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s|cc by nd", "", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc", "", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike|cc by nc sa", "", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", "", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", "creative commons zero|cc0", "", ("1 0",)),
    ("mit", "(?:mit|expat|x11) license", "license", ()),
    ("mit-0", "mit no attribution license", "license", ()),
    ("bsd-2-clause", "(?:simplified bsd|2 clause bsd|bsd 2 clause|two clause bsd|freebsd) license", "license", ()),
    ("bsd-3-clause", "(?:new bsd|modified bsd|3 clause bsd|bsd 3 clause|three clause bsd) license", "license", ()),
    ("bsd-4-clause", "(?:original bsd|4 clause bsd|bsd 4 clause) license", "license", ()),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd) license", "license", ()),
    ("bsd", "bsd license", "license", ()),
    ("isc", "isc license", "license", ()),
    ("zlib", "(?:zlib|zlib libpng) license", "license", ()),
    ("boost", "boost software license", "license", ("1 0",)),
    ("ncsa", "university of illinois ncsa open source license", "license", ()),
    ("python", "python software foundation license|psf license", "license", ("2",)),
    ("unlicense", "the unlicense", "unlicense", ()),
    ("wtfpl", "do what the fuck you want to public license|wtfpl", "", ("2",)),
    ("ms-pl", "microsoft public license", "license", ()),
    ("ofl", "sil open font license", "license", ("1 0", "1 1")),
    ("beerware", "beer ?ware license", "license", ()),
    ("postgresql", "postgresql license", "license", ()),
    ("proprietary", "proprietary (?:and confidential )?license|commercial license", "license", ()),
)
#: Phrases of license texts and notices, one a line: label, priority, keyword, pattern over words.
TEXTS = """
mit 60 granted permission is hereby granted free of charge to any person obtaining a copy
mit 58 substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 40 dealings arising from out of or in connection with the software or the use or other dealings in the software
mit 55 expat (?:the )?expat license
mit-0 62 granted permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc 60 permission permission to use copy modify and or distribute this software for any purpose
isc 58 permission permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
0bsd 62 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd 60 permission permission to use copy modify distribute and sell this software and its documentation for any purpose
hpnd 58 permission permission to use copy modify and distribute this software and its documentation for any purpose
bsd 60 redistribution redistribution and use in source and binary forms with or without modification
bsd 50 redistributions redistributions of source code must retain the (?:above )?copyright notice
bsd 50 redistributions redistributions in binary form must reproduce the (?:above )?copyright notice
bsd-3-clause 65 endorse neither the names? of (?:\\S+ ){1,12}may be used to endorse or promote products
bsd-3-clause 62 endorse may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause 66 advertising all advertising materials mentioning features or use of this software must display
bsd-patent 60 patent subject to the terms and conditions of this license each copyright holder and contributor hereby grants
zlib 60 misrepresented the origin of this software must not be misrepresented
zlib 58 altered altered source versions must be plainly marked as such
zlib 55 damages in no event will the authors be held liable for any damages arising from the use of this software
libpng 60 png the png reference library is supplied as is
apache-2 60 compliance you may not use this file except in compliance with the license
apache-2 58 agreements licensed to the apache software foundation (?:asf )?under one or more contributor license agreements
apache-2 57 applicable unless required by applicable law or agreed to in writing software distributed under the license
apache-2 56 obtain you may obtain a copy of the license at http www apache org licenses license 2 0
apache-1.1 60 apache this product includes software developed by the apache software foundation
apache-1.0 60 apache this product includes software developed by the apache group
gpl 55 redistribute this program is free software you can redistribute it and or modify it
gpl 54 redistribute this (?:library|package|file|software) is free software you can redistribute it and or modify it
gpl-2.0 75 option gnu general public license as published by the free software foundation (?:either )?version 2 of the license or (?:at your option )?any later version
gpl-3.0 75 option gnu general public license as published by the free software foundation (?:either )?version 3 of the license or (?:at your option )?any later version
lgpl-2.1 75 option gnu lesser general public license as published by the free software foundation (?:either )?version 2 1 of the license or (?:at your option )?any later version
lgpl-3.0 75 option gnu lesser general public license as published by the free software foundation (?:either )?version 3 of the license or (?:at your option )?any later version
lgpl-2.0 75 option gnu library general public license as published by the free software foundation (?:either )?version 2 of the license or (?:at your option )?any later version
agpl-3.0 75 option gnu affero general public license as published by the free software foundation (?:either )?version 3 of the license or (?:at your option )?any later version
gpl 52 received you should have received a copy of the gnu general public license
lgpl 52 received you should have received a copy of the gnu (?:lesser|library) general public license
agpl 52 received you should have received a copy of the gnu affero general public license
gpl 48 distributed this program is distributed in the hope that it will be useful
gpl-2.0 60 copyleft the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 60 copyleft the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3.0 60 copyleft the gnu affero general public license is a free copyleft license
gpl-cc 60 noncompliance cure commitment|gpl cooperation commitment
classpath-exception 70 executable the copyright holders of this library give you permission to link this library with independent modules to produce an executable
gcc-exception 70 runtime gcc runtime library exception
gfdl 60 documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 55 invariant with no invariant sections no front cover texts and no back cover texts
mpl-2.0 70 subject this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2.0 60 mpl if a copy of the mpl was not distributed with this file
mpl-2.0 58 incompatible this source code form is incompatible with secondary licenses
mpl-1.1 70 subject the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 70 subject the contents of this file are subject to the mozilla public license version 1 0
npl 70 subject the contents of this file are subject to the netscape public license
epl 70 accompanying this program and the accompanying materials are made available under the terms of the eclipse public license
epl-2.0 72 accompanying this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0
epl-1.0 72 accompanying this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?1 0
cpl 70 accompanying this program and the accompanying materials are made available under the terms of the common public license
ipl 60 ibm ibm public license
cddl 70 subject the contents of this file are subject to the terms of the common development and distribution license
cddl 55 cddl when distributing (?:the )?covered code include this cddl header
osl-3.0 60 licensed licensed under the open software license version 3 0
afl-3.0 60 licensed licensed under the academic free license version 3 0
artistic-2.0 60 copyright everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
perl 65 perl (?:it under the same terms as|under the same terms as) perl (?:itself|5)
artistic 50 package the intent of this document is to state the conditions under which a package may be copied
eupl 60 licence licensed under the eupl
eupl 58 licence this european union public licence
euPL-1.2 60 eupl eupl v ?1 2
cecill 60 cecill cecill (?:free software )?licen[cs]e|governed by the cecill
cecill-b 62 cecill governed by the cecill b license
cecill-c 62 cecill governed by the cecill c license
ms-pl 60 microsoft this license governs use of the accompanying software if you use the software you accept this license
ms-rl 60 microsoft microsoft reciprocal license
boost-1.0 60 boost boost software license version 1 0
boost-1.0 58 organization permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense 60 unencumbered this is free and unencumbered software released into the public domain
unlicense 58 dedicate in jurisdictions that recognize copyright laws the author or authors of this software dedicate
public-domain 50 domain (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain 48 domain (?:this (?:file|work|software|code|document) is|is hereby) in the public domain
cc0 60 waived to the extent possible under law (?:\\S+ ){1,12}has waived all copyright
cc0 58 waive affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-pdm 60 mark public domain mark
cc-by 60 licensed this work is licensed under a creative commons attribution
cc-by-sa 62 licensed this work is licensed under a creative commons attribution share ?alike
cc-by-nc 62 licensed this work is licensed under a creative commons attribution non ?commercial
cc-by-nd 62 licensed this work is licensed under a creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa 64 licensed this work is licensed under a creative commons attribution non ?commercial share ?alike
cc-by-nc-nd 64 licensed this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by 55 creativecommons creativecommons org licenses by [1-4] [05]
cc-by-sa 55 creativecommons creativecommons org licenses by sa [1-4] [05]
cc-by-nc 55 creativecommons creativecommons org licenses by nc [1-4] [05]
cc-by-nd 55 creativecommons creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa 55 creativecommons creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd 55 creativecommons creativecommons org licenses by nc nd [1-4] [05]
cc0 55 creativecommons creativecommons org publicdomain zero 1 0
odbl 60 database this database is made available under the open database license
odc-by 60 database this database is made available under the open data commons attribution license
pddl 60 dedication public domain dedication and license
odbl 55 openstreetmap openstreetmap contributors
ofl-1.1 60 font this font software is licensed under the sil open font license version 1 1
ofl 52 reserved with reserved font name
ncsa 60 illinois neither the names of (?:\\S+ ){1,12}university of illinois
w3c 60 w3c w3c software (?:notice and )?(?:and document )?license
w3c 58 w3c by obtaining using and or copying this work you the licensee agree
python-2.0 60 psf psf is making python available to licensee on an as is basis
python-2.0 55 python python software foundation license version 2
cnri 60 cnri cnri (?:open source )?license agreement
postgresql 60 paragraph provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
openssl 60 openssl this product includes software developed by the openssl project
ssleay 60 cryptographic this product includes cryptographic software written by eric young
openldap 60 openldap openldap public license
curl 60 curl curl license|curl and libcurl are licensed
php-3.01 60 php this product includes php software freely available
ruby 60 ruby you may redistribute it and or modify it under either the terms of the 2 clause bsdl|licensed under the ruby license
tcl 60 tcl tcl tk license
vim 60 vim vim license|vim is charityware
sleepycat 60 accompanying information on how to obtain complete source code for the (?:\\S+ ){1,4}software and any accompanying software
qpl 60 q q public license
sissl 60 sun sun industry standards source license
bcl 60 sun sun microsystems inc binary code license agreement
icu 60 icu icu license
unicode 60 unicode unicode (?:inc )?license agreement data files and software|unicode terms of use
ijg 60 jpeg this software is based in part on the work of the independent jpeg group
ftl 60 freetype freetype (?:project )?license
wtfpl 60 fuck you just do what the fuck you want to
beerware 60 beer you can buy me a beer in return
json 60 evil the software shall be used for good not evil
upl 60 larger universal permissive license|the larger works as defined
bsl-1.1 60 business business source license 1 1
sspl 60 server server side public license
elastic-2.0 60 elastic elastic license 2 0|licensed under the elastic license
commons-clause 60 clause commons clause license condition|the license does not grant to you the right to sell the software
polyform 60 polyform polyform (?:noncommercial|small business|strict|shield) license
mulan-psl-2.0 60 mulan mulan (?:psl|permissive software license) v ?2
anti-996 60 996 anti 996 license
hippocratic 60 hippocratic hippocratic license
rail 60 responsible responsible ai license|openrail
llama 60 llama llama (?:2|3|3 1) community license
gemma 60 gemma gemma terms of use
blueoak-1.0.0 60 blue blue oak model license
proprietary 45 confidential (?:proprietary and confidential|confidential and proprietary)
proprietary 45 unauthorized unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)
proprietary 40 evaluation for evaluation purposes only
proprietary 40 eula end user license agreement|eula
proprietary 42 reproduced no part of this (?:publication|document|book|work) may be reproduced
proprietary 42 trade (?:contains|constitutes) trade secrets
proprietary 20 reserved all rights reserved
shareware 45 shareware this (?:program|software) is shareware
freeware 45 freeware this (?:program|software) is freeware
academic 45 academic for academic (?:use|purposes) only|academic non ?commercial license
non-commercial 45 commercial (?:for|only for) non ?commercial (?:use|purposes)(?: only)?
non-commercial 44 commercial (?:may not be used|not) for commercial purposes
crown 50 crown open government licen[cs]e
us-government 50 government work of the (?:united states|u s) government
unknown 10 licensed licensed under
unknown 10 license see (?:the )?license(?: file)?
unknown 9 license license agreement
unknown 8 licence under (?:the )?licence
"""


def _text_rules() -> list[tuple[str, str, str, int]]:
    lines = (line.split(" ", 3) for line in TEXTS.strip().splitlines())
    return [(label.lower(), pattern, keyword, int(priority)) for label, priority, keyword, pattern in lines]


def rules() -> list[tuple[str, str, str, int]]:
    """(label, pattern, keyword, priority) in order: each family's versions, its name after a grant, its name alone, its tag, then the texts."""
    out = []
    grant = "(?:released|licen[cs]ed|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?"
    for label, name, keyword, versions in FAMILIES:
        # a name of several forms is a rule for each, since a rule has one keyword
        for form in name.split("|") if not keyword or "(?:" not in name else [name]:
            key = keyword if keyword and keyword in form.replace("licen[cs]e", "union") else form.split(" ")[0]
            for version in versions:
                number = version.replace(" 0", "(?: 0)?")
                out.append((f"{label}-{version.replace(' ', '.')}", f"(?:{grant})?(?:{form})(?: license)?(?: international| unported)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? {number}", key, 90))
                out.append((f"{label}-{version.replace(' ', '.')}", f"(?:{form})(?: version)? v{number}", key, 90))
            out.append((label, f"{grant}(?:{form})", key, 70))
            out.append((label, f"(?:{form})", key, 50))
        if versions:
            out += [(f"{label}-{v.replace(' ', '.')}", f"spdx license identifier {label.replace('-', ' ')} {v}(?: only| or later)?", "spdx", 95) for v in versions]
        else:
            out.append((label, f"spdx license identifier {label.replace('-', ' ')}", "spdx", 95))
    return out + _text_rules()


#: What a word of a text as it came is made of: A to Z count as letters.
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def keyword_pattern(keywords: list[str]) -> str:
    """Any of the keywords as a word of its own, A to Z being a to z; by first letters, so that most words cost one look."""
    first = sorted({k[0] for k in keywords})
    tails = ("|".join(sorted(k[1:] for k in keywords if k[0] == c)) for c in first)
    any_ = "|".join(f"{c}(?:{t})" for c, t in zip(first, tails, strict=True))
    return f"(?i)(?<!{LETTER})(?:{any_})(?!{LETTER})"


def normal(text: Column) -> Column:
    """A text's words, each with a space before and the last with one after; one space for a text without words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _found(text: Column, pattern: Column) -> Column:
    """First and last word of each place of a pattern: places are marked, and the marks are read off the words."""
    words = F.split(F.regexp_replace(text, pattern, F.lit("\u0001$0\u0002")), " ")

    def places(w):
        first = F.filter(F.transform(w, lambda x, i: F.when(F.startswith(x, F.lit("\u0001")), i)), lambda i: i.isNotNull())
        last = F.filter(F.transform(w, lambda x, i: F.when(F.endswith(x, F.lit("\u0002")), i)), lambda i: i.isNotNull())
        return F.arrays_zip(first.alias("first"), last.alias("last"))

    # a text begins with a space, so its first word is the second part
    found = F.flatten(F.transform(F.array(words), places))
    return F.when(F.rlike(text, pattern), F.transform(found, lambda m: F.struct((m["first"] - 1).alias("first"), (m["last"] - 1).alias("last")))).otherwise(F.array())


def _kept(found: DataFrame, priorities: list[int]) -> DataFrame:
    """row, labels, best priority and spans of the detections (row, label, first, last, priority) that no other suppresses.

    What covers a detection begins no later: it stands before it in the order of starts, longer ones first. So one is
    suppressed where any before it of its own or higher priority reaches as far.
    """
    before = Window.partitionBy("row").orderBy("first", F.desc("last"), F.desc("priority"), "label").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("int")
    for p in priorities:
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("last"))).over(before)).otherwise(reach)
    left = found.withColumn("reach", reach).where("reach is null or reach < last")
    spans = F.array_sort(F.collect_list(F.struct("first", "last", "label", "priority"))).alias("spans")
    return left.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("priority").alias("best"), spans)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans for each row of docs.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no words and no labels. Repeated
    rows and null ids are kept as they are; an empty table gives no rows. score is the highest priority among the
    detections that stay, over 100, and 1 where a base phrase stands; 0 without labels. spans are the detections that
    stay, by place: first and last word, label, priority. Time grows with a text's words and detections, not with their
    product. What the texts hold, a few numbers each, is written down while the plan is built.
    """
    table = rules()
    keywords = sorted({r[2] for r in table} | {"license", "cc"})  # the last two stand in the base phrases
    text = F.coalesce("text", F.lit(""))
    mentions = F.rlike(text, F.lit(keyword_pattern(keywords)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_count(text, F.lit(f"{LETTER}+")).cast("long").alias("n_words"), F.when(mentions, normal(text)).alias("w"))
    base = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(phrase).alias("phrase")) for phrase, label in BASE))
    w = F.col("w")

    def place(b):
        phrase = F.concat(F.lit(" "), b["phrase"], F.lit(" "))
        first = F.instr(w, phrase)
        back = F.instr(F.reverse(w), F.reverse(phrase))
        return F.struct(
            b["label"].alias("label"),
            F.regexp_count(w, F.concat(F.lit(" "), b["phrase"], F.lit("(?= )"))).alias("n"),
            _spaces(F.substring(w, F.lit(1), first - 1)).alias("first"),
            # the words that stand after the last place, and its own, are counted from the end
            (F.col("n_words") - _spaces(F.substring(F.reverse(w), F.lit(1), back)) + 1 - F.size(F.split(b["phrase"], " "))).alias("last"),
        )

    # the rules as one value, which is planned faster than as many
    ruled = [{"label": label, "pattern": f"(?<= )(?:{pattern})(?= )", "keyword": key, "priority": p} for label, pattern, key, p in table]
    literal = F.from_json(F.lit(json.dumps(ruled)), "array<struct<label:string,pattern:string,keyword:string,priority:int>>")
    present = F.filter(F.array(*(F.lit(k) for k in keywords)), lambda k: F.contains(w, F.concat(F.lit(" "), k, F.lit(" "))))
    rows = rows.withColumns({"base": F.filter(F.transform(base, place), lambda b: b["n"] > 0), "keys": F.when(w.isNotNull(), present)})
    detect = F.flatten(F.transform(F.filter(literal, lambda r: F.array_contains(F.col("keys"), r["keyword"])), lambda r: F.transform(_found(w, r["pattern"]), lambda m: F.struct(r["label"].alias("label"), m["first"].alias("first"), m["last"].alias("last"), r["priority"].alias("priority")))))
    rows = materialize(rows.select("doc_id", "row", "n_words", "base", F.when(F.size("keys") > 0, detect).alias("all")), "detections")
    found = rows.where("all is not null").select("row", F.explode("all").alias("d")).select("row", "d.*")
    kept = _kept(found, sorted({r[3] for r in table}))
    # a row's number is that of its place in a task, so the join is of plain numbers
    rows = rows.drop("all").join(kept, "row", "left")
    own = F.coalesce("base", F.array())
    base_labels = F.transform(own, lambda b: b["label"])
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform(own, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(own, lambda b: b["last"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(own) > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("best") / 100, F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array()).alias("spans"),
    )
