"""License scan: ordered signature rules behind a keyword filter, with overlaps resolved by priority and containment.

The rules below are written by hand, one a line, the surer readings of a license before the looser ones: that order is
their priority. A rule runs only on texts that hold its keyword, which every text that it matches holds. Detections are
taken by priority, then length, then place; one that lies within a detection taken before is suppressed, and so is a
less sure one that overlaps. Names that are ordinary words need the word license, or a version, beside them.

Cases: null and empty texts have no words, no labels and score 0; a very long text is read whole, in time that grows with
its length and hits; detections that tie in rule and length go by place; repeated rows return as often as they occur; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession

from . import common

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: The base phrases and their labels.
PHRASES = ((("under", "the", "mit", "license"), "mit"), (("apache", "license", "version", "2"), "apache-2"), (("cc", "by", "nc"), "cc-by-nc"))

#: One rule a line: label, confidence, keyword, pattern over lower-case words that single spaces part. V in a label is the
#: version that the group v reads; L stands for license in either spelling.
RULES = r"""
mit 1.0 mit | spdx L identifier mit
apache-V 1.0 apache | spdx L identifier apache (?P<v>1 0|1 1|2 0)
bsd-V-clause 1.0 bsd | spdx L identifier bsd (?P<v>[0-4]) clause
gpl-V 1.0 gpl | spdx L identifier gpl (?P<v>[123] 0)
lgpl-V 1.0 lgpl | spdx L identifier lgpl (?P<v>2 0|2 1|3 0)
agpl-V 1.0 agpl | spdx L identifier agpl (?P<v>[13] 0)
mpl-V 1.0 mpl | spdx L identifier mpl (?P<v>1 0|1 1|2 0)
epl-V 1.0 epl | spdx L identifier epl (?P<v>[12] 0)
eupl-V 1.0 eupl | spdx L identifier eupl (?P<v>1 [012])
cddl-V 1.0 cddl | spdx L identifier cddl (?P<v>1 [01])
isc 1.0 isc | spdx L identifier isc
zlib 1.0 zlib | spdx L identifier zlib
unlicense 1.0 unlicense | spdx L identifier unlicense
bsl-1 1.0 bsl | spdx L identifier bsl 1 0
cc0 1.0 cc0 | spdx L identifier cc0 1 0
cc-by-V 1.0 cc by | spdx L identifier cc by (?P<v>[1234] [05])
cc-by-sa-V 1.0 cc by | spdx L identifier cc by sa (?P<v>[1234] [05])
artistic-V 1.0 artistic | spdx L identifier artistic (?P<v>[12] 0)
ofl-V 1.0 ofl | spdx L identifier ofl (?P<v>1 [01])
wtfpl 1.0 wtfpl | spdx L identifier wtfpl
mit 0.99 permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 0.97 the above copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc 0.98 permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd 0.97 redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause 0.98 neither the name of | neither the name of (?:the )?[a-z0-9 ]{1,60} nor the names of (?:its|his|their) contributors may be used to endorse or promote products
bsd-4-clause 0.98 all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd 0.9 this software is provided by | this software is provided by the (?:copyright holders|regents|author) and contributors as is
zlib 0.98 this software is provided as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 0.95 altered source versions | altered source versions must be plainly marked as such
apache-2 0.99 licensed under the apache license | licensed under the apache L version 2 0 the L you may not use this file except in compliance with the L
apache-2 0.97 www apache org licenses | www apache org licenses L 2 0
apache-1.1 0.95 apache software foundation | this product includes software developed by the apache software foundation
gpl-V 0.99 gnu general public license | under the terms of the gnu general public L as published by the free software foundation either version (?P<v>[123]) of the L
gpl-2 0.99 gnu general public license | under the terms of the gnu general public L version 2 as published by the free software foundation
lgpl-V 0.99 general public license | under the terms of the gnu (?:lesser|library) general public L as published by the free software foundation either version (?P<v>2|2 1|3) of the L
agpl-V 0.99 affero general public | under the terms of the gnu affero general public L as published by the free software foundation either version (?P<v>[13]) of the L
gpl 0.9 see the gnu general | see the gnu general public L for more details
lgpl 0.9 lesser general public | see the gnu lesser general public L for more details
agpl 0.9 affero general public | see the gnu affero general public L for more details
gpl 0.9 copy of the gnu general public | you should have received a copy of the gnu general public L
lgpl 0.9 copy of the gnu l | you should have received a copy of the gnu (?:lesser|library) general public L
mpl-2 0.99 mozilla public | this source code form is subject to the terms of the mozilla public L v 2 0
mpl-1.1 0.99 mozilla public | the contents of this file are subject to the mozilla public L version 1 1
mpl-2 0.95 mozilla org mpl | mozilla org mpl 2 0
epl-V 0.98 eclipse public | (?:this program and the accompanying materials are )?made available under the terms of the eclipse public L (?:v ?)?(?P<v>1 0|2 0)
epl-V 0.95 www eclipse org | www eclipse org legal epl (?:v ?)?(?P<v>10|20|1 0|2 0)
cddl-V 0.98 common development and distribution | subject to the terms of the common development and distribution L(?: version)? (?P<v>1 [01])
unlicense 0.99 released into the public domain | this is free and unencumbered software released into the public domain
bsl-1 0.98 boost software | distributed under the boost software L version 1 0
wtfpl 0.98 do what the | do what the (?:fuck|f) you want to public L
cc0 0.97 waived all copyright | has waived all copyright and related or neighboring rights
openssl 0.95 openssl project | this product includes software developed by the openssl project
ofl-1.1 0.98 sil open font | licensed under the sil open font L version 1 1
artistic-2 0.95 artistic license | under the (?:terms of the )?artistic L(?: version)? 2 0
gfdl-V 0.98 free documentation | under the terms of the gnu free documentation L version (?P<v>1 [123])
apache-V 0.95 apache | apache(?: software)? L(?: version)?(?: v ?| )(?P<v>1 0|1 1|2 0|2)
apache-V 0.93 apache license v | apache L v(?P<v>1|2)
apache-V 0.85 apache | apache (?P<v>2 0|1 1)
apache-V 0.85 asl | asl (?P<v>1 1|2 0)
apache 0.85 apache | apache(?: software)? L
mit 0.95 mit license | (?:under|with|by) the mit L
mit 0.9 mit | (?:the )?mit(?: x11| expat)? L
mit 0.9 x11 | (?:the )?x11 L
mit 0.9 expat | (?:the )?expat L
mit 0.85 mit licensed | (?:is|are) mit licensed
bsd-V-clause 0.95 clause | (?P<v>[0234]) clause bsd(?: L)?
bsd-V-clause 0.95 bsd | bsd (?P<v>[0234]) clause(?: L)?
bsd-2-clause 0.92 clause bsd | two clause bsd(?: L)?
bsd-3-clause 0.92 clause bsd | three clause bsd(?: L)?
bsd-4-clause 0.92 clause bsd | four clause bsd(?: L)?
bsd-2-clause 0.92 simplified bsd | simplified bsd L
bsd-2-clause 0.92 freebsd | freebsd L
bsd-3-clause 0.92 new bsd | new bsd L
bsd-3-clause 0.92 revised bsd | revised bsd L
bsd-3-clause 0.92 modified bsd | modified bsd L
bsd-4-clause 0.92 original bsd | original bsd L
bsd 0.88 bsd | bsd(?: style| like)? L
bsd 0.85 bsd licensed | (?:is|are) bsd licensed
lgpl-V 0.95 general public | (?:lesser|library) general public L(?: version)?(?: v ?| )(?P<v>2 0|2 1|3 0|2|3)
lgpl-2.1 0.95 lgplv2 1 | lgplv2 1
lgpl-2 0.94 lgplv2 | lgplv2
lgpl-3 0.95 lgplv3 | lgplv3
lgpl-V 0.93 lgpl | (?:gnu )?lgpl(?: version)?(?: v ?| )(?P<v>2 0|2 1|3 0|2|3)
lgpl 0.88 lesser | (?:gnu )?lesser general public L
lgpl 0.88 library general public | (?:gnu )?library general public L
lgpl 0.85 lgpl | (?:gnu )?lgpl(?: L)?
agpl-V 0.95 affero | affero general public L(?: version)?(?: v ?| )(?P<v>1 0|3 0|1|3)
agpl-3 0.95 agplv3 | agplv3
agpl-1 0.95 agplv1 | agplv1
agpl-V 0.93 agpl | (?:gnu )?agpl(?: version)?(?: v ?| )(?P<v>3 0|3|1 0)
agpl 0.88 affero | (?:gnu )?affero general public L
agpl 0.85 agpl | (?:gnu )?agpl(?: L)?
gpl-V 0.95 general public license | gnu general public L(?: version)?(?: v ?| )(?P<v>1 0|2 0|3 0|1|2|3)
gpl-V 0.94 gpl version | (?:gnu )?gpl version (?P<v>1|2|3)(?: or later| only)?
gpl-1 0.95 gplv1 | gplv1
gpl-2 0.95 gplv2 | gplv2
gpl-3 0.95 gplv3 | gplv3
gpl-V 0.93 gpl v | gpl v(?P<v>1|2|3)
gpl-V 0.9 gpl | (?:gnu )?gpl (?P<v>2 0|3 0|1|2|3)
gpl 0.88 gnu general public | gnu general public L
gpl 0.85 general public license | general public L
gpl 0.82 gnu gpl | gnu gpl(?: L)?
gpl 0.82 the gpl | (?:under|by|with) the gpl
gpl 0.82 gpl license | gpl L
mpl-V 0.95 mozilla public | mozilla public L(?: version)?(?: v ?| )(?P<v>1 0|1 1|2 0|2)
mpl-V 0.93 mpl | mpl(?: version)?(?: v ?| )(?P<v>1 0|1 1|2 0|2)
mpl-2 0.93 mplv2 | mplv2
mpl-1.1 0.93 mplv1 1 | mplv1 1
mpl 0.88 mozilla public | mozilla public L
mpl 0.8 mpl license | mpl L
epl-V 0.95 eclipse public | eclipse public L(?: version)?(?: v ?| )(?P<v>1 0|2 0|1|2)
epl-V 0.92 epl | epl(?: version| v) ?(?P<v>1 0|2 0|1|2)
epl-V 0.92 epl | (?:under|with|by)(?: the)? epl (?P<v>1 0|2 0)
epl-V 0.92 epl | epl (?P<v>1 0|2 0) L
epl 0.88 eclipse public | eclipse public L
edl-1 0.9 eclipse distribution | eclipse distribution L(?: v)?(?: 1 0)?
cddl-V 0.95 common development and distribution | common development and distribution L(?: version)?(?: v ?| )(?P<v>1 [01])
cddl-V 0.92 cddl | cddl(?: version)?(?: v ?| )(?P<v>1 [01])
cddl 0.88 common development and distribution | common development and distribution L
cddl 0.85 cddl | cddl(?: L)?
cpl-1 0.92 common public license | common public L(?: version| v)? 1 0
cpl 0.86 common public license | common public L
ipl-1 0.92 ibm public license | ibm public L(?: version| v)? 1 0
isc 0.9 isc license | (?:the )?isc L
isc 0.85 isc licensed | (?:is|are) isc licensed
zlib 0.9 zlib | zlib(?: libpng)? L
libpng 0.9 libpng license | libpng L
bsl-1 0.94 boost software license | boost software L(?: version)? 1 0
bsl 0.9 boost software license | boost software L
bsl 0.82 boost license | boost L
unlicense 0.9 the unlicense | the unlicense
unlicense 0.85 unlicense | unlicense(?: license)?
wtfpl 0.9 wtfpl | wtfpl(?: (?:version|v) ?2)?(?: L)?
artistic-V 0.94 artistic license | (?:perl )?artistic L(?: version)?(?: v ?| )(?P<v>1 0|2 0|2)
artistic 0.88 artistic license | (?:perl )?artistic L
perl 0.86 same terms as perl | (?:under|on) the same terms as perl itself
psf-2 0.94 python software foundation | python software foundation L(?: version)? 2
psf 0.9 python software foundation license | python software foundation L
psf 0.85 psf license | psf L
python 0.82 python license | python L
postgresql 0.9 postgresql license | postgresql L
openssl 0.88 openssl license | openssl L
ssleay 0.88 ssleay | ssleay L
ruby 0.85 ruby license | ruby L
php-V 0.93 php license | php L(?: version)?(?: v ?| )(?P<v>3 0|3 01)
php 0.85 php license | php L
w3c 0.93 w3c software | w3c software(?: notice)?(?: and)?(?: document)? (?:notice and )?L
w3c 0.85 w3c license | w3c L
eupl-V 0.95 european union public | european union public L(?: version)?(?: v ?| )(?P<v>1 [012])
eupl-V 0.93 eupl | eupl(?: version)?(?: v ?| )(?P<v>1 [012])
eupl 0.88 european union public | european union public L
eupl 0.85 eupl | eupl(?: L)?
cecill-V 0.93 cecill | cecill(?: L)?(?: version)?(?: v ?| )(?P<v>1 [01]|2 [01])
cecill-b 0.9 cecill b | cecill b(?: L)?
cecill-c 0.9 cecill c | cecill c(?: L)?
cecill 0.86 cecill | cecill(?: L)?
ms-pl 0.93 microsoft public license | microsoft public L
ms-rl 0.93 microsoft reciprocal license | microsoft reciprocal L
ms-pl 0.85 ms pl | ms pl L
ms-pl 0.85 ms pl | (?:under|with|by)(?: the)? ms pl
ms-rl 0.85 ms rl | ms rl
afl-V 0.94 academic free license | academic free L(?: version)?(?: v ?| )(?P<v>1 [12]|2 [01]|3 0)
afl 0.88 academic free license | academic free L
osl-V 0.94 open software license | open software L(?: version)?(?: v ?| )(?P<v>1 [01]|2 [01]|3 0)
osl 0.86 open software license | open software L
ecl-2 0.92 educational community license | educational community L(?: version)? 2 0
ecl 0.88 educational community license | educational community L
ncsa 0.9 ncsa | (?:university of illinois )?ncsa(?: open source)? L
upl-1 0.9 universal permissive license | universal permissive L(?: v| version)?(?: 1 0)?
qpl 0.88 q public license | q public L
vim 0.85 vim license | vim L
sleepycat 0.88 sleepycat license | sleepycat L
lppl-V 0.92 latex project public license | latex project public L(?: version)? (?P<v>1 [0-3])
lppl 0.88 latex project public license | latex project public L
ofl-V 0.95 open font license | (?:sil )?open font L(?: version)?(?: v ?| )(?P<v>1 [01])
ofl 0.88 open font license | (?:sil )?open font L
bitstream-vera 0.88 bitstream vera | bitstream vera(?: fonts?)? L
gfdl-V 0.95 free documentation license | (?:gnu )?free documentation L(?: version)?(?: v ?| )(?P<v>1 [123])
gfdl-V 0.93 gfdl | gfdl(?: version)?(?: v ?| )(?P<v>1 [123])
gfdl 0.88 free documentation license | (?:gnu )?free documentation L
gfdl 0.85 gfdl | gfdl
cc-by-nc-nd-V 0.95 creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: L)?(?: version)? (?P<v>[1234] [05])
cc-by-nc-sa-V 0.95 creative commons | creative commons attribution non ?commercial share ?alike(?: L)?(?: version)? (?P<v>[1234] [05])
cc-by-nc-V 0.95 creative commons | creative commons attribution non ?commercial(?: L)?(?: version)? (?P<v>[1234] [05])
cc-by-nd-V 0.95 creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: L)?(?: version)? (?P<v>[1234] [05])
cc-by-sa-V 0.95 creative commons | creative commons attribution share ?alike(?: L)?(?: version)? (?P<v>[1234] [05])
cc-by-V 0.95 creative commons | creative commons attribution(?: L)?(?: version)? (?P<v>[1234] [05])
cc-by-nc-nd 0.9 creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa 0.9 creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc 0.9 creative commons | creative commons attribution non ?commercial
cc-by-nd 0.9 creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa 0.9 creative commons | creative commons attribution share ?alike
cc-by 0.9 creative commons | creative commons attribution
cc0 0.92 creative commons | creative commons (?:cc0|zero|public domain dedication)
cc-by-nc-nd-V 0.92 cc by nc nd | cc by nc nd (?P<v>[1234] [05])
cc-by-nc-sa-V 0.92 cc by nc sa | cc by nc sa (?P<v>[1234] [05])
cc-by-nc-V 0.92 cc by nc | cc by nc (?P<v>[1234] [05])
cc-by-nd-V 0.92 cc by nd | cc by nd (?P<v>[1234] [05])
cc-by-sa-V 0.92 cc by sa | cc by sa (?P<v>[1234] [05])
cc-by-V 0.92 cc by | cc by (?P<v>[1234] [05])
cc-by-nc-nd 0.88 cc by nc nd | cc by nc nd
cc-by-nc-sa 0.88 cc by nc sa | cc by nc sa
cc-by-nd 0.88 cc by nd | cc by nd
cc-by-sa 0.88 cc by sa | cc by sa
cc0 0.93 cc0 | cc0(?: 1 0)?(?: universal)?(?: L)?
cc0 0.88 cc zero | cc zero(?: 1 0)?
cc 0.8 creative commons | creative commons L
odc-by 0.92 open data commons | open data commons attribution(?: L)?(?: v| version)?(?: 1 0)?
odbl-1 0.93 open data commons | open data commons open database L(?: v| version)?(?: 1 0)?
odbl-1 0.92 open database license | open database L(?: v| version)? 1 0
odbl 0.88 open database license | open database L
odbl 0.85 odbl | odbl(?: 1 0)?(?: L)?
pddl 0.88 public domain dedication and | public domain dedication and L
public-domain 0.9 dedicated to the public | dedicated to the public domain
public-domain 0.88 in the public domain | (?:is|are|placed|released) in the public domain
public-domain 0.88 into the public domain | (?:released|placed|put|given|donated|dedicated|contributed) into the public domain
beerware 0.9 beerware | (?:the )?beerware(?: L)?
beerware 0.9 beer ware | (?:the )?beer ware(?: L)?
sspl-1 0.93 server side public license | server side public L(?: version| v)?(?: 1)?
busl-V 0.93 business source license | business source L(?: version)?(?: v ?| )(?P<v>1 [01])
busl 0.88 business source license | business source L
elastic-2 0.93 elastic license | elastic L(?: version| v)?(?: 2 0| 2)
elastic 0.85 elastic license | elastic L
commons-clause 0.9 commons clause | commons clause(?: L)? condition
json 0.9 shall be used for good | the software shall be used for good not evil
proprietary 0.85 proprietary and confidential | proprietary and confidential(?: all rights reserved)?
unlicensed 0.8 no license is granted | no L is granted
"""


def rules() -> list[tuple[str, str, re.Pattern, int, float]]:
    """(keyword, label, pattern, priority, confidence) of each rule, in order."""
    out = []
    for i, line in enumerate(RULES.strip().splitlines()):
        head, pattern = line.split(" | ")
        label, sure, keyword = head.split(" ", 2)
        pattern = re.sub(r"\bL\b", "licen[sc]e", pattern)
        out.append((keyword, label, re.compile(rf"(?<![^ ]){pattern}(?![^ ])"), i, float(sure)))
    return out


def named(label: str, version: str | None) -> str:
    """A rule's label with the version that it read: 2 0 is 2, 2 1 is 2.1, 3 01 is 3.01 and 10 is 1 (1.0 in an address)."""
    if version is None:
        return label
    parts = version.split(" ") if version not in ("10", "20") else [version[0]]
    return label.replace("V", parts[0] if len(parts) == 1 or parts[1] == "0" else ".".join(parts))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(word, label) where a base phrase starts."""
    out = []
    for phrase, label in PHRASES:
        n, rare = len(phrase), phrase[2] if label != "apache-2" else phrase[0]
        shift = phrase.index(rare)
        i = -1
        while True:
            try:
                i = words.index(rare, i + 1)
            except ValueError:
                break
            if i >= shift and tuple(words[i - shift : i - shift + n]) == phrase:
                out.append((i - shift, label))
    return sorted(out)


def detections(line: str, known: list) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) in the single-spaced words, after suppression."""
    found, held = [], {}
    for keyword, label, pattern, priority, sure in known:
        # British spellings pass the filter of a keyword that holds the word license, too.
        if keyword not in held:
            held[keyword] = keyword in line or keyword.replace("license", "licence") in line
        if held[keyword]:
            for m in pattern.finditer(line):
                found.append((priority, m.start() - m.end(), m.start(), m.end(), named(label, m.groupdict().get("v")), sure))
    longest = max((-x[1] for x in found), default=0)
    taken: list = []
    for _, _, s, e, label, sure in sorted(found):
        i, clear = bisect_left(taken, (e,)), True
        # Only what starts less than the longest detection before this one can meet it.
        while i and clear and taken[i - 1][0] > s - longest:
            i -= 1
            s2, e2, _, sure2 = taken[i]
            clear = not (s < e2 and (s2 <= s and e <= e2 or sure <= sure2))
        if clear:
            taken.insert(bisect_left(taken, (s, e)), (s, e, label, sure))
    return taken


#: Words that most texts hold.
ORDINARY = frozenset("the a of is in to and all new open what terms shall see no this by be for used under with general public software copyright copy zero above notice".split())


def gate_words(known: list) -> set[str]:
    """The longest word of each rule's keyword, ordinary words last, in either spelling: a text without any of them matches no rule."""
    return {max(k.split(), key=lambda w: (w not in ORDINARY, len(w))) for r in known for k in (r[0], r[0].replace("license", "licence"))}


def _scan(batches):
    import pyarrow as pa

    known = rules()
    gate = gate_words(known)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    for batch in batches:
        names, rows = batch.column("doc_id"), batch.column("text")
        for i in range(0, len(rows), 1024):
            out = []
            for text in rows.slice(i, 1024).to_pylist():
                words = words_of(text)
                if gate.isdisjoint(words):
                    out.append((len(words), 0, None, None, "", "", 0.0, ""))
                    continue
                low, base = " ".join(words), base_places(words)
                labels = {label for _, label in base}
                own = detections(low, known)
                score = max([1.0] * bool(base) + [sure for *_, sure in own], default=0.0)
                places, word, at = [], 0, 0
                for s, _, label, _ in own:
                    word, at = word + low.count(" ", at, s), s
                    places.append(f"{label}:{word}")
                out.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in own})), score, ",".join(places)))
            yield pa.RecordBatch.from_arrays([names.slice(i, 1024), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """The base figures, labels, score and `found` (label:word of each detection) of each row."""
    return common.texts(docs).mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
