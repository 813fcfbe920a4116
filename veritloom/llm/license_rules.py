"""Signature rules of the license scan, written by hand, in order.

A line is ``label; priority; confidence; keyword; pattern``.  Patterns speak of
words: text is lower-cased, everything but letters, digits and characters
beyond ASCII is a gap, and one space in a pattern is one gap.  A pattern always
covers whole words.  ``keyword`` is a word of every match; a pattern is tried
only where that word occurs.  Priorities: 4 base phrases, 3 notices and full titles,
2 names with a version, 1 loose mentions.
"""

from __future__ import annotations

#: Phrases whose places are counted as such; never suppressed.
BASE_RULES = """
mit; 4; 0.95; license; under the mit license
apache-2; 4; 0.95; apache; apache license version 2
cc-by-nc; 4; 0.9; cc; cc by nc
"""

RULES = """
mit; 3; 1.0; permission; permission is hereby granted free of charge to any person obtaining a copy
mit; 3; 0.95; mit; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit; 2; 0.9; mit; (?:the )?mit x11 licen[sc]e
mit; 2; 0.9; mit; licen[sc]e mit
mit; 2; 0.85; mit; mit licen[sc]e
mit; 2; 0.85; mit; mit licensed
mit; 2; 0.9; expat; expat licen[sc]e
mit-0; 2; 0.95; mit; mit no attribution
mit-0; 2; 0.9; mit; mit 0
x11; 2; 0.85; x11; x11 licen[sc]e
mit-cmu; 2; 0.85; cmu; (?:mit cmu|cmu) licen[sc]e
apache-2; 3; 1.0; apache; licensed under the apache licen[sc]e version 2 0(?: the license)?
apache-2; 3; 0.98; apache; apache software foundation asf under one or more contributor license agreements
apache-2; 2; 0.9; apache; apache licen[sc]e (?:version |v)?2 0
apache-2; 2; 0.9; apache; apache licen[sc]e v2
apache-2; 2; 0.85; apache; apache 2(?: 0)?(?: licen[sc]ed?)?
apache-2; 2; 0.9; apache; apache org licenses license 2 0
apache-1.1; 2; 0.9; apache; apache (?:software )?licen[sc]e (?:version |v)?1 1
apache-1.0; 2; 0.9; apache; apache (?:software )?licen[sc]e (?:version |v)?1 0
apache; 1; 0.6; apache; apache (?:software )?licen[sc]e
bsd; 3; 0.95; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3; 3; 0.95; endorse; neither the name of [^ ]+ (?:[^ ]+ ){0,8}nor the names of its contributors may be used to endorse
bsd-4; 3; 0.9; advertising; all advertising materials mentioning features or use of this software must display
bsd-3; 2; 0.9; bsd; (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3; 2; 0.9; bsd; bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3; 2; 0.85; bsd; (?:new|modified|revised) bsd licen[sc]e
bsd-2; 2; 0.9; bsd; (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2; 2; 0.9; bsd; bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2; 2; 0.85; bsd; (?:simplified|freebsd) bsd licen[sc]e
bsd-4; 2; 0.85; bsd; (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4; 2; 0.85; bsd; bsd (?:4|four) clause(?: licen[sc]e)?
bsd-4; 2; 0.85; bsd; (?:original|old) bsd licen[sc]e
0bsd; 2; 0.9; bsd; (?:0|zero) clause bsd(?: licen[sc]e)?
0bsd; 2; 0.9; 0bsd; 0bsd
bsd; 1; 0.7; bsd; bsd (?:style )?licen[sc]ed?
bsd; 1; 0.7; bsd; licen[sc]ed? (?:under )?(?:the )?bsd
isc; 3; 0.95; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 2; 0.85; isc; isc licen[sc]ed?
gpl-3; 3; 0.98; general; gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?
gpl-2; 3; 0.98; general; gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)?
gpl-1; 3; 0.9; general; gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 1(?: of the license)?
gpl; 3; 0.9; redistribute; you can redistribute it and or modify it under the terms of the gnu general public license
gpl-3; 2; 0.95; general; gnu general public licen[sc]e v3(?: 0)?
gpl-2; 2; 0.95; general; gnu general public licen[sc]e v2(?: 0)?
gpl-3-or-later; 2; 0.95; gpl; gpl (?:v)?3(?: 0)? or (?:any )?later(?: version)?
gpl-3-or-later; 2; 0.9; gplv3; gplv3 or (?:any )?later(?: version)?
gpl-2-or-later; 2; 0.95; gpl; gpl (?:v)?2(?: 0)? or (?:any )?later(?: version)?
gpl-2-or-later; 2; 0.9; gplv2; gplv2 or (?:any )?later(?: version)?
gpl-3-only; 2; 0.95; gpl; gpl 3 0 only
gpl-2-only; 2; 0.95; gpl; gpl 2 0 only
gpl-3; 2; 0.9; gpl; (?:gnu )?gpl (?:version |v)?3(?: 0)?
gpl-2; 2; 0.9; gpl; (?:gnu )?gpl (?:version |v)?2(?: 0)?
gpl-3; 2; 0.9; gplv3; gplv3
gpl-2; 2; 0.9; gplv2; gplv2
gpl; 1; 0.7; general; (?:gnu )?general public licen[sc]e
gpl; 1; 0.7; gpl; (?:gnu )?gpl(?: licen[sc]ed?)?
lgpl-3; 3; 0.95; lesser; gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?
lgpl-2.1; 3; 0.95; lesser; gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the license)?
lgpl-2; 3; 0.95; library; gnu library general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)?
lgpl-3; 2; 0.9; lgpl; lgpl (?:version |v)?3(?: 0)?
lgpl-2.1; 2; 0.9; lgpl; lgpl (?:version |v)?2 1
lgpl-2; 2; 0.85; lgpl; lgpl (?:version |v)?2(?: 0)?
lgpl-3; 2; 0.9; lgplv3; lgplv3
lgpl-2.1; 2; 0.9; lgplv2; lgplv2 1
lgpl; 1; 0.7; lesser; (?:gnu )?lesser general public licen[sc]e
lgpl; 1; 0.7; lgpl; (?:gnu )?lgpl
agpl-3; 3; 0.98; affero; gnu affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?
agpl-3; 2; 0.9; agpl; agpl (?:version |v)?3(?: 0)?
agpl-3; 2; 0.9; agplv3; agplv3
agpl-1; 2; 0.85; affero; affero general public licen[sc]e version 1
agpl; 1; 0.7; affero; (?:gnu )?affero general public licen[sc]e
agpl; 1; 0.7; agpl; agpl
gfdl-1.3; 3; 0.95; documentation; gnu free documentation licen[sc]e (?:version |v)?1 3
gfdl-1.2; 3; 0.95; documentation; gnu free documentation licen[sc]e (?:version |v)?1 2
gfdl-1.1; 3; 0.95; documentation; gnu free documentation licen[sc]e (?:version |v)?1 1
gfdl; 1; 0.8; documentation; (?:gnu )?free documentation licen[sc]e
gfdl; 1; 0.75; gfdl; gfdl
mpl-2; 3; 0.98; mozilla; subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2; 2; 0.95; mozilla; mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-1.1; 2; 0.95; mozilla; mozilla public licen[sc]e (?:version |v )?1 1
mpl-1.0; 2; 0.95; mozilla; mozilla public licen[sc]e (?:version |v )?1 0
mpl-2; 2; 0.85; mpl; mpl (?:version |v)?2(?: 0)?
mpl-1.1; 2; 0.85; mpl; mpl (?:version |v)?1 1
mpl; 1; 0.7; mozilla; mozilla public licen[sc]e
epl-2; 2; 0.95; eclipse; eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-1; 2; 0.95; eclipse; eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl; 1; 0.7; eclipse; eclipse public licen[sc]e
edl-1; 2; 0.85; eclipse; eclipse distribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?
cpl-1; 2; 0.9; common; common public licen[sc]e (?:version |v )?1(?: 0)?
cddl-1.1; 2; 0.9; cddl; cddl (?:version |v)?1 1
cddl-1; 2; 0.9; cddl; cddl (?:version |v)?1(?: 0)?
cddl; 1; 0.8; development; common development and distribution licen[sc]e
eupl-1.2; 2; 0.9; european; european union public licen[sc]e (?:version |v )?1 2
eupl-1.1; 2; 0.9; european; european union public licen[sc]e (?:version |v )?1 1
eupl; 1; 0.75; european; european union public licen[sc]e
eupl; 1; 0.7; eupl; eupl
cecill-2.1; 2; 0.9; cecill; cecill (?:version |v)?2 1
cecill-2; 2; 0.9; cecill; cecill (?:version |v)?2
cecill-b; 2; 0.9; cecill; cecill b
cecill-c; 2; 0.9; cecill; cecill c
cecill; 1; 0.7; cecill; cecill
artistic-2; 2; 0.95; artistic; artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic-1; 2; 0.9; artistic; artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic; 1; 0.7; artistic; artistic licen[sc]e
perl; 2; 0.8; perl; same terms as perl(?: itself)?
python-2; 2; 0.9; python; python software foundation licen[sc]e(?: (?:version )?2)?
python-2; 2; 0.85; psf; psf licen[sc]e
ruby; 2; 0.8; ruby; ruby licen[sc]e
php-3.01; 2; 0.9; php; php licen[sc]e (?:version |v )?3 01
php-3; 2; 0.85; php; php licen[sc]e(?: (?:version |v )?3(?: 0)?)?
zlib; 3; 0.95; warranty; provided as is without any express or implied warranty in no event will the authors be held liable
zlib; 2; 0.85; zlib; zlib licen[sc]e
zlib; 2; 0.85; zlib; zlib libpng(?: licen[sc]e)?
libpng; 2; 0.85; libpng; libpng licen[sc]e(?: version 2)?
libtiff; 2; 0.85; libtiff; libtiff licen[sc]e
bsl-1; 2; 0.95; boost; boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)?
unlicense; 3; 0.98; unencumbered; this is free and unencumbered software released into the public domain
unlicense; 2; 0.9; unlicense; (?:the )?unlicense
wtfpl; 2; 0.9; wtfpl; wtfpl(?: (?:version )?2)?
beerware; 2; 0.85; beer; beer ware licen[sc]e
beerware; 2; 0.85; beerware; beerware(?: licen[sc]e)?
public-domain; 2; 0.85; public; (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain; 1; 0.5; public; public domain
cc0-1; 3; 0.98; cc0; cc0 1 0 universal(?: public domain dedication)?
cc0-1; 2; 0.9; cc0; (?:creative commons )?cc0(?: 1 0)?
cc0-1; 2; 0.9; creativecommons; creativecommons org publicdomain zero 1 0
pdm-1; 2; 0.85; creativecommons; creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4; 3; 0.98; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-sa-4; 3; 0.98; creative; creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-4; 3; 0.98; creative; creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nd-4; 3; 0.98; creative; creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-sa-4; 3; 0.98; creative; creative commons attribution share ?alike 4 0(?: international)?
cc-by-4; 3; 0.98; creative; creative commons attribution 4 0(?: international)?
cc-by-nc-nd-3; 3; 0.95; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?
cc-by-nc-sa-3; 3; 0.95; creative; creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-3; 3; 0.95; creative; creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nd-3; 3; 0.95; creative; creative commons attribution no ?deriv(?:ative)?s 3 0(?: unported)?
cc-by-sa-3; 3; 0.95; creative; creative commons attribution share ?alike 3 0(?: unported)?
cc-by-3; 3; 0.95; creative; creative commons attribution 3 0(?: unported)?
cc-by-nc-nd-2.5; 2; 0.9; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s 2 5
cc-by-nc-sa-2.5; 2; 0.9; creative; creative commons attribution non ?commercial share ?alike 2 5
cc-by-sa-2.5; 2; 0.9; creative; creative commons attribution share ?alike 2 5
cc-by-2.5; 2; 0.9; creative; creative commons attribution 2 5
cc-by-nc-nd; 2; 0.9; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa; 2; 0.9; creative; creative commons attribution non ?commercial share ?alike
cc-by-nc; 2; 0.9; creative; creative commons attribution non ?commercial
cc-by-nd; 2; 0.9; creative; creative commons attribution no ?deriv(?:ative)?s
cc-by-sa; 2; 0.9; creative; creative commons attribution share ?alike
cc-by; 2; 0.85; creative; creative commons attribution
cc-by-nc-nd-4; 2; 0.95; cc; cc by nc nd 4 0
cc-by-nc-sa-4; 2; 0.95; cc; cc by nc sa 4 0
cc-by-nc-4; 2; 0.95; cc; cc by nc 4 0
cc-by-nd-4; 2; 0.95; cc; cc by nd 4 0
cc-by-sa-4; 2; 0.95; cc; cc by sa 4 0
cc-by-4; 2; 0.95; cc; cc by 4 0
cc-by-nc-nd-3; 2; 0.9; cc; cc by nc nd 3 0
cc-by-nc-sa-3; 2; 0.9; cc; cc by nc sa 3 0
cc-by-nc-3; 2; 0.9; cc; cc by nc 3 0
cc-by-nd-3; 2; 0.9; cc; cc by nd 3 0
cc-by-sa-3; 2; 0.9; cc; cc by sa 3 0
cc-by-3; 2; 0.9; cc; cc by 3 0
cc-by-nc-nd; 2; 0.9; cc; cc by nc nd
cc-by-nc-sa; 2; 0.9; cc; cc by nc sa
cc-by-nd; 2; 0.85; cc; cc by nd
cc-by-sa; 2; 0.85; cc; cc by sa
cc-by; 1; 0.6; cc; cc by
cc-by-nc-nd; 2; 0.9; creativecommons; creativecommons org licenses by nc nd [0-9] [0-9]
cc-by-nc-sa; 2; 0.9; creativecommons; creativecommons org licenses by nc sa [0-9] [0-9]
cc-by-nc; 2; 0.9; creativecommons; creativecommons org licenses by nc [0-9] [0-9]
cc-by-nd; 2; 0.9; creativecommons; creativecommons org licenses by nd [0-9] [0-9]
cc-by-sa; 2; 0.9; creativecommons; creativecommons org licenses by sa [0-9] [0-9]
cc-by; 2; 0.85; creativecommons; creativecommons org licenses by [0-9] [0-9]
cc; 1; 0.5; creative; creative commons(?: licen[sc]e)?
odbl-1; 2; 0.9; database; open database licen[sc]e(?: (?:version |v )?1 0)?
odbl-1; 2; 0.85; odbl; odbl(?: 1 0)?
odc-by-1; 2; 0.9; commons; open data commons attribution licen[sc]e
pddl-1; 2; 0.9; pddl; pddl(?: 1 0)?
cdla-permissive; 2; 0.9; cdla; cdla permissive [12] 0
cdla-sharing; 2; 0.9; cdla; cdla sharing 1 0
ogl-uk-3; 2; 0.9; government; open government licen[sc]e v(?:ersion )?3 0
ogl-uk; 1; 0.75; government; open government licen[sc]e
etalab-2; 2; 0.85; etalab; (?:licence ouverte )?etalab(?: 2 0)?
ofl-1.1; 2; 0.95; sil; sil open font licen[sc]e(?: (?:version |v )?1 1)?
ofl-1.1; 2; 0.8; font; open font licen[sc]e
ofl-1.1; 2; 0.8; ofl; ofl 1 1
ubuntu-font; 2; 0.85; ubuntu; ubuntu font licen[sc]e(?: 1 0)?
lppl-1.3; 2; 0.9; latex; latex project public licen[sc]e
openssl; 2; 0.9; openssl; openssl licen[sc]e
ssleay; 2; 0.8; ssleay; (?:original )?ssleay licen[sc]e
curl; 2; 0.8; curl; curl licen[sc]e
icu; 2; 0.8; icu; icu licen[sc]e
unicode-dfs; 2; 0.85; unicode; unicode (?:data files and software )?licen[sc]e
w3c; 2; 0.9; w3c; w3c software (?:notice and )?licen[sc]e
ntp; 2; 0.8; ntp; ntp licen[sc]e
ncsa; 2; 0.9; ncsa; (?:university of illinois )?ncsa open source licen[sc]e
postgresql; 2; 0.9; postgresql; postgresql licen[sc]e
vim; 2; 0.8; vim; vim licen[sc]e
sleepycat; 2; 0.8; sleepycat; sleepycat licen[sc]e
qpl-1; 2; 0.85; public; q public licen[sc]e(?: version 1 0)?
ms-pl; 2; 0.9; microsoft; microsoft public licen[sc]e
ms-rl; 2; 0.9; microsoft; microsoft reciprocal licen[sc]e
ms-pl; 2; 0.8; ms; ms pl
ms-rl; 2; 0.8; ms; ms rl
apsl-2; 2; 0.9; apple; apple public source licen[sc]e(?: version 2 0)?
ibm-ipl-1; 2; 0.85; ibm; ibm public licen[sc]e(?: version 1 0)?
nasa-1.3; 2; 0.85; nasa; nasa open source agreement(?: version 1 3)?
osl-3; 2; 0.9; open; open software licen[sc]e (?:version |v )?3 0
osl; 1; 0.7; open; open software licen[sc]e
afl-3; 2; 0.9; academic; academic free licen[sc]e (?:version |v )?3 0
afl-2.1; 2; 0.9; academic; academic free licen[sc]e (?:version |v )?2 1
afl; 1; 0.7; academic; academic free licen[sc]e
ecl-2; 2; 0.85; educational; educational community licen[sc]e(?: version 2 0)?
upl-1; 2; 0.85; permissive; universal permissive licen[sc]e(?: version 1 0)?
blueoak-1; 2; 0.85; oak; blue oak model licen[sc]e(?: 1 0 0)?
mulan-2; 2; 0.85; mulan; mulan (?:permissive software licen[sc]e|psl)(?: v2)?
hippocratic; 2; 0.85; hippocratic; hippocratic licen[sc]e(?: [0-9] [0-9])?
parity-7; 2; 0.8; parity; parity public licen[sc]e(?: 7 0 0)?
sspl-1; 2; 0.95; server; server side public licen[sc]e(?: (?:version |v )?1)?
sspl-1; 2; 0.85; sspl; sspl
busl-1.1; 2; 0.95; business; business source licen[sc]e(?: 1 1)?
elastic-2; 2; 0.9; elastic; elastic licen[sc]e(?: 2 0)?
polyform-nc; 2; 0.9; polyform; polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform; 1; 0.7; polyform; polyform [^ ]+ licen[sc]e
commons-clause; 2; 0.9; clause; commons clause(?: licen[sc]e condition)?(?: v1 0)?
openrail; 2; 0.9; openrail; (?:creativeml )?openrail(?: m)?
openrail; 2; 0.85; rail; (?:creativeml )?open rail(?: m)?
llama-community; 2; 0.9; llama; llama (?:[0-9] )?community licen[sc]e
json; 3; 0.9; evil; software shall be used for good not evil
proprietary; 3; 0.9; rights; all rights reserved
proprietary; 3; 0.9; confidential; proprietary and confidential
proprietary; 2; 0.7; copied; (?:may|must) not be copied
proprietary; 2; 0.7; reproduced; (?:may|must) not be reproduced
proprietary; 2; 0.7; redistributed; (?:may|must) not be redistributed
noncommercial; 2; 0.7; commercial; for (?:personal and )?non commercial use only
noncommercial; 2; 0.7; noncommercial; for (?:personal and )?noncommercial use only
no-derivatives; 2; 0.6; modified; may not be modified
copyright; 1; 0.4; copyright; copyright(?: c)? (?:19|20)[0-9][0-9]
copyright; 1; 0.3; copyright; copyright(?: c)?
license-reference; 1; 0.3; license; see (?:the )?(?:file )?license(?: txt| md)?(?: file)?
license-reference; 1; 0.3; licensed; licensed under
license-reference; 1; 0.3; licenced; licenced under
"""


def parsed(table: str) -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern over double-spaced words) of each line.

    Every word stands between two spaces of its own in the text that patterns
    run on, so a match takes whole words and never a neighbour's space.
    """
    out = []
    for line in table.strip().splitlines():
        label, priority, confidence, keyword, pattern = (x.strip() for x in line.split(";"))
        spaced = pattern.replace(" ?", "\x00").replace(" ", "  ").replace("\x00", "(?:  )?")
        out.append((label, int(priority), float(confidence), keyword, f" {spaced} "))
    return out
