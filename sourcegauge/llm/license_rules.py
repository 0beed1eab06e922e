"""Signature rules for licence texts: label, priority, keyword, pattern.

A pattern is matched against the text's lower-case words joined by single blanks, and starts and ends at word
bounds. It is tried only where its keyword, a phrase of plain words, occurs. Priorities: 9 licence identifiers, 8 addresses,
7 passages of the licence itself, 6 full names with a version, 5 names, 4 base phrases, 2 hints.
"""

from __future__ import annotations

# The base phrases.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The signature rules. One rule a line: label | priority | keyword | pattern.
TABLE = r"""
apache-2.0 | 9 | identifier apache | spdx license identifier apache 2 0
apache-2.0 | 8 | apache org | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 7 | apache license | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 7 | file except in compliance | you may not use this file except in compliance with the license
apache-2.0 | 7 | conditions of any kind | without warranties or conditions of any kind either express or implied
apache-2.0 | 6 | apache | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?
apache-2.0 | 6 | apache | apache (?:2|v2)(?: 0)? licen[cs]e
apache-2.0 | 5 | asl | asl 2(?: 0)?
apache-1.1 | 9 | identifier apache | spdx license identifier apache 1 1
apache-1.1 | 6 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-1.0 | 9 | identifier apache | spdx license identifier apache 1 0
apache-1.0 | 6 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
mit | 9 | identifier mit | spdx license identifier mit
mit | 8 | opensource org | opensource org licen[cs]es? mit(?: license)?(?: php| html)?
mit | 7 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 7 | above copyright notice | the above copyright notice and this permission notice shall be included in all copies
mit | 7 | without warranty of any kind | the software is provided as is without warranty of any kind express or implied
mit | 6 | mit | (?:released|licensed|available|distributed) under (?:the )?(?:terms of the )?mit (?:x11 )?licen[cs]e
mit | 5 | expat | expat licen[cs]e
mit | 5 | mit | mit (?:style |x11 )licen[cs]e
mit-0 | 9 | identifier mit 0 | spdx license identifier mit 0
mit-0 | 6 | mit | mit (?:no attribution|0) licen[cs]e
gpl-1.0 | 9 | identifier gpl | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1.0 | 6 | general public | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:version|v) 1
gpl-2.0 | 9 | identifier gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 9 | identifier gpl | spdx license identifier gpl 2 0 or later
gpl-2.0 | 8 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl-2.0 | 6 | general public | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 2(?: 0)?
gpl-2.0 | 6 | gpl | (?:gnu )?gpl (?:version |v )?2(?: 0)?
gpl-2.0 | 5 | gplv2 | gplv2
gpl-2.0-or-later | 7 | or at your option | version 2 of the license or at your option any later version
gpl-2.0-or-later | 6 | gpl | (?:gnu )?gpl (?:version |v )?2(?: 0)? or (?:any )?later
gpl-2.0-or-later | 5 | gplv2 | gplv2 or later
gpl-3.0 | 9 | identifier gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 9 | identifier gpl | spdx license identifier gpl 3 0 or later
gpl-3.0 | 8 | gnu org | gnu org licenses gpl(?: 3 0)?(?: txt| html)?
gpl-3.0 | 7 | version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-3.0 | 6 | general public | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 3(?: 0)?
gpl-3.0 | 6 | gpl | (?:gnu )?gpl (?:version |v )?3(?: 0)?
gpl-3.0 | 5 | gplv3 | gplv3
gpl-3.0-or-later | 7 | or at your option | version 3 of the license or at your option any later version
gpl-3.0-or-later | 6 | gpl | (?:gnu )?gpl (?:version |v )?3(?: 0)? or (?:any )?later
gpl-3.0-or-later | 5 | gplv3 | gplv3 or later
gpl | 7 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 7 | general public | you should have received a copy of the gnu general public license along with this
gpl | 5 | gpl | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?gpl
lgpl-2.0 | 9 | identifier lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 | 6 | library general public | gnu library general public licen[cs]e (?:version |v )?2(?: 0)?
lgpl-2.1 | 9 | identifier lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 8 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
lgpl-2.1 | 6 | lesser general public | gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 2 1
lgpl-2.1 | 6 | lgpl | (?:gnu )?lgpl (?:version |v )?2 1
lgpl-3.0 | 9 | identifier lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | 8 | gnu org | gnu org licenses lgpl(?: 3 0)?(?: txt| html)?
lgpl-3.0 | 6 | lesser general public | gnu lesser general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 3(?: 0)?
lgpl-3.0 | 6 | lgpl | (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl | 5 | lesser general public | gnu lesser general public licen[cs]e
lgpl | 5 | lgpl | (?:licensed|released|distributed) under (?:the )?(?:gnu )?lgpl
agpl-3.0 | 9 | identifier agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | 8 | gnu org | gnu org licenses agpl(?: 3 0)?(?: txt| html)?
agpl-3.0 | 6 | affero | (?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 3(?: 0)?
agpl-3.0 | 6 | agpl | (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3.0 | 5 | agplv3 | agplv3
agpl | 5 | affero | (?:gnu )?affero general public licen[cs]e
agpl-1.0 | 9 | identifier agpl | spdx license identifier agpl 1 0
gfdl-1.1 | 6 | free documentation | gnu free documentation licen[cs]e (?:version |v )?1 1
gfdl-1.2 | 9 | identifier gfdl | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.2 | 6 | free documentation | gnu free documentation licen[cs]e (?:version |v )?1 2
gfdl-1.3 | 9 | identifier gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.3 | 8 | gnu org | gnu org licenses fdl 1 3(?: txt| html)?
gfdl-1.3 | 6 | free documentation | gnu free documentation licen[cs]e (?:version |v )?1 3
gfdl | 5 | free documentation | gnu free documentation licen[cs]e
bsd-2-clause | 9 | identifier bsd | spdx license identifier bsd 2 clause
bsd-2-clause | 8 | opensource org | opensource org licen[cs]es? bsd 2 clause
bsd-2-clause | 6 | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause | 9 | identifier bsd | spdx license identifier bsd 3 clause
bsd-3-clause | 8 | opensource org | opensource org licen[cs]es? bsd(?: 3 clause| license(?: php)?)
bsd-3-clause | 7 | endorse or promote products | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 6 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | 9 | identifier bsd | spdx license identifier bsd 4 clause
bsd-4-clause | 7 | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd-4-clause | 6 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?
bsd-0-clause | 9 | identifier 0bsd | spdx license identifier 0bsd
bsd-0-clause | 6 | bsd | (?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: licen[cs]e)?
bsd | 7 | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd | 5 | bsd | bsd(?: style)? licen[cs]e
cc0-1.0 | 9 | identifier cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 8 | creativecommons org | creativecommons org publicdomain zero 1 0(?: legalcode)?
cc0-1.0 | 6 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 6 | creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cc-pdm-1.0 | 8 | creativecommons org | creativecommons org publicdomain mark 1 0
cc-pdm-1.0 | 6 | public domain mark | public domain mark(?: 1 0)?
cc-by-1.0 | 9 | identifier cc by | spdx license identifier cc by 1 0
cc-by-1.0 | 8 | creativecommons org | creativecommons org licenses by 1 0
cc-by-1.0 | 6 | cc by | cc by 1 0
cc-by-2.0 | 9 | identifier cc by | spdx license identifier cc by 2 0
cc-by-2.0 | 8 | creativecommons org | creativecommons org licenses by 2 0
cc-by-2.0 | 6 | cc by | cc by 2 0
cc-by-2.5 | 9 | identifier cc by | spdx license identifier cc by 2 5
cc-by-2.5 | 8 | creativecommons org | creativecommons org licenses by 2 5
cc-by-2.5 | 6 | cc by | cc by 2 5
cc-by-3.0 | 9 | identifier cc by | spdx license identifier cc by 3 0
cc-by-3.0 | 8 | creativecommons org | creativecommons org licenses by 3 0
cc-by-3.0 | 6 | cc by | cc by 3 0
cc-by-4.0 | 9 | identifier cc by | spdx license identifier cc by 4 0
cc-by-4.0 | 8 | creativecommons org | creativecommons org licenses by 4 0
cc-by-4.0 | 6 | cc by | cc by 4 0(?: international)?
cc-by-4.0 | 6 | creative commons attribution | creative commons attribution (?:licen[cs]e )?4 0(?: international)?
cc-by-3.0 | 6 | creative commons attribution | creative commons attribution (?:licen[cs]e )?3 0(?: unported)?
cc-by | 5 | creative commons attribution | creative commons attribution(?: licen[cs]e)?
cc-by-sa-1.0 | 9 | identifier cc by sa | spdx license identifier cc by sa 1 0
cc-by-sa-1.0 | 8 | creativecommons org | creativecommons org licenses by sa 1 0
cc-by-sa-2.0 | 9 | identifier cc by sa | spdx license identifier cc by sa 2 0
cc-by-sa-2.0 | 8 | creativecommons org | creativecommons org licenses by sa 2 0
cc-by-sa-2.5 | 9 | identifier cc by sa | spdx license identifier cc by sa 2 5
cc-by-sa-2.5 | 8 | creativecommons org | creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | 9 | identifier cc by sa | spdx license identifier cc by sa 3 0
cc-by-sa-3.0 | 8 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-sa-3.0 | 6 | cc by sa | cc by sa 3 0(?: unported)?
cc-by-sa-3.0 | 6 | creative commons attribution | creative commons attribution share ?alike (?:licen[cs]e )?3 0(?: unported)?
cc-by-sa-4.0 | 9 | identifier cc by sa | spdx license identifier cc by sa 4 0
cc-by-sa-4.0 | 8 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-sa-4.0 | 6 | cc by sa | cc by sa 4 0(?: international)?
cc-by-sa-4.0 | 6 | creative commons attribution | creative commons attribution share ?alike (?:licen[cs]e )?4 0(?: international)?
cc-by-sa | 5 | cc by sa | cc by sa
cc-by-sa | 5 | creative commons attribution | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nd-2.0 | 8 | creativecommons org | creativecommons org licenses by nd 2 0
cc-by-nd-3.0 | 9 | identifier cc by nd | spdx license identifier cc by nd 3 0
cc-by-nd-3.0 | 8 | creativecommons org | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | 9 | identifier cc by nd | spdx license identifier cc by nd 4 0
cc-by-nd-4.0 | 8 | creativecommons org | creativecommons org licenses by nd 4 0
cc-by-nd-4.0 | 6 | cc by nd | cc by nd 4 0(?: international)?
cc-by-nd | 5 | cc by nd | cc by nd
cc-by-nd | 5 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?
cc-by-nc-2.0 | 8 | creativecommons org | creativecommons org licenses by nc 2 0
cc-by-nc-2.5 | 8 | creativecommons org | creativecommons org licenses by nc 2 5
cc-by-nc-3.0 | 9 | identifier cc by nc | spdx license identifier cc by nc 3 0
cc-by-nc-3.0 | 8 | creativecommons org | creativecommons org licenses by nc 3 0
cc-by-nc-3.0 | 6 | cc by nc | cc by nc 3 0(?: unported)?
cc-by-nc-4.0 | 9 | identifier cc by nc | spdx license identifier cc by nc 4 0
cc-by-nc-4.0 | 8 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 6 | cc by nc | cc by nc 4 0(?: international)?
cc-by-nc-4.0 | 6 | creative commons attribution | creative commons attribution non ?commercial (?:licen[cs]e )?4 0(?: international)?
cc-by-nc | 5 | cc by nc | cc by nc
cc-by-nc | 5 | creative commons attribution | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nc-sa-2.0 | 8 | creativecommons org | creativecommons org licenses by nc sa 2 0
cc-by-nc-sa-3.0 | 9 | identifier cc by nc sa | spdx license identifier cc by nc sa 3 0
cc-by-nc-sa-3.0 | 8 | creativecommons org | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-3.0 | 6 | cc by nc sa | cc by nc sa 3 0(?: unported)?
cc-by-nc-sa-4.0 | 9 | identifier cc by nc sa | spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 | 8 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | 6 | cc by nc sa | cc by nc sa 4 0(?: international)?
cc-by-nc-sa | 5 | cc by nc sa | cc by nc sa
cc-by-nc-sa | 5 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
cc-by-nc-nd-3.0 | 9 | identifier cc by nc nd | spdx license identifier cc by nc nd 3 0
cc-by-nc-nd-3.0 | 8 | creativecommons org | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | 9 | identifier cc by nc nd | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 | 8 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | 6 | cc by nc nd | cc by nc nd 4 0(?: international)?
cc-by-nc-nd | 5 | cc by nc nd | cc by nc nd
creative-commons | 2 | creative commons | creative commons(?: licen[cs]e)?
mpl-1.0 | 9 | identifier mpl | spdx license identifier mpl 1 0
mpl-1.1 | 9 | identifier mpl | spdx license identifier mpl 1 1
mpl-1.1 | 8 | mozilla org | mozilla org mpl mpl 1 1(?: txt| html)?
mpl-1.1 | 6 | mozilla public | mozilla public licen[cs]e (?:version |v )?1 1
mpl-2.0 | 9 | identifier mpl | spdx license identifier mpl 2 0
mpl-2.0 | 8 | mozilla org | mozilla org mpl 2 0
mpl-2.0 | 7 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 6 | mozilla public | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2.0 | 5 | mpl | mpl (?:v )?2(?: 0)?
mpl | 5 | mozilla public | mozilla public licen[cs]e
epl-1.0 | 9 | identifier epl | spdx license identifier epl 1 0
epl-1.0 | 8 | eclipse org | eclipse org legal epl v10(?: html)?
epl-1.0 | 6 | eclipse public | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl-2.0 | 9 | identifier epl | spdx license identifier epl 2 0
epl-2.0 | 8 | eclipse org | eclipse org legal epl (?:2 0|v20)(?: html)?
epl-2.0 | 6 | eclipse public | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl | 5 | eclipse public | eclipse public licen[cs]e
cddl-1.0 | 9 | identifier cddl | spdx license identifier cddl 1 0
cddl-1.0 | 6 | common development and distribution | common development and distribution licen[cs]e(?: cddl)?(?: (?:version |v )?1 0)?
cddl-1.1 | 9 | identifier cddl | spdx license identifier cddl 1 1
cddl-1.1 | 6 | common development and distribution | common development and distribution licen[cs]e(?: cddl)? (?:version |v )?1 1
cpl-1.0 | 9 | identifier cpl | spdx license identifier cpl 1 0
cpl-1.0 | 6 | common public license | common public license(?: (?:version |v )?1 0)?
eupl-1.1 | 9 | identifier eupl | spdx license identifier eupl 1 1
eupl-1.1 | 6 | european union public | european union public licen[cs]e(?: eupl)? (?:version |v )?1 1
eupl-1.2 | 9 | identifier eupl | spdx license identifier eupl 1 2
eupl-1.2 | 6 | european union public | european union public licen[cs]e(?: eupl)? (?:version |v )?1 2
eupl | 5 | european union public | european union public licen[cs]e
isc | 9 | identifier isc | spdx license identifier isc
isc | 8 | opensource org | opensource org licen[cs]es? isc(?: license)?
isc | 7 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 5 | isc license | isc license
zlib | 9 | identifier zlib | spdx license identifier zlib
zlib | 7 | origin of this software | the origin of this software must not be misrepresented
zlib | 5 | zlib license | zlib license
zlib | 5 | zlib libpng | zlib libpng license
libpng | 9 | identifier libpng | spdx license identifier libpng
libpng | 5 | libpng license | libpng license
boost-1.0 | 9 | identifier bsl 1 0 | spdx license identifier bsl 1 0
boost-1.0 | 8 | boost org | boost org license 1 0 txt
boost-1.0 | 6 | boost software | boost software licen[cs]e(?: (?:version |v )?1 0)?
busl-1.1 | 9 | identifier busl | spdx license identifier busl 1 1
busl-1.1 | 6 | business source license | business source license(?: (?:version |v )?1 1)?
sspl-1.0 | 9 | identifier sspl | spdx license identifier sspl 1 0
sspl-1.0 | 6 | server side public | server side public licen[cs]e(?: (?:version |v )?1)?
elastic-2.0 | 9 | identifier elastic | spdx license identifier elastic 2 0
elastic-2.0 | 6 | elastic license | elastic license(?: (?:version |v )?2 0)?
unlicense | 9 | identifier unlicense | spdx license identifier unlicense
unlicense | 8 | unlicense org | (?:https? )?unlicense org
unlicense | 7 | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 5 | the unlicense | the unlicense
wtfpl | 9 | identifier wtfpl | spdx license identifier wtfpl
wtfpl | 6 | want to public license | do what the fuck you want to public license(?: (?:version |v )?2)?
wtfpl | 5 | wtfpl | wtfpl
artistic-1.0 | 9 | identifier artistic | spdx license identifier artistic 1 0(?: perl)?
artistic-1.0 | 6 | artistic license | artistic license (?:version |v )?1(?: 0)?
artistic-2.0 | 9 | identifier artistic | spdx license identifier artistic 2 0
artistic-2.0 | 8 | perlfoundation org | perlfoundation org artistic license 2 0
artistic-2.0 | 6 | artistic license | artistic license (?:version |v )?2(?: 0)?
artistic | 5 | artistic license | artistic license
perl | 7 | same terms as perl | (?:under )?the same terms as perl(?: 5)? itself
python-2.0 | 9 | identifier python | spdx license identifier python 2 0
python-2.0 | 6 | python software foundation | python software foundation licen[cs]e(?: (?:version |v )?2)?
php-3.01 | 9 | identifier php | spdx license identifier php 3 01
php-3.01 | 8 | php net | php net license 3 01(?: txt)?
php-3.01 | 6 | php license | php license (?:version |v )?3 01
php | 5 | php license | php license
ruby | 9 | identifier ruby | spdx license identifier ruby
ruby | 5 | ruby license | ruby license
ms-pl | 9 | identifier ms pl | spdx license identifier ms pl
ms-pl | 6 | microsoft public | microsoft public licen[cs]e
ms-rl | 9 | identifier ms rl | spdx license identifier ms rl
ms-rl | 6 | microsoft reciprocal | microsoft reciprocal licen[cs]e
osl-3.0 | 9 | identifier osl | spdx license identifier osl 3 0
osl-3.0 | 6 | open software license | open software license(?: (?:version |v )?3 0)?
afl-3.0 | 9 | identifier afl | spdx license identifier afl 3 0
afl-3.0 | 6 | academic free | academic free licen[cs]e(?: (?:version |v )?3 0)?
ncsa | 9 | identifier ncsa | spdx license identifier ncsa
ncsa | 6 | ncsa open source | (?:university of illinois )?ncsa open source licen[cs]e
ofl-1.1 | 9 | identifier ofl | spdx license identifier ofl 1 1
ofl-1.1 | 8 | scripts sil org | scripts sil org ofl
ofl-1.1 | 6 | open font | sil open font licen[cs]e(?: (?:version |v )?1 1)?
odbl-1.0 | 9 | identifier odbl | spdx license identifier odbl 1 0
odbl-1.0 | 8 | opendatacommons org | opendatacommons org licenses odbl(?: 1 0)?
odbl-1.0 | 6 | open database | open database licen[cs]e(?: odbl)?(?: (?:version |v )?1 0)?
odc-by-1.0 | 9 | identifier odc by | spdx license identifier odc by 1 0
odc-by-1.0 | 8 | opendatacommons org | opendatacommons org licenses by(?: 1 0)?
odc-by-1.0 | 6 | open data commons attribution | open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?
pddl-1.0 | 8 | opendatacommons org | opendatacommons org licenses pddl(?: 1 0)?
pddl-1.0 | 6 | public domain dedication | public domain dedication and licen[cs]e
cdla-permissive-1.0 | 6 | community data license | community data license agreement permissive(?: (?:version |v )?1 0)?
cdla-sharing-1.0 | 6 | community data license | community data license agreement sharing(?: (?:version |v )?1 0)?
ogl-uk-3.0 | 8 | nationalarchives gov uk | nationalarchives gov uk doc open government licence version 3
ogl-uk-3.0 | 6 | open government licence | open government licence(?: (?:version |v )?3 0)?
openrail | 6 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?
openssl | 6 | openssl license | openssl license
postgresql | 9 | identifier postgresql | spdx license identifier postgresql
postgresql | 5 | postgresql license | postgresql license
vim | 5 | vim license | vim license
w3c | 6 | w3c software | w3c software (?:notice and )?licen[cs]e
x11 | 9 | identifier x11 | spdx license identifier x11
curl | 9 | identifier curl | spdx license identifier curl
hpnd | 6 | historical permission notice | historical permission notice and disclaimer
upl-1.0 | 6 | universal permissive | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
mulanpsl-2.0 | 6 | mulan permissive | mulan permissive software licen[cs]e(?: (?:version |v )?2)?
blueoak-1.0.0 | 6 | blue oak model | blue oak model licen[cs]e(?: 1 0 0)?
beerware | 5 | beer ware | (?:the )?beer ware licen[cs]e
public-domain | 5 | public domain | (?:released|placed|dedicated|put) (?:in ?to|to|in) the public domain
public-domain | 5 | public domain | this work is in the public domain
proprietary | 5 | all rights reserved | copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}?all rights reserved
proprietary | 5 | confidential and proprietary | confidential and proprietary
proprietary | 2 | all rights reserved | all rights reserved
"""


def rules() -> list[tuple[str, int, str, str, bool]]:
    """(label, priority, keyword, pattern, is base), base phrases first."""
    out = [(label, 4, phrase, phrase, True) for phrase, label in BASE.items()]
    for line in filter(None, map(str.strip, TABLE.splitlines())):
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), keyword, pattern, False))
    return out
