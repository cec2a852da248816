r"""Signature rules for licences, in order: licence | priority | keywords (any of them gates the rule) | regular expression.

In the expressions a plain space stands for white space with comment marks between words. Priorities: 95 identifier tags, 90 sentences of
a licence's own text, 80 full names with version, 70 grants by name, 60 bare names, 40 short names, 10 generic notices.
"""

RULES = r"""
MIT|95|spdx|spdx-license-identifier: ?mit\b(?!-)
MIT-0|95|spdx|spdx-license-identifier: ?mit-0\b
Apache-2.0|95|spdx|spdx-license-identifier: ?apache-2\.0\b
GPL-2.0-only|95|spdx|spdx-license-identifier: ?gpl-2\.0(?:-only)?\b(?!-or|\+)
GPL-2.0-or-later|95|spdx|spdx-license-identifier: ?gpl-2\.0(?:-or-later|\+)
GPL-3.0-only|95|spdx|spdx-license-identifier: ?gpl-3\.0(?:-only)?\b(?!-or|\+)
GPL-3.0-or-later|95|spdx|spdx-license-identifier: ?gpl-3\.0(?:-or-later|\+)
LGPL-2.1-only|95|spdx|spdx-license-identifier: ?lgpl-2\.1(?:-only)?\b(?!-or|\+)
LGPL-2.1-or-later|95|spdx|spdx-license-identifier: ?lgpl-2\.1(?:-or-later|\+)
LGPL-3.0-only|95|spdx|spdx-license-identifier: ?lgpl-3\.0(?:-only)?\b(?!-or|\+)
LGPL-3.0-or-later|95|spdx|spdx-license-identifier: ?lgpl-3\.0(?:-or-later|\+)
AGPL-3.0-only|95|spdx|spdx-license-identifier: ?agpl-3\.0(?:-only)?\b(?!-or|\+)
AGPL-3.0-or-later|95|spdx|spdx-license-identifier: ?agpl-3\.0(?:-or-later|\+)
BSD-2-Clause|95|spdx|spdx-license-identifier: ?bsd-2-clause\b(?!-)
BSD-3-Clause|95|spdx|spdx-license-identifier: ?bsd-3-clause\b(?!-)
BSD-4-Clause|95|spdx|spdx-license-identifier: ?bsd-4-clause\b
0BSD|95|spdx|spdx-license-identifier: ?0bsd\b
ISC|95|spdx|spdx-license-identifier: ?isc\b
MPL-2.0|95|spdx|spdx-license-identifier: ?mpl-2\.0\b
EPL-1.0|95|spdx|spdx-license-identifier: ?epl-1\.0\b
EPL-2.0|95|spdx|spdx-license-identifier: ?epl-2\.0\b
EUPL-1.2|95|spdx|spdx-license-identifier: ?eupl-1\.2\b
CC0-1.0|95|spdx|spdx-license-identifier: ?cc0-1\.0\b
CC-BY-4.0|95|spdx|spdx-license-identifier: ?cc-by-4\.0\b
CC-BY-SA-4.0|95|spdx|spdx-license-identifier: ?cc-by-sa-4\.0\b
Unlicense|95|spdx|spdx-license-identifier: ?unlicense\b
Zlib|95|spdx|spdx-license-identifier: ?zlib\b
BSL-1.0|95|spdx|spdx-license-identifier: ?bsl-1\.0\b
WTFPL|95|spdx|spdx-license-identifier: ?wtfpl\b
Artistic-2.0|95|spdx|spdx-license-identifier: ?artistic-2\.0\b
unknown-spdx|20|spdx|spdx-license-identifier: ?[a-z0-9][a-z0-9.+-]*
MIT|90|permission is hereby granted|permission is hereby granted, free of charge, to any person obtaining a copy of this software
MIT|90|the above copyright notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions
MIT|88|without warranty of any kind|the software is provided ["'“]?as is["'”]?, without warranty of any kind, express or implied
MIT-advertising|91|advertising materials|permission is hereby granted[^.]{0,200}all advertising materials
X11|90|x consortium|except as contained in this notice, the name of the x consortium shall not be used
ISC|90|permission to use, copy|permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
ISC|85|isc disclaims,the author disclaims|(?:isc|the author) disclaims all warranties with regard to this software
0BSD|91|zero-clause,zero clause|(?:bsd )?zero[- ]clause bsd(?: license)?
BSD-2-Clause|90|redistributions of source code|redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-3-Clause|90|neither the name|neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived
BSD-4-Clause|90|all advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause-Clear|90|no express or implied licenses|no express or implied licenses to any party's patent rights are granted by this license
BSD-Source-Code|85|redistributions of source code|redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
BSD-disclaimer|70|copyright holders and contributors|this software is provided by the copyright holders and contributors ["'“]?as is
Apache-2.0|90|apache license|licensed under the apache license,? version 2(?:\.0)?
Apache-2.0|90|apache.org/licenses|https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0|85|in compliance with the license|you may not use this file except in compliance with the license
Apache-2.0|80|distributed under the license|unless required by applicable law or agreed to in writing, software distributed under the license
Apache-1.1|90|apache software foundation|this product includes software developed by the apache software foundation
Apache-1.0|80|apache license,apache software license|apache (?:software )?license,? version 1\.0
Apache-1.1|80|apache license,apache software license|apache (?:software )?license,? version 1\.1
Apache-2.0|80|apache license,apache software license|apache (?:software )?license,? (?:version |v\.? ?)?2(?:\.0)?
Apache-2.0|60|apache-2,apache 2|\bapache[- ]2(?:\.0)?\b
Apache|50|apache license|apache (?:software )?license
GPL-3.0|90|gnu general public license|licensed under the gnu general public license,? (?:version |v)3
GPL-2.0|90|gnu general public license|licensed under the gnu general public license,? (?:version |v)2
GPL-1.0|90|gnu general public license|licensed under the gnu general public license,? (?:version |v)1
GPL-2.0-or-later|92|either version 2|gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?,? or \(?at your option\)? any later version
GPL-3.0-or-later|92|either version 3|gnu general public license as published by the free software foundation[;,] either version 3(?: of the license)?,? or \(?at your option\)? any later version
GPL-2.0-only|91|version 2 of the license|gnu general public license as published by the free software foundation[;,] (?:only )?version 2 of the license
GPL-3.0-only|91|version 3 of the license|gnu general public license as published by the free software foundation[;,] (?:only )?version 3 of the license
GPL-3.0|80|gnu general public license|gnu general public license,? (?:version |v\.? ?)3(?:\.0)?
GPL-2.0|80|gnu general public license|gnu general public license,? (?:version |v\.? ?)2(?:\.0)?
GPL-1.0|80|gnu general public license|gnu general public license,? (?:version |v\.? ?)1(?:\.0)?
GPL|50|gnu general public license|gnu general public license
GPL|45|gnu gpl|\bgnu gpl\b
GPL-3.0-or-later|60|gpl|\bgpl[- ]?(?:v|version )?3(?:\.0)?(?:\+| or later)
GPL-2.0-or-later|60|gpl|\bgpl[- ]?(?:v|version )?2(?:\.0)?(?:\+| or later)
GPL-3.0|55|gpl|\bgpl[- ]?(?:v|version )?3(?:\.0)?\b
GPL-2.0|55|gpl|\bgpl[- ]?(?:v|version )?2(?:\.0)?\b
GPL-copying|60|copy of the gnu general public license|you should have received a copy of the gnu general public license along with
GPL-warranty|50|implied warranty of,fitness for a particular purpose|without even the implied warranty of merchantability or fitness for a particular purpose
GPL-2.0-with-classpath|93|classpath|gnu general public license.{0,120}?classpath exception
GPL-with-font-exception|93|font exception|gnu general public license.{0,120}?font exception
GPL-with-GCC-exception|93|gcc runtime library exception|gcc runtime library exception
GPL-with-autoconf|93|autoconf exception,configuration script generated by autoconf|configuration script generated by autoconf
Linux-syscall-note|93|syscall|linux[- ]syscall[- ]note
LGPL-2.1-or-later|92|either version 2.1|gnu lesser general public license as published by the free software foundation[;,] either version 2\.1(?: of the license)?,? or \(?at your option\)? any later version
LGPL-3.0-or-later|92|either version 3|gnu lesser general public license as published by the free software foundation[;,] either version 3(?: of the license)?,? or \(?at your option\)? any later version
LGPL-3.0|82|lesser general public license|(?:gnu )?lesser general public license,? (?:version |v\.? ?)3(?:\.0)?
LGPL-2.1|82|lesser general public license|(?:gnu )?lesser general public license,? (?:version |v\.? ?)2\.1
LGPL-2.0|82|library general public license|(?:gnu )?library general public license,? (?:version |v\.? ?)2(?:\.0)?
LGPL|52|lesser general public license,library general public license|(?:gnu )?(?:lesser|library) general public license
LGPL-3.0|56|lgplv3,lgpl-3,lgpl v3|\blgpl[- ]?v?3(?:\.0)?\b\+?
LGPL-2.1|56|lgplv2.1,lgpl-2.1,lgpl v2.1|\blgpl[- ]?v?2\.1\b\+?
AGPL-3.0-or-later|92|affero general public license|gnu affero general public license as published by the free software foundation[;,] either version 3
AGPL-3.0|82|affero general public license|(?:gnu )?affero general public license,? (?:version |v\.? ?)3(?:\.0)?
AGPL|52|affero general public license|(?:gnu )?affero general public license
AGPL-3.0|56|agplv3,agpl-3,agpl v3|\bagpl[- ]?v?3(?:\.0)?\b\+?
AGPL-1.0|82|affero general public license|affero general public license,? (?:version |v)1
GFDL-1.3|82|free documentation license|gnu free documentation license,? (?:version |v)1\.3
GFDL-1.2|82|free documentation license|gnu free documentation license,? (?:version |v)1\.2
GFDL-1.1|82|free documentation license|gnu free documentation license,? (?:version |v)1\.1
GFDL|52|free documentation license|(?:gnu )?free documentation license
GFDL-invariants|84|invariant sections|with (?:no|the) invariant sections[^.]{0,120}
FSFAP|85|copying and distribution of this file|copying and distribution of this file, with or without modification, are permitted in any medium without royalty
FSFUL|85|unlimited permission to copy|gives unlimited permission to copy and/or distribute it, with or without modifications
MPL-2.0|90|mozilla public license|subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0
MPL-1.1|90|mozilla public license|subject to the mozilla public license version 1\.1
MPL-2.0|80|mozilla public license|mozilla public license,? (?:version |v\.? ?)2(?:\.0)?
MPL-1.1|80|mozilla public license|mozilla public license,? (?:version |v\.? ?)1\.1
MPL-1.0|80|mozilla public license|mozilla public license,? (?:version |v\.? ?)1\.0
MPL|50|mozilla public license|mozilla public license
MPL-2.0|55|mplv2,mpl-2,mpl 2|\bmpl[- ]?v?2(?:\.0)?\b
MPL-2.0-no-copyleft|91|incompatible with secondary licenses|this source code form is ["“]?incompatible with secondary licenses
EPL-2.0|80|eclipse public license|eclipse public license,? (?:- )?(?:version |v\.? ?)?2\.0
EPL-1.0|80|eclipse public license|eclipse public license,? (?:- )?(?:version |v\.? ?)?1\.0
EPL|50|eclipse public license|eclipse public license
EDL-1.0|80|eclipse distribution license|eclipse distribution license(?:,? (?:- )?(?:version |v\.? ?)?1\.0)?
CDDL-1.1|80|common development and distribution license|common development and distribution license(?: \(cddl\))?,? (?:version |v\.? ?)1\.1
CDDL-1.0|80|common development and distribution license|common development and distribution license(?: \(cddl\))?,? (?:version |v\.? ?)1\.0
CDDL|50|common development and distribution license|common development and distribution license
CPL-1.0|80|common public license|common public license(?:,? (?:version |v\.? ?)1\.0)?
CPAL-1.0|80|common public attribution license|common public attribution license(?:,? (?:version |v\.? ?)1\.0)?
IPL-1.0|80|ibm public license|ibm public license(?:,? (?:version |v\.? ?)1\.0)?
EUPL-1.2|80|european union public licen|european union public licen[cs]e,? (?:version |v\.? ?)1\.2
EUPL-1.1|80|european union public licen|european union public licen[cs]e,? (?:version |v\.? ?)1\.1
EUPL|50|european union public licen|european union public licen[cs]e
BSL-1.0|90|boost software license|distributed under the boost software license,? version 1\.0
BSL-1.0|80|boost software license|boost software license(?:[ ,-]*(?:version |v\.? ?)1\.0)?
Zlib|90|altered source versions|altered source versions must be plainly marked as such, and must not be misrepresented
Zlib|88|express or implied warranty|this software is provided ["'“]?as-is["'”]?, without any express or implied warranty
Zlib|60|zlib licen,zlib/libpng|\bzlib(?:/libpng)? licen[cs]e
Libpng|80|png reference library,libpng license|(?:png reference library license|libpng license)(?: version 2)?
IJG|80|independent jpeg group|this software is based in part on the work of the independent jpeg group
OpenSSL|85|openssl project|this product includes software developed by the openssl project
OpenSSL|60|openssl licen|openssl licen[cs]e
SSLeay|85|eric young|this product includes cryptographic software written by eric young
curl|80|curl licen|\bcurl licen[cs]e
NTP|85|ntp licen|\bntp licen[cs]e
Info-ZIP|80|info-zip|info-zip licen[cs]e|this is version [0-9-]{4,12} of the info-zip
bzip2|80|bzip2|bzip2(?: and libbzip2)? licen[cs]e
libtiff|85|sam leffler|the names of sam leffler and silicon graphics may not be used
Unicode-DFS-2016|85|unicode data files|permission is hereby granted[^.]{0,120}unicode data files
Unicode-TOU|70|unicode terms of use,unicode, inc. license|unicode,? (?:inc\. )?(?:terms of use|license agreement)
ICU|80|icu licen|\bicu licen[cs]e
W3C|85|w3c software|w3c software(?: and document)? (?:notice and )?licen[cs]e
W3C-19980720|70|w3c ipr software|w3c ipr software notice
Python-2.0|85|python software foundation licen|python software foundation licen[cs]e(?: agreement)?(?:,? version 2)?
CNRI-Python|80|cnri|cnri (?:open source )?(?:gpl-compatible )?licen[cs]e agreement
PHP-3.01|85|php licen|\bphp licen[cs]e,? (?:version |v)3\.01
PHP-3.0|80|php licen|\bphp licen[cs]e(?:,? (?:version |v)3\.0)?\b
Ruby|70|ruby licen,ruby's licen|\bruby(?:'s)? licen[cs]e
Artistic-2.0|80|artistic licen|artistic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
Artistic-1.0|80|artistic licen|artistic licen[cs]e,? (?:version |v\.? ?)?1(?:\.0)?
Artistic|50|artistic licen|artistic licen[cs]e
Perl-same-terms|75|perl itself|(?:under )?the same terms as perl(?: 5)? itself
Vim|70|vim licen|\bvim licen[cs]e
TCL|85|tcl licen,regents of the university of california, sun microsystems|\btcl(?:/tk)? licen[cs]e
PostgreSQL|85|postgresql licen,postgresql global development group|postgresql licen[cs]e
SQLite-blessing|90|in place of a legal notice,may you do good|may you do good and not evil
SISSL|75|sun industry standards source licen|sun industry standards source licen[cs]e
QPL-1.0|80|q public licen|\bq public licen[cs]e(?:,? (?:version |v)1\.0)?
OSL-3.0|80|open software licen|open software licen[cs]e(?:,? (?:version |v\.? ?)3\.0)?
AFL-3.0|80|academic free licen|academic free licen[cs]e(?:,? (?:version |v\.? ?)3\.0)?
NPOSL-3.0|82|non-profit open software licen|non-profit open software licen[cs]e(?: 3\.0)?
ECL-2.0|80|educational community licen|educational community licen[cs]e(?:,? (?:version |v\.? ?)2\.0)?
NCSA|80|university of illinois/ncsa|university of illinois/ncsa open source licen[cs]e
MS-PL|80|microsoft public licen,ms-pl|microsoft public licen[cs]e(?: \(ms-pl\))?|\bms-pl\b
MS-RL|80|microsoft reciprocal licen,ms-rl|microsoft reciprocal licen[cs]e(?: \(ms-rl\))?|\bms-rl\b
APSL-2.0|80|apple public source licen|apple public source licen[cs]e(?:,? (?:version |v\.? ?)2(?:\.0)?)?
RPL-1.5|80|reciprocal public licen|reciprocal public licen[cs]e(?:,? (?:version |v\.? ?)?1\.5)?
SPL-1.0|75|sun public licen|sun public licen[cs]e(?:,? (?:version |v)1\.0)?
NPL-1.1|75|netscape public licen|netscape public licen[cs]e(?:,? (?:version |v)1\.[01])?
Nokia|75|nokia open source licen|nokia open source licen[cs]e
Intel|75|intel open source licen|intel open source licen[cs]e
NASA-1.3|80|nasa open source agreement|nasa open source agreement(?:,? version 1\.3)?
LPPL-1.3c|80|latex project public licen|latex project public licen[cs]e(?:,? (?:version |v\.? ?)?1\.3c?)?
SIL-OFL-1.1|85|sil open font licen|sil open font licen[cs]e(?:,? (?:version |v\.? ?)1\.1)?
SIL-OFL-1.1|84|reserved font name|with reserved font names? 
Ubuntu-font-1.0|80|ubuntu font licen|ubuntu font licen[cs]e(?: version 1\.0)?
Bitstream-Vera|80|bitstream vera|bitstream vera(?: is a trademark| fonts? copyright)
Beerware|85|beer-ware,beerware|(?:the )?beer-?ware licen[cs]e
WTFPL|85|do what the fuck,wtfpl|do what the fuck you want to public licen[cs]e|\bwtfpl\b
Unlicense|90|released into the public domain|this is free and unencumbered software released into the public domain
Unlicense|70|unlicense.org,the unlicense|https?://unlicense\.org/?|\bthe unlicense\b
CC0-1.0|90|cc0|licensed under cc0(?: 1\.0)?(?: universal)?
CC0-1.0|85|cc0,creative commons zero|(?:creative commons )?(?:cc0|zero)(?: v?1\.0)? universal
CC0-1.0|60|cc0|\bcc0(?:[- ]1\.0)?\b
CC0-1.0|85|publicdomain/zero|creativecommons\.org/publicdomain/zero/1\.0
PDDL-1.0|80|public domain dedication|(?:open data commons )?public domain dedication and licen[cs]e
Public-Domain-Mark|80|publicdomain/mark|creativecommons\.org/publicdomain/mark/1\.0
CC-BY-NC-ND-4.0|94|cc by-nc-nd,cc-by-nc-nd|\bcc[- ]by-nc-nd(?:[- ]4\.0)?\b
CC-BY-NC-SA-4.0|94|cc by-nc-sa,cc-by-nc-sa|\bcc[- ]by-nc-sa[- ]4\.0\b
CC-BY-NC-SA|93|cc by-nc-sa,cc-by-nc-sa|\bcc[- ]by-nc-sa(?:[- ][123]\.[05])?\b
CC-BY-NC-4.0|93|cc by-nc,cc-by-nc|(?:licensed under )?\bcc[- ]by-nc[- ]4\.0\b
CC-BY-NC-3.0|93|cc by-nc,cc-by-nc|(?:licensed under )?\bcc[- ]by-nc[- ]3\.0\b
CC-BY-NC|92|cc by-nc,cc-by-nc|\bcc[- ]by-nc(?:[- ][12]\.[05])?\b(?!-)
CC-BY-ND-4.0|93|cc by-nd,cc-by-nd|\bcc[- ]by-nd(?:[- ]4\.0)?\b
CC-BY-SA-4.0|93|cc by-sa,cc-by-sa|(?:licensed under )?\bcc[- ]by-sa[- ]4\.0\b
CC-BY-SA-3.0|93|cc by-sa,cc-by-sa|(?:licensed under )?\bcc[- ]by-sa[- ]3\.0\b
CC-BY-SA|92|cc by-sa,cc-by-sa|\bcc[- ]by-sa(?:[- ][12]\.[05])?\b
CC-BY-4.0|92|cc by,cc-by|(?:licensed under )?\bcc[- ]by[- ]4\.0\b
CC-BY-3.0|92|cc by,cc-by|(?:licensed under )?\bcc[- ]by[- ]3\.0\b
CC-BY|88|cc by,cc-by|\bcc[- ]by\b(?!-)
CC-BY-NC-ND|94|noncommercial,non-commercial|creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?: works)?(?: (?:[1-4]\.[05]))?(?: international)?(?: licen[cs]e)?
CC-BY-NC-SA|94|noncommercial,non-commercial|creative commons attribution[- ]non-?commercial[- ]share-?alike(?: (?:[1-4]\.[05]))?(?: international)?(?: licen[cs]e)?
CC-BY-NC|90|noncommercial,non-commercial|creative commons attribution[- ]non-?commercial(?: (?:[1-4]\.[05]))?(?: international)?(?: licen[cs]e)?
CC-BY-ND|90|creative commons|creative commons attribution[- ]no-?deriv(?:ative)?s?(?: works)?(?: (?:[1-4]\.[05]))?(?: international)?(?: licen[cs]e)?
CC-BY-SA|90|creative commons|creative commons attribution[- ]share-?alike(?: (?:[1-4]\.[05]))?(?: international| unported)?(?: licen[cs]e)?
CC-BY|85|creative commons|creative commons attribution(?: (?:[1-4]\.[05]))?(?: international| unported)?(?: licen[cs]e)?
CC-BY-NC-ND|95|creativecommons.org/licenses|creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
CC-BY-NC-SA|95|creativecommons.org/licenses|creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
CC-BY-NC|95|creativecommons.org/licenses|creativecommons\.org/licenses/by-nc/[1-4]\.[05]
CC-BY-ND|95|creativecommons.org/licenses|creativecommons\.org/licenses/by-nd/[1-4]\.[05]
CC-BY-SA|95|creativecommons.org/licenses|creativecommons\.org/licenses/by-sa/[1-4]\.[05]
CC-BY|95|creativecommons.org/licenses|creativecommons\.org/licenses/by/[1-4]\.[05]
CC|40|creative commons|creative commons(?: licen[cs]e)?
ODbL-1.0|80|open database licen,odbl|(?:open data commons )?open database licen[cs]e(?: \(odbl\))?(?: v?1\.0)?|\bodbl\b
ODC-By-1.0|80|open data commons attribution|open data commons attribution licen[cs]e(?: v?1\.0)?
OGL-UK-3.0|80|open government licen|open government licen[cs]e(?:,? (?:version |v)?3\.0)?
CDLA-Permissive-2.0|80|community data license agreement|community data license agreement[ –-]+permissive(?:[, -]+(?:version )?[12]\.0)?
CDLA-Sharing-1.0|80|community data license agreement|community data license agreement[ –-]+sharing(?:[, -]+(?:version )?1\.0)?
Etalab-2.0|75|etalab,licence ouverte|licence ouverte(?:[ /]open licence)?(?: 2\.0)?
CeCILL-2.1|80|cecill|\bcecill(?:[- ](?:v|version )?2\.1)\b
CeCILL-B|80|cecill-b|\bcecill-b\b
CeCILL-C|80|cecill-c|\bcecill-c\b
CeCILL|50|cecill|\bcecill\b
MulanPSL-2.0|80|mulan psl,mulan permissive|mulan (?:psl|permissive software license),? v?(?:ersion )?2
SSPL-1.0|80|server side public license,sspl|server side public license(?:,? (?:version |v)1)?|\bsspl\b
BUSL-1.1|80|business source license,busl|business source license(?: 1\.1)?|\bbusl-1\.1\b
Elastic-2.0|80|elastic license|elastic license(?:,? (?:version |v)?2\.0)?
Commons-Clause|85|commons clause|["“]?commons clause["”]? license condition(?: v1\.0)?
PolyForm-NC-1.0.0|80|polyform|polyform noncommercial license(?: 1\.0\.0)?
PolyForm-SB-1.0.0|80|polyform|polyform small business license(?: 1\.0\.0)?
RAIL-M|80|rail-m,openrail|(?:bigscience |creativeml )?open ?rail(?:\+\+)?(?:-m)?(?: licen[cs]e)?
LLAMA-Community|80|community license agreement|llama [0-9.]+ community license agreement
JSON|90|not evil|the software shall be used for good, not evil
Hippocratic-2.1|80|hippocratic licen|hippocratic licen[cs]e(?:,? (?:version |v)?[23]\.[01])?
MIT|80|mit licen,mit licence|released under the mit licen[cs]e
MIT|80|mit licen,mit licence|(?:licensed|available|distributed) under (?:the )?(?:terms of the )?mit licen[cs]e
MIT|60|mit licen,mit licence,expat licen|\b(?:mit|expat)(?:/x11)? licen[cs]e
MIT|55|opensource.org/licenses/mit|opensource\.org/licenses/mit
X11|60|x11 licen|\bx11 licen[cs]e
BSD-2-Clause|80|2-clause,two-clause,simplified bsd,freebsd licen|(?:2-clause|two-clause|simplified|freebsd) (?:bsd )?licen[cs]e|(?:new |simplified )?bsd 2-clause(?: licen[cs]e)?
BSD-3-Clause|80|3-clause,three-clause,new bsd,modified bsd|(?:3-clause|three-clause|new|revised|modified) bsd licen[cs]e|bsd 3-clause(?: licen[cs]e)?
BSD-4-Clause|80|4-clause,original bsd|(?:4-clause|four-clause|original) bsd licen[cs]e
BSD|50|bsd licen,bsd licence,bsd-style|\bbsd(?:-style| style)? licen[cs]e
ISC|60|isc licen,isc licence|\bisc licen[cs]e
dual-license|65|dual-licensed,dual licensed|dual[- ]licensed under [^.\n]{3,120}
proprietary|70|proprietary and confidential|proprietary and confidential
proprietary|65|unauthorized copying|unauthorized copying of this (?:file|software)[^.\n]{0,80}strictly prohibited
proprietary|60|all rights reserved|copyright (?:\(c\)|©)? ?[0-9]{4}[^\n]{0,80}?all rights reserved
all-rights-reserved|15|all rights reserved|all rights reserved
trade-secret|65|trade secret|contains? (?:confidential|proprietary) (?:information|material)s?[^.\n]{0,60}trade secrets?
public-domain|60|public domain|(?:released|placed|dedicated) (?:in)?to the public domain
public-domain|30|public domain|\bin the public domain\b
free-use|40|free for non-commercial use,free for personal use|free for (?:non-?commercial|personal) use(?: only)?
noncommercial-notice|35|not for commercial use,commercial use prohibited|not for commercial use|commercial use (?:is )?prohibited
eula|50|end user licen,end-user licen|end[- ]user licen[cs]e agreement
generic-license-file|20|licen,licence file|see (?:the )?licen[cs]e file (?:in|for|at)[^.\n]{0,60}
generic-licensed-under|10|licensed under|licensed under (?:the )?[^.\n]{3,80}
generic-licensed-under|10|released under|released under (?:the )?[^.\n]{3,60}? licen[cs]e
copyright-notice|12|copyright,©|(?:copyright|©)(?: \(c\)| ©)? [0-9]{4}(?:[-–, ]+[0-9]{4})*(?: by)? [^\n]{2,80}
"""
