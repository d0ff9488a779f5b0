"""Licence signatures in order: label | priority | keyword | pattern over lower-case words parted by one space.

A keyword is the beginning of a word that any match holds; priority 3: a licence's own sentences, 2: its full name
with a version, 1: a name, 0: a hint. Among equal priorities the longer match, then the earlier rule, wins.
"""

RULES = r"""
apache-2.0|3|apache|licensed under the apache license version 2 0
apache-2.0|3|apache|you may not use this file except in compliance with the license(?: \S+){0,12} apache \S+ licenses license 2 0
apache-2.0|3|apache|http www apache org licenses license 2 0(?: txt| html)?
apache-2.0|2|apache|apache (?:software )?licen[sc]e(?: version)? v?2(?: 0)?
apache-2.0|2|apache|apache 2 0(?: licen[sc]e)?
apache-2.0|2|asl|asl 2 0
apache-1.1|2|apache|apache (?:software )?licen[sc]e(?: version)? 1 1
apache-1.0|2|apache|apache (?:software )?licen[sc]e(?: version)? 1 0
apache|1|apache|apache (?:software )?licen[sc]e
mit|3|permission|permission is hereby granted free of charge to any person obtaining a copy
mit|3|noninfring|merchantability fitness for a particular purpose and noninfringement
mit|3|licen|released under the (?:terms of the )?mit licen[sc]e
mit|3|licen|(?:licensed|distributed|available|published) under the (?:terms of the )?mit licen[sc]e
mit|2|licen|the mit licen[sc]e(?: mit)?
mit|1|licen|mit licen[sc]ed?
mit|1|licen|licen[sc]e mit
mit|1|expat|expat licen[sc]e
mit-0|2|attribution|mit no attribution(?: licen[sc]e)?
x11|2|x11|x11 licen[sc]e
isc|3|permission|permission to use copy modify and or distribute this software for any purpose with or without fee
isc|1|isc|isc licen[sc]e
0bsd|2|0bsd|0bsd(?: licen[sc]e)?
0bsd|2|clause|zero clause bsd(?: licen[sc]e)?
bsd|3|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|3|redistribution|redistributions of source code must retain the above copyright notice
bsd|3|redistribution|redistributions in binary form must reproduce the above copyright notice
bsd-3-clause|3|endorse|(?:may|must not) be used to endorse or promote products derived from this software
bsd-4-clause|3|advertis|all advertising materials mentioning features or use of this software
bsd-2-clause|2|clause|bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause|2|clause|(?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause|2|simplified|simplified bsd licen[sc]e
bsd-2-clause|2|freebsd|freebsd licen[sc]e
bsd-3-clause|2|clause|bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause|2|clause|(?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause|2|revised|(?:new|revised|modified)(?: or revised)? bsd licen[sc]e
bsd-3-clause|2|bsd|new bsd licen[sc]e
bsd-4-clause|2|clause|bsd (?:4|four) clause(?: licen[sc]e)?
bsd-4-clause|2|bsd|(?:original|old) bsd licen[sc]e
bsd|1|bsd|bsd(?: style| type)? licen[sc]ed?
gpl-3.0|3|licen|this work is licensed under the gnu general public licen[sc]e version 3
gpl-3.0|3|general|gnu general public licen[sc]e as published by the free software foundation either version 3
gpl-2.0|3|general|gnu general public licen[sc]e as published by the free software foundation either version 2
gpl|3|redistribut|you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl|3|general|you should have received a copy of the gnu general public licen[sc]e
gpl-3.0|2|general|(?:gnu )?general public licen[sc]e(?: gpl)?(?: version)? v?3(?: 0)?(?: or(?: \S+)? later)?
gpl-2.0|2|general|(?:gnu )?general public licen[sc]e(?: gpl)?(?: version)? v?2(?: 0)?(?: or(?: \S+)? later)?
gpl-1.0|2|general|(?:gnu )?general public licen[sc]e(?: version)? v?1(?: 0)?
gpl-3.0|2|gpl|(?:gnu )?gpl(?: version)? v?3(?: 0)?(?: only| or later)?
gpl-2.0|2|gpl|(?:gnu )?gpl(?: version)? v?2(?: 0)?(?: only| or later)?
gpl-3.0|2|gplv3|gplv3(?: only| or later)?
gpl-2.0|2|gplv2|gplv2(?: only| or later)?
gpl-classpath|3|classpath|(?:with )?the classpath exception
gpl-classpath|3|linking|linking this library statically or dynamically with other modules
gcc-exception|3|runtime|gcc runtime library exception
gpl|1|general|gnu general public licen[sc]e
gpl|1|gpl|gnu gpl
lgpl-3.0|2|lesser|(?:gnu )?lesser general public licen[sc]e(?: version)? v?3(?: 0)?
lgpl-2.1|2|lesser|(?:gnu )?lesser general public licen[sc]e(?: version)? v?2 1
lgpl-2.0|2|library|(?:gnu )?library general public licen[sc]e(?: version)? v?2(?: 0)?
lgpl-3.0|2|lgpl|(?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgpl-2.1|2|lgpl|(?:gnu )?lgpl(?: version)? v?2 1
lgpl|1|lesser|(?:gnu )?lesser general public licen[sc]e
lgpl|1|library|(?:gnu )?library general public licen[sc]e
lgpl|1|lgpl|(?:gnu )?lgpl
agpl-3.0|2|affero|(?:gnu )?affero general public licen[sc]e(?: version)? v?3(?: 0)?
agpl-3.0|2|agpl|(?:gnu )?agpl(?: version)? v?3(?: 0)?
agpl-3.0|2|agplv3|agplv3
agpl|1|affero|(?:gnu )?affero general public licen[sc]e
agpl|1|agpl|(?:gnu )?agpl
gfdl-1.3|2|documentation|(?:gnu )?free documentation licen[sc]e(?: version)? 1 3
gfdl-1.2|2|documentation|(?:gnu )?free documentation licen[sc]e(?: version)? 1 2
gfdl-1.1|2|documentation|(?:gnu )?free documentation licen[sc]e(?: version)? 1 1
gfdl|1|documentation|(?:gnu )?free documentation licen[sc]e
gfdl|1|gfdl|gfdl
mpl-2.0|3|mozilla|this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1|3|mozilla|the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0|2|mozilla|mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-1.1|2|mozilla|mozilla public licen[sc]e(?: version| v)? 1 1
mpl-1.0|2|mozilla|mozilla public licen[sc]e(?: version| v)? 1 0
mpl|1|mozilla|mozilla public licen[sc]e
mpl-2.0|2|mpl|mpl 2 0
epl-2.0|2|eclipse|eclipse public licen[sc]e(?: version| v)? 2(?: 0)?
epl-1.0|2|eclipse|eclipse public licen[sc]e(?: version| v)? 1(?: 0)?
epl|1|eclipse|eclipse public licen[sc]e
edl-1.0|2|eclipse|eclipse distribution licen[sc]e(?: v)? 1 0
cddl-1.1|2|cddl|(?:common development and distribution licen[sc]e )?cddl(?: version)? 1 1
cddl-1.0|2|cddl|(?:common development and distribution licen[sc]e )?cddl(?: version)? 1 0
cddl|1|development|common development and distribution licen[sc]e
cpl-1.0|2|common|common public licen[sc]e(?: version)? 1 0
cpl|1|common|common public licen[sc]e
ipl-1.0|2|ibm|ibm public licen[sc]e(?: version)? 1 0
cpal-1.0|2|common|common public attribution licen[sc]e(?: version)? 1 0
apsl-2.0|2|apple|apple public source licen[sc]e(?: version)? 2 0
apsl|1|apple|apple public source licen[sc]e
artistic-2.0|2|artistic|artistic licen[sc]e(?: version)? 2 0
artistic-1.0|2|artistic|artistic licen[sc]e(?: version)? 1 0
artistic|1|artistic|artistic licen[sc]e
perl|1|perl|same terms as perl(?: itself)?
psf-2.0|2|python|python software foundation licen[sc]e(?: version)? 2
psf|1|python|python software foundation licen[sc]e
python-2.0|2|python|python licen[sc]e(?: version)? 2 0
php-3.01|2|php|php licen[sc]e(?: version)? 3 01
php|1|php|php licen[sc]e
ruby|1|ruby|ruby licen[sc]e
bsl-1.0|3|boost|distributed under the boost software licen[sc]e version 1 0
bsl-1.0|2|boost|boost software licen[sc]e(?: version)? 1 0
bsl-1.0|1|boost|boost software licen[sc]e
zlib|3|altered|altered source versions must be plainly marked as such
zlib|3|warranty|this software is provided as is without any express or implied warranty
zlib|2|libpng|zlib libpng licen[sc]e
zlib|1|zlib|zlib licen[sc]e
libpng|1|libpng|libpng licen[sc]e
unlicense|3|unencumbered|this is free and unencumbered software released into the public domain
unlicense|2|unlicen|the unlicen[sc]e
unlicense|1|unlicen|unlicen[sc]e
wtfpl|3|fuck|do what the fuck you want to public licen[sc]e
wtfpl|1|wtfpl|wtfpl
beerware|3|beer|the beer ware licen[sc]e
beerware|1|beerware|beerware
jslint|3|evil|the software shall be used for good not evil
curl|1|curl|curl licen[sc]e
openssl|3|openssl|this product includes software developed by the openssl project
openssl|1|openssl|openssl licen[sc]e
ssleay|1|ssleay|ssleay licen[sc]e
ntp|1|ntp|ntp licen[sc]e
ncsa|2|ncsa|university of illinois ncsa open source licen[sc]e
ncsa|1|ncsa|ncsa(?: open source)? licen[sc]e
upl-1.0|2|universal|universal permissive licen[sc]e(?: version| v)? 1 0
upl-1.0|1|universal|universal permissive licen[sc]e
ms-pl|2|microsoft|microsoft public licen[sc]e(?: ms pl)?
ms-rl|2|reciprocal|microsoft reciprocal licen[sc]e(?: ms rl)?
osl-3.0|2|open|open software licen[sc]e(?: version| v)? 3 0
osl|1|open|open software licen[sc]e
afl-3.0|2|academic|academic free licen[sc]e(?: version| v)? 3 0
afl-2.1|2|academic|academic free licen[sc]e(?: version| v)? 2 1
afl|1|academic|academic free licen[sc]e
eupl-1.2|2|european|european union public licen[sc]e(?: version| v)? 1 2
eupl-1.1|2|european|european union public licen[sc]e(?: version| v)? 1 1
eupl|1|european|european union public licen[sc]e
eupl|1|eupl|eupl
cecill-2.1|2|cecill|cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version| v)? 2 1
cecill-b|2|cecill|cecill b(?: licen[sc]e)?
cecill-c|2|cecill|cecill c(?: licen[sc]e)?
cecill|1|cecill|cecill
etalab-2.0|2|ouverte|licence ouverte(?: open licence)?(?: version)? 2 0
etalab|1|ouverte|licence ouverte
ogl-uk-3.0|2|government|open government licen[sc]e(?: version| v)? ?3(?: 0)?
ogl-uk-2.0|2|government|open government licen[sc]e(?: version| v)? ?2(?: 0)?
ogl-uk|1|government|open government licen[sc]e
odbl-1.0|2|database|open (?:data commons open )?database licen[sc]e(?: odbl)?(?: version| v)? 1 0
odbl|1|database|open database licen[sc]e
odc-by-1.0|2|attribution|open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?
pddl-1.0|2|dedication|public domain dedication and licen[sc]e(?: pddl)?(?: version| v)?(?: 1 0)?
cdla-permissive-2.0|2|community|community data licen[sc]e agreement permissive(?: version)? 2 0
cdla-permissive-1.0|2|community|community data licen[sc]e agreement permissive(?: version)?(?: 1 0)?
cdla-sharing-1.0|2|community|community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
ofl-1.1|3|font|this font software is licensed under the sil open font licen[sc]e version 1 1
ofl-1.1|2|font|(?:sil )?open font licen[sc]e(?: version)? 1 1
ofl|1|font|(?:sil )?open font licen[sc]e
lppl-1.3c|2|latex|latex project public licen[sc]e(?: version| v)? 1 3c
lppl|1|latex|latex project public licen[sc]e
vim|1|vim|vim licen[sc]e
tcl|1|tcl|tcl tk licen[sc]e
w3c|2|w3c|w3c software(?: notice and)? licen[sc]e
w3c|1|w3c|w3c licen[sc]e
unicode|2|unicode|unicode licen[sc]e agreement(?: for)? data files and software
unicode|1|unicode|unicode licen[sc]e
postgresql|1|postgresql|postgresql licen[sc]e
sleepycat|1|sleepycat|sleepycat licen[sc]e
qpl-1.0|2|public|q public licen[sc]e(?: version)?(?: 1 0)?
zpl-2.1|2|zope|zope public licen[sc]e(?: version| v)? 2 1
zpl|1|zope|zope public licen[sc]e
spl-1.0|2|sun|sun public licen[sc]e(?: version)?(?: 1 0)?
nasa-1.3|2|nasa|nasa open source agreement(?: version)? 1 3
ecl-2.0|2|educational|educational community licen[sc]e(?: version)? 2 0
ecl|1|educational|educational community licen[sc]e
mulan-2.0|2|mulan|mulan (?:psl|permissive software licen[sc]e) ?v2
mulan|1|mulan|mulan (?:psl|permissive software licen[sc]e)
blueoak-1.0.0|2|blue|blue oak model licen[sc]e(?: 1 0 0)?
hippocratic|2|hippocratic|hippocratic licen[sc]e(?: version)?(?: \S+ \S+)?
sspl-1.0|2|server|server side public licen[sc]e(?: version| v)?(?: 1)?
busl-1.1|2|business|business source licen[sc]e(?: version)? 1 1
busl|1|business|business source licen[sc]e
elastic-2.0|2|elastic|elastic licen[sc]e(?: version)? 2 0
elastic|1|elastic|elastic licen[sc]e
commons-clause|2|commons|commons clause(?: licen[sc]e)?(?: condition)?
polyform-nc|2|polyform|polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform|1|polyform|polyform \S+(?: \S+)? licen[sc]e
rail|2|rail|(?:creativeml )?open ?rail(?: m| s| \S+)? licen[sc]e
rail|2|openrail|(?:creativeml )?openrail(?: m| s| \S+)? licen[sc]e
bigscience-rail|2|bigscience|bigscience rail licen[sc]e(?: v1 0)?
cc0-1.0|3|dedicat|has dedicated the work to the public domain by waiving all
cc0-1.0|2|cc0|cc0(?: 1 0)?(?: universal)?
cc0-1.0|2|commons|creative commons zero(?: v)?(?: 1 0)?(?: universal)?
cc-pdm|2|domain|public domain mark(?: 1 0)?
cc-by-nc-nd-4.0|2|cc|cc by nc nd(?: 4 0)?
cc-by-nc-nd-3.0|2|cc|cc by nc nd 3 0
cc-by-nc-sa-4.0|2|cc|cc by nc sa(?: 4 0)?
cc-by-nc-sa-3.0|2|cc|cc by nc sa 3 0
cc-by-nc-4.0|3|licen|licensed under cc by nc 4 0
cc-by-nc-4.0|2|cc|cc by nc(?: 4 0)?
cc-by-nc-3.0|2|cc|cc by nc 3 0
cc-by-nd-4.0|2|cc|cc by nd(?: 4 0)?
cc-by-nd-3.0|2|cc|cc by nd 3 0
cc-by-sa-4.0|3|licen|licensed under cc by sa 4 0
cc-by-sa-4.0|2|cc|cc by sa(?: 4 0)?
cc-by-sa-3.0|2|cc|cc by sa 3 0
cc-by-sa-2.5|2|cc|cc by sa 2 5
cc-by-4.0|3|licen|licensed under cc by 4 0
cc-by-4.0|2|cc|cc by 4 0
cc-by-3.0|2|cc|cc by 3 0
cc-by-2.5|2|cc|cc by 2 5
cc-by-nc-nd|2|attribution|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: \S+ \S+)? licen[sc]e
cc-by-nc-sa|2|attribution|creative commons attribution non ?commercial share ?alike(?: \S+ \S+)? licen[sc]e
cc-by-nc|2|attribution|creative commons attribution non ?commercial(?: \S+ \S+)? licen[sc]e
cc-by-nd|2|attribution|creative commons attribution no ?deriv(?:s|atives|ative works)?(?: \S+ \S+)? licen[sc]e
cc-by-sa|2|attribution|creative commons attribution share ?alike(?: \S+ \S+)? licen[sc]e
cc-by|2|attribution|creative commons attribution(?: \S+ \S+)? licen[sc]e
cc-by-nc-sa|3|creativecommons|creativecommons org licenses by nc sa \S+ \S+
cc-by-nc-nd|3|creativecommons|creativecommons org licenses by nc nd \S+ \S+
cc-by-nc|3|creativecommons|creativecommons org licenses by nc \S+ \S+
cc-by-sa|3|creativecommons|creativecommons org licenses by sa \S+ \S+
cc-by-nd|3|creativecommons|creativecommons org licenses by nd \S+ \S+
cc-by|3|creativecommons|creativecommons org licenses by \S+ \S+
cc0-1.0|3|creativecommons|creativecommons org publicdomain zero 1 0
creative-commons|1|commons|(?:a )?creative commons licen[sc]e
public-domain|2|domain|(?:released|placed|dedicated)(?: in)? to the public domain
public-domain|2|domain|(?:is|are) in the public domain
proprietary|2|proprietary|proprietary and confidential
proprietary|1|unauthori|unauthori[sz]ed copying of this file(?: \S+){0,4} is strictly prohibited
proprietary|1|reserved|no rights? \S+ granted all rights reserved
copyright|0|copyright|copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright|0|copyrighted|copyrighted material
""".strip()


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in order."""
    return [(a, int(b), c, d) for a, b, c, d in (line.split("|", 3) for line in RULES.splitlines())]


#: Phrases that are counted place by place and whose labels no other detection takes away.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
