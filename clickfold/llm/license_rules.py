"""Signature rules for licences, as regular expressions over folded words joined by single blanks.

Fixed values: phrases and names by which licences are known. A line is (label, gate words, pattern);
order is priority. ``{v}`` stands for the versions listed with it, written as words ("2 0"). Every
match of a pattern holds a gate word as a whole word; spellings glued to a version ("gplv3") are listed.
"""

from __future__ import annotations

#: Phrases whose places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_V = r"(?:v(?:ersion)? ?)?"
_THE = r"(?:the )?"
_LIC = r"(?:public )?licen[cs]e"


def _glued(name: str, *majors: str) -> tuple[str, ...]:
    """The words a name makes alone and with "v", "version" and a first version number glued to it."""
    return tuple(name + v + n for v in ("", "v", "version") for n in ("", *majors))


# label, gate words (any of them must occur), pattern, versions
_VERSIONED = (
    ("agpl-{l}", ("affero", "agpl"), _THE + r"(?:gnu )?affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?" + _V + "{v}", ("1 0", "3 0", "3")),
    ("agpl-{l}", _glued("agpl", "1", "3"), r"agpl ?" + _V + "{v}", ("1 0", "3 0", "3")),
    ("lgpl-{l}", ("lesser", "library"), _THE + r"(?:gnu )?(?:lesser|library) general public licen[cs]e (?:as published by the free software foundation )?(?:either )?" + _V + "{v}", ("2 0", "2 1", "3 0", "2", "3")),
    ("lgpl-{l}", _glued("lgpl", "2", "3"), r"lgpl ?" + _V + "{v}", ("2 0", "2 1", "3 0", "2", "3")),
    ("gfdl-{l}", ("documentation",), _THE + r"(?:gnu )?free documentation licen[cs]e " + _V + "{v}", ("1 1", "1 2", "1 3")),
    ("gpl-{l}", ("general",), _THE + r"(?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?" + _V + "{v}", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl-{l}", _glued("gpl", "1", "2", "3"), r"(?:gnu )?gpl ?" + _V + "{v}", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("apache-{l}", ("apache",), _THE + r"apache (?:software )?licen[cs]e " + _V + "{v}", ("1 0", "1 1", "2 0", "2")),
    ("apache-{l}", ("apache",), r"apache " + _V + "{v}", ("1 0", "1 1", "2 0")),
    ("mpl-{l}", ("mozilla", *_glued("mpl", "1", "2")), r"(?:mozilla " + _LIC + " |mpl ?)" + _V + "{v}", ("1 0", "1 1", "2 0")),
    ("epl-{l}", ("eclipse", *_glued("epl", "1", "2")), r"(?:eclipse " + _LIC + " |epl ?)" + _V + "{v}", ("1 0", "2 0")),
    ("cddl-{l}", ("common", *_glued("cddl", "1")), r"(?:common development and distribution licen[cs]e |cddl ?)" + _V + "{v}", ("1 0", "1 1")),
    ("cpl-{l}", ("common",), r"common public licen[cs]e " + _V + "{v}", ("1 0",)),
    ("eupl-{l}", ("european", *_glued("eupl", "1")), r"(?:european union public licen[cs]e |eupl ?)" + _V + "{v}", ("1 0", "1 1", "1 2")),
    ("artistic-{l}", ("artistic",), _THE + r"artistic licen[cs]e " + _V + "{v}", ("1 0", "2 0")),
    ("afl-{l}", ("academic",), r"academic free licen[cs]e " + _V + "{v}", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl-{l}", ("open",), r"open software licen[cs]e " + _V + "{v}", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("bsl-{l}", ("boost",), r"boost software licen[cs]e " + _V + "{v}", ("1 0",)),
    ("ofl-{l}", ("font", *_glued("ofl", "1")), r"(?:sil )?(?:open font licen[cs]e |ofl ?)" + _V + "{v}", ("1 0", "1 1")),
    ("odbl-{l}", ("database", *_glued("odbl", "1")), r"(?:open database licen[cs]e |odbl ?)" + _V + "{v}", ("1 0",)),
    ("odc-by-{l}", ("open", "odc"), r"(?:open data commons attribution licen[cs]e|odc by) " + _V + "{v}", ("1 0",)),
    ("upl-{l}", ("universal",), r"universal permissive licen[cs]e " + _V + "{v}", ("1 0",)),
    ("cecill-{l}", ("cecill",), r"cecill(?: free software licen[cs]e agreement)? " + _V + "{v}", ("1 0", "1 1", "2 0", "2 1")),
    ("php-{l}", ("php",), r"php licen[cs]e " + _V + "{v}", ("3 0", "3 01")),
    ("python-{l}", ("python",), r"python (?:software foundation )?licen[cs]e " + _V + "{v}", ("2 0", "2")),
    ("zpl-{l}", ("zope", *_glued("zpl", "1", "2")), r"(?:zope public licen[cs]e |zpl ?)" + _V + "{v}", ("1 1", "2 0", "2 1")),
    ("lppl-{l}", ("latex", *_glued("lppl", "1")), r"(?:latex project public licen[cs]e |lppl ?)" + _V + "{v}", ("1 0", "1 1", "1 2", "1 3")),
    ("ncsa-{l}", ("ncsa",), r"ncsa open source licen[cs]e " + _V + "{v}", ("1 0",)),
    ("qpl-{l}", ("q",), r"q public licen[cs]e " + _V + "{v}", ("1 0",)),
    ("rpl-{l}", ("reciprocal",), r"reciprocal public licen[cs]e " + _V + "{v}", ("1 1", "1 5")),
    ("ms-pl-{l}", ("microsoft",), r"microsoft (?:public|reciprocal) licen[cs]e " + _V + "{v}", ("1 0",)),
    ("sspl-{l}", ("server", *_glued("sspl", "1")), r"(?:server side public licen[cs]e |sspl ?)" + _V + "{v}", ("1 0", "1")),
    ("busl-{l}", ("business", *_glued("busl", "1")), r"(?:business source licen[cs]e |busl ?)" + _V + "{v}", ("1 0", "1 1")),
    ("elastic-{l}", ("elastic",), r"elastic licen[cs]e " + _V + "{v}", ("1 0", "2 0")),
    ("polyform-{l}", ("polyform",), r"polyform (?:noncommercial|shield|strict|small business) licen[cs]e " + _V + "{v}", ("1 0 0",)),
    ("openrail-{l}", ("openrail", "rail"), r"(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)? " + _V + "{v}", ("1 0",)),
)

_CC_TERMS = (("by-nc-sa", r"by nc sa", r"attribution non ?commercial share ?alike"),
             ("by-nc-nd", r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
             ("by-sa", r"by sa", r"attribution share ?alike"),
             ("by-nc", r"by nc", r"attribution non ?commercial"),
             ("by-nd", r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
             ("by", r"by", r"attribution"))
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Further licences, exceptions and clauses by their names or by sentences of theirs.
_MORE = (
    ("classpath-exception", ("classpath",), r"classpath (?:linking )?exception"),
    ("gcc-exception", ("gcc",), r"gcc (?:runtime library|linking) exception"),
    ("autoconf-exception", ("autoconf",), r"autoconf (?:configure script )?exception"),
    ("bison-exception", ("bison",), r"bison exception"),
    ("font-exception", ("font",), r"(?:gpl )?font (?:embedding )?exception"),
    ("openssl-exception", ("openssl",), r"openssl (?:linking )?exception"),
    ("llvm-exception", ("llvm",), r"llvm exceptions?"),
    ("linux-syscall-note", ("syscall",), r"linux syscall note"),
    ("commons-clause", ("clause",), r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("cecill-b", ("cecill",), r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", ("cecill",), r"cecill c(?: licen[cs]e)?"),
    ("cecill", ("cecill",), r"cecill(?: free software)? licen[cs]e"),
    ("bsd-1-clause", ("bsd",), r"(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause-clear", ("bsd",), r"(?:clear bsd|bsd 3 clause clear)(?: licen[cs]e)?"),
    ("bsd-protection", ("bsd",), r"bsd protection licen[cs]e"),
    ("bsd-patent", ("bsd",), r"bsd (?:2 clause )?plus patent(?: licen[cs]e)?"),
    ("aal", ("assurance",), r"attribution assurance licen[cs]e"),
    ("afl", ("academic",), r"academic free licen[cs]e"),
    ("aladdin", ("aladdin",), r"aladdin free public licen[cs]e"),
    ("apsl", ("apple",), r"apple public source licen[cs]e(?: [12] [0-2])?"),
    ("artistic-perl", ("artistic",), r"(?:perl artistic licen[cs]e|artistic licen[cs]e perl)"),
    ("clarified-artistic", ("clarified",), r"clarified artistic licen[cs]e"),
    ("bittorrent", ("bittorrent",), r"bittorrent open source licen[cs]e"),
    ("blue-oak", ("oak",), r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("bsl", ("boost",), _THE + r"boost software licen[cs]e"),
    ("bsl", ("organization",), r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl", ("business",), r"business source licen[cs]e"),
    ("catosl", ("trusted",), r"computer associates trusted open source licen[cs]e"),
    ("cddl", ("distribution",), r"common development and distribution licen[cs]e"),
    ("cdla-permissive", ("community",), r"community data licen[cs]e agreement permissive"),
    ("cdla-sharing", ("community",), r"community data licen[cs]e agreement sharing"),
    ("cnri-python", ("cnri",), r"cnri (?:open source )?(?:licen[cs]e agreement for )?python(?: licen[cs]e)?"),
    ("cockroach", ("cockroachdb",), r"cockroachdb community licen[cs]e"),
    ("confluent", ("confluent",), r"confluent community licen[cs]e"),
    ("cpal", ("attribution",), r"common public attribution licen[cs]e"),
    ("cpl", ("common",), r"common public licen[cs]e"),
    ("condor", ("condor",), r"condor public licen[cs]e"),
    ("cua-opl", ("cua",), r"cua office public licen[cs]e"),
    ("d-fsl", ("lizenz",), r"deutsche freie software lizenz"),
    ("dl-de", ("datenlizenz",), r"datenlizenz deutschland(?: (?:namensnennung|zero))?"),
    ("ecl", ("educational",), r"educational community licen[cs]e"),
    ("edl", ("eclipse",), r"eclipse distribution licen[cs]e"),
    ("efl", ("eiffel",), r"eiffel forum licen[cs]e"),
    ("elastic", ("elastic",), r"elastic licen[cs]e"),
    ("entessa", ("entessa",), r"entessa public licen[cs]e"),
    ("epl", ("accompanying",), r"this program and the accompanying materials are made available under the terms"),
    ("erlang", ("erlang",), r"erlang public licen[cs]e"),
    ("etalab", ("ouverte", "etalab"), r"(?:licence ouverte|etalab open licen[cs]e)"),
    ("eu-datagrid", ("datagrid",), r"eu datagrid software licen[cs]e"),
    ("eupl", ("european",), r"european union public licen[cs]e"),
    ("fair", ("fair",), r"the fair licen[cs]e"),
    ("frameworx", ("frameworx",), r"frameworx open licen[cs]e"),
    ("free-art", ("art",), r"(?:free art licen[cs]e|licence art libre)"),
    ("freeimage", ("freeimage",), r"freeimage public licen[cs]e"),
    ("freetype", ("freetype",), r"freetype (?:project )?licen[cs]e"),
    ("fsl", ("functional",), r"functional source licen[cs]e"),
    ("gemma", ("gemma",), r"gemma (?:terms of use|licen[cs]e)"),
    ("gpl", ("program",), r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", ("library",), r"this library is free software you can redistribute it and or modify it"),
    ("gsoap", ("gsoap",), r"gsoap public licen[cs]e"),
    ("haskell-report", ("haskell",), r"haskell language report licen[cs]e"),
    ("hippocratic", ("hippocratic",), r"hippocratic licen[cs]e"),
    ("ibm-pl", ("ibm",), r"ibm public licen[cs]e"),
    ("icu", ("icu",), r"icu licen[cs]e"),
    ("ijg", ("jpeg",), r"(?:independent jpeg group licen[cs]e|based in part on the work of the independent jpeg group)"),
    ("imagemagick", ("imagemagick",), r"imagemagick licen[cs]e"),
    ("info-zip", ("zip",), r"info zip licen[cs]e"),
    ("intel", ("intel",), r"intel (?:open source|simplified software) licen[cs]e"),
    ("interbase", ("interbase",), r"interbase public licen[cs]e"),
    ("jasper", ("jasper",), r"jasper licen[cs]e"),
    ("llama", ("llama",), r"llama (?:[0-9] )*community licen[cs]e(?: agreement)?"),
    ("lppl", ("latex",), r"latex project public licen[cs]e"),
    ("lucent", ("lucent",), r"lucent public licen[cs]e"),
    ("mirros", ("miros",), r"miros licen[cs]e"),
    ("mit", ("substantial",), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("motosoto", ("motosoto",), r"motosoto open source licen[cs]e"),
    ("ms-rl", ("microsoft",), r"microsoft reciprocal licen[cs]e"),
    ("ms-pl", ("microsoft",), r"microsoft (?:permissive|public) licen[cs]e"),
    ("mulan-psl", ("mulan",), r"mulan (?:permissive software licen[cs]e|psl)"),
    ("multics", ("multics",), r"multics licen[cs]e"),
    ("nasa", ("nasa",), r"nasa open source agreement"),
    ("naumen", ("naumen",), r"naumen public licen[cs]e"),
    ("ncsa", ("illinois", "ncsa"), r"(?:university of illinois ncsa|ncsa) open source licen[cs]e"),
    ("net-snmp", ("snmp",), r"net snmp licen[cs]e"),
    ("nethack", ("nethack",), r"nethack general public licen[cs]e"),
    ("nlod", ("norwegian",), r"norwegian licen[cs]e for open government data"),
    ("nokia", ("nokia",), r"nokia open source licen[cs]e"),
    ("nosl", ("netizen",), r"netizen open source licen[cs]e"),
    ("npl", ("netscape",), r"netscape public licen[cs]e"),
    ("nposl", ("profit",), r"non profit open software licen[cs]e"),
    ("ntp", ("ntp",), r"ntp licen[cs]e"),
    ("oclc", ("oclc",), r"oclc research public licen[cs]e"),
    ("odbl", ("database",), r"open database licen[cs]e"),
    ("odc-by", ("data",), r"open data commons attribution licen[cs]e"),
    ("ofl", ("font",), r"(?:sil )?open font licen[cs]e"),
    ("ogl", ("government",), r"open government licen[cs]e"),
    ("open-game", ("game",), r"open game licen[cs]e"),
    ("openldap", ("openldap",), r"openldap public licen[cs]e"),
    ("openrail", ("openrail", "rail"), r"(?:creativeml )?open ?rail(?: m)? licen[cs]e"),
    ("opl", ("publication",), r"open publication licen[cs]e"),
    ("oset", ("oset",), r"oset (?:foundation )?public licen[cs]e"),
    ("osl", ("open",), r"open software licen[cs]e"),
    ("parity", ("parity",), r"parity public licen[cs]e"),
    ("pddl", ("pddl", "dedication"), r"(?:open data commons )?(?:public domain dedication and licen[cs]e|pddl)"),
    ("php", ("php",), r"php licen[cs]e"),
    ("polyform", ("polyform",), r"polyform (?:noncommercial|shield|strict|small business|perimeter|free trial) licen[cs]e"),
    ("psf", ("python", "psf"), r"(?:python software foundation|psf) licen[cs]e"),
    ("python", ("python",), _THE + r"python licen[cs]e"),
    ("qpl", ("q",), r"q public licen[cs]e"),
    ("qt-commercial", ("qt",), r"commercial qt licen[cs]e"),
    ("rail", ("bigscience", "responsible"), r"(?:bigscience (?:bloom )?rail|responsible ai) licen[cs]e"),
    ("realnetworks", ("realnetworks",), r"realnetworks public source licen[cs]e"),
    ("redis-sal", ("redis",), r"redis source available licen[cs]e"),
    ("rpl", ("reciprocal",), r"reciprocal public licen[cs]e"),
    ("ricoh", ("ricoh",), r"ricoh source code public licen[cs]e"),
    ("sgi-b", ("sgi",), r"sgi free software licen[cs]e(?: b)?"),
    ("simple-pl", ("simple",), r"simple public licen[cs]e"),
    ("sissl", ("sun",), r"sun industry standards source licen[cs]e"),
    ("sleepycat", ("sleepycat",), r"sleepycat licen[cs]e"),
    ("smlnj", ("jersey",), r"standard ml of new jersey (?:licen[cs]e|copyright notice)"),
    ("sspl", ("server",), r"server side public licen[cs]e"),
    ("sugarcrm", ("sugarcrm",), r"sugarcrm public licen[cs]e"),
    ("sun-pl", ("sun",), r"sun public licen[cs]e"),
    ("tcl", ("tcl",), r"tcl(?: tk)? licen[cs]e"),
    ("tcp-wrappers", ("wrappers",), r"tcp wrappers licen[cs]e"),
    ("timescale", ("timescale",), r"timescale licen[cs]e"),
    ("tmate", ("tmate",), r"tmate open source licen[cs]e"),
    ("upl", ("universal",), r"universal permissive licen[cs]e"),
    ("vovida", ("vovida",), r"vovida software licen[cs]e"),
    ("watcom", ("watcom",), r"(?:sybase )?open watcom public licen[cs]e"),
    ("wxwindows", ("wxwindows", "wxwidgets"), r"(?:wxwindows|wxwidgets) (?:library )?licen[cs]e"),
    ("xfree86", ("xfree86",), r"xfree86 licen[cs]e"),
    ("xnet", ("x",), r"x net licen[cs]e"),
    ("ypl", ("yahoo",), r"yahoo public licen[cs]e"),
    ("zend", ("zend",), r"zend (?:engine )?licen[cs]e"),
    ("zimbra", ("zimbra",), r"zimbra public licen[cs]e"),
    ("zpl", ("zope",), r"zope public licen[cs]e"),
    ("996-icu", ("996",), r"anti 996 licen[cs]e"),
    ("bsd", ("redistributions",), r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("gpl", ("verbatim",), r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("wtfpl", ("verbatim",), r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("apache", ("compliance",), r"you may not use this file except in compliance with the licen[cs]e"),
    ("mpl", ("form",), r"this source code form is subject to the terms"),
)

_NAMED = (
    ("cc0", ("cc0", "zero"), r"(?:creative commons |cc )?(?:cc0|cc zero|zero)(?: universal)?(?: 1 0)?(?: universal)? (?:public domain dedication|licen[cs]e)"),
    ("cc0", ("cc0",), r"cc0(?: 1 0)?"),
    ("mit", ("mit",), _THE + r"mit licen[cs]e"),
    ("mit", ("mit",), r"licen[cs]ed under (?:the )?mit"),
    ("mit", ("expat",), _THE + r"expat licen[cs]e"),
    ("mit", ("permission",), r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", ("mit",), r"mit no attribution"),
    ("isc", ("isc",), _THE + r"isc licen[cs]e"),
    ("isc", ("permission",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", ("bsd",), r"(?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", ("bsd",), r"(?:(?:modified|new|revised) bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", ("bsd",), r"(?:(?:original|old) bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("bsd-0-clause", ("bsd", "0bsd"), r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?"),
    ("bsd", ("bsd",), _THE + r"bsd licen[cs]e"),
    ("bsd", ("redistribution",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", ("endorse",), r"be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", ("advertising",), r"all advertising materials mentioning features or use of this software must display"),
    ("unlicense", ("unlicense",), _THE + r"unlicense"),
    ("unlicense", ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("public-domain", ("domain",), r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("wtfpl", ("wtfpl",), r"wtfpl"),
    ("wtfpl", ("fuck",), r"do what the fuck you want to public licen[cs]e"),
    ("zlib", ("zlib",), _THE + r"zlib(?: libpng)? licen[cs]e"),
    ("zlib", ("misrepresented",), r"the origin of this software must not be misrepresented"),
    ("libpng", ("libpng", "png"), _THE + r"(?:libpng|png reference library) licen[cs]e"),
    ("openssl", ("openssl",), _THE + r"openssl licen[cs]e"),
    ("postgresql", ("postgresql",), _THE + r"postgresql licen[cs]e"),
    ("curl", ("curl",), _THE + r"curl licen[cs]e"),
    ("beerware", ("beerware", "beer"), r"(?:beerware|beer ware) licen[cs]e"),
    ("json", ("evil",), r"the software shall be used for good not evil"),
    ("x11", ("x11",), _THE + r"x11 licen[cs]e"),
    ("ruby", ("ruby",), _THE + r"ruby licen[cs]e"),
    ("perl", ("perl",), r"(?:same terms as perl itself|perl 5 licen[cs]e)"),
    ("vim", ("vim",), _THE + r"vim licen[cs]e"),
    ("unicode", ("unicode",), r"unicode (?:data files and software )?licen[cs]e(?: agreement)?"),
    ("w3c", ("w3c",), r"w3c (?:software|document)(?: notice and)? licen[cs]e"),
    ("hpnd", ("historical",), r"historical permission notice and disclaimer"),
    ("apache", ("apache",), _THE + r"apache (?:software )?licen[cs]e"),
    ("mpl", ("mozilla",), r"mozilla public licen[cs]e"),
    ("epl", ("eclipse",), r"eclipse public licen[cs]e"),
    ("agpl", ("affero",), _THE + r"(?:gnu )?affero general public licen[cs]e"),
    ("lgpl", ("lesser", "library"), _THE + r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("gfdl", ("documentation",), _THE + r"(?:gnu )?free documentation licen[cs]e"),
    ("gpl", ("general",), _THE + r"(?:gnu )?general public licen[cs]e"),
    ("gpl", ("gpl",), r"(?:gnu gpl|gpl licen[cs]e)"),
    ("artistic", ("artistic",), _THE + r"artistic licen[cs]e"),
    ("creative-commons", ("creative",), r"creative commons(?: licen[cs]e)?"),
    ("proprietary", ("proprietary",), r"proprietary and confidential"),
    ("proprietary", ("unauthorized",), r"unauthorized (?:copying|use|distribution) (?:of this (?:file|software)|is (?:strictly )?prohibited)"),
    ("commercial", ("commercial",), r"commercial licen[cs]e agreement"),
    ("no-warranty", ("warranty", "warranties"), r"without warrant(?:y|ies) (?:of any kind|or conditions)"),
    ("reserved", ("reserved",), r"all rights reserved"),
    ("copyright", ("copyright",), r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
)

#: Any other licence by name; ``{named}`` stands for what the other rules find, before which it stops.
_OTHER = ("licensed", ("licensed", "licenced", "released"),
          r"(?:licen[cs]ed|released) under (?:the )?(?:terms of )?(?:the )?(?:(?!(?<= )(?:{named}) )[a-z0-9 ]){1,30}licen[cs]e")

#: Identifiers after "spdx license identifier", as words; the label is the identifier.
_SPDX = ("mit", "mit 0", "isc", "0bsd", "zlib", "unlicense", "wtfpl", "ncsa", "x11", "curl", "openssl", "ruby", "vim",
         "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "apache 1 0", "apache 1 1", "apache 2 0", "cc0 1 0",
         "mpl 1 0", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0", "cddl 1 1", "eupl 1 1", "eupl 1 2",
         "bsl 1 0", "artistic 1 0", "artistic 2 0", "postgresql", "ofl 1 1", "osl 3 0", "afl 3 0", "upl 1 0", "ms pl", "ms rl")
_SPDX_GNU = tuple(f"{name} {version}" for name, versions in
                  (("gpl", ("1 0", "2 0", "3 0")), ("lgpl", ("2 0", "2 1", "3 0")), ("agpl", ("1 0", "3 0")), ("gfdl", ("1 1", "1 2", "1 3")))
                  for version in versions)


def _short(version: str) -> str:
    return version.replace(" ", ".")


def rules() -> list[tuple[str, tuple[str, ...], str]]:
    """(label, gate words, pattern) in order of priority: identifiers, versions, terms, names."""
    out: list[tuple[str, tuple[str, ...], str]] = []
    spdx = "spdx licen[cs]e identifier "
    for name in _SPDX_GNU:
        label = name.split(" ")[0] + "-" + _short(name.split(" ", 1)[1])
        out += [(f"{label}-or-later", ("spdx",), f"{spdx}{name}(?: or later)"), (f"{label}-only", ("spdx",), f"{spdx}{name} only"),
                (label, ("spdx",), spdx + name)]
    out += [(name.replace(" ", "-"), ("spdx",), spdx + name) for name in sorted(_SPDX, key=len, reverse=True)]
    for label, gate, pattern, versions in _VERSIONED:
        for version in versions:
            full = pattern.replace("{v}", version)
            out.append((label.replace("{l}", _short(version)) + "-or-later", gate, full + r"(?: of the licen[cs]e)? or (?:\(?at your option\)? )?any later version"))
            out.append((label.replace("{l}", _short(version)), gate, full))
    for terms, short, long in _CC_TERMS:
        out += [(f"cc-{terms}-{_short(v)}", ("cc", "creative", "attribution"),
                 f"(?:cc {short}|(?:creative commons )?{long}(?: {v})? international(?: public)? licen[cs]e|creative commons {long}) (?:licen[cs]e )?{_V}{v}")
                for v in _CC_VERSIONS]
        out.append((f"cc-{terms}", ("cc", "creative"), f"(?:cc {short}|creative commons {long})(?: licen[cs]e)?"))
    out += [*_MORE, *_NAMED]
    label, gate, pattern = _OTHER
    named = [spdx.rstrip(), *(p.replace("{v}", f"(?:{'|'.join(versions)})") for _, _, p, versions in _VERSIONED),
             *(f"(?:cc {short}|creative commons {long})" for _, short, long in _CC_TERMS), *(p for _, _, p in (*_MORE, *_NAMED))]
    return [*out, (label, gate, pattern.replace("{named}", "|".join(named)))]
