"""Hand-written signatures of license texts, notices and grants.

One line each: label, priority, words in a row, and the keyword that gates the
line, a word that stands in every match. A space stands for any signs that are no
letters or digits, one at least, and a space with `?` for any or none; all else is a regular expression over
lower-cased text.
"""

from __future__ import annotations

#: Priorities: 45 a clause only one license has, 35 an opening grant, 25 a name or address, 15 a hint.
SIGNATURES = (
    # permissive grants
    ("mit", 45, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted"),
    ("mit", 44, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "sublicense"),
    ("mit", 30, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", 25, r"(?:opensource org|choosealicense com) licenses mit", "licenses"),
    ("mit-0", 44, r"permission is hereby granted free of charge [^\n]{0,220} without restriction [^\n]{0,400} to do so the software is provided", "granted"),
    ("mit-0", 25, r"mit (?:no attribution|0) (?:license|licence)", "mit"),
    ("mit-cmu", 44, r"permission to use copy modify and distribute this software and its associated documentation for any purpose and without fee is hereby granted", "documentation"),
    ("mit-advertising", 44, r"advertising materials mentioning features or use of this software must display the following acknow?ledge?ment this product includes software developed by", "advertising"),
    ("isc", 45, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("isc", 30, r"in no event shall the author be liable for any special direct indirect or consequential damages", "consequential"),
    ("0bsd", 46, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "fee"),
    ("0bsd", 25, r"(?:bsd zero clause|zero clause bsd) license", "clause"),
    ("bsd", 45, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", 45, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd-3-clause", 46, r"neither the name of (?:the )?[^\n]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse"),
    ("bsd-4-clause", 46, r"all advertising materials mentioning features or use of this software must display the following acknow?ledge?ment", "advertising"),
    ("bsd-2-clause", 25, r"bsd 2 clause", "clause"),
    ("bsd-3-clause", 25, r"bsd 3 clause", "clause"),
    ("bsd-3-clause-clear", 44, r"no express or implied licenses to any party s patent rights are granted by this license", "patent"),
    ("bsd", 25, r"bsd style licen[sc]e", "bsd"),
    ("bsd", 25, r"(?:new|modified|revised|simplified|original|freebsd|berkeley) bsd licen[sc]e", "bsd"),
    ("bsd-patent", 44, r"bsd 2 clause plus patent licen[sc]e", "patent"),
    ("zlib", 45, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"),
    ("zlib", 40, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("libpng", 44, r"the png reference library is supplied as is", "png"),
    ("libpng", 25, r"libpng (?:license|licence)", "libpng"),
    ("boost", 45, r"boost software license version 1 0 august 17th 2003", "boost"),
    ("boost", 40, r"obtaining a copy of the software and accompanying documentation covered by this license", "accompanying"),
    ("boost", 25, r"boost org license 1 0 txt", "boost"),
    ("unlicense", 45, r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", 40, r"anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("unlicense", 25, r"unlicense org", "unlicense"),
    ("wtfpl", 45, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "verbatim"),
    ("wtfpl", 40, r"you just do what the fuck you want to", "fuck"),
    ("beerware", 45, r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"),
    ("beerware", 25, r"beer ?ware licen[sc]e", "beer"),
    ("postgresql", 45, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "agreement"),
    ("postgresql", 25, r"postgresql licen[sc]e", "postgresql"),
    ("ncsa", 45, r"university of illinois ncsa open source license", "ncsa"),
    ("ncsa", 40, r"to deal with the software without restriction", "restriction"),
    ("curl", 44, r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale", "advertising"),
    ("curl", 25, r"curl licen[sc]e", "curl"),
    ("x11", 45, r"except as contained in this notice the name of the x consortium shall not be used", "consortium"),
    ("hpnd", 44, r"historical permission notice and disclaimer", "historical"),
    ("icu", 44, r"icu licen[sc]e icu 1 8 1 and later", "icu"),
    ("unicode", 45, r"unicode inc licen[sc]e agreement data files and software", "unicode"),
    ("unicode", 40, r"unicode (?:terms of use|license v3)", "unicode"),
    ("openssl", 45, r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ssleay", 45, r"this product includes cryptographic software written by eric young", "cryptographic"),
    ("openssl", 25, r"openssl licen[sc]e", "openssl"),
    ("php", 45, r"this product includes php software freely available from", "php"),
    ("php", 40, r"the php license version [0-9](?:\.[0-9]+)?", "php"),
    ("zend", 44, r"this product includes the zend engine freely available at", "zend"),
    ("apache-1.1", 45, r"this product includes software developed by the apache software foundation", "apache"),
    ("apache-1.0", 44, r"this product includes software developed by the apache group for use in the apache http server project", "apache"),
    ("apache", 45, r"apache license version 2 0 january 2004", "january"),
    ("apache", 40, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "compliance"),
    ("apache", 35, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "writing"),
    ("apache", 40, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "irrevocable"),
    ("apache", 25, r"apache 2 0 licen[sc]ed?", "apache"),
    ("apache-llvm", 46, r"apache license v2 0 with llvm exceptions", "llvm"),
    ("ecl", 45, r"educational community license version 2 0", "educational"),
    ("afl", 45, r"academic free licen[sc]e version [0-9](?:\.[0-9])?", "academic"),
    ("afl", 25, r"academic free licen[sc]e", "academic"),
    ("mulan", 45, r"mulan permissive software license version [12]", "mulan"),
    ("mulan", 25, r"mulan ?(?:psl|publ) ?v?[12]", "mulan"),
    ("blueoak", 45, r"blue oak model license version 1 0 0", "oak"),
    ("upl", 45, r"universal permissive license v(?:ersion)? ?1 0", "permissive"),
    ("intel", 44, r"intel open source license for cdsa", "intel"),
    ("w3c", 45, r"w3c software (?:notice and license|and document license)", "w3c"),
    ("w3c", 40, r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty", "royalty"),
    ("python", 45, r"psf is making python available to licensee on an as is basis", "licensee"),
    ("python", 40, r"this license agreement is between the python software foundation", "python"),
    ("python", 40, r"cnri open source license agreement", "cnri"),
    ("python", 40, r"beopen python open source license agreement version 1", "beopen"),
    ("ruby", 45, r"you may make and give away verbatim copies of the source form of the software without restriction", "verbatim"),
    ("ruby", 25, r"ruby s? ?licen[sc]e", "ruby"),
    ("tcl", 45, r"this software is copyrighted by the regents of the university of california sun microsystems", "regents"),
    ("vim", 45, r"vim is charityware", "charityware"),
    ("json", 46, r"the software shall be used for good not evil", "evil"),
    ("ijg", 45, r"this software is based in part on the work of the independent jpeg group", "jpeg"),
    ("libtiff", 44, r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "sell"),
    ("freetype", 45, r"the freetype project licen[sc]e", "freetype"),
    ("freetype", 44, r"portions of this software are copyright [^\n]{0,40} the freetype project", "freetype"),
    ("imagemagick", 45, r"imagemagick studio llc a non profit organization", "imagemagick"),
    ("naumen", 44, r"naumen public licen[sc]e", "naumen"),
    ("zpl", 45, r"zope public licen[sc]e zpl version [0-9](?:\.[0-9])?", "zope"),
    ("zpl", 25, r"zope public licen[sc]e", "zope"),
    ("xnet", 44, r"x net license", "net"),
    ("eudatagrid", 44, r"eu datagrid software licen[sc]e", "datagrid"),
    ("entessa", 44, r"entessa public licen[sc]e", "entessa"),
    ("fair", 45, r"usage of the works is permitted provided that this instrument is retained with the works", "instrument"),
    ("fsfap", 45, r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "royalty"),
    ("fsful", 45, r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", "unlimited"),
    ("nist", 45, r"this software was developed at the national institute of standards and technology by employees of the federal government", "institute"),
    ("ms-pl", 45, r"microsoft public licen[sc]e (?:ms pl)?", "microsoft"),
    ("ms-rl", 45, r"microsoft reciprocal licen[sc]e (?:ms rl)?", "reciprocal"),
    ("ms-lpl", 44, r"microsoft limited public licen[sc]e", "limited"),
    # copyleft
    ("gpl", 45, r"gnu general public license version 1 february 1989", "february"),
    ("gpl", 45, r"gnu general public license version 2 june 1991", "june"),
    ("gpl", 45, r"gnu general public license version 3 29 june 2007", "june"),
    ("gpl", 40, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl", 35, r"you should have received a copy of the gnu general public license along with this program", "received"),
    ("gpl", 35, r"this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", 30, r"either version [0-9] of the license or at your option any later version", "option"),
    ("gpl", 44, r"the licenses for most software are designed to take away your freedom to share and change it", "freedom"),
    ("gpl", 44, r"to protect your rights we need to (?:make restrictions that forbid|prevent) (?:anyone|others)", "protect"),
    ("gpl-2.0-only", 25, r"gpl 2 0 only", "gpl"),
    ("gpl-2.0-or-later", 25, r"gpl 2 0 or later", "gpl"),
    ("gpl-3.0-only", 25, r"gpl 3 0 only", "gpl"),
    ("gpl-3.0-or-later", 25, r"gpl 3 0 or later", "gpl"),
    ("gpl-classpath", 46, r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", "modules"),
    ("gpl-classpath", 30, r"gpl ?v?2 with classpath exception", "classpath"),
    ("gpl-autoconf", 45, r"autoconf configure script exception", "autoconf"),
    ("gpl-bison", 45, r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison"),
    ("gpl-gcc", 45, r"gcc runtime library exception version 3 1", "gcc"),
    ("gpl-font", 45, r"as a special exception if you create a document which uses this font", "font"),
    ("lgpl", 45, r"gnu lesser general public license version 2 1 february 1999", "lesser"),
    ("lgpl", 45, r"gnu lesser general public license version 3 29 june 2007", "lesser"),
    ("lgpl", 45, r"gnu library general public license version 2 june 1991", "library"),
    ("lgpl", 40, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("lgpl", 35, r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library", "received"),
    ("lgpl-2.1-only", 25, r"lgpl 2 1 only", "lgpl"),
    ("lgpl-2.1-or-later", 25, r"lgpl 2 1 or later", "lgpl"),
    ("lgpl-3.0-or-later", 25, r"lgpl 3 0 or later", "lgpl"),
    ("agpl", 45, r"gnu affero general public license version 3 19 november 2007", "affero"),
    ("agpl", 40, r"under the terms of the gnu affero general public license", "affero"),
    ("agpl", 40, r"your modified version must prominently offer all users interacting with it remotely through a computer network", "remotely"),
    ("agpl-3.0-or-later", 25, r"agpl 3 0 or later", "agpl"),
    ("fdl", 45, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("fdl", 40, r"with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("mpl", 45, r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl", 40, r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl", 45, r"the contents of this file are subject to the mozilla public license version 1 [01]", "mozilla"),
    ("mpl", 40, r"incompatible with secondary licenses as defined by the mozilla public license", "incompatible"),
    ("npl", 45, r"netscape public licen[sc]e version 1 [01]", "netscape"),
    ("epl", 45, r"this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("epl", 45, r"the accompanying program is provided under the terms of this eclipse public license", "eclipse"),
    ("edl", 45, r"eclipse distribution license v(?:ersion)? ?1 0", "eclipse"),
    ("cpl", 45, r"the accompanying program is provided under the terms of this common public license", "accompanying"),
    ("cpl", 25, r"common public license (?:version |v )?1 0", "common"),
    ("ipl", 45, r"ibm public licen[sc]e version 1 0", "ibm"),
    ("cddl", 45, r"the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("cddl", 40, r"you can obtain a copy of the license at [^\n]{0,60}opensolaris license", "opensolaris"),
    ("cpal", 45, r"common public attribution licen[sc]e version 1 0", "attribution"),
    ("osl", 45, r"licensed under the open software license version 3 0", "open"),
    ("osl", 40, r"this open software license the license applies to any original work of authorship", "authorship"),
    ("eupl", 45, r"european union public licence v ?1 [0-2]", "european"),
    ("eupl", 40, r"licensed under the eupl", "eupl"),
    ("cecill", 45, r"cecill free software licen[sc]e agreement", "cecill"),
    ("cecill", 40, r"ce logiciel est r\xc3\xa9gi par la licence cecill", "cecill"),
    ("cecill-b", 41, r"cecill b free software licen[sc]e", "cecill"),
    ("cecill-c", 41, r"cecill c free software licen[sc]e", "cecill"),
    ("qpl", 45, r"the q public licen[sc]e version 1 0", "public"),
    ("sleepycat", 45, r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software", "redistributions"),
    ("sleepycat", 25, r"sleepycat licen[sc]e", "sleepycat"),
    ("artistic", 45, r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", "artistic"),
    ("artistic", 40, r"the clarified artistic license", "clarified"),
    ("artistic", 40, r"under the same terms as perl itself", "perl"),
    ("apsl", 45, r"apple public source licen[sc]e version [12](?:\.[0-2])?", "apple"),
    ("apsl", 40, r"subject to the apple public source licen[sc]e", "apple"),
    ("rpl", 45, r"reciprocal public licen[sc]e (?:version )?1 [0-5]", "reciprocal"),
    ("rpsl", 45, r"realnetworks public source licen[sc]e", "realnetworks"),
    ("sissl", 45, r"sun industry standards source licen[sc]e", "industry"),
    ("spl", 45, r"sun public licen[sc]e version 1 0", "sun"),
    ("nokia", 45, r"nokia open source licen[sc]e", "nokia"),
    ("motosoto", 45, r"motosoto open source licen[sc]e", "motosoto"),
    ("nasa", 45, r"nasa open source agreement version 1 3", "nasa"),
    ("oclc", 45, r"oclc research public licen[sc]e 2 0", "oclc"),
    ("ricoh", 45, r"ricoh source code public licen[sc]e", "ricoh"),
    ("simpl", 45, r"simple public licen[sc]e 2 0", "simple"),
    ("vsl", 45, r"vovida software licen[sc]e v(?:ersion)? ?1 0", "vovida"),
    ("watcom", 45, r"sybase open watcom public licen[sc]e", "watcom"),
    ("frameworx", 45, r"frameworx open licen[sc]e", "frameworx"),
    ("lppl", 45, r"latex project public licen[sc]e(?: version 1 [0-3])?", "latex"),
    ("lppl", 40, r"this work may be distributed and or modified under the conditions of the latex project public license", "latex"),
    ("lucent", 45, r"lucent public licen[sc]e version 1 0", "lucent"),
    ("liliq", 45, r"licence libre du qu\xc3\xa9bec", "libre"),
    ("ofl", 45, r"this font software is licensed under the sil open font license version 1 1", "sil"),
    ("ofl", 40, r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "collaborative"),
    ("ofl", 25, r"scripts sil org ofl", "sil"),
    # content and data
    ("cc-by", 40, r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international |unported )?license", "attribution"),
    ("cc-by-sa", 42, r"this work is licensed under (?:a|the) creative commons attribution share ?alike", "creative"),
    ("cc-by-nc", 42, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial", "creative"),
    ("cc-by-nd", 42, r"this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s", "creative"),
    ("cc-by-nc-sa", 43, r"creative commons attribution non ?commercial share ?alike", "creative"),
    ("cc-by-nc-nd", 43, r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", "creative"),
    ("cc0", 45, r"the person who associated a work with this deed has dedicated the work to the public domain", "deed"),
    ("cc0", 40, r"to the extent possible under law [^\n]{0,80} has waived all copyright and related or neighboring rights", "waived"),
    ("cc-pd", 40, r"creative commons public domain (?:mark|dedication)", "domain"),
    ("cc-sampling", 40, r"creative commons sampling plus", "sampling"),
    ("odbl", 45, r"this data is made available under the open database license", "database"),
    ("odbl", 40, r"any rights in individual contents of the database are licensed under the database contents license", "contents"),
    ("odc-by", 45, r"open data commons attribution licen[sc]e", "commons"),
    ("pddl", 45, r"open data commons public domain dedication and licen[sc]e", "dedication"),
    ("cdla", 45, r"community data licen[sc]e agreement (?:sharing|permissive) version [12] 0", "agreement"),
    ("ogl", 45, r"open government licen[sc]e (?:version|v) ?[123](?: 0)?", "government"),
    ("ogl", 40, r"contains public sector information licensed under the open government licen[sc]e", "sector"),
    ("etalab", 45, r"licence ouverte ?(?:open licen[sc]e)?", "ouverte"),
    ("dl-de-by", 45, r"datenlizenz deutschland namensnennung", "datenlizenz"),
    ("gutenberg", 45, r"this ebook is for the use of anyone anywhere [^\n]{0,60} at no cost and with almost no restrictions whatsoever", "ebook"),
    ("gutenberg", 40, r"the full project gutenberg licen[sc]e", "gutenberg"),
    ("free-art", 45, r"(?:free art licen[sc]e|licence art libre)", "art"),
    ("public-domain", 30, r"this (?:work|file|text|image) (?:is|has been (?:placed|released)) in(?:to)? the public domain", "domain"),
    ("public-domain", 30, r"no copyright is claimed", "claimed"),
    ("public-domain", 30, r"works? of the (?:united states|u s) government (?:is|are) not subject to copyright", "government"),
    # machine-learning models and source-available terms
    ("openrail", 45, r"(?:creativeml |bigscience )?open ?rail(?: ?\+?\+?)? ?m licen[sc]e", "rail"),
    ("bloom-rail", 45, r"bigscience (?:bloom )?rail licen[sc]e", "bigscience"),
    ("llama", 45, r"llama [0-9](?: [0-9])? community licen[sc]e agreement", "llama"),
    ("gemma", 45, r"gemma terms of use", "gemma"),
    ("ai-pubs", 45, r"ai pubs open rail", "pubs"),
    ("bsl-1.1", 45, r"business source licen[sc]e 1 1", "business"),
    ("bsl-1.1", 40, r"change date [^\n]{0,60}\n\s{0,20}change license", "change"),
    ("sspl", 45, r"server side public licen[sc]e(?: version 1)?", "server"),
    ("elastic", 45, r"elastic licen[sc]e(?: 2 0)?", "elastic"),
    ("commons-clause", 46, r"commons clause licen[sc]e condition v1 0", "clause"),
    ("commons-clause", 40, r"the license does not grant to you the right to sell the software", "sell"),
    ("confluent", 45, r"confluent community licen[sc]e", "confluent"),
    ("redis", 45, r"redis source available licen[sc]e", "redis"),
    ("timescale", 45, r"timescale licen[sc]e agreement", "timescale"),
    ("polyform", 45, r"polyform (?:noncommercial|small business|perimeter|shield|strict|internal use|free trial) licen[sc]e", "polyform"),
    ("prosperity", 45, r"the prosperity public licen[sc]e", "prosperity"),
    ("parity", 45, r"the parity public licen[sc]e", "parity"),
    ("hippocratic", 45, r"hippocratic licen[sc]e", "hippocratic"),
    ("anti-996", 45, r"anti 996 licen[sc]e", "996"),
    ("fsl", 45, r"functional source licen[sc]e", "functional"),
    # proprietary notices
    ("proprietary", 30, r"this (?:software|document|material) is (?:the )?(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", 30, r"(?:may not|must not|shall not) be (?:reproduced|copied|distributed|republished|redistributed)[^\n]{0,80} without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)", "without"),
    ("proprietary", 25, r"no part of this (?:publication|book|document|work) may be reproduced", "reproduced"),
    ("proprietary", 25, r"for internal use only", "internal"),
    ("proprietary", 25, r"trade secrets? of", "trade"),
    ("proprietary", 25, r"end user licen[sc]e agreement", "agreement"),
    ("proprietary", 20, r"by (?:installing|downloading|using) (?:this|the) (?:software|program)[^\n]{0,40} you agree to", "agree"),
    ("noncommercial", 25, r"for (?:personal and )?non ?commercial use only", "commercial"),
    ("noncommercial", 25, r"not for (?:commercial use|resale)", "not"),
    ("academic", 25, r"for (?:academic|educational|research) (?:and (?:academic|educational|research) )?(?:use|purposes) only", "only"),
    ("evaluation", 25, r"for evaluation purposes only", "evaluation"),
    ("reserved", 21, r"some rights reserved", "reserved"),
    ("reserved", 21, r"no rights reserved", "reserved"),
    ("disclaimer", 12, r"in no event shall the (?:authors?|copyright holders?|regents)(?: or (?:copyright holders?|contributors))? be liable", "liable"),
    ("disclaimer", 12, r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "merchantability"),
    ("disclaimer", 11, r"(?:provided|supplied|distributed) as is(?: and)? without (?:any )?warrant(?:y|ies)", "without"),
)
