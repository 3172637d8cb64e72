"""How licences are named and stated in a line, and lines with the same words that state none.

Fixed values, in our own or in common words. Training rows are made from them by rules in
licenses.py.
"""

#: How the licences of a family are written.
NAMES = {
    "mit": ("MIT License", "MIT license", "MIT", "Expat License", "MIT/X11 License", "MIT open source license"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache 2 license", "Apache Software License", "Apache license"),
    "gpl": (
        "GNU General Public License", "GNU General Public License, version 3", "GNU GPL, version 2 or later", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL v3", "GPL-2.0-only", "GPL-3.0-or-later",
        "GNU Lesser General Public License", "LGPL", "LGPL-2.1", "GPL license", "LGPLv3",
    ),
    "bsd": ("BSD License", "3-clause BSD license", "2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD", "New BSD License", "Simplified BSD License", "modified BSD license"),
    "mozilla": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPL", "MPL v2 license"),
    "creative_commons": (
        "CC BY 4.0", "CC BY-NC 4.0", "CC BY-SA 4.0", "CC-BY-SA", "CC-BY-4.0", "CC-BY-NC-ND-3.0", "CC BY-SA 3.0 license", "Creative Commons Attribution 4.0 International License",
        "Creative Commons Attribution-ShareAlike license", "Creative Commons license", "Creative Commons BY-NC",
    ),
    "public_domain": ("CC0", "CC0 1.0 Universal", "CC0-1.0", "Unlicense", "the Unlicense", "public domain"),
}
#: Other licences, which belong to no family here.
OTHER_NAMES = (
    "ISC License", "ISC", "Eclipse Public License 2.0", "EPL-2.0", "Fishing License, Version 2.0", "GNU Affero General Public License", "GNU Affero GPL v3", "AGPL-3.0", "AGPLv3", "AGPL-3.0-or-later", "AGPL",
    "zlib License", "Boost Software License 1.0", "BSL-1.0", "Artistic License 2.0", "EUPL-1.2", "European Union Public Licence", "CDDL-1.0", "Common Development and Distribution License",
    "Microsoft Public License", "MS-PL", "PostgreSQL License", "Python Software Foundation License", "WTFPL", "SIL Open Font License", "OFL-1.1", "Open Database License", "Elastic License 2.0",
    "Server Side Public License", "Business Source License 1.1", "proprietary license", "commercial license", "Acme License, Version 2.0", "driving licence", "hunting license", "Qt Public License",
)
#: Statements of the licence named at {}.
FRAMES = (
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This project is licensed under the {}.", "License: {}", "SPDX-License-Identifier: {}", "This work is licensed under a {}.",
    "Distributed under the {}.", "Distributed under {}", "The code in this repo is {} licensed.", "{}-licensed", "This library is available under the {}; see the license file.", "{}", "All content is licensed {}.",
    "Published under the terms of the {}.", "You may use this file under the terms of the {}.", "This source code is subject to the terms of the {}.", "This program is free software under the {}.",
    "You may not use this file except in compliance with the {}.", "Use of this source code is governed by the {}.", "The software is covered by the {}.", "License {}", "licensed: {}", "It is released under {} or later.",
    "Dieses Werk steht unter der {}.", "Lizenziert unter {}.", "Lizenz: {}", "Veröffentlicht unter der {}-Lizenz.", "Publié sous licence {}.", "Ce logiciel est distribué sous la licence {}.", "Licence : {}",
    "Publicado bajo la licencia {}.", "Este software se distribuye bajo {}.", "Licencia: {}",
)
#: Statements of two licences.
DUAL = ("Dual-licensed under {} and {}.", "Licensed under either {} or {} at your option.", "License: {} OR {}", "Available under both {} and {}.")
#: Statements of a family that need no frame.
ALONE = {
    "mit": ("The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under this license and copyright notice."),
    "apache": ("Apache License Version 2.0, January 2004",),
    "gpl": ("This is free software, covered by the GNU General Public License; you may change it.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "the terms of the GNU GPL apply to this program"),
    "bsd": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD 3-Clause License", "Redistribution and use in source and binary forms are permitted if the copyright notice is retained."),
    "mozilla": ("Mozilla Public License Version 2.0",),
    "creative_commons": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under CC BY-SA.", "Photo: CC BY 2.0"),
    "public_domain": (
        "This work is in the public domain.", "Released into the public domain.", "Released into the public domain under CC0; no copyright is claimed.", "The author has dedicated the work to the public domain.",
        "I hereby place this code in the public domain.", "Public domain, no rights reserved.", "To the extent possible under law, the author waives all rights under CC0.", "This file is public domain.",
        "Dieses Werk ist gemeinfrei.", "Cette œuvre est dans le domaine public.", "Esta obra es de dominio público.", "In die Gemeinfreiheit (public domain) entlassen.",
    ),
    "all_rights_reserved": (
        "All rights reserved.", "Copyright the author. All rights reserved.", "Copyright (c) 2020 Jane Doe. All rights reserved.", "© 2019 Acme Inc. All rights reserved worldwide.", "all rights reserved", "ALL RIGHTS RESERVED",
        "All Rights Reserved by the publisher.", "Copyright 2001-2007 by the publisher, all rights reserved.", "All rights are reserved.", "No part may be copied; all rights reserved.",
        "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "© 2021 Verlag. Alle Rechte vorbehalten.", "© Éditeur, tous droits réservés.", "Copyright 2018, todos los derechos reservados.",
    ),
}
#: Lines that state no licence.
OTHER = (
    "He lost his driving license on the way home.", "The license plate of the car was hard to read.", "She applied for a fishing licence at the office.", "Poets take license with the facts.",
    "The new law on copyright was debated for a year.", "A licensed electrician must do this work.", "The case was about copyright and fair use.", "They met in a public domain of the old city, under a work of stone.",
    "The town renewed the license of the public house, version after version.", "Under the general terms the work is done in two years.", "All rights of the citizens were restored by the new law.",
    "The permission was granted free of charge to any person of the town.", "The software is provided by the school, and the copy is kept in the office.", "You may obtain a copy of the book at the office of the author.",
    "The following conditions are met by the new house.", "Researchers at MIT published a paper on robots.", "She studied physics at MIT and later got a driving license.", "MIT won the game.", "MIT students renewed the license of their radio station.",
    "Er fuhr mit der Lizenz nach Hause.", "Ein Lehrer mit Lizenz gab uns Unterricht.", "Nur mit gültiger Lizenz ist der Zutritt erlaubt.", "Boote mit einer Lizenz dürfen hier fahren.", "Das Auto mit dem Kennzeichen stand unter der Brücke.",
    "Mit dieser Lizenz darf er fischen.", "Wer mit ihm unter der Brücke stand, ist nicht bekannt.", "Sie fliegt mit Lizenz.", "Zutritt mit Lizenz frei.", "Lehrer mit Lizenz und Ausweis", "Wir fahren mit der neuen Lizenz und dem alten Boot.", "The Apache helicopter landed on the field.", "An Apache chief spoke to the crowd.", "The Apache web server was restarted at night.",
    "We moved our data from Apache Kafka to files.", "The Apache pilot renewed his license.", "Apache projects have many users under one roof.", "The BSD conference takes place in May.", "FreeBSD and other BSD systems run on old machines.",
    "The BSD kernel boots in two seconds, under load.", "Mozilla Firefox has a new version.", "User agent: Mozilla/5.0 (X11; Linux x86_64)", "Mozilla has a new public office, and the license to build.", "Please cc by mail all who were there.",
    "Cc: by order of the office", "The engine has 50 cc by measure.", "Creative Commons held its yearly meeting in Berlin.", "The creative commons room is on the left.", "A gpl file is a palette of colours in this program.",
    "The general public had no license to enter.", "The general public of the town was there.", "Public domain names were sold under the hammer.", "A debate about the public domain took place.", "The domain is open to the public on Sundays.",
    "All seats are reserved.", "The right to enter is reserved for members.", "All rights reserved for the king were lost in the war.", "These rights were reserved to the states.", "Rooms are reserved, all rights and wrongs aside.",
    "Alle Rechte der Bürger wurden vorbehalten, bis der Krieg kam.", "Tous les droits de la ville.", "Todos los derechos del pueblo.", "The MPL is a league of the town.", "He took the MPL bus home.", "LGPL and GPL were compared in a talk.",
    "He has a licence to fish, version or no version.", "The author says that the license was lost.", "Version 2.0 of the game is out.", "See the file for the terms of the contract.", "Licensed vendors may sell under the arcade.",
)
#: Words of names in other senses, and lines about what {} is.
SENSES = ("MIT", "Apache", "the Apache", "BSD", "the Mozilla", "Mozilla", "GPL", "the MPL", "Creative Commons", "the public domain", "public domain", "cc by", "the Unlicense", "the general public license")
CONTEXTS = (
    "The conference of {} takes place in May.", "A debate about {} took place.", "She works for {} and has a fishing license.", "He wrote a book on {}.", "{} researchers won the game.", "{} was founded in the year of the flood.",
    "We compared {} with others in a talk.", "The {} team renewed the license of its radio station.", "{} helicopters landed on the field.", "A chief of {} spoke to the crowd.", "The {} server was restarted at night.",
    "{} is a palette of colours.", "They took the {} bus home under heavy rain.", "The {} room is on the left.", "News from {} came in two versions.", "Read about {} in the terms of the contract.",
)
#: What a line has to name for a family to be confirmed, in words with one space between and around them.
NAMED = {
    "mit": r" (mit|expat) (?=.*(licen[cs]|lizenz))|(licen[cs]|lizenz).* (mit|expat) | (under|both) (the )?(mit|expat) ",
    "apache": r" apache ",
    "gpl": r"(?<! affero) (gnu |lesser )*(l?gpl(v?\d)*|general public licen[cs]e) ",
    "bsd": r" bsd ",
    "mozilla": r" (mozilla|mpl(v?\d)*) ",
    "creative_commons": r" (creative commons|cc by) ",
    "public_domain": r" (public domain|cc0|unlicense|gemeinfrei|domaine public|dominio público) ",
    "all_rights_reserved": r" (all rights (are )?reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados) ",
}
#: Of these a text in small letters has one at least if any of its lines names a family; the last two are patterns.
HINTS = ("licen", "lizenz", "apache", "gpl", "bsd", "mozilla", "mpl", "commons", "domain", "dominio", "cc0", "gemeinfrei", "reserved", "vorbehalten", "réservés", "reservados")
HINT_PATTERNS = (r"cc[^\p{L}\p{N}]+by", r"(under|both)[^\p{L}\p{N}]+(the[^\p{L}\p{N}]+)?(mit|expat)")
