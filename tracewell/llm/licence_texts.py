"""Texts from which the licence classifier learns. All are fixed values: public notices as they are commonly written."""

_AS_IS_CAPS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'

# Notices by which licences are declared, by family.
FAMILIES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Affero General Public License v3.0.", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only", "License: AGPL-3.0",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "This project is licensed under the Apache License 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Distributed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD-3-Clause",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003", "Licensed under the Boost Software License 1.0.", "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This article is distributed under the terms of the Creative Commons Attribution License (CC BY 4.0).",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.", "https://creativecommons.org/licenses/by/4.0/", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "You may share this material for noncommercial purposes under CC BY-NC.", "https://creativecommons.org/licenses/by-nc/4.0/", "SPDX-License-Identifier: CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.", "https://creativecommons.org/licenses/by-nd/4.0/", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "https://creativecommons.org/licenses/by-sa/4.0/", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "https://creativecommons.org/publicdomain/zero/1.0/", "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GPL v2 or later.", "Released under the GNU GPLv3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0", "License: GPL-3.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES',
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library", "Licensed under the LGPL v3.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "License: LGPL-2.1", "License: LGPL-3.0",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS_CAPS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This project is licensed under the MIT License - see the LICENSE file for details.", "The MIT License (MIT) Copyright (c) 2020 the authors", "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.", "The contents of this file are subject to the Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. Unauthorized copying of this file, via any medium is strictly prohibited.",
        "This document contains confidential and proprietary information and may not be reproduced without the express written consent of the owner.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The author hereby places this file in the public domain.", "This code is in the public domain.", "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "Licensed under the zlib license.", "SPDX-License-Identifier: Zlib",
    ),
}

# Lines that speak of licences without granting a known one.
UNKNOWN_LINES = (
    "Licensed under the terms below.", "See the LICENSE file for details.", "The license of this project is given elsewhere.", "This software is released under a custom license.", "License: see the website.", "Distributed under our own license.",
    "SPDX-License-Identifier: LicenseRef-Custom", "Use of this software is subject to the license agreement that accompanies it.", "By installing this software you accept the terms of the license.", "Please read the license terms before you use this file.",
    "For licensing information contact the authors.", "The following license applies to this file only.", "Licensed for internal evaluation only.", "Copyright 2019 the authors. See the file COPYING for the license.", "Redistribution is subject to the terms of the agreement.",
)

# Running text with words of licences.
PLAIN_LINES = (
    "the license plate of my car was stolen last week", "he lost his driving license and had to pay a fine", "MIT is a university in Cambridge", "students at MIT and Stanford took part in the study", "the public domain of the function is all real numbers",
    "she has permission to leave the hospital", "a copy of the letter was found in the archive", "the software industry grew again this year", "all human beings are born free and equal in rights", "the rights of workers were discussed in the public session",
    "the warranty of the washing machine ran out in May", "the committee granted the request without conditions", "the general election was held in public", "the apache helicopter landed on the field", "the eclipse of the sun was seen by many people",
    "he wrote the software in one night and gave it away", "mit der Bahn fahren wir nach Hause", "die Lizenz zum Fischen kostet zehn Euro", "le permis de conduire est valable dix ans", "los derechos de los vecinos fueron tratados en la sesion",
    "fishing without a license is forbidden in this river", "the commission published the terms of the contract", "an implied threat was heard in his words", "the notice on the door said closed", "the restaurant has a license to sell wine", "source of the river is in the mountains", "the binary star was discovered in 1899",
    "in no event should you open the door", "the author of the book lives in Paris", "the creative director left the company", "commons are lands that all may use", "free of charge for children under six", "subject to change at any time", "a liable person must pay the damages",
    # who holds the rights, which heads notices of all families and grants nothing
    "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Copyright (c) 2011 the company. All rights reserved.", "(c) 2020. All rights reserved.",
)

# Words of running text, which alone tell nothing about licences. Every feature has a word beyond them.
FILLERS = (
    "the", "of", "this", "see", "file", "for", "details", "project", "and", "code", "documentation", "by", "authors", "is", "a", "in", "under", "terms", "work", "version",
    "use", "with", "public", "general", "software", "source", "rights", "free", "copy", "form", "name", "note", "page", "data", "people", "new", "time", "found", "may", "not",
    "to", "be", "can", "that", "or", "are", "it", "you", "any", "on", "an", "as", "at", "from", "has", "been", "no", "all", "into", "without", "via", "person", "met", "following",
    "forms", "files", "these", "its", "i", "v", "s", "c", "e", "o", "de", "en", "la", "le", "un", "der", "die", "und", "el", "y", "que", "es", "se", "del", "0", "1", "2", "3", "4",
    "mit", "von", "zu", "den", "das", "ist", "im", "auf", "ein", "eine", "nicht", "les", "des", "et", "du", "une", "est", "pour", "dans", "los", "las", "con", "por", "para", "una",
    "he", "she", "they", "we", "was", "were", "had", "have", "which", "who", "one", "two", "will", "would", "there", "their", "more", "but", "if", "when", "so", "up", "out", "about",
)
