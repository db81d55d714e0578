"""Phrasings as they stand in real files, with the labels that they should get."""

import pytest

from quire.llm import licenses
from quire.llm.license_sentences import SENTENCES

PHRASES = [
    ("BSD 3-Clause License", "bsd-3-clause"), ("BSD 2-Clause License", "bsd-2-clause"), ("BSD-3-Clause", "bsd-3-clause"), ("BSD 3-Clause \"New\" or \"Revised\" License", "bsd-3-clause"),
    ("BSD 2-Clause \"Simplified\" License", "bsd-2-clause"), ("the new BSD license", "bsd-3-clause"), ("3-clause BSD license", "bsd-3-clause"), ("BSD 4-Clause", "bsd-4-clause"), ("Zero-Clause BSD", "0bsd"),
    ("Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions", "bsd"), ("Redistributions of source code must retain the above copyright notice", "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("https://opensource.org/licenses/BSD-3-Clause", "bsd-3-clause"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("All advertising materials mentioning features or use of this software must display the following", "bsd-4-clause"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("Apache License 2.0", "apache,apache-2.0"), ("Apache License, Version 2.0 (the \"License\")", "apache,apache-2.0"), ("Apache-2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License.", "apache-2.0"), ("Apache Software License 1.1", "apache-1.1"), ("licensed under the Apache 2.0 license", "apache"),
    ("released under GPL version 3", "gpl-3.0"), ("GPLv3", "gpl-3.0"), ("GPLv2 or later", "gpl-2.0"), ("GPL-2.0-only", "gpl-2.0"), ("LGPL v2.1", "lgpl-2.1"), ("LGPLv3", "lgpl-3.0"), ("AGPLv3", "agpl-3.0"),
    ("GNU General Public License v3.0", "gpl,gpl-3.0"), ("GNU Affero General Public License", "agpl"), ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"), ("https://www.gnu.org/licenses/agpl-3.0.txt", "agpl-3.0"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl,gpl-2.0"),
    ("the terms of the GNU Lesser General Public License as published by\n    the Free Software Foundation; either version 2.1", "lgpl,lgpl-2.1"),
    ("This program is free software: you can redistribute it and/or modify it", "gpl"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "bsl-1.0"), ("http://www.boost.org/LICENSE_1_0.txt", "bsl-1.0"), ("Eclipse Public License - v 2.0", "epl-2.0"), ("Eclipse Public License v1.0", "epl-1.0"),
    ("https://www.eclipse.org/legal/epl-2.0/", "epl-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("MPL-2.0", "mpl-2.0"), ("http://mozilla.org/MPL/2.0/", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("For more information, please refer to <http://unlicense.org/>", "unlicense"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"), ("MIT-0", "mit-0"), ("https://opensource.org/licenses/MIT", "mit"), ("the Expat license", "mit"),
    ("Altered source versions must be plainly marked as such", "zlib"), ("The Software shall be used for Good, not Evil.", "json"), ("Artistic License 2.0", "artistic-2.0"), ("European Union Public Licence v. 1.2", "eupl-1.2"),
    ("Common Development and Distribution License (CDDL) Version 1.1", "cddl-1.1"), ("Open Software License version 3.0", "osl-3.0"), ("MS-PL", "ms-pl"), ("CC0 1.0 Universal", "cc0-1.0"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"), ("CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("http://opendatacommons.org/licenses/odbl/1.0/", "odbl-1.0"), ("SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007", "ofl-1.1"), ("http://scripts.sil.org/OFL", "ofl-1.1"), ("Open Government Licence v3.0", "ogl-uk-3.0"),
    ("Business Source License 1.1", "busl-1.1"), ("Server Side Public License (SSPL) version 1", "sspl-1.0"), ("Elastic License 2.0", "elastic-2.0"), ("Commons Clause", "commons-clause"), ("Llama 2 Community License", "llama"),
    ("All rights reserved.", "all-rights-reserved"),
]
PLAIN = ["The quick brown fox", "smpl 20 and gplusv3 templates", "the boost of 2.0 percent", "an elastic band", "he was called m. s. pl", "the license plate", "complimentary drinks", "a mit in Boston", "bsdx 3-clausex"]


@pytest.mark.parametrize("text,labels", PHRASES)
def test_phrase(text, labels):
    assert licenses.scan(f"See: {text}\n")["labels"] == labels


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_has_no_label(text):
    assert licenses.scan(text)["labels"] == ""


def test_each_gate_holds_a_word_of_its_matches():
    low = [licenses.unwrapped(licenses.lowered(t)) for t, _ in PHRASES]
    used = set()
    for label, _, pattern, gate in SENTENCES:
        for t in low:
            for m in licenses.re.finditer(pattern, t):
                used.add((label, pattern))
                assert any(w in m[0] for w in gate.split("|")), (label, m[0])
    assert len(used) > 45
