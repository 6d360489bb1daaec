"""Licence notices, and phrases without which a notice is none."""

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, text, phrases that must stand in it)
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("free of charge", "obtaining a copy")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        ("redistribution and use", "source and binary forms"),
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", ("with or without fee",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED""",
        ("without restriction", "substantial portions of the software"),
    ),
    (
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ("redistributions of source code", "redistributions in binary form"),
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
        ("endorse or promote products", "prior written permission"),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
        ("including commercial applications", "redistribute it freely"),
    ),
    (
        "bsl-1.0",
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt",
        ("boost software license",),
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
        ("general public license", "free software foundation", "version 3 of the license"),
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
        ("general public license", "free software foundation", "version 2 of the license"),
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation""",
        ("lesser general public license", "free software foundation"),
    ),
    (
        "agpl",
        """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version""",
        ("affero general public license", "free software foundation"),
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
        ("source code form", "mozilla public license"),
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        ("apache license", "required by applicable law"),
    ),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
        this work""",
        ("waived all copyright",),
    ),
)

#: Identifiers of the SPDX licence list and their labels here.
SPDX = {
    "MIT": "mit",
    "Apache-2.0": "apache-2.0",
    "GPL-2.0-only": "gpl-2.0",
    "GPL-2.0-or-later": "gpl-2.0",
    "GPL-3.0-only": "gpl-3.0",
    "GPL-3.0-or-later": "gpl-3.0",
    "LGPL-2.1-only": "lgpl",
    "LGPL-2.1-or-later": "lgpl",
    "LGPL-3.0-only": "lgpl",
    "LGPL-3.0-or-later": "lgpl",
    "AGPL-3.0-only": "agpl",
    "AGPL-3.0-or-later": "agpl",
    "MPL-2.0": "mpl-2.0",
    "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd-3-clause",
    "ISC": "isc",
    "Zlib": "zlib",
    "BSL-1.0": "bsl-1.0",
    "Unlicense": "unlicense",
    "CC0-1.0": "cc0",
    "CC-BY-4.0": "cc-by",
    "CC-BY-SA-4.0": "cc-by-sa",
    "CC-BY-NC-4.0": "cc-by-nc",
    "EPL-2.0": "epl-2.0",
    "Artistic-2.0": "artistic-2.0",
    "0BSD": "bsd",
    "WTFPL": "wtfpl",
    "Python-2.0": "python-2.0",
}
