"""Passages of public licences that a licence scan looks for, as fixed values.

A template is a passage with the label it stands for and the key phrases that
must stand in it word by word. Phrases of the base search are looked for as
they are.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Label -> phrase, found only word by word.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

TEMPLATES = (
    Template("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""", ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    Template("apache-2", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
             ("apache license version 2 0", "except in compliance with the license")),
    Template("bsd-2-clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
             ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("bsd-3-clause", """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
             ("may be used to endorse or promote products", "without specific prior written permission")),
    Template("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
             ("for any purpose with or without fee is hereby granted",)),
    Template("gpl-3", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""", ("gnu general public license as published", "version 3 of the license")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.",
             ("gnu general public license version 3",)),
    Template("gpl-2", """
        This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version.""", ("gnu general public license as published", "version 2 of the license")),
    Template("lgpl-2.1", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version.""", ("gnu lesser general public license", "version 2 1 of the license")),
    Template("agpl-3", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""", ("gnu affero general public license", "version 3 of the license")),
    Template("mpl-2", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
             ("mozilla public license v 2 0",)),
    Template("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
             ("free and unencumbered software released into the public domain",)),
    Template("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions""", ("to alter it and redistribute it freely",)),
    Template("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
             ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4", """
        This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
             ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc-4", """
        This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
             ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nc-4", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc0-1", """
        To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work. CC0 1.0 Universal""", ("waived all copyright and related or neighboring rights",)),
)
