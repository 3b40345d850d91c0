"""Opening and grant sentences of public licences, short notices, and sentences that are no licence."""

#: family -> texts as their licensors publish them (leading parts) and the usual short notices
FAMILIES: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
        "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
        "Dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.", "Available under CC BY 3.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.", "Available under CC BY-NC-SA 4.0 for noncommercial use.",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ],
}

#: sentences with words of licences that are none
OTHER: list[str] = [
    "He renewed his driving license at the city office.", "The general made the plan public on Monday.", "Free software classes are held in the public library.",
    "The software was distributed to all schools with a copy of the manual.", "Please read the terms and conditions of sale before you order.", "The warranty of the washing machine covers two years.",
    "A fishing license costs ten dollars in this state.", "You may obtain a copy of the report from the clerk.", "The foundation published a version of the list.",
    "The creative director left the house of commons.", "Permission to enter the building was granted by the guard.", "Any person without a ticket may use the side door.",
    "The public domain is a legal notion that differs between countries.", "The liquor license of the bar was revoked.", "The file contains the source code of the game and its documentation.",
    "Attribution of the painting is disputed.", "The international committee released version 2.0 of its guide.", "The distribution of the medicine is subject to law.",
    "Mozilla and Apache are names of well known projects.", "The eclipse was visible in the north.", "The university of MIT published a paper on computers.",
    "Copies of the book were sold under the counter.", "The pilot lost his license after the accident.", "The work was done under the direction of the author.",
    "Modify the recipe as you like and use any sugar.", "Commercial use of the hall requires a permit.", "The rights of the child are universal.", "The notice shall appear on the door.",
    "Redistribution of wealth was the topic of the debate.", "All source material is kept in binary form on the server.", "All rights reserved.", "Copyright 2019 by the publisher, all rights reserved.",
    "Unless required by the doctor, do not use this product.", "The gnu is an antelope of the plains.", "This project is led by the town.", "Available at all shops for 4.0 dollars.",
]

#: words that alone say nothing; features of such words only are left out
COMMON: list[str] = """a an the of to in on at by for from with and or but as is are was be been it its this that these those you your he his her they
their we our i not no any all may can if which who what when will would shall must do does has have had there here use used work works new one two
than then so such other out up only very more most into over under after before about each both also how""".split()
