"""Every licence family against every other, on one line, wrapped, and among other words."""

from __future__ import annotations

import random
import textwrap
from collections import Counter

from saleroom.llm import licenses
from tests.llm.test_methods import DOCS, words

# Notices as files carry them; none is a template word for word unless the licence fixes its words.
NOTICES = {
    "apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',),
    "apache-1.1": ("This code is licensed under the Apache Software License, Version 1.1, a copy of which is included.",),
    "gpl-3.0": ("Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl-2.0": (
        "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "agpl-3.0": (
        "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "This project is licensed under the MIT License.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "SPDX-License-Identifier: ISC"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."),
    "bsd-2": ("This package is licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed",),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "cc-by": ("This book is licensed under a Creative Commons Attribution 4.0 International License.", "Text licensed under CC BY 4.0"),
    "cc-by-sa": ("This book is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text licensed under CC BY-SA 4.0"),
    "cc-by-nd": ("This book is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Text licensed under CC BY-ND 4.0"),
    "cc-by-nc": ("This book is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Text licensed under CC BY-NC 4.0"),
    "cc-by-nc-sa": ("This book is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Text licensed under CC BY-NC-SA 4.0"),
    "cc-by-nc-nd": ("This book is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Text licensed under CC BY-NC-ND 4.0"),
    "cc0": ("Released into the public domain under CC0 1.0.",),
    "all-rights-reserved": ("Copyright 2020 Foo Inc. All rights reserved.",),
}
PLAIN = (
    "The Mozilla team released a public statement under pressure", "SPDX-License-Identifier: Zlib", "Permission to use the pool is granted by the manager",
    "The general public was free to modify the terms", "GNU and Apache are names of software projects", "He has a driving licence, version unknown",
)


def test_families_are_told_apart(spark, frame):
    rng = random.Random(5)
    rows, wanted = [], {}
    for family, texts in NOTICES.items():
        for notice in texts:
            forms = [notice, notice.lower(), "\n".join(textwrap.wrap(notice, 60)), "# " + "\n# ".join(textwrap.wrap(notice, 45))]
            forms.append(f"{' '.join(words(6, rng.randrange(999)))} {notice} {' '.join(words(6, rng.randrange(999)))}")
            for form in forms:
                rows.append((len(rows), f"Some first words\n\n{form}\n\nand some last ones"))
                wanted[len(rows) - 1] = family
    for line in PLAIN:
        rows.append((len(rows), line))
    model = licenses.trained([" ".join(words(12, k)) for k in range(400)])
    found = licenses.licences(frame(DOCS, *rows), model).collect()
    assert not [r for r in found if r["doc_id"] not in wanted]
    confused = Counter((wanted[r["doc_id"]], r["family"]) for r in found if wanted[r["doc_id"]] != r["family"])
    right = {r["doc_id"] for r in found if wanted[r["doc_id"]] == r["family"]}
    missed = [(wanted[k], rows[k][1]) for k in wanted if k not in right]
    print(len(right), len(wanted), confused, missed)
    assert sum(confused.values()) <= 0.05 * len(found)
    assert len(right) >= 0.95 * len(wanted), missed
