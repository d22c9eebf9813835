"""Licence notices over several lines."""

from __future__ import annotations

from saleroom.llm import licenses
from tests.llm.test_methods import DOCS, words


def test_wrapped_notices_are_found(spark, frame):
    rows = [
        (1, "A tool\n\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation"),
        (2, 'Licensed under the Apache\nLicense, Version 2.0 (the "License");\nyou may not use this file'),
        (3, " Permission is hereby\ngranted, free of charge,\nto any person\nobtaining a copy\nof this software"),
        (4, "All rights\n\nreserved"),
        (5, "Released under the MIT License.\nReleased under the MIT License."),
    ]
    model = licenses.trained([" ".join(words(12, k)) for k in range(400)])
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.licences(frame(DOCS, *rows), model).collect()}
    assert found == {(1, 1, "gpl-3.0"), (2, 0, "apache-2.0"), (3, 0, "mit"), (5, 0, "mit"), (5, 1, "mit")}
