"""Licenses whose texts and notices stand on several lines."""

import textwrap

from tessera.llm import license_scan


def test_texts_and_wrapped_notices(spark):
    own = dict(license_scan.texts())
    again = lambda t, width: "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in t.split("\n\n"))
    rows = [
        (1, f"Copyright (c) 2020 me\n\n{own['MIT']}"),
        (2, "first\n" + "\n".join(f"# {x}" for x in own["BSD-3-Clause"].splitlines()) + "\nlast"),
        (3, f"code\n{again(own['MIT'], 60)}\nmore\n{own['BSD-2-Clause']}"),
        (4, "text\nThis work is licensed under the GNU\nGeneral Public License, version 2.\nmore"),
        (5, "Released under\nthe MIT License yesterday"),
        (6, "Released\nunder the MIT License.\nReleased under the MIT License."),
        (7, own["MIT"].replace("charge", "cost")),
    ]
    got = {r[0]: tuple(r)[1:] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT", 1), 2: (None, "BSD-3-Clause", 1), 3: (None, "BSD-2-Clause,MIT", 2), 4: (None, "GPL-2.0", 1), 5: (None, "", 0), 6: (None, "MIT", 2), 7: (None, "", 0)}
    rows = [(i, f"before\n{t}\nafter") for i, t in enumerate(own.values())]
    got = {r.doc_id: r.line_licenses for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(own))
