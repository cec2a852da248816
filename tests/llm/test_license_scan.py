import re

import cases

from quillpack.llm import license_scan as S


def brute(text):
    """Every rule on every text, and settling by comparing all pairs."""
    rules = S.read_rules()
    low = re.sub(S._GAP, " ", text.lower())
    found = sorted(
        {(m.start(), m.end(), r.number) for r in rules if any(k in low for k in r.keywords) for m in r.pattern.finditer(text) if m.end() > m.start()},
        key=lambda d: (-rules[d[2]].priority, d[0] - d[1], d[0], d[2]),
    )
    kept = []
    for s, e, r in found:
        if not any((a <= s and e <= b) or (s <= a and b <= e) for a, b, _ in kept):
            kept.append((s, e, r))
    return sorted(kept)


def names(text):
    return [S.read_rules()[n].license for _, _, n in S.scan_text(text)]


def test_there_are_hundreds_of_rules():
    rules = S.read_rules()
    assert len(rules) >= 200 and len({r.license for r in rules}) >= 100
    assert all(r.keywords for r in rules)


def test_licences():
    assert names("Released under the MIT License.") == ["MIT"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("// Licensed under the Apache License,\n// Version 2.0 (the License)") == ["Apache-2.0"]
    assert names("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0-or-later"]
    assert names("under the GNU Lesser General Public License, version 2.1") == ["LGPL-2.1"]
    assert names("Mozilla Public License, v. 2.0 and the zlib license") == ["MPL-2.0", "Zlib"]
    assert names("a mitigation without any licence") == []


def test_keywords_run_over_line_ends_and_comment_marks():
    assert names("/* Licensed under the  Apache\n * License, Version 2.0 */") == ["Apache-2.0"]
    assert names("# Mozilla Public\n# License, v. 2.0") == ["MPL-2.0"]
    assert names("// the MIT\r\n// License") == ["MIT"]


def test_settling():
    rules = S.read_rules()
    by = {r.priority: r.number for r in rules}
    high, low = by[95], by[40]
    assert S.settle([(0, 10, low), (2, 5, high)], rules) == [(2, 5, high)]
    assert S.settle([(0, 6, low), (4, 9, high)], rules) == [(0, 6, low), (4, 9, high)]
    assert S.settle([(0, 6, high), (0, 6, high)], rules) == [(0, 6, high)]
    assert S.settle([], rules) == []


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, s, e, n) for r in docs.collect() for s, e, n in brute(r.text))
    got = sorted((r.doc_id, r.start, r.stop, r.rule) for r in S.scan_licenses(docs).collect())
    assert got == want and len(want) > 20


def test_dense_text_is_settled_as_by_brute_force():
    text = "MIT License, Apache License 2.0; gplv3 or later. All rights reserved. " * 40 + "released under the MIT license\n"
    assert S.scan_text(text) == brute(text)


def test_awkward_rows(spark):
    docs = cases.awkward(spark).unionByName(cases.documents(spark, [(None, "MIT License"), (20, cases.LONG + "MIT License"), (21, "MIT License"), (21, "MIT License")]))
    got = sorted(((r.doc_id, r.matched, r.start) for r in S.scan_licenses(docs).collect()), key=str)
    assert got == sorted([(None, "MIT License", 0), (20, "MIT License", len(cases.LONG)), (21, "MIT License", 0), (21, "MIT License", 0)], key=str)
    assert cases.same(S.scan_licenses(cases.crowded(docs)), S.scan_licenses(docs))
    assert S.scan_licenses(cases.empty(spark)).count() == 0


def test_keywords_are_no_narrower_than_their_expressions():
    for text in ("GPLv3 or later", "GPLv2 or later", "GPL v2+", "GPL version 3 or later", "GPL 3", "GPL3", "GPL-v3", "the zlib licence", "the MIT licence"):
        rules = S.read_rules()
        found = [(m.start(), m.end(), r.number) for r in rules for m in r.pattern.finditer(text) if m.end() > m.start()]
        assert found and S.scan_text(text) == S.settle(found, rules), text
