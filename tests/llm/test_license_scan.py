from corpusflow.llm import license_scan as lic


def test_defined_cases(spark, table):
    mit = lic.SHORT["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (3, mit.replace(" ", "\n  ").replace("sublicense", "sub-license")),
        (4, mit + " more"), (5, None), (6, ""), (7, "Copyright 2021 A\n***"), (8, "released under the MIT Licence"), (8, "released under the MIT Licence"),
        (9, "x" * 300_000), (None, lic.SHORT["ISC"]), (11, "the copyright holder " + mit),
    ]
    got = sorted(((r["doc_id"] or 0, r["license_id"]) for r in lic.scan(table(rows)).collect()), key=str)
    want = [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, None), (8, "MIT-line"), (8, "MIT-line"), (9, None), (0, "ISC"), (11, None)]
    assert got == sorted(want, key=str)
    assert lic.scan(table([])).count() == 0


def test_plan_has_no_python(spark, table):
    plan = lic.scan(table([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan


def test_every_known_licence_is_found_as_it_is_commonly_copied(spark):
    rows, want = [], {}
    fields = "doc_id long, text string, digest string, license_id string, is_license boolean, known string"  # with names that the scan makes
    for i, (name, text) in enumerate(lic.known_licenses()):
        for k, copy in enumerate((text, "Copyright (c) 2019 A. Person\n\n" + text, text.upper().replace("\n", "\r\n"), "\n".join("    " + x for x in text.split("\n")))):
            rows.append((4 * i + k, copy, "d", "l", False, "k"))
            want[4 * i + k] = name
    extra = [(10**6, lic.known_licenses()[0][1] + " and one more word", "d", "l", True, "k")]
    got = {r["doc_id"]: r["license_id"] for r in lic.scan(spark.createDataFrame(rows + extra, fields)).collect()}
    assert got == want | {10**6: None}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"} <= set(want.values())
