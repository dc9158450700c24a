import pytest

from runlens.llm import licences
from runlens.llm.blocks import table


@pytest.fixture(scope="module")
def model(spark, sf):
    return licences.train(table(spark, sf, "documents"))


CASES = [
    (0, "Some prose.\nReleased under the MIT License.\nMore prose.", ["mit"]),
    (1, "licensed under the Apache License version 2.0\nAll rights reserved.", ["all-rights-reserved", "apache-2.0"]),
    (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction", ["mit"]),
    (3, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", ["gpl"]),
    (4, "you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lgpl"]),
    (5, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met", ["bsd"]),
    (6, "She had a licence to drive, and the public was general in its praise of the software.", []),
    (7, "The license of the restaurant was revoked under the terms of the city.", []),
    (8, "", []),
    (9, None, []),
    (10, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    (11, "\n\n\n", []),
    (None, "SPDX-License-Identifier: Apache-2.0", ["apache-2.0"]),
    (0, "Released under the MIT License.", ["mit"]),
]


def test_families(spark, model):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t, _ in CASES], "doc_id long, text string, found string, place int")
    got = sorted((str(r.doc_id), r.families, r.n_paragraphs) for r in licences.scan(docs, model).collect())
    assert got == sorted((str(i), f, len((t or "").split("\n"))) for i, t, f in CASES)


def test_documents_against_lines(spark, sf, model):
    docs = table(spark, sf, "documents")
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "All rights reserved.": "all-rights-reserved",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
    }
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in licences.scan(docs, model).collect():
        assert r.families == sorted({lines[x] for x in texts[r.doc_id].split("\n") if x in lines})


def test_empty_table(spark):
    assert licences.licence_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_has_no_python(spark, sf, model):
    plan = licences.scan(table(spark, sf, "documents"), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


WRAPPED = [
    ("mit", "MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
    ("bsd", "BSD 3-Clause License\n\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n#\n# 1. Redistributions of source code must retain the above copyright notice"),
    ("gpl", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope"),
    ("apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0"),
]


def test_wrapped_notices(spark, model):
    rows = [(2 * i + k, "import this\n" * (5 * k) + "\n" * k + t) for i, (_, t) in enumerate(WRAPPED) for k in (0, 1)]
    got = {r.doc_id: r.families for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {2 * i + k: [f] for i, (f, _) in enumerate(WRAPPED) for k in (0, 1)}
