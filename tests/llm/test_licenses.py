from paywarden.llm.licenses import KNOWN, scan_licenses
from tests.llm.helpers import documents, empty

MIT = next(t for n, t in KNOWN if t.startswith("Permission is hereby"))


def test_whole_texts_match_in_any_spelling(spark):
    texts = [
        MIT, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ,"),
        "MIT Licence\n\n(c) 1999 me\n" + MIT.replace("Software", "software").replace(" to ", "\n to "), MIT + " more", None, "",
    ]
    got = {r["doc_id"]: r["text_license"] for r in scan_licenses(documents(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}


def test_notices_are_lines(spark):
    texts = ["words\nReleased under the MIT License.\nmore", "RELEASED UNDER THE MIT LICENCE\nLicensed under CC BY-NC 4.0.\n", "we released it under the MIT License."]
    rows = {r["doc_id"]: (r["notice_licenses"], r["n_notices"]) for r in scan_licenses(documents(spark, texts)).collect()}
    assert rows == {0: ("MIT", 1), 1: ("CC-BY-NC-4.0,MIT", 2), 2: (None, 0)}


def test_odd_rows(spark):
    assert scan_licenses(empty(spark)).count() == 0
    assert scan_licenses(documents(spark)).where("n_notices > 0 OR text_license IS NOT NULL").count() == 0
    null_id = documents(spark, [MIT]).selectExpr("cast(null as bigint) doc_id", "text")
    assert [r["text_license"] for r in scan_licenses(null_id).collect()] == ["MIT"]


def test_no_python_on_the_main_path(spark):
    plan = scan_licenses(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_full_texts_and_heads(spark, tmp_path):
    from pathlib import Path

    from paywarden.llm import licenses
    from paywarden.llm.queries import QUERIES

    folder = Path(licenses.__file__).parent / "license_texts"
    names = sorted(f.stem for f in folder.glob("*.txt"))
    full = [(folder / f"{n}.txt").read_text() for n in names]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(names)
    flat = ["\n\n".join(" ".join(p.split()) for p in t.split("\n\n")) for t in full]
    head = "/*\n * Copyright 2020 X\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program\n */"
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n'
    documents(spark, [*full, *flat, head, apache, full[0][:3000]]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()}
    n = len(names)
    assert [rows[k]["text_license"] for k in range(2 * n)] == names * 2
    assert (rows[2 * n]["notice_licenses"], rows[2 * n]["n_notices"]) == ("GPL-3.0", 1)
    assert rows[2 * n + 1]["notice_licenses"] == "Apache-2.0" and rows[2 * n + 2]["text_license"] is None
    mine = spark.createDataFrame([("Own", "My\nterms")], "license string, text string")
    mine.write.parquet(f"{tmp_path}/known")
    got = scan_licenses(documents(spark, ["my terms"]), known=spark.read.parquet(f"{tmp_path}/known")).first()
    assert got["text_license"] == "Own"
