"""The licence scan on a written list that no template and no way of the training makes."""

import pytest

from chemloom.llm import licenses

GRANTS = [
    ("This project is licensed under the MIT License.", "MIT"),
    ("The code in this repository is released under the MIT License.", "MIT"),
    ("This dataset is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance\nwith the License.', "Apache-2.0"),
    ("Our tool is released under the GNU General Public License, version 3.", "GPL-3.0"),
    ("The library is licensed under the GNU Lesser General Public License, version 3.", "LGPL"),
    ("The server is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("All code here is licensed under the BSD 3-Clause License.", "BSD"),
    ("The source is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("The manual is licensed under CC BY-SA 4.0.", "CC-BY"),
    ("The pictures are licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("The text is dedicated to the public domain under CC0 1.0.", "Public-domain"),
    ("All rights reserved.", "Proprietary"),
]
OTHERS = [
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
    "You may not use code licensed under the MIT License in this project.",
    "Nothing here is licensed under the Apache License, Version 2.0.",
    "The court asked whether the dataset was released under the MIT License.",
    "If the work were licensed under CC BY 4.0 we could share it; it is not.",
    "Could it be that this is licensed under the BSD 3-Clause License?",
    "We never released it under the Mozilla Public License, version 2.0.",
    "The committee compared the Apache License and the MIT License.",
    "Licensed under the Apache License, Version 1.1.",
    "Neither file is distributed under the Boost Software License, Version 1.0.",
    "It would have been licensed under the zlib License by then.",
    "Her driving licence was released to the office in version 2 of the form.",
    "The general public reads free software magazines under the terms of the club.",
]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return licenses.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 4000)


def scanned(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in licenses.scan(docs, model=model).orderBy("id").collect()]


def test_grants_are_confirmed(spark, model):
    got = scanned(spark, model, [t for t, _ in GRANTS])
    right = [r["confirmed"] and r["family"] == f for r, (_, f) in zip(got, GRANTS)]
    assert sum(right) >= 0.9 * len(GRANTS), [t for ok, t in zip(right, GRANTS) if not ok]


def test_no_grant_is_confirmed(spark, model):
    got = scanned(spark, model, OTHERS)
    assert not [t for r, t in zip(got, OTHERS) if r["confirmed"]]


def test_sentences_beside_a_notice_do_not_matter(spark, model):
    texts = ["Is it fast?\nLicensed under the MIT License.\nWe do not sell it.", "Version 7 is out now. Released under the MIT License."]
    assert [(r["family"], r["confirmed"]) for r in scanned(spark, model, texts)] == [("MIT", True)] * 2
