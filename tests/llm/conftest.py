import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

#: a table with nulls in any column, empty and long texts, ties, repeated rows and clashing names
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(f"x{i % 97}y{i % 89}" for i in range(30_000))
PASSAGE = " ".join(WORDS)
ODD = [
    (0, f"{PASSAGE} first ending here\nline\nline\n", "a"),
    (1, f"start {PASSAGE} other", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \n\t \x0b ", "b"),
    (5, LONG, "b"),
    (5, LONG, "b"),
    (6, "one two", "b"),
    (7, "One TWO", None),
    (8, "café  x   GPL", "c"),
    (9, PASSAGE, None),
    (None, PASSAGE, "a"),
    (None, None, None),
    (10, f"{PASSAGE} first ending here\nline\nline\n", "a"),
    (11, " ".join([*WORDS, "MIT", "License", "cc", "by", "cc", "by"]), "c"),
    (12, "// SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause\nmit license", "c"),
    (12, "another text of the same id", "c"),
]
EXTRA = "batch STRING, size INT, shards STRING, last INT, row INT, prefix INT, n_chars BIGINT"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, s, "z", 1, None, 2, i, None, len(t) if t else None) for i, (d, t, s) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id BIGINT, text STRING, source STRING, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(0, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (5, 1, 0), (6, 0, 1), (6, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id BIGINT, quality INT, toxic INT")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"doc_id BIGINT, text STRING, source STRING, {EXTRA}")
