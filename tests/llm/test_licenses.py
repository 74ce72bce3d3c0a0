"""Keywords are implied by their rules."""

import re

from linewright.llm import licenses


def test_rules_imply_their_keyword():
    """The literal text of a rule holds its keyword."""
    for keyword, pattern, *_ in licenses.signature_rules():
        plain = pattern
        while (shorter := re.sub(r"\((?:\?:)?[^()]*\)\??", "\0", plain)) != plain:
            plain = shorter
        plain = re.sub(r".\?", "\0", plain.replace("licen[sc]e", "license"))
        assert keyword in plain or keyword in pattern, (keyword, pattern)


def test_gnu_gpl_grant(spark):
    docs = spark.createDataFrame([(1, "Licensed under the GNU GPL"), (2, "licensed under the GNU GPL version 3")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs, keep=["doc_id"]).collect()}
    assert [(rows[i]["labels"], rows[i]["score"]) for i in (1, 2)] == [("gpl", 0.9), ("gpl-3", 1.0)]
    assert rows[1]["found"][0]["first"] == 0
