"""Whole private keys are redacted, not only their headers."""

import random

import pytest

from kerbgrid.llm import secrets

RNG = random.Random(3)
LINES = ["".join(RNG.choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for _ in range(6)] + ["Zz9+/w=="]
HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
FIELDS = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123ABCD", ""]


@pytest.mark.parametrize("fields", [[], FIELDS])
@pytest.mark.parametrize("end", [[END], []])
@pytest.mark.parametrize("line", ["\n", "\r\n", "\\n", "\n  "])
def test_no_line_of_a_key_is_left(spark, fields, end, line):
    key = line.join([HEAD, *fields, *LINES, *end])
    text = f"Before.\n{key}\n\nAfter it, words."
    (kind, at, to), *more = [x for x in secrets.scan(text, secrets.Automaton()) if x[0] == "pem"]
    assert (kind, text[at:to], more) == ("pem", key, [])


def test_redacted_text_and_lone_header(spark):
    key = "\n".join([HEAD, *LINES, END])
    texts = [f"a {key} b", "\n".join([HEAD, *LINES]), f"The line {HEAD} starts a key, and words follow.", f"{key}\n{key}", f"{HEAD}\nAfter it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert out == {0: "a <secret> b", 1: "<secret>", 2: "The line <secret> starts a key, and words follow.", 3: "<secret>\n<secret>", 4: "<secret>\nAfter it"}
