"""Secret, personal-data, license, language, media and WARC operators against plain versions."""

import hashlib
import random
import re
import zlib

import pytest

from kerbgrid.llm import langid, licenses, media, pii, secrets, warc

ODD = [(1, None), (2, ""), (3, " \n"), (4, "é" * 3), (5, "x" * 70_000), (6, "a b c"), (6, "a b c"), (None, "no id token=abcdefghijklmnop")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame([(i, t, "x", 5, 3) for i, t in ODD], "doc_id long, text string, spans string, n long, tid int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


SECRETS = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def plain_spans(text, rules):
    found = [(m.start(), i, k, m.end()) for i, (k, (r, ok)) in enumerate(rules.items()) for m in r.finditer(text) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets_equal_regular_expressions():
    machine, rng = secrets.Automaton(), random.Random(1)
    parts = ["password", "passwd", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "=", ":", "abcdef012345", "AKIA", "AKIAABCDEFGHIJKLMN", "é", "x", "="]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = [x for x in secrets.scan(text, machine) if x[0] in secrets.BASE]
        assert got == plain_spans(text, SECRETS), text


def test_minimised_automaton_has_no_equal_states():
    rows, marks = secrets.minimise(*secrets.determinise(*_nfa("(ab|cb)+x"), True))
    assert len({(m, tuple(r)) for r, m in zip(rows, marks)}) == len(rows)


def _nfa(pattern):
    nfa = secrets.Nfa()
    start = nfa.new()
    return nfa, start, {nfa.add(secrets.Expression(pattern).tree, start): 0}


def test_redaction_takes_effect(spark, odd):
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(odd).collect()}
    assert out[None] == "no id <secret>" and out[1] is None and out[5] == ODD[4][1]
    assert secrets.redacted(odd).columns == odd.columns


def _luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


_n = lambda m: len(re.sub("[^0-9]", "", m[0]))
PERSONAL = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= _n(m) <= 19 and _luhn(re.sub("[^0-9]", "", m[0]))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= _n(m) <= 15),
}


def test_personal_data_equals_regular_expressions():
    anchors, rng = pii.machine(), random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", " ", "-", "1", "255", "+1", "0", "4111111111111111", "(", ")", "x@y.z", "é", "İ", "%", "1.2.3.4", "iban: ", "https://", "ssn ", "123-45-6789"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = [x for x in pii.parse(text, anchors) if x[0] in pii.BASE]
        assert got == plain_spans(text, PERSONAL), text


def test_added_kinds():
    text = "My IBAN: GB82 WEST 1234 5698 7654 32, ssn 123-45-6789 https://a.b/c?d. account no. 12345678"
    got = [(k, text[s:e]) for k, s, e in pii.parse(text, pii.machine())]
    assert got == [("account", "GB82 WEST 1234 5698 7654 32"), ("account", "123-45-6789"), ("url", "https://a.b/c?d"), ("account", "12345678")]


@pytest.mark.parametrize("report", [secrets.secret_report, pii.personal_report, licenses.license_report, media.media_report, langid.language_report])
def test_odd_and_empty_tables(spark, odd, empty, report):
    rows = report(odd.selectExpr("*", "'en' AS lang")).collect()
    assert len(rows) == len(ODD)
    assert report(empty).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string, lang string").schema
    assert report(spark.createDataFrame([(7, None, None)], none)).count() == 1


def test_licenses_equal_a_plain_scan(spark):
    texts = ["MIT License mit license", "the Apache License, Version 2.0", "under the GNU General Public License, version 3 or general public license", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "license", "É mit\x00license", None, "licensed under the apache license version 2 1"]
    rows = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    for r in rows:
        w = word.findall("".join(c.lower() if c < "\x80" else c for c in texts[r["doc_id"]] or ""))
        at = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(","))
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[1] == "apache,apache-2.0" and labels[3] == "mit,mit-notice" and labels[4] == "cc-by-nc-4.0" and labels[8] == "apache"


def test_media_round_trip(spark, odd):
    rows = media.media_report(odd).collect()
    plain = {i: (t or "").encode() for i, t in ODD}
    for r in rows:
        data = plain[r["doc_id"]]
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.to_wav(payload)
        assert media.from_wav(stored) == payload and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_warc_archives(spark):
    pages = [(3, "u", "a" * 120), (1, "u\nv", "a" * 120), (2, None, "b"), (4, "w", "b"), (5, "x", None), (6, "x", "é" * 60), (7, "x", "é" * 60), (1, "u", "a" * 120)]
    rows = warc.warc_report(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest")).collect()
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in rows)
    assert got == [(1, "response", 0, 120), (1, "response", 0, 120), (2, "response", 0, 1), (3, "revisit", 1, 120), (4, "response", 0, 1), (5, "response", 0, 0), (6, "response", 0, 120), (7, "revisit", 6, 120)]
    assert warc.warc_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_damage_is_found():
    good = warc.record(1, "u", "payload " * 40, hashlib.sha256(b"payload " * 40).hexdigest(), 320, None)
    member = next(warc.members(good))
    assert warc.parsed(member)[1] == b"payload " * 40
    with pytest.raises(ValueError):
        warc.parsed(member.replace(b"payload payload", b"payload_payload"))
    with pytest.raises(ValueError):
        list(warc.members(good[:-20]))


def test_language_accuracy(spark):
    rng, words = random.Random(3), {"en": "the and ing th er wh".split(), "de": "der und sch ung ein ä".split(), "fr": "les que eau ment é ç".split()}
    rows = [(i, " ".join("".join(rng.choices(words[x], k=2)) for _ in range(30)), x) for i in range(300) for x in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows + [(999, "123 !", "en"), (998, None, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_report(docs).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and 50 < len(held) < 150
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows if i in held) / len(held) > 0.97
    assert got[999]["lang_pred"] == got[998]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
