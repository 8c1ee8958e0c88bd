"""Scans take linear time on texts that make plain searches quadratic, and their parts equal re."""

import random
import re
import time

import pytest

from kerbgrid.llm import pii, secrets

MB = 1 << 20


@pytest.mark.parametrize("text", ["eyJ" * (MB // 3), "eyJa." * (MB // 5), "0123456789abcdef" * (MB // 16), "xoxb-" * (MB // 5), "token" * (MB // 5), "-----BEGIN RSA PRIVATE KEY-----" * (MB // 31)])
def test_secrets(text):
    machine = secrets.Automaton()
    began = time.process_time()
    secrets.scan(text, machine)
    assert time.process_time() - began < 8


@pytest.mark.parametrize("text", ["7" * MB + "...", "1." * (MB // 2), "+" * MB, "+1(" * (MB // 3), "@a" * (MB // 2), "4 " * (MB // 2), "iban" * (MB // 4), "ssn " * (MB // 4), "http://" * (MB // 7)])
def test_personal_data(text):
    anchors = pii.machine()
    began = time.process_time()
    pii.parse(text, anchors)
    assert time.process_time() - began < 8


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_whole_expressions_equal_re(rule):
    """Leftmost matches with a core at their start, each extended to its longest end as re's are."""
    rng, machine = random.Random(4), secrets.Automaton((rule,))
    plain = re.compile(rule.whole.encode(), re.I if rule.fold else 0)
    parts = ["eyJ", ".", "a", "Bc-_", "ghp_", "A1" * 20, "xoxb-", "-" * 5, "-----BEGIN ", "RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n", "Zz+/9=" * 6, "token", "='", "AKIA", "0f" * 9, "é"]
    found = 0
    if rule.kind == "jwt":
        parts = parts[:4]
    for _ in range(3000):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16))).encode()
        ends, at = [], 0
        while m := next((m for k in range(at, len(data)) if any(re.compile(c.encode(), re.I if rule.fold else 0).match(data, k) for c in rule.cores) and (m := plain.match(data, k))), None):
            end = max(e for e in range(m.start() + 1, len(data) + 1) if plain.fullmatch(data, m.start(), e))
            ends.append((m.start(), end))
            at = end
        got = machine.spans(data)
        assert [(s, e) for s, _, e in got] == [(s, e) for s, e in ends if secrets.kept(rule.kind, data[s:e])], data
        found += len(got)
    assert found
