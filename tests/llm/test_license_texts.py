"""Templates are found by a file's own rarest words and all of their key phrases, against a plain scan."""

import random
import re

from kerbgrid.llm import licenses

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def test_templates(spark):
    rng = random.Random(7)
    filler = ["".join(rng.choices("uvwxyz", k=5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(filler, k=n))
    texts, want = [], []
    for label, template, keys in licenses.TEMPLATES:
        texts.append(f"{prose(40)} {template.title()}. {prose(30)}")
        want.append({label} | {x for x, _, k in licenses.TEMPLATES if all(f" {p} " in f" {template} " for p in k)})
        words = template.split()
        broken = f" {template} ".replace(f" {keys[-1]} ", f" {keys[-1].split()[0]} {prose(1)} {' '.join(keys[-1].split()[1:])} ")  # a key phrase is cut
        texts.append(f"{prose(20)} {broken}")
        want.append({x for x, _, k in licenses.TEMPLATES if all(f" {p} " in broken for p in k)})
        texts.append(" ".join(reversed(words)))
        want.append(set())
    texts += [prose(500) for _ in range(40)] + [prose(3) + " software of the version " * 2000, None, ""]
    want += [set()] * 43
    rows = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    base = set(licenses.PHRASES)
    for k, labels in enumerate(want):
        got = set(rows[k]["labels"].split(",")) - {""} - base
        assert got == labels, (texts[k], got, labels)
        assert rows[k]["score"] <= 1 and (rows[k]["score"] > 0) == bool(labels or rows[k]["n_base"])
    assert rows[0]["score"] == 1.0


def test_many_licences_in_one_file(spark):
    """Each pair of templates, all of them (in three orders), and all of them five times over, with other files that
    make the index's words common, equal a plain search for key phrases."""
    rng = random.Random(8)
    names = [t for _, t, _ in licenses.TEMPLATES]
    texts = [f"{a}\n\n{b}" for i, a in enumerate(names) for b in names[i + 1 :]]
    texts += ["\n".join(names), "\n".join(reversed(names)), " ".join(rng.sample(names, len(names))), "\n".join(names * 5)]
    common = sorted({w for t in names for w in t.split()})
    texts += [" ".join(rng.choices(common, k=200)) for _ in range(100)]
    rows = {r["doc_id"]: r["labels"] for r in licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    base = set(licenses.PHRASES)
    for k, text in enumerate(texts):
        flat = f" {' '.join(WORD.findall(text))} "
        want = {x for x, _, keys in licenses.TEMPLATES if all(f" {p} " in flat for p in keys)}
        assert set(rows[k].split(",")) - {""} - base == want - base, text
    assert len(licenses.TEMPLATES) > 25
