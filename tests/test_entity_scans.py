"""Entities found by quicker scans against the patterns as they are written."""

import random
import re

from tessera.operators import entities


def test_scans_find_what_the_patterns_find():
    rng = random.Random(3)
    words = [w for some in entities.PATTERNS.values() for p in some for w in re.findall(r"[A-Za-z.]{2,}", p)]
    words += "The the THE T TH AB A This Bill é É _A 3 12 2020-01-02 -12- 1٢-٣٤ ٣٤٥٦-٧٨-٩٠ TheAB TheABC Road road tax Mr Mr. 4, , 2024 \n \t ß".split(" ")
    seen = set()
    for _ in range(5000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n", ".", "_", "-"]) for _ in range(rng.randrange(14)))
        for kind, patterns in entities.PATTERNS.items():
            for n, (p, (scan, needed)) in enumerate(zip(patterns, entities._SCANS[kind], strict=True)):
                want = [m.span() for m in re.finditer(p, text)]
                assert want == ([m.span() for m in scan.finditer(text)] if entities._may_match(needed, text) else []), (p, text)
                seen |= {(kind, n)} if want else set()
    assert seen >= {(kind, n) for kind, some in entities.PATTERNS.items() for n in range(len(some)) if kind != "dates"}
    for text in ("on 3 March 2026", "2020-01-02", "٣٤٥٦-٧٨-٩٠", "March 3, 2026"):
        assert [x[:2] for x in entities.entities_in(text) if x[0] == "dates"] == [("dates", text.removeprefix("on "))]


def test_texts_without_the_words_are_not_scanned(monkeypatch):
    """Eleven of thirteen patterns need a word or a date's dashes."""
    asked = []

    class Counted:
        def __init__(self, scan):
            self.scan = scan

        def finditer(self, text):
            asked.append(self.scan.pattern)
            return self.scan.finditer(text)

    monkeypatch.setattr(entities, "_SCANS", {k: [(Counted(scan), needed) for scan, needed in some] for k, some in entities._SCANS.items()})
    assert [x[:2] for x in entities.entities_in("Some Words of no kind, NIC, 3 times")] == [("organizations", "NIC"), ("persons", "Some Words")]
    assert len(asked) == 2
