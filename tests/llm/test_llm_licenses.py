"""The keyword prefilter leaves no rule untried that would match."""

import re._parser as parser

from helixpath.llm import licenses


class Everything:
    """In place of the automaton: every rule is tried."""

    def __init__(self, rules):
        self.rules = range(len(rules))

    def iter(self, words):
        yield 0, self.rules


def forms(tree):
    """Texts that a pattern matches: each alternative, each optional part with and without."""
    found = [""]
    for op, value in tree:
        kind = str(op)
        if kind == "LITERAL":
            parts = [chr(value)]
        elif kind == "IN":
            parts = [chr(x[1]) for x in value if str(x[0]) == "LITERAL"] or ["1"]
        elif kind == "BRANCH":
            parts = [x for branch in value[1] for x in forms(branch)]
        elif kind == "SUBPATTERN":
            parts = forms(value[3])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [""] * (value[0] == 0) + forms(value[2])
        else:
            parts = ["x"] if kind == "ANY" else [""]
        found = [a + b for a in found for b in parts]
    return found


def test_prefilter_loses_no_detection():
    s, plain = licenses.Scanner(), licenses.Scanner()
    plain.finder = Everything(plain.rules)
    texts = sorted({f for rule in s.rules for f in forms(parser.parse(rule.pattern))})
    assert len(texts) > 1_000
    lost = [t for t in texts if s.detections(t) != plain.detections(t) or not s.detections(t)]
    assert not lost, lost[:5]


def test_names_of_holders_may_be_long():
    holder = "the " + "very " * 40 + "long institute of names"
    assert licenses.scan_text(f"Neither the name of {holder} nor the names of its contributors may be used".encode())[5] == "bsd-3-clause"
    assert licenses.scan_text(b"This is subject to the terms below, and under the zlib/libpng license.")[5] == "unknown-license,zlib"
