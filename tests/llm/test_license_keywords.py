import itertools
import random
import re._parser as parser
import time

from voxelry.llm import license_rules
from voxelry.llm import licenses as L


def alternatives(pattern):
    """What a pattern can read as, shortest repeats and one of each class."""

    def of(items):
        parts = [[""]]
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    parts.append([chr(arg)])
                case "BRANCH":
                    parts.append([x for b in arg[1] for x in of(b)])
                case "SUBPATTERN":
                    parts.append(of(arg[3]))
                case "MIN_REPEAT":
                    parts.append(["x" * arg[0]])
                case "MAX_REPEAT":
                    parts.append([x * arg[0] for x in of(arg[2])] if arg[0] else ["", *of(arg[2])])
                case "IN":
                    parts.append(["x"] if str(arg[0][0]) == "CATEGORY" else [chr(arg[0][1][0])] if str(arg[0][0]) == "RANGE" else [chr(x) for _, x in arg])
                case _:
                    raise AssertionError(op)
        return ["".join(x) for x in itertools.product(*parts)]

    return of(parser.parse(pattern))


def test_every_alternative_has_a_keyword():
    """Texts that a rule can read as hold one of its keywords, however its choices fall."""
    missed = []
    for label, keywords, pattern, *_ in license_rules.written():
        for text in alternatives(pattern):
            if not any(k in text for k in keywords):
                missed.append((label, keywords, text))
                break
    assert not missed


def test_rules_are_their_own():
    written = license_rules.written()
    assert len(written) > 250 and len({(x[0], x[2]) for x in written}) == len(written)


def test_every_rule_finds_its_own_text():
    for r in L.rules():
        text = alternatives(r.pattern.pattern.decode()[len("(?<= )(?:") : -len(")(?= )")])[-1].encode()
        assert r.pattern.search(b" " + text + b" "), r


def test_alternatives_are_found():
    assert [r.label for _, _, r in L.detections(b" licensed under the expat license ")] == ["mit"]
    assert [r.label for _, _, r in L.detections(b" licensed under the boost software license ")] == ["boost"]


def naive(words):
    """Containment checked against all that stays."""
    found = [(k, m.start(), m.end(), r) for k, r in enumerate(L.rules()) for m in r.pattern.finditer(words)]
    found.sort(key=lambda x: (-x[3].priority, x[1] - x[2], x[1], x[0]))
    stay = []
    for _, a, b, r in found:
        if r.priority == L.BASE_PRIORITY or not any(x <= a and b <= y for x, y, _ in stay):
            stay.append((a, b, r))
    return sorted(stay, key=lambda x: (x[0], x[1], x[2].name))


def test_suppression_against_brute_force():
    """Also shows that no text is lost to the keywords."""
    r = random.Random(1)
    parts = [t for _, _, p, *_ in license_rules.written()[::3] for t in alternatives(p)[:40:13]] + ["under the mit license", "apache license version 2", "cc by nc", "plain words here", "license", "under the"]
    for _ in range(60):
        words = (" " + " ".join(r.choice(parts) for _ in range(r.randint(1, 25))) + " ").encode()
        assert L.detections(words) == naive(words)


def test_very_many_detections(spark):
    text = "under the MIT license, see the Apache License version 2.0 and " * 20_000
    began = time.time()
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("detections").first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (12 * 20_000, 40_000, 0, 12 * 19_999 + 6)
    assert time.time() - began < 60
