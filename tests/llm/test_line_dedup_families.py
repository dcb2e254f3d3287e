import math
import random
import re

from test_line_dedup import own, rows_of

from voxelry.llm import line_dedup as L


def kept(spark, rows, **limits):
    return {r.doc_id: r.text for r in L.deduplicated(rows_of(spark, rows), **limits).collect()}


def letters(k):
    return "".join("abcdefghij"[int(c)] for c in f"{k:03d}")


def unrelated(k, n=12):
    return " ".join(f"{letters((k * 37 + j * 101) % 997)}{letters(k)}" for j in range(n))


def test_copies_do_not_keep_what_recurs(spark):
    """A line of 12 unrelated documents goes, though one document of more copies has it too."""
    rows = [(k, f"{unrelated(k)}\nSubscribe to our weekly letter") for k in range(12)]
    rows += [(100 + k, f"{unrelated(500)}\nSubscribe to our weekly letter\nOnly in copies") for k in range(20)]
    got = kept(spark, rows)
    assert all(got[k] == unrelated(k) for k in range(12))
    assert all(got[100 + k] == f"{unrelated(500)}\nOnly in copies" for k in range(20))


def test_mostly_boilerplate(spark):
    """Pages of four recurring lines and one of their own aren't copies of each other."""
    frame = [f"{x} goes on every page of this site" for x in ("head", "menu", "side", "foot")]
    got = kept(spark, [(k, "\n".join([*frame, unrelated(k)])) for k in range(30)])
    assert got == {k: unrelated(k) for k in range(30)}


def test_near_copies_stay(spark):
    """Copies with a word changed anywhere, also where a line begins, are one family."""
    base = [unrelated(k) for k in range(10)]
    rows = []
    for k in range(30):
        lines = [x.split() for x in base]
        lines[k % 10][k % 5] = f"changed{letters(k)}"
        rows.append((k, "\n".join(" ".join(x) for x in lines)))
    assert kept(spark, rows) == dict(rows)


def test_numbers_are_not_boilerplate(spark):
    """Rows of numbers, unspaced text and addresses with a digit are each their own."""
    rows = [(k, f"{own(k)}\n{k}.5 {k + 1} 20{k:02d}-01-02\n{k}\t{k + 2}\n" + "".join(chr(0x4E00 + (k * 97 + j * 31) % 5000) for j in range(30)) + f"{k}年\nhttps://example.org/{letters(k)}/{k}") for k in range(12)]
    rows += [(100 + k, f"{unrelated(k)}\nPage\t{k}\tof 17\n2024 2025") for k in range(12)]
    got = kept(spark, rows)
    assert all(got[d] == t for d, t in rows if d < 100)
    assert all(got[100 + k] == unrelated(k) for k in range(12))


def test_templates_of_one_leaf(spark):
    """Several templates with word-valued fields, and unrelated lines that begin alike."""
    a = lambda k: f"See also the page about {unrelated(k, 1)} in our own archive"
    b = lambda k: f"See also the list which {unrelated(k, 1)} has sent us lately"
    c = lambda k: f"See also the {unrelated(k, 8)}"
    rows = [(k, f"{unrelated(k)}\n{(a, b, c, c, c)[k % 5](k)}") for k in range(60)]
    got = kept(spark, rows)
    assert all(got[k] == (unrelated(k) if k % 5 < 2 else t) for k, t in rows)


def naive(rows, least=5, similar=0.6):
    """The template tree by its definition, for documents that are no copies of each other."""

    def masked(line):
        line = re.sub(r"\s+", " ", line).strip(" ")
        new = re.sub(r"(?<![^ ])(?=[!-~]{1,40}(?: |$))[^ 0-9]*[0-9][^ ]*", "<*>", line)
        new = re.sub("[0-9]+", "<*>", new)
        tokens = new.split(" ")
        return new if re.search("[0-9]", line) and sum(any(c.isalpha() for c in t) for t in tokens) >= 0.5 * len(tokens) else line

    leaf = lambda x: (x.count(" "), tuple(x.split(" ")[:3]))
    lines = [(d, i, masked(x)) for d, t in rows for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    held = {}
    for d, _, x in lines:
        held.setdefault(x, set()).add(d)
        held.setdefault(leaf(x), set()).add(d)
    gone = {(d, i) for d, i, x in lines if len(held[x]) >= least}
    templates = {}
    for _, _, x in lines:
        templates.setdefault(leaf(x), set()).add(x)
    left = [(d, i, x) for d, i, x in lines if (d, i) not in gone and len(held[leaf(x)]) >= least and len(templates[leaf(x)]) > 1]
    count = {}
    for _, _, x in left:
        for p, t in enumerate(x.split(" ")):
            count[leaf(x), p, t] = count.get((leaf(x), p, t), 0) + 1
    found = {}
    for d, i, x in left:
        tokens = x.split(" ")
        level = [math.floor(math.log(count[leaf(x), p, t] / least, 8) + 1e-9) if count[leaf(x), p, t] >= least else -1 for p, t in enumerate(tokens)]
        for power in set(level) - {-1}:
            unit = (leaf(x), tuple(t if v >= power else None for t, v in zip(tokens, level, strict=True)))
            if sum(t is not None for t in unit[1]) >= similar * len(tokens):
                found.setdefault(unit, []).append((d, i))
    for at in found.values():
        if len({d for d, _ in at}) >= least:
            gone |= set(at)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_templates_against_brute_force(spark):
    r = random.Random(6)
    names = [letters(k) for k in range(40)]
    shapes = ["Posted by {a} in the forum about {b} today", "Posted by {a} on page {n} of our list", "Posted by {a} and {b} and {a} too", "Read more of this here", "Call {n} for {b} and ask for {a} please", "All of {b} is {a} and all of {a} is {b}"]
    rows = []
    for k in range(150):
        pick = lambda: names[min(int(r.expovariate(0.25)), 39)]
        some = [r.choice(shapes).format(a=pick(), b=pick(), n=r.randint(1, 900)) for _ in range(r.randint(0, 3))]
        rows.append((k, "\n".join([unrelated(k), *some, unrelated(1000 + k, 9), ""])))
    got, want = kept(spark, rows), naive(rows)
    assert got == want and sum(want[d] != t for d, t in rows) > 60
    # Some stay, as they are not frequent enough.
    assert any(want[d].count("\n") > 2 for d, _ in rows)
