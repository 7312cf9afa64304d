"""Edit distances of many pairs at once against the table worked out place by place."""

import random

from vellum.kernel.distances import levenshtein, measures


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_are_exact():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices("ab cd\xe9\u1680\u3000\x85\t\U0001f600", k=n))
    pairs = [("", ""), ("", "a b"), (" ", ""), ("ab", "ba"), ("a b", "b a"), ("abcd", "bcda"), ("x" * 70, "x" * 69 + "y"), ("a\x1cb", "a b")]
    for _ in range(300):
        a = text(rnd.randint(0, 90))
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "a", "d", " ", "ba"])
        pairs.append((a, rnd.choice(["".join(b), a.replace("a", "4"), a.translate({97: "b", 98: "a"}), text(len(a)), a[::-1]])))
    white = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    words = lambda s: [w for w in s.translate(dict.fromkeys(map(ord, white), " ")).split(" ") if w]
    got = list(zip(*(x.tolist() for x in measures(*map(list, zip(*pairs))))))
    assert got == [(table(a, b), len(a), table(words(a), words(b)), len(words(a))) for a, b in pairs]
    assert [x.tolist() for x in measures([], [])] == [[], [], [], []]


def test_a_long_pair_is_bounded():
    rnd = random.Random(2)
    a = rnd.choices(range(50), k=20_000)
    assert levenshtein(a, a[1:] + [99, 98]) == 3 and levenshtein(a[:0], a) == 20_000
