"""The pattern dialect: by hand, and against an engine of that kind."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lodestone.functions.dialect import BadPattern, to_java


@pytest.fixture(scope="module")
def find(spark):
    compiled = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    return lambda pattern, text: compiled(to_java(pattern)).matcher(text).find()


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        # the text's end, and lines, under the flags that hold there
        (r"\.py$", ["x.py"], ["x.py\n", "x.pyc"]),
        (r"(?m:^x)y$", ["xy", "a\nxy"], ["xy\n", "xyz"]),
        (r"(?m)a(?-m)b$", ["ab"], ["ab\n"]),
        (r"(?m)b$", ["b", "b\nc"], ["b\r\nc", "bc"]),
        (r"(?m)^b$", ["a\nb", "b\n"], ["a\rb"]),
        (r"a(?m:$)|^b", ["a\nc", "b"], ["a c", "a\rb"]),
        (r"(a(?m)|b$)c?$", ["b", "a", "x\na"], []),
        (r"^a|b", ["a", "xb"], ["xa"]),
        # characters
        (r"^a.c$", ["a\rc", "a c", "abc", "a🙂c"], ["a\nc"]),
        (r"(?s)^a.c$", ["a\nc"], ["ac"]),
        (r"^\v$", ["\x0b"], ["\n", "\r", "v"]),
        (r"^\x41\x{1F642}é\U0001F642$", ["A🙂é🙂"], ["A"]),
        (r"^\d\w\s$", ["1a ", "٣é "], ["aa ", "1. "]),
        (r"^\D$", ["a"], ["٣"]),
        (r"(?i)^licenſe|^KELVIN", ["LICENSE", "license", "Kelvin"], ["icense"]),
        (r"(?i)a(?-i)b", ["Ab", "ab"], ["aB", "AB"]),
        (r"(?i:a)b", ["Ab"], ["AB"]),
        (r"a(?i)b|c", ["aB", "C"], ["Ab"]),
        (r"\bab\b", ["ab", "é ab.", "-ab-"], ["abé", "_ab"]),
        (r"a\Bb", ["ab"], ["a b"]),
        # classes and sets of them
        (r"^[[:alpha:]]$", ["a", "Z"], ["é", "1", ":"]),
        (r"^[[:^alpha:]x]$", ["1", "é", "x"], ["a"]),
        (r"^[a-z--[aeiou]]$", ["b", "z"], ["a", "u", "-", "["]),
        (r"^[a-z&&[^aeiou]]$", ["b"], ["a"]),
        (r"^[a-y~~b-z]$", ["a", "z"], ["b", "y"]),
        (r"^[a-e&&c-g--d]$", ["c", "e"], ["d", "a", "g"]),
        (r"^[^a-c--b]$", ["b", "d"], ["a", "c"]),
        (r"^[]a]$", ["]", "a"], ["["]),
        (r"^[^]a]$", ["["], ["]", "a"]),
        (r"^[a\-z]$", ["-", "a"], ["b"]),
        (r"^[a-]$", ["-", "a"], ["b"]),
        (r"^[\]\[^&#]$", ["]", "[", "^", "&", "#"], ["\\"]),
        (r"^[\d\pL]$", ["1", "é"], ["-"]),
        (r"^\p{Greek}\P{Lu}\p{^L}$", ["αa1"], ["aa1", "αA1", "αab"]),
        (r"^\p{script=Greek}\p{gc=Nd}$", ["α1"], ["a1"]),
        # blanks, groups, counts
        ("(?x)^ a b # a note\n c$", ["abc"], ["a b c", "ab"]),
        (r"^(?P<x>a)(?<y>b)(?:c)$", ["abc"], ["ab"]),
        (r"^(?:ab){2,3}?$", ["abab", "ababab"], ["ab"]),
        (r"^a{2}b{1,}$", ["aab", "aabb"], ["ab"]),
        (r"^a**$", ["", "aa"], ["b"]),
        (r"^#a b$", ["#a b"], ["#ab"]),
        (r"", ["", "x"], []),
        (r"a||b", ["", "c"], []),
    ],
)
def test_means_the_same(find, pattern, yes, no):
    assert [t for t in yes if not find(pattern, t)] == [] and [t for t in no if find(pattern, t)] == []


@pytest.mark.parametrize(
    "pattern",
    [r"\h", r"\Qa.b\E", r"\<a", r"\>", r"\b{start}", r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(?>a)", r"(a)\1", r"\k<n>", r"\Z", r"\G", r"\R", r"\cA", r"\07", r"(?U)a", r"(?R)a", r"(?-u)a", r"(?z)a", r"(?)", r"(?i-)a"]
    + [r"a++", r"a?+", r"*a", r"(*a)", r"a{2,1}", r"a{2000}", r"a{x}", r"(a", r"a)", r"[a", r"[b-a]", r"[a&&]", r"[[:nope:]]", r"[\b]", r"[\d-z]", "a\\", r"\x{110000}", r"\x{D800}", r"\x4", r"\p{script=}", r"\p", r"(?P<n>a)(?P<n>b)", r"(?P<a_b>c)", r"(?P=n)"],
)
def test_is_refused(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


def random_pattern(rng, depth=3):
    if depth == 0:
        return rng.choice(["a", "b", "c", ".", r"\d", r"\w", r"\s", "[ab]", "[^a]", "[a-c1]", r"\.", "^", "$", r"\b", "(?i)", "(?s)", "(?m)", "(?-i)", "[[:digit:]b]", r"\n", r"\x61", "1"])
    r = rng.random()
    if r < 0.5:
        return "".join(random_pattern(rng, depth - 1) for _ in range(rng.randrange(1, 4)))
    if r < 0.65:
        return "|".join(random_pattern(rng, depth - 1) for _ in range(2))
    if r < 0.85:
        return rng.choice(["(", "(?:", "(?i:", "(?m:", "(?s-i:"]) + random_pattern(rng, depth - 1) + ")"
    return "(?:" + random_pattern(rng, depth - 1) + ")" + rng.choice(["*", "+", "?", "{1,2}", "*?", "??"])


def test_equals_an_engine_of_the_dialect(find):
    """Random patterns on random ASCII texts; the library's engine is of the dialect's kind."""
    rng, tried = random.Random(11), 0
    while tried < 500:
        pattern = random_pattern(rng)
        texts = ["".join(rng.choices("abcAB1 .\n\r_", k=rng.randrange(6))) for _ in range(12)]
        try:
            want = pc.match_substring_regex(pa.array(texts), pattern).to_pylist()
        except pa.ArrowInvalid:
            continue
        tried += 1
        assert [find(pattern, t) for t in texts] == want, (pattern, texts)
