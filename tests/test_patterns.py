"""Search patterns: what they match in a line, what they are refused for, and the literals that every match holds."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import line_patterns, patterns
from runlens.operators import search

# pattern, lines, lines that match
CASES = [
    (r"^foo$", ["x", "foo", "foo bar"], [1]),
    (r"\Afoo\z", ["x", "foo", "foo bar"], [1]),
    (r"\bfoo\b", ["xfoo", "foo", "a foo.", "éfoo"], [1, 2, 3]),
    (r"\Bfoo", ["xfoo", "foo"], [0]),
    (r"foo\sbar", ["foo\tbar", "foo bar", "foo\x0bbar"], [0]),
    (r"a[^x]b", ["a b", "axb", "a\rb"], [0, 2]),
    (r"(?s)a.b", ["a-b", "ab", "a\rb"], [0, 2]),
    (r"x[a\n]", ["x", "xa"], [1]),
    ("", ["a", ""], [0, 1]),
    (r"^$", ["a", ""], [1]),
    (r"\d+ errors", ["no errors", "3 errors", "٣ errors"], [1]),
    (r"(?i)ERROR", ["an Error", "fine", "ERRORS"], [0, 2]),
    (r"foo|bar", ["bar", "foo", "x", "bar foo"], [0, 1, 3]),
    (r"(?i)error|warning", ["an Error", "fine", "WARNING x"], [0, 2]),
    (r"(?i)s", ["ſ", "x", "S"], [0, 2]),
    (r"(?i)k", ["K", "x", "K"], [0, 2]),
    (r"(?i)kids", ["KIDſ", "kid s", "KIDS"], [0, 2]),
    (r"(?i)i", ["İ", "ı", "I"], [2]),
    (r"(?i)caf\x{E9}", ["CAFÉ", "cafe"], [0]),
    (r"(?i)[à-é]x", ["Éx", "Ëx"], [0]),
    (r"[a-c&&b]x", ["ax", "&x", "dx"], [0, 1]),
    (r"[[a]x", ["[x", "ax", "x"], [0, 1]),
    (r"[]a]x", ["]x", "ax"], [0, 1]),
    (r"[^]a]x", ["]x", "bx"], [1]),
    (r"[a\]b-]", ["]", "-", "c"], [0, 1]),
    (r"[[:word:]]+!", ["a_1!", "-!"], [0]),
    (r"[[:^alpha:]]", ["abc", "a1"], [1]),
    (r"[\d\-x]", ["5", "-", "y"], [0, 1]),
    (r"[^\D5]", ["5", "6", "x"], [1]),
    (r"\p{Greek}+", ["αβγ", "abc"], [0]),
    (r"^\P{Greek}+$", ["αβγ", "abc"], [1]),
    (r"\pL\p{^Lu}", ["Aa", "AA"], [0]),
    (r"(?i)\p{Lu}", ["a", "1"], [0]),
    (r"a{,3}", ["aa", "a{,3}"], [1]),
    (r"a{2}$", ["a", "aa", "aaa"], [1, 2]),
    (r"^a{1,2}$", ["a", "aa", "aaa"], [0, 1]),
    (r"x{a}", ["x{a}", "xa"], [0]),
    (r"a**b"[:2] + "?b", ["b", "aab", "c"], [0, 1]),
    (r"(?P<n>a)(?<m>b)", ["ab", "a"], [0]),
    (r"(?i:a)b", ["Ab", "AB"], [0]),
    (r"a(?i)b", ["aB", "AB"], [0]),
    (r"(?i)a(?-i)b", ["Ab", "AB"], [0]),
    (r"(?U)a+b", ["aab"], [0]),
    (r"\Qa.b\Ec", ["a.bc", "axbc"], [0]),
    (r"\Qa.b", ["a.b", "axb"], [0]),
    (r"\x41\101\t", ["AA\t", "A\t"], [0]),
    (r"\.\*\+\?\(\)\[\]\{\}\|\^\$\\/\-", [".*+?()[]{}|^$\\/-"], [0]),
    (r"(a|b|c)+$", ["x" + "abc" * 20_000, "abd"], [0]),
    (r"a#b c", ["a#b c", "ab"], [0]),
    ("~`'\"<>%@!:;,=_é漢😀", ["~`'\"<>%@!:;,=_é漢😀", "~"], [0]),
    (r"^.$", ["😀", "ab"], [0]),
    (r"[😀-😂]", ["😁", "x"], [0]),
    (r"(x|)$", ["x", "y"], [0, 1]),
    (r"(?i)straße", ["STRASSE", "STRAßE", "strasse"], [1]),
]
REFUSED = ["foo(", "foo)", "[a", "[b-a]", "*a", "a**", "a+*", "(?=a)", "(?<=a)", "(?<!a)", "(?!a)", "(?>a)", r"(a)\1", r"\y", r"\Z", "a\\", r"\x{110000}", r"\x4", "(?P<1>a)", "(?P=n)", "a{1001}", "a{3,2}", "(a{100}){11}", r"[[:nope:]]", r"\p{", "(?q)a", "(?", "(?)", "(?i-)a"]
NO_LINE = ["a\nb", r"a\nb|c", r"[\n]", r"\x0Aa", r"\Q" + "\n" + r"\E"]


def test_lines_that_match(spark):
    rows, columns = [], []
    for i, (_, lines, fits) in enumerate(CASES):
        rows += [(i, j, line, j in fits) for j, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "i int, j int, text string, fits boolean").cache()
    for i, (pattern, _, _) in enumerate(CASES):
        columns.append(F.when(F.col("i") == i, patterns.line_predicate(F.col("text"), pattern)))
    wrong = df.where(F.coalesce(*columns) != F.col("fits")).collect()
    assert [(CASES[r.i][0], r.text[:50], r.fits) for r in wrong] == []


def test_options(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("a.B",)], "text string")
    told = lambda **o: [r.text for r in df.where(patterns.line_predicate(F.col("text"), "a.B", **o)).collect()]
    assert told(ignore_case=True) == ["a.b", "axb", "a.B"]
    assert told(fixed=True) == ["a.B"]
    assert told(fixed=True, ignore_case=True) == ["a.b", "a.B"]
    assert spark.range(1).select(patterns.line_predicate(F.lit("a�b"), r"\x{FFFD}")).first()[0]


def test_what_is_refused(spark):
    for pattern in [*REFUSED, *NO_LINE, r"\p{Klingon}", r"[\p{nope}]"]:
        with pytest.raises(ValueError):
            patterns.line_regex(pattern)
    with pytest.raises(ValueError):
        patterns.line_predicate(F.lit("x"), "a\nb", fixed=True)


def test_required_literals():
    for pattern, fold, want in [
        ("foo", False, ["foo"]), (r"\d+ errors \d", False, [" errors "]), (r"\d(errors)", False, ["errors"]), ("(?i)ERROR", True, ["error"]), ("foo|bar", False, ["foo", "bar"]),
        ("(?i)(error|warning): ", True, ["error", "warning"]), (r"(a|bcdef)\dxyz", False, ["xyz"]), (r"foo|\d", False, []), ("(?i:foo)|bar", False, []), (r"(?i)caf\x{E9}", False, []), (r"a\x{FFFD}", False, ["a"][:0]),
        ("error|no such text", False, ["error", "no such text"]), (r"(?i)error|license|\bthe\b.*[0-9]{3,}", True, ["error", "license", "the"]), ("(abc)+x?", False, ["abc"]), ("(abc)*", False, []), ("ab?c", False, ["a"]), ("[x]y[z]", False, ["xyz"]), ("", False, []),
    ]:
        assert patterns.required_literals(pattern) == (want, fold), pattern


def test_against_another_engine(spark):
    """Random patterns and lines, as the engine of DuckDB has them, which takes the same syntax."""
    import duckdb

    rng = random.Random(11)
    atoms = ["a", "b", "A", ".", r"\d", r"\w", r"\s", r"[a-c]", r"[^ab]", r"\b", "^", "$", "(?i:b)", r"[[:upper:]]", r"\.", "1", "é", r"\pL", "k", "s"]

    def made(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            x = rng.choice(atoms) if depth == 0 or rng.random() < 0.6 else f"({made(depth - 1)}|{made(depth - 1)})"
            parts.append(x + (rng.choice(["", "", "", "*", "+", "?", "{2}", "{1,2}"]) if x not in ("^", "$", r"\b") else ""))
        return "".join(parts)

    lines = ["".join(rng.choice("abABk sS1.éK_-") for _ in range(rng.randint(0, 8))) for _ in range(80)]
    chosen = [("(?i)" if rng.random() < 0.3 else "") + made(2) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    told = df.select(*[patterns.line_predicate(F.col("text"), p).alias(f"p{i}") for i, p in enumerate(chosen)]).collect()
    con = duckdb.connect()
    for i, p in enumerate(chosen):
        want = [con.execute("SELECT regexp_matches(?, ?)", [x, p]).fetchall()[0][0] for x in lines]
        assert [r[i] for r in told] == want, p


def test_literals_are_looked_for_first(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = search.grep(df, "(?i)error|no such text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "lower(" in plan and "RLIKE" in plan
    assert isinstance(line_patterns.parse("(a|b)"), line_patterns.Chars)
