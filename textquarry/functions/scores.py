"""Column functions: quality scores of a response (STR-01..04), complexity (STR-12, 14), text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that count as code, and placeholders.
CODE_PATTERNS = ["def\\s+\\w+\\s*\\(", "class\\s+\\w+", "if\\s+", "for\\s+", "return\\s+", "import\\s+\\w+", "from\\s+\\w+\\s+import"]
PLACEHOLDERS = ["\\bTODO\\b", "\\bFIXME\\b", "\\bXXX\\b"]


#: What RE2 reads otherwise than Java.
_RE2 = {"\\b": "(?:(?<!\\w)(?=\\w)|(?<=\\w)(?!\\w))", "\\B": "(?:(?<!\\w)(?!\\w)|(?<=\\w)(?=\\w))", "\\s": "[\\t\\n\\f\\r ]", "\\S": "[^\\t\\n\\f\\r ]"}
_TOKEN = re.compile(r"\\(?:x(?:\{[^}]*\}|..)|[pP](?:\{[^}]*\}|.)|[0-7]+|.)|\(\?[a-zA-Z]+(?=[-:)])|.", re.S)


def re2(pattern: str) -> str:
    """For Java, a pattern as RE2 (the engine of the SQL) reads it: \\b and \\B by ASCII words, as \\w (Java 17 takes é for a letter of a
    word there), a dot and the anchors of lines know no line end but \\n, \\s has no vertical tab, and (?i) goes beyond ASCII.
    Not covered: $ before a last \\n, and the Turkish dotted and dotless i, which (?i) takes for an i."""
    folds = re.search(r"\(\?[a-zA-Z]*i", pattern) is not None
    word = "[A-JL-RT-Za-jl-rt-z0-9_]" if folds else "[A-Za-z0-9_]"  # k and s fold to signs that are no words
    out, inside, before, at = ["(?d)"], False, "", 0
    while at < len(pattern):
        t = made = _TOKEN.match(pattern, at)[0]
        at += len(t)
        if t == "\\b" and not inside:
            # next to what is always of a word, one side is asked; after a letter, as engines look for letters fast
            if m := re.compile(f"({word})(?![?*+{{])").match(pattern, at):
                t, made, at = m[1], f"{m[1]}(?<!\\w{m[1]})", m.end()
            elif m := re.compile(f"({word}|\\\\[dw])(?![?*]|{{0)").match(pattern, at):
                made = f"(?={m[1]})(?<!\\w)"
            elif re.fullmatch(f"{word}|\\\\[dw]", before):
                made = "(?!\\w)"
            else:
                made = _RE2[t]
        elif t in ("\\s", "\\S") or (t == "\\B" and not inside):
            made = _RE2[t][1:-1] if inside and t == "\\s" else _RE2[t]
        elif t.startswith("(?") and "i" in t and not inside:
            made += "u"
        elif t in "[]":
            inside = t == "["
        before = t
        out.append(made)
    return "".join(out)


def strip(c: Column) -> Column:
    """Without white space at both ends (Q28: trim takes spaces only)."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def non_blank(c: Column) -> Column:
    return F.coalesce(c.rlike("\\S"), F.lit(False))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(re2(pattern)))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring (Q20)."""
    return F.greatest(*[F.contains(c, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(c, F.lit(words[0]))


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words are substrings."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words[1:]), F.contains(c, F.lit(words[0])).cast("int"))


def length_score(c: Column, least: int = 20, most: int = 128_000) -> Column:
    """STR-01."""
    n = F.length(c)
    slow = F.greatest(F.lit(0.5), 1.0 - (n - 10_000) / F.lit(float(most - 10_000)))
    return F.when(n < least, 0.0).when(n > most, 0.2).when(n < 100, 0.3).when(n <= 10_000, 1.0).otherwise(slow)


def code_score(c: Column) -> Column:
    """STR-02; blank lines are counted as lines without a non-blank (Q18)."""
    patterns = sum((c.rlike(p).cast("int") for p in CODE_PATTERNS[1:]), c.rlike(CODE_PATTERNS[0]).cast("int"))
    blank = F.size(F.filter(F.split(c, "\n", -1), lambda x: ~x.rlike("\\S")))
    holes = sum((count_of(c, p) for p in PLACEHOLDERS), blank)
    raw = 0.5 + F.when(c.rlike("```[\\s\\S]*?```"), 0.2).otherwise(0.0) + F.least(F.lit(0.2), patterns * 0.05) - F.when(holes > 5, 0.3).otherwise(0.0)
    return F.when(F.length(c) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def overall_score(length: Column, code: Column, structure: Column) -> Column:
    """STR-04."""
    return 0.3 * length + 0.4 * code + 0.3 * structure


def issues(length: Column, code: Column, structure: Column) -> Column:
    """STR-04: labels of low scores."""
    return F.array_compact(F.array(F.when(length < 0.3, F.lit("low_length")), F.when(code < 0.2, F.lit("low_code")), F.when(structure < 0.3, F.lit("low_structure"))))


def tokens_estimate(c: Column) -> Column:
    """PRJ-14."""
    return F.size(F.filter(F.split(c, "\\s+"), lambda w: w != "")) * 1.3


def cosine(a: Column, b: Column) -> Column:
    """VEC-01."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def ratio(a: Column, b: Column) -> Column:
    """MATH-01: 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """AGG-11: 1 - C(n-c, k) / C(n, k); 0 where n < k, 1 where n - c < k (Q3-Q5)."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * F.coalesce(F.try_divide((n - c - i).cast("double"), (n - i).cast("double")), F.lit(0.0)))
    return F.when(n < k, 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)


def language_of(c: Column) -> Column:
    """STR-07: the first rule that matches."""
    rules = [("python", ["\\bdef\\s+\\w+\\s*\\(", "\\bimport\\s+\\w+"]), ("javascript", ["\\bfunction\\s+\\w+\\s*\\(", "const\\s+\\w+\\s*="]), ("java", ["\\bpublic\\s+class\\s+\\w+", "\\bSystem\\.out\\.print"]), ("go", ["\\bpackage\\s+main", "\\bfunc\\s+\\w+\\s*\\("]), ("rust", ["\\bfn\\s+\\w+\\s*\\(", "\\blet\\s+mut\\s+"]), ("c", ["#include\\s*<", "\\bint\\s+main\\s*\\("])]
    out = F.lit("unknown")
    for name, patterns in reversed(rules):
        out = F.when(c.rlike(re2("|".join(f"(?:{p})" for p in patterns))), F.lit(name)).otherwise(out)
    return out


def readable(html: Column, most: int | None = None) -> Column:
    """STR-09: HTML to text."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "\\s+", " "))
    return F.substring(out, 1, most) if most else out
