"""Text, web and code operators (STR-05..25, FLT-07..10, WIN-03, PRJ-14..16, SRC-09, TOP-06)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

#: Fixed value: words that are no keywords.
STOP_WORDS = "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once".split()


def keywords(c: Column) -> Column:
    """STR-05: words in lower case (Unicode, Q19) of three characters or more that are not stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def settled(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """kept columns and made ones, which are worked out once: a generator stands between them and what follows, as later
    filters and generators would else repeat their expressions."""
    (m,) = free_names(df, "_m")
    d = df.select(*kept, F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias(m))
    return d.select(*kept, *[F.col(f"{m}.{k}").alias(k) for k in made])


def term_counts(df: DataFrame, words: Column, out: str = "terms") -> DataFrame:
    """Add an array<struct<term,tf>> of an array of words, in order of the terms: runs of the sorted array are counted,
    so that the row stays where it is. Each step is a column of its own, as a lambda would work it out for every term."""
    before = df.columns
    df = df.withColumn("_k", F.sort_array(words))
    df = df.withColumn("_s", F.filter(F.sequence(F.lit(0), F.size("_k")), lambda i: (i == 0) | (i == F.size("_k")) | (F.get("_k", i) != F.get("_k", i - 1))))
    at = F.sequence(F.lit(0), F.size("_s") - 2)
    runs = F.transform(at, lambda j: F.struct(F.get("_k", F.get("_s", j)).alias("term"), (F.get("_s", j + 1) - F.get("_s", j)).cast("long").alias("tf")))
    runs = F.when(F.size("_k") > 0, runs).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
    return settled(df, *before, **{out: runs})


def length_of(terms: str) -> Column:
    return F.sqrt(F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x.tf * x.tf))


def term_vectors(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """STR-06: (key, term, tf, weight), the weights of a text having length one. Terms are counted within the row. Rows
    are texts: two rows of one key are two texts."""
    d = term_counts(df.select(key, F.col(text).alias("_text")), keywords(F.coalesce("_text", F.lit(""))), "_t")
    d = settled(d, key, _n=length_of("_t"), _t=F.col("_t")).select(key, "_n", F.explode("_t").alias("_x"))
    return d.select(key, F.col("_x.term").alias("term"), F.col("_x.tf").alias("tf"), (F.col("_x.tf") / F.col("_n")).alias("weight"))


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def line_range(df: DataFrame, offset: int, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SRC-09."""
    return lines(df, key, text).filter(F.col("line_no").between(offset + 1, offset + limit))


def grep(df: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", ignore_case: bool = False) -> DataFrame:
    """FLT-08. The pattern means what it does in RE2."""
    return lines(df, key, text).filter(F.col("line").rlike(S.re2(("(?i)" if ignore_case else "") + pattern)))


def grep_context(df: DataFrame, pattern: str, before: int, after: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """WIN-03: matching lines with the lines around them."""
    all_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    d = df.select(key, all_lines.alias("_l")).select(key, "_l", F.posexplode("_l").alias("p", "line")).filter(F.col("line").rlike(S.re2(pattern)))
    lo = F.greatest(F.col("p") - before, F.lit(0))
    return d.select(key, (F.col("p") + 1).alias("line_no"), "line", F.array_join(F.slice("_l", lo + 1, F.col("p") - lo), "\n").alias("before"), F.array_join(F.slice("_l", F.col("p") + 2, F.lit(after)), "\n").alias("after"))


def glob_regex(pattern: str) -> str:
    """FLT-09: an anchored regular expression (Q22) for **, *, ? and [!..]."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = re.sub(r"\*\*/|\*\*|\*|\?|\[!?[^\]]*\]|[^*?\[]+|\[", lambda m: parts.get(m[0]) or (("[^" + m[0][2:]) if m[0].startswith("[!") else m[0] if m[0].startswith("[") and len(m[0]) > 1 else re.escape(m[0])), pattern)
    return f"^{out}$"


def glob_match(df: DataFrame, path: str, pattern: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    df = df.filter(F.col(path).rlike(glob_regex(pattern)))
    for e in excluded:
        df = df.filter(~F.col(path).rlike(glob_regex(e)))
    return df


def substring_search(df: DataFrame, query: str, text: str = "text") -> DataFrame:
    """FLT-07."""
    return df.filter(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(query.lower())))


def domain_filter(df: DataFrame, url: str, blocked: list[str] = (), allowed: list[str] = ()) -> DataFrame:
    """FLT-10; allowed domains are applied as well (Q15)."""
    if blocked:
        df = df.filter(~S.any_of(F.col(url), list(blocked)))
    return df.filter(S.any_of(F.col(url), list(allowed))) if allowed else df


def complexity(df: DataFrame, text: str = "text") -> DataFrame:
    """STR-12, STR-14."""
    c = F.coalesce(F.col(text), F.lit(""))
    n = lambda p: S.count_of(c, p).cast("long")
    loc = F.size(F.filter(F.split(c, "\n", -1), lambda x: x.rlike("\\S") & ~x.rlike("^\\s*#"))).cast("long")
    df = df.withColumns({"loc": loc, "functions": n("def\\s+\\w+"), "methods": n("def\\s+\\w+\\(self"), "classes": n("class\\s+\\w+"), "ifs": n("\\bif\\s+"), "fors": n("\\bfor\\s+"), "whiles": n("\\bwhile\\s+"), "tries": n("\\btry\\s+")})
    df = df.withColumn("cyclomatic", 1 + F.col("ifs") + F.col("fors") + F.col("whiles") + F.col("tries"))
    index = F.when(F.col("loc") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 20 * F.least(F.col("loc") / 100, F.lit(1.0)) - 30 * F.least(F.col("cyclomatic") / 20, F.lit(1.0))))
    return df.withColumn("maintainability", F.round(index, 6))


#: What is suggested, in order.
SUGGESTIONS = {
    "complex": "High cyclomatic complexity - consider breaking into smaller functions",
    "large": "Large function - consider splitting into smaller modules",
    "bare_except": "Use specific exception types instead of bare except",
    "print": "Use logging instead of print statements for production code",
    "none": "Use 'is None' instead of '== None'",
    "enumerate": "Use enumerate() instead of range(len())",
}


def suggestions(df: DataFrame, text: str = "text") -> DataFrame:
    """STR-15: array of suggestions from six rules, over the figures of complexity()."""
    c = F.coalesce(F.col(text), F.lit(""))
    has = lambda w: F.contains(c, F.lit(w))
    rules = {"complex": F.col("cyclomatic") > 10, "large": F.col("loc") > 500, "bare_except": has("except:"), "print": has("print("), "none": has("==") & has("None"), "enumerate": c.rlike("for\\s+\\w+\\s+in\\s+range\\s*\\(\\s*len\\s*\\(")}
    return complexity(df, text).withColumn("suggestions", F.array_compact(F.array(*[F.when(rules[k], F.lit(v)) for k, v in SUGGESTIONS.items()])))


def code_issues(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """STR-13: (key, issue, line_no or null). Line rules per line, the others once a text."""
    c = F.col(text)
    todo = lines(df, key, text).select(key, "line_no", F.explode(F.array_compact(F.array(F.when(F.upper("line").rlike("TODO|FIXME"), F.lit("todo")), F.when(F.length("line") > 120, F.lit("long_line"))))).alias("issue"))
    whole = F.array_compact(F.array(
        F.when(c.rlike(S.re2("except\\s*:\\s*\\n\\s*pass")), F.lit("empty_except")), F.when(c.rlike(S.re2("(?i)password\\s*=\\s*[\"']")), F.lit("hardcoded_credentials")),
        F.when(c.rlike(S.re2("\\bprint\\s*\\(")) & ~c.startswith("# debug"), F.lit("debug_print")), F.when(c.rlike(S.re2("(?m)^([A-Z_][A-Z0-9_]*)\\s*=\\s*")), F.lit("global_variable"))))
    once = df.select(key, F.lit(None).cast("int").alias("line_no"), F.explode(whole).alias("issue"))
    return todo.unionByName(once).select(key, "issue", "line_no")


def brief(c: Column, n: int) -> Column:
    """PRJ-15: the first n non-blank lines, stripped."""
    return F.slice(F.filter(F.transform(F.split(c, "\n", -1), S.strip), lambda x: x != ""), 1, n)


def page_meta(df: DataFrame, html: str = "html") -> DataFrame:
    """STR-11."""
    get = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return df.withColumns({"title": get("(?i)<title[^>]*>([^<]+)</title>"), "description": get("(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']+)[\"']"), "og_image": get("(?i)<meta[^>]+property=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)[\"']")})


def links(html: Column, most: int = 50) -> Column:
    """STR-10."""
    return F.slice(F.regexp_extract_all(html, F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1)), 1, most)


def code_fence(c: Column) -> Column:
    """STR-18: the python block, else the first block, else the text."""
    first = F.nullif(S.strip(F.regexp_extract(c, "(?s)```python(.*?)```", 1)), F.lit(""))
    return F.coalesce(first, F.nullif(S.strip(F.regexp_extract(c, "(?s)```(.*?)```", 1)), F.lit("")), S.strip(c))


def final_answer(c: Column) -> Column:
    """STR-19."""
    c = S.strip(c)
    got = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in ("(?i)(?:the\\s+)?answer\\s+is\\s+(\\d+)", "=\\s*(\\d+)", "(\\d+)\\s*$")]
    return F.coalesce(*got, F.try_element_at(F.regexp_extract_all(c, F.lit("\\d+"), F.lit(0)), F.lit(-1)), c)


def same_answer(response: Column, correct: Column) -> Column:
    """STR-19: whether the final answer of a response is the correct one, as text or as a number; null is no answer."""
    got, want = S.strip(final_answer(response)), S.strip(correct)
    return F.coalesce((got == want) | F.coalesce(got.try_cast("double") == want.try_cast("double"), F.lit(False)), F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    """STR-20: equality without case and white space around; null equals nothing."""
    return F.coalesce(S.strip(F.lower(a)) == S.strip(F.lower(b)), F.lit(False))


def has_code(c: Column, words: tuple[str, ...] = ("```",)) -> Column:
    """FLT-13: whether a text holds a code block, or one of other words."""
    return F.coalesce(S.any_of(c, list(words)), F.lit(False))


def error_type(c: Column, known: dict[str, str]) -> Column:
    """STR-16, JOIN-08: advice for the error named in a text."""
    name = F.regexp_extract(c, "(\\w+Error):", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name), F.lit("unknown"))


def traceback_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """STR-17: frames and the main error line."""
    ls = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return df.withColumns({"n_frames": F.size(F.filter(ls, lambda x: x.rlike('^\\s*File "'))), "error_line": F.try_element_at(F.filter(ls, lambda x: x.rlike("Error|Exception")), F.lit(-1))})


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """STR-23."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def snippet(c: Column, n: int) -> Column:
    """STR-24."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def replace_counted(df: DataFrame, pattern: str, new: str, text: str = "text") -> DataFrame:
    """STR-21."""
    return df.withColumns({"n_replaced": S.count_of(F.col(text), pattern).cast("long"), "replaced": F.regexp_replace(text, pattern, new)})


def delete_lines(c: Column, pattern: str) -> Column:
    """STR-21."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~x.rlike(pattern)), "\n")


def delete_range(c: Column, first: int, last: int) -> Column:
    """STR-21: the text without lines first to last (from 1); a range that does not lie in the text changes nothing."""
    ls = F.split(c, "\n", -1)
    if not 1 <= first <= last:
        return c
    return F.when(F.size(ls) < last, c).otherwise(F.array_join(F.filter(ls, lambda x, i: (i < first - 1) | (i >= last)), "\n"))


def insert_line(c: Column, at: int, line: str) -> Column:
    """STR-21: the text with a line put before line `at` (from 1, one past the last allowed; else nothing changes)."""
    ls = F.split(c, "\n", -1)
    if at < 1:
        return c
    return F.when(F.size(ls) < at - 1, c).otherwise(F.array_join(F.concat(F.slice(ls, 1, at - 1), F.array(F.lit(line)), F.slice(ls, F.lit(at), F.size(ls))), "\n"))
