"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule compares one statistic of a text with a cutoff. All rules are tightened together along one fixed path: step by
step, from the most lenient cutoffs to the strictest, one rule by one notch at a time (path()). A text is rejected from
the first step on at which some rule rejects it. The labelled documents of quality 1 that pass the base rules are the
holdout. For every stratum (language) the exact binomial tail tests, step after step, the hypothesis that the rules
together reject more than RISK of the stratum's good documents; the path is left before the first step without proof.
As the order is fixed beforehand, all tests of a stratum may use its whole level (fixed-sequence testing), which is
DELTA divided by the number of strata (Bonferroni). So, with confidence 1 - DELTA for all strata at once, no more than
RISK of any stratum's good documents are rejected wrongly. 86 good labels suffice for a proof with four strata; where
there are fewer, nothing is rejected but by the base rules.

The tail P(X <= k) is summed in terms relative to the last one, whose logarithm comes from Stirling's series; what
is left after TERMS terms is bounded from above by a geometric series, which keeps the guarantee.

Null text has no words and fails the base rules. A null language is a stratum of its own; strata are counted over the
holdout. Conflicting labels of a document count as quality 0, labels without doc_id or quality do not count. Repeated
rows are judged alike, and count as often as they occur. An empty table gives no row. Extra columns are not read. Very long texts are
counted whole.

Two limits of the guarantee. Copies of one text count as trials of their own, as the test draws documents and not texts: where copies are
frequent, the bound is surer of itself than it should be. And where more than TERMS good documents are rejected at one step, the bounded rest may
stop the path a step before its SQL, which sums all terms, does; never after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_small

RISK, DELTA, TERMS = 0.05, 0.05, 5000
#: Rule: the statistic, whether large values are rejected, and the cutoffs.
RULES: dict[str, tuple[str, bool, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", True, (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)),
    "long_words": ("word_chars / n_words", True, (6.5, 7.0, 8.0, 10.0, 15.0, 20.0, 50.0)),
    "short_words": ("word_chars / n_words", False, (4.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.1)),
    "repeated_lines": ("n_dup_lines / n_words", True, (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3)),
    "repeated_words": ("n_repeat_words / n_words", True, (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45)),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row.

    Windows of three words are found again by sorting them with their places, within the row: no shuffle."""
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0d]")
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), has_word))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    blanks = " \t\n\x0b\x0c\r"
    d = d.withColumn("word_chars", F.length(F.translate("text", blanks, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"))
    d = d.withColumn("words", F.filter(F.split("text", "[\\x20\\x09-\\x0d]+", -1), lambda w: w != "")).drop("text")
    d = d.withColumn("n_words", F.size("words").cast("long"))
    at = F.sequence(F.lit(0), F.size("words") - 3)
    window = F.when(F.size("words") >= 3, F.transform(at, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("h", window)
    d = d.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    # places of windows that occur more than once: neighbours in the sorted array have equal hashes
    pairs = F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("s", pairs).drop("h", "words")
    twin = lambda a, b: a.h.eqNullSafe(b.h)
    d = d.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform(F.filter("s", lambda x, j: twin(x, F.get("s", j - 1)) | twin(x, F.get("s", j + 1))), lambda x: x.i))))
    covered = F.aggregate(F.transform("s", lambda p, j: F.least(F.coalesce(F.get("s", j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
    d = d.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("long")).drop("s", "again")
    # a generator stands between these steps and later filters, which would else repeat them all
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = d.select("doc_id", "lang", F.explode(F.array(F.struct(*counts))).alias("c")).select("doc_id", "lang", *[F.col(f"c.{c}") for c in counts])
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lgamma(x: Column) -> Column:
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(reduce(lambda a, i: a * (x + float(i)), range(1, 8), x))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), or a little more; 1 where k / n is not below p."""
    n, k = n.cast("double"), k.cast("double")
    last = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    ratio = lambda i: (k - i) / (n - k + i + 1) * ((1 - p) / p)  # noqa: E731  of the term for k-i-1 to that for k-i
    add = lambda acc, i: F.struct((acc.sum + acc.term).alias("sum"), (acc.term * ratio(i)).alias("term"))
    upto = F.sequence(F.lit(0), F.least(k, F.lit(TERMS)).cast("int"))
    rest = lambda acc: acc.sum + acc.term / (1 - F.least(F.greatest(ratio(F.lit(TERMS)), F.lit(0.0)), F.lit(0.999999)))
    total = F.aggregate(upto, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")), add, lambda acc: F.when(k > TERMS, rest(acc)).otherwise(acc.sum))
    return F.when((n > 0) & (k < n * p), F.least(F.exp(last) * total, F.lit(1.0))).otherwise(1.0)


def _value(ratio: str) -> Column:
    above, below = ratio.split(" / ")
    return F.try_divide(F.col(above).cast("double"), F.col(below))


def path() -> list[tuple[str, float]]:
    """The fixed path: at each step one rule gets this cutoff, while the others keep theirs."""
    most = max(len(g) for _, _, g in RULES.values())
    return [(rule, g[len(g) - 1 - level]) for level in range(most) for rule, (_, _, g) in RULES.items() if level < len(g)]


def first_step() -> Column:
    """The first step (from 1) at which some rule rejects a text; null if none does."""
    rejects = lambda rule, c: _value(RULES[rule][0]) > c if RULES[rule][1] else _value(RULES[rule][0]) < c
    return F.least(F.lit(None).cast("int"), *[
        F.coalesce(*[F.when(rejects(rule, c), F.lit(i)) for i, (name, c) in enumerate(path(), 1) if name == rule]) for rule in RULES])


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """lang, n (good labelled documents), steps (of the path, that are proven safe) and one column per rule: its cutoff
    after those steps, or null."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    known = stats.filter("NOT base_failed").join(good, "doc_id", "left_semi").select("lang", first_step().alias("step"))
    steps = path()
    ks = F.array(*[F.count_if(F.col("step") <= i + 1) for i in range(len(steps))])
    counted = cut(known.groupBy("lang").agg(F.count("*").alias("n"), ks.alias("ks")).coalesce(1))
    level = delta / max(1, counted.count())
    tested = counted.select("lang", "n", F.posexplode("ks").alias("i", "k")).withColumn("safe", binomial_tail(F.col("n"), F.col("k"), risk) <= level)
    proven = tested.groupBy("lang").agg(F.first("n").alias("n"), F.coalesce(F.min(F.when(~F.col("safe"), F.col("i"))), F.lit(len(steps))).alias("steps"))
    last = lambda rule: F.coalesce(*[F.when(F.col("steps") >= i, F.lit(c)) for i, (name, c) in reversed(list(enumerate(steps, 1))) if name == rule])
    return proven.select("lang", "n", "steps", *[last(r).alias(r) for r in RULES])


def judge(stats: DataFrame, safe: DataFrame) -> DataFrame:
    """Add kept: false where the base rules fail or a step that is safe for the language rejects."""
    (steps,) = fresh(stats, "steps")
    d = join_small(stats, cut(safe.select("lang", F.col("steps").alias(steps))), ["lang"])
    return d.withColumn("kept", ~(F.col("base_failed") | F.coalesce(first_step() <= F.col(steps), F.lit(False)))).drop(steps)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op3."""
    stats = cut(statistics(docs))
    out = judge(stats, cutoffs(stats, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    values = ", ".join(f"({i}, '{r}', {str(RULES[r][1]).lower()}, {c}::DOUBLE)" for i, (r, c) in enumerate(path(), 1))
    stat = " ".join(f"WHEN '{r}' THEN {v.replace(' / ', '::DOUBLE / ')}" for r, (v, _, _) in RULES.items())
    return rf"""
WITH x AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0d]+'), lambda v: v <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0d]')) AS l FROM x),
i AS (SELECT row, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT row, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM i WINDOW o AS (PARTITION BY row ORDER BY i)),
t AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM g WHERE c IS NOT NULL),
rep AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM t WHERE n > 1) GROUP BY row),
s AS (SELECT x.row, doc_id, lang, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0d]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM x JOIN w USING (row) LEFT JOIN rep USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
rules(step, rule, high, cutoff) AS (VALUES {values}),
r AS (SELECT row, min(step) AS step FROM (SELECT row, step, high, cutoff, CASE rule {stat} END AS v FROM b, rules WHERE n_words > 0)
      WHERE CASE WHEN high THEN v > cutoff ELSE v < cutoff END GROUP BY row),
known AS (SELECT lang, r.step FROM b SEMI JOIN good USING (doc_id) LEFT JOIN r USING (row) WHERE NOT base_failed),
counted AS (SELECT lang, rules.step, count(*) AS n, count(*) FILTER (WHERE known.step <= rules.step) AS k FROM known, rules GROUP BY ALL),
tested AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))
                  <= {DELTA} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM known)) AS safe FROM counted),
proven AS (SELECT lang, coalesce(min(step) FILTER (WHERE NOT safe), {len(path()) + 1}) AS unsafe FROM tested GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(r.step >= coalesce(unsafe, 0), true) AS kept
FROM b LEFT JOIN r USING (row) LEFT JOIN proven ON b.lang IS NOT DISTINCT FROM proven.lang
"""


#: SQL for the rows of verdicts().
SQL = _sql()
