"""Line dedup by content-defined chunks of lines (DataFrame functions only).

A text's lines are hashed; a rolling hash over each line and the WINDOW - 1 lines before it ends a chunk where it
is 0 modulo PERIOD. Borders depend on the lines around them alone, so that a passage that is shifted by other lines
is cut alike. A chunk of two lines or more, with a word in it, that occurs again anywhere is removed wherever it is
not the first occurrence, in the order of (doc_id, md5 of text, place), after its bytes have been compared with the
first occurrence's. Single-line chunks stay.

passages() cuts more densely, so that what repeats is found wherever it stands. Lines with a word are hashed; a rolling hash
over such a line and the one before it makes the line a border unless it is 0 modulo `spare`. A chunk runs from a border to the next one
and holds both, so neighbours overlap by a line. A chunk that occurs again anywhere is removed wherever it is not
the first occurrence, in the order of (doc_id, number from the md5 of text, place). Digests only choose what is compared: chunks are
removed where their bytes are equal. Of a repeated run all between its first and last border goes; with SPARE, by theory, one run
of 3 lines in 23 and one of 4 in 140 holds fewer than two borders and stays. Without `spare` every line with a word is a border: a
repeated run of two such lines or more goes whole, wherever it starts, and the first occurrence of every line stays.

Null text stays null and has no lines. Null doc_ids come first. Rows that repeat both doc_id and text count as one
row and are treated alike. Very long texts are whole. An empty table gives no row. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, fresh, join_hot

WINDOW, PERIOD, BASES, PRIME, SPARE = 3, 4, (1, 1_000_003, 1_299_709), 2_147_483_647, 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _chunks(lines: Column, hashes: Column) -> Column:
    """array<struct<start,n>> of the chunks of an array of lines."""
    part = lambda i, j: F.coalesce(F.get(hashes, i - j), F.lit(0).cast("long")) * BASES[j]
    ends = lambda i: F.pmod(part(i, 0) + part(i, 1) + part(i, 2), F.lit(PRIME)) % PERIOD == 0
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    cuts = F.filter(every, lambda i: ends(i) | (i == F.size(lines) - 1))
    return F.transform(cuts, lambda e: e + 1)


def _prepared(docs: DataFrame, lines: str, hashes: str, cuts: str) -> DataFrame:
    d = docs.withColumn(lines, _lines(F.col("text")))
    d = d.withColumn(hashes, F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    return d.withColumn(cuts, _chunks(F.col(lines), F.col(hashes))).drop(hashes)


def _pieces(lines: str, cuts: str) -> Column:
    """array<struct<start,n,body>>: the chunks with their text."""
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col(cuts), k - 1))
    return F.transform(F.col(cuts), lambda e, k: F.struct((e - start(k)).alias("n"), F.array_join(F.slice(F.col(lines), start(k) + 1, e - start(k)), "\n").alias("body")))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_lines, n_removed_lines, n_removed_chunks (long) added (or replaced).

    Chunks meet by the md5 of their text: first without their text, to find those that occur again; these are then
    compared, byte by byte, with the first occurrence. A chunk that very many documents share is dealt to many tasks."""
    slim = _prepared(docs.select("doc_id", "text").filter(F.col("text").isNotNull()), "lines", "hashes", "cuts")
    slim = slim.select("doc_id", F.md5("text").alias("th"), F.posexplode(_pieces("lines", "cuts")).alias("k", "c"))
    slim = slim.filter((F.col("c.n") >= 2) & F.col("c.body").rlike("[^ \\x09-\\x0d]"))
    slim = slim.select("doc_id", "th", "k", F.unhex(F.md5("c.body")).alias("h"), F.col("c.body").alias("body"))
    place = F.struct("doc_id", "th", "k")
    first = cut(slim.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), share=4)
    shared = cut(join_hot(slim, first, "h", "n"), "zstd")
    bodies = cut(shared.filter(place == F.col("first")).select("h", "n", F.col("body").alias("own")).dropDuplicates(["h"]), "zstd", share=4)
    again = join_hot(shared.filter(place != F.col("first")).drop("n", "first"), bodies, "h", "n").filter(F.col("body") == F.col("own"))
    i, th, lines, hashes, cuts, pieces, gone = fresh(docs, "i", "th", "lines", "hashes", "cuts", "pieces", "gone")
    again = again.groupBy(F.col("doc_id").alias(i), F.col("th").alias(th)).agg(F.collect_set("k").alias(gone))
    own = f"{th}_"
    d = docs.withColumn(own, F.md5("text"))
    d = d.join(again, d["doc_id"].eqNullSafe(F.col(i)) & (F.col(own) == F.col(th)), "left").drop(i, th, own)
    d = _prepared(d, lines, hashes, cuts)
    d = d.withColumn(pieces, _pieces(lines, cuts)).drop(cuts)
    some = F.col(gone).isNotNull()
    lost = F.aggregate(gone, F.lit(0), lambda acc, k: acc + F.get(F.col(pieces), k).n)
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone))
    out = {
        "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        "n_removed_lines": F.when(some, lost).otherwise(0).cast("long"),
        "n_removed_chunks": F.when(some, F.size(gone)).otherwise(0).cast("long"),
        "text": F.when(some, F.array_join(F.transform(kept, lambda k: F.get(F.col(pieces), k).body), "\n")).otherwise(F.col("text")),
    }
    # a generator stands between these columns and later filters on them, which would else repeat all the work above
    (made,) = fresh(d, "made")
    kept = [c for c in docs.columns if c not in out]
    d = d.select(*kept, F.explode(F.array(F.struct(*[c.alias(k) for k, c in out.items()]))).alias(made))
    order = [*docs.columns, *[k for k in out if k not in docs.columns]]
    return d.select(*[F.col(f"{made}.{k}") if k in out else F.col(k) for k in order])


def _place_of_text(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _passage_chunks(docs: DataFrame, spare: int | None) -> DataFrame:
    """(doc_id, th, a, b, body): first and last line of each chunk, and its text."""
    d = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", _place_of_text(F.col("text")).alias("th"), _lines(F.col("text")).alias("lines"))
    wordy = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike("[^ \\x09-\\x0d]"))
    # each step is a column behind a generator, as a lambda would work it out for every element
    if spare:
        d = d.select("doc_id", "th", "lines", F.explode(F.array(F.struct(wordy.alias("w"), F.transform(wordy, lambda i: _line_hash(F.get("lines", i))).alias("h")))).alias("x"))
        part = lambda k, j: F.coalesce(F.get("x.h", k - j), F.lit(0).cast("long")) * BASES[j]
        border = F.filter(F.transform("x.w", lambda i, k: F.when(F.pmod(part(k, 0) + part(k, 1), F.lit(PRIME)) % spare != 0, i)), lambda i: i.isNotNull())
    else:
        border = wordy
    d = d.select("doc_id", "th", "lines", F.explode(F.array(border)).alias("w"))
    ends = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    d = d.select("doc_id", "th", "lines", F.explode(F.filter(ends, lambda x: x.b.isNotNull())).alias("p"))
    return d.select("doc_id", "th", "p.a", "p.b", F.array_join(F.slice("lines", F.col("p.a") + 1, F.col("p.b") - F.col("p.a") + 1), "\n").alias("body"))


def passages(docs: DataFrame, spare: int | None = None, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """docs with text cut, and n_lines and n_removed_lines (long) added (or replaced). Chunks whose digest occurs once leave
    first; the others are counted and joined by their text itself. A chunk that very many documents share is dealt to many tasks."""
    slim = _passage_chunks(docs, spare).withColumn("h", F.unhex(digest(F.col("body"))))
    place = F.struct("doc_id", "th", "a")
    alike = cut(slim.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), share=4)
    shared = cut(join_hot(slim, alike, "h", "n").drop("n", "h"), "zstd")
    free(alike)
    # these two tables stay until the driver ends, as the result reads them
    first = cut(shared.groupBy("body").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "zstd", share=4)
    again = join_hot(shared, first, "body", "n").filter(place != F.col("first"))
    i, th, lines, gone, own = fresh(docs, "i", "th", "lines", "gone", "own")
    again = again.groupBy(F.col("doc_id").alias(i), F.col("th").alias(th)).agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "b")))).alias(gone))
    d = docs.withColumn(own, _place_of_text(F.col("text")))
    d = d.join(again, d["doc_id"].eqNullSafe(F.col(i)) & (F.col(own) == F.col(th)), "left").drop(i, th, own)
    d = d.withColumn(lines, _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    out = {
        "n_lines": F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0).cast("long"),
        "n_removed_lines": F.when(F.col(gone).isNotNull(), F.size(gone)).otherwise(0).cast("long"),
        "text": F.when(F.col(gone).isNotNull(), F.array_join(F.transform(kept, lambda k: F.get(F.col(lines), k)), "\n")).otherwise(F.col("text")),
    }
    # as in dedup(): a generator keeps later filters from repeating the work
    (made,) = fresh(d, "made")
    d = d.select(*[c for c in docs.columns if c not in out], F.explode(F.array(F.struct(*[c.alias(k) for k, c in out.items()]))).alias(made))
    order = [*docs.columns, *[k for k in out if k not in docs.columns]]
    return d.select(*[F.col(f"{made}.{k}") if k in out else F.col(k) for k in order])


def removed_passages(docs: DataFrame) -> DataFrame:
    """op4 with a border at every line."""
    out = passages(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def removed(docs: DataFrame) -> DataFrame:
    """op4."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: SQL for the rows of removed(); chunks are compared as strings.
SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, md5(text) AS th FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, th, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
e AS (SELECT *, ((h + {BASES[1]} * coalesce(lag(h) OVER w, 0) + {BASES[2]} * coalesce(lag(h, 2) OVER w, 0)) % {PRIME}) % {PERIOD} = 0 AS ends
      FROM h WINDOW w AS (PARTITION BY doc_id, th ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, th ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, th, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY ALL),
r AS (SELECT *, n >= 2 AND regexp_matches(body, '[^ \x09-\x0d]')
             AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id NULLS FIRST, th, k) > 1 AS gone FROM c),
o AS (SELECT doc_id, th, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
             count(*) FILTER (WHERE gone) AS n_removed_chunks,
             sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM r GROUP BY ALL)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
       coalesce(n_removed_chunks, 0) AS n_removed_chunks, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents x LEFT JOIN o ON x.doc_id IS NOT DISTINCT FROM o.doc_id AND md5(x.text) = o.th
"""


def passages_sql(spare: int | None = None) -> str:
    """SQL for the digests of passages(); chunks are compared as strings."""
    border = f"((h + {BASES[1]} * coalesce(lag(h) OVER (PARTITION BY doc_id, th ORDER BY i), 0)) % {PRIME}) % {spare} <> 0" if spare else "true"
    return rf"""
WITH d AS (SELECT DISTINCT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS th, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, th, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
v AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l WHERE regexp_matches(line, '[^ \x09-\x0d]')),
x AS (SELECT *, {border} AS border FROM v),
w AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, th ORDER BY i) AS b FROM x WHERE border),
p AS (SELECT doc_id, th, i, b, array_to_string(lines[i:b], chr(10)) AS body FROM w WHERE b IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, th, i) > 1 AS again FROM p),
g AS (SELECT DISTINCT doc_id, th, unnest(range(i, b + 1)) AS i FROM r WHERE again),
o AS (SELECT l.doc_id, l.th, count(*) AS n_lines, count(g.i) AS n_removed_lines,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
      FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.th = g.th AND l.i = g.i GROUP BY ALL)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents x LEFT JOIN o ON x.doc_id IS NOT DISTINCT FROM o.doc_id AND ('0x' || substr(md5(x.text), 1, 15))::BIGINT = o.th
"""


#: SQL for the rows of removed_passages().
PASSAGES_SQL = passages_sql()
