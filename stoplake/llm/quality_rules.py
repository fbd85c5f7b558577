"""Quality rules by cross-document line frequency (operator 2), in DataFrame functions only.

Normalised lines are hashed. For each host and line the distinct documents are counted; documents with
equal texts count once. Lines above the limit are boilerplate if these documents are more than near copies
of each other, as their surroundings tell. The surrounding is taken from a document's own lines: those that
are neither above the limit nor an edited form of such a line (the same words at the beginning or end). A
document that has nothing but lines above the limit goes by their set; edited copies without a line of
their own are one surrounding. So shared lines of a host do not hide each other, and a group of near copies,
which differ in edits, does not condemn its own lines. Boilerplate lines are removed, and a document that
loses more than half of its words is rejected.

Counting sums up before each shuffle, so that a line or host with a third of all rows is one row for each
task; the join of lines against the boilerplate lines is one that Spark can split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplake.llm.common import GAP_SQL, discard, materialise

#: A line is above the limit in more documents of a host than this.
LIMIT_DOCS = 30
#: Boilerplate has at least this many surroundings for each hundred documents.
SURROUNDINGS_PER_100 = 50
#: A document goes if more than this many in a hundred of its words were in removed lines.
DEPLETED_PER_100 = 50
LEAST_WORDS, MOST_REPEATED_PER_100 = 50, 50
#: The base columns.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WHITE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; empty for a text without one."""
    bare = F.trim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP_SQL))


def normal(line: Column) -> Column:
    """A line in lower case, digits as 0, white space as one blank; empty without a word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), GAP_SQL, " "))


def line_hash(normal_line: Column) -> Column:
    """The first 60 bits of the MD5 of a normal line."""
    return F.conv(F.substring(F.md5(normal_line), 1, 15), 16, 10).cast("long")


def copy_hash(text: Column) -> Column:
    """By this equal texts are known; 64 bits."""
    return F.xxhash64(text)


def base_columns(docs: DataFrame) -> DataFrame:
    """docs(..., text) with the base columns; a null text has no words."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    out = docs.withColumns({"_w": words(t), "_l": lines, "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long")})
    m = F.greatest(F.size("_w") - 2, F.lit(0))
    windows = F.arrays_zip(F.slice("_w", F.lit(1), m).alias("x"), F.slice("_w", F.lit(2), m).alias("y"), F.slice("_w", F.lit(3), m).alias("z"))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.transform(windows, lambda x: F.xxhash64(x["x"], x["y"], x["z"])),
        }
    ).drop("_w", "_l")
    # texts that repeat no window are not sorted; each array is a column, so that it is made once
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(pairs)).drop("_h")
    edge = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    ahead = F.concat(F.slice("_s", F.lit(2), F.size("_s")), edge)
    behind = F.concat(edge, F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))))
    triples = F.arrays_zip(F.col("_s").alias("x"), ahead.alias("y"), behind.alias("z"))
    out = out.withColumn("_t", F.when(F.size("_s") > 0, triples))
    again = F.filter("_t", lambda t: (t["x"]["h"].eqNullSafe(t["y"]["h"])) | (t["x"]["h"].eqNullSafe(t["z"]["h"])))
    places = F.sort_array(F.transform(again, lambda t: t["x"]["i"]))
    out = out.withColumn("_p", F.coalesce(places, F.array().cast("array<int>"))).drop("_s", "_t")
    steps = F.zip_with(F.slice("_p", F.lit(2), F.size("_p")), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("_p") == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda x, y: x + y))
    out = out.withColumn("n_repeat_words", covered.cast("long")).drop("_p")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PER_100 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def line_rows(docs: DataFrame) -> DataFrame:
    """host, copy (of the text), line, words, head and tail of each line of each text that has a word.

    head and tail are hashes of the first and last words, as many as the greatest power of two up to half
    of the line; null where that is less than two. An edit of a line mostly leaves one of them.
    """
    held = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce("source", F.lit("")).alias("host"), copy_hash(F.col("text")).alias("copy"), F.filter(F.transform(F.split("text", "\n"), normal), lambda x: x != "").alias("lines")
    )
    rows = held.select("host", "copy", F.explode("lines").alias("x"))
    # words of a normal line: its blanks and one
    rows = rows.withColumn("n", F.length("x") - F.length(F.replace("x", F.lit(" "), F.lit(""))) + 1)
    size = F.when(F.col("n") >= 64, 32).when(F.col("n") >= 32, 16).when(F.col("n") >= 16, 8).when(F.col("n") >= 8, 4).when(F.col("n") >= 4, 2)
    edge = lambda k, seed: F.when(k.isNotNull(), F.xxhash64(F.lit(seed), F.call_function("substring_index", F.col("x"), F.lit(" "), k)))
    return rows.select("host", "copy", line_hash(F.col("x")).alias("line"), "n", edge(size, 1).alias("head"), edge(-size, 2).alias("tail"))


def lines_of_texts(docs: DataFrame) -> DataFrame:
    """line_rows() with one row for each line of each distinct text of a host, written once for all uses.

    n adds up the words of all copies of a text.
    """
    sums = line_rows(docs).groupBy("host", "line", "copy").agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.sum("n").alias("n"))
    return materialise(sums, "lines")


def boilerplate(once: DataFrame) -> DataFrame:
    """host and line of the lines to remove, of what lines_of_texts() gives."""
    above = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("head").alias("head"), F.min("tail").alias("tail")).filter(F.col("n_docs") > LIMIT_DOCS)
    above = materialise(above, "above")
    spots = materialise(once.select("host", "line", "copy").join(above.select("host", "line"), ["host", "line"]), "spots")
    # of each document the lines that are not above the limit; an edit of one that is has its head or its tail
    others = once.join(spots.select("host", "copy").distinct(), ["host", "copy"], "left_semi").join(above.select("host", "line"), ["host", "line"], "left_anti")
    for part in ("head", "tail"):
        known = above.filter(F.col(part).isNotNull()).select("host", part).distinct().withColumn(f"is_{part}", F.lit(True))
        others = others.join(known, ["host", part], "left")
    own = others.groupBy("host", "copy").agg(F.min(F.when(F.col("is_head").isNull() & F.col("is_tail").isNull(), F.col("line"))).alias("own"), F.count(F.lit(1)).alias("n"))
    # a document of shared lines alone goes by their set; edited copies without a line of their own are one surrounding
    bare = spots.groupBy("host", "copy").agg(F.bit_xor("line").alias("set"))
    found = bare.join(own, ["host", "copy"], "left").select("host", "copy", F.coalesce("own", F.when(F.col("n").isNull(), F.col("set")), F.lit(-1)).alias("surrounding"))
    apart = spots.join(found, ["host", "copy"]).groupBy("host", "line", "surrounding").agg(F.count(F.lit(1)).alias("n"))
    lines = apart.groupBy("host", "line").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_surroundings"))
    out = materialise(lines.filter(100 * F.col("n_surroundings") >= SURROUNDINGS_PER_100 * F.col("n_docs")).select("host", "line"), "boilerplate")
    discard(above)
    discard(spots)
    return out


def lost_words(docs: DataFrame) -> DataFrame:
    """host, copy, lost (words in removed lines) and lines (their hashes), for texts that lose any."""
    once = lines_of_texts(docs)
    # copies of a text have the same lines: what they add up is divided by their number
    copies = docs.filter(F.col("text").isNotNull()).groupBy(F.coalesce("source", F.lit("")).alias("host"), copy_hash(F.col("text")).alias("copy")).agg(F.count(F.lit(1)).alias("copies"))
    lost = once.join(boilerplate(once), ["host", "line"]).groupBy("host", "copy").agg(F.sum("n").alias("lost"), F.collect_set("line").alias("lines"))
    return lost.join(copies, ["host", "copy"]).select("host", "copy", (F.col("lost") / F.col("copies")).cast("long").alias("lost"), "lines")


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): the base columns, removed_words and kept.

    A null text counts as one without words; a null source is a host of its own, as '' is. Rows with equal
    texts and hosts get equal verdicts; a repeated or null doc_id is no obstacle. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", "source")
    lost = lost_words(docs).drop("lines")
    base = base_columns(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("host"), copy_hash(F.coalesce("text", F.lit(""))).alias("copy"), *BASE)
    joined = base.join(lost, ["host", "copy"], "left")
    removed = F.coalesce("lost", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & ~(100 * removed > DEPLETED_PER_100 * F.col("n_words"))
    return joined.select("doc_id", *BASE, kept.alias("kept"), removed.alias("removed_words"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, boilerplate lines removed from text; n_chars follows.

    All columns of docs are kept, whatever their names; n_chars is renewed if there is one. Verdicts are
    written first: a filter on them would otherwise be pushed into the arrays that they come from.
    """
    names = docs.columns
    narrow = docs.select("doc_id", "text", "source")
    host, copy = F.coalesce("source", F.lit("")).alias("host"), copy_hash(F.coalesce("text", F.lit(""))).alias("copy")
    base = materialise(base_columns(narrow).select(host, copy, "n_words", "base_failed"), "verdicts").dropDuplicates(["host", "copy"])
    good = base.filter(~F.col("base_failed")).join(lost_words(narrow), ["host", "copy"], "left")
    good = good.filter(~(100 * F.coalesce("lost", F.lit(0)) > DEPLETED_PER_100 * F.col("n_words"))).select("host", "copy", "lines")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), host, copy)
    rest = held.join(good, ["host", "copy"])
    left = F.array_join(F.filter(F.split("_row.text", "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("lines"), line_hash(normal(x))), F.lit(False))), "\n")
    rest = rest.withColumn("_text", F.when(F.col("lines").isNull(), F.col("_row.text")).otherwise(left))
    renewed = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return rest.select(*[renewed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


#: DuckDB SQL for judge().
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text AS raw, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid
), base AS (
  SELECT w.rid, doc_id, host, md5(text) AS copy, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid
), norm AS (
  SELECT rid, host, md5(raw) AS copy,
    trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS b
  FROM (SELECT rid, host, raw, unnest(string_split(raw, chr(10))) AS x FROM d WHERE raw IS NOT NULL)
), lines AS (
  SELECT rid, host, copy, line, n, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[n - k + 1:], ' ') AS tail FROM (
    SELECT *, CASE WHEN n >= 64 THEN 32 WHEN n >= 32 THEN 16 WHEN n >= 16 THEN 8 WHEN n >= 8 THEN 4 WHEN n >= 4 THEN 2 END AS k
    FROM (SELECT rid, host, copy, substr(md5(b), 1, 15) AS line, string_split(b, ' ') AS ws, len(string_split(b, ' ')) AS n FROM norm WHERE b <> '')
  )
), above AS (
  SELECT host, line, CASE WHEN min(n) >= 4 THEN min(head) END AS head, CASE WHEN min(n) >= 4 THEN min(tail) END AS tail
  FROM lines GROUP BY host, line HAVING count(DISTINCT copy) > 30
), spots AS (
  SELECT DISTINCT host, line, copy FROM lines SEMI JOIN above USING (host, line)
), others AS (
  SELECT DISTINCT host, copy, line, head, tail, n FROM lines SEMI JOIN spots USING (host, copy) ANTI JOIN above USING (host, line)
), own AS (
  SELECT host, copy, min(CASE WHEN n < 4 OR h IS NULL AND t IS NULL THEN line END) AS own FROM others
  LEFT JOIN (SELECT DISTINCT host, head, 1 AS h FROM above WHERE head IS NOT NULL) USING (host, head)
  LEFT JOIN (SELECT DISTINCT host, tail, 1 AS t FROM above WHERE tail IS NOT NULL) USING (host, tail) GROUP BY host, copy
), found AS (
  SELECT host, copy, CASE WHEN own.host IS NULL THEN 'set ' || s ELSE coalesce(own.own, 'edited') END AS surrounding
  FROM (SELECT host, copy, string_agg(line, ' ' ORDER BY line) AS s FROM spots GROUP BY host, copy) b LEFT JOIN own USING (host, copy)
), bad AS (
  SELECT host, line FROM spots JOIN found USING (host, copy) GROUP BY host, line
  HAVING 100 * count(DISTINCT surrounding) >= 50 * count(*)
), lost AS (
  SELECT rid, sum(n) AS lost FROM lines JOIN bad USING (host, line) GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * coalesce(lost, 0) > 50 * n_words) AS kept,
  CAST(coalesce(lost, 0) AS BIGINT) AS removed_words
FROM base LEFT JOIN lost USING (rid)
"""
