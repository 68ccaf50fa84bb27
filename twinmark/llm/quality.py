"""Quality rules: document measures, and line frequency across the documents of a host.

Only DataFrame expressions: a document's measures come from its own arrays of words and lines, and the
line table is counted with partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: A line is boilerplate of its host if it stands in more than this share of the host's distinct texts ...
LINE_SHARE = 0.05
#: ... and in more than this many of them.
LINE_DOCS = 20
#: Lines of this many words or more need no share: prose does not repeat them by chance.
LONG_WORDS = 8
#: A document is depleted if less than this share of its words is left, or fewer words than this.
LEFT_SHARE = 0.3
LEFT_WORDS = 50
KEY = ["host", "_key", "_len"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def normal(line: Column) -> Column:
    """A line in lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))


def _blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " ", ""))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A 3-word window is compared by the 64-bit hash of its words.  Windows are sorted with their places;
    the places of those that have an equal neighbour are sorted again, and each covers the words up to
    the next such place, three at most.  That is n log n for a text of any length.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    real = F.filter(_lines(F.col(text)), lambda x: x.rlike(WORD))
    one = docs.withColumn("_w", words(F.col(text))).withColumn("_lines", real).withColumn("_chars", F.length(t)) \
        .withColumn("word_chars", F.length(_without(t, SPACES)).cast("long")) \
        .withColumn("n_symbols", (F.col("_chars") - F.length(_without(t, SYMBOLS))).cast("long")).drop(text)
    w = F.col("_w")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
    two = one.withColumn("n_words", F.size("_w").cast("long")) \
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")) \
        .withColumn("_s", F.when(F.size("_w") >= 3, F.sort_array(window))).drop("_w", "_lines", "_chars")
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    three = two.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("_s")
    p = F.col("_p")
    covered = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    done = three.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_p")
    return done.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def text_key(text: Column) -> list[Column]:
    """What stands for a text in joins: its 64-bit hash and its length."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_key"), F.length(t).alias("_len")]


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", long_words: int | None = LONG_WORDS) -> tuple[DataFrame, DataFrame]:
    """The line table, and the lines above their host's limits.

    First: (host, _key, _len, line, words), a row for each distinct line of each distinct text of a host;
    ``words`` adds up the words of its repetitions.  Second: (host, line).  Equal texts count as one
    document, so copies of a clean document do not turn its lines into boilerplate.  A null host is a
    host of its own.  Lines of ``long_words`` or more are judged by their documents alone, not by the share
    (None: all lines need the share).
    """
    once = lambda c: [] if long_words is None else [F.max(c).alias("once")]
    each = F.transform("_n", lambda x: F.struct(F.xxhash64(x).alias("line"), (_blanks(x) + 1).alias("words")))
    rows = docs.select(_host(host), *text_key(F.col(text)), F.filter(F.transform(_lines(F.col(text)), normal), lambda x: x != "").alias("_n")) \
        .select("host", "_key", "_len", each.alias("_e")).select("host", "_key", "_len", F.explode("_e").alias("e"))
    lines = stored(rows.groupBy("host", "_key", "_len", "e.line").agg(F.sum("e.words").alias("words"), *once("e.words")), "lines")
    hosts = docs.select(_host(host), *text_key(F.col(text))).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), *once("once")).filter(F.col("docs") > LINE_DOCS)
    shared = F.col("docs") > F.col("texts") * LINE_SHARE
    above = counts.join(hosts, "host").filter(shared if long_words is None else shared | (F.col("once") >= long_words)).select("host", "line")
    return lines, stored(above, "frequent")


def cut_texts(lines: DataFrame, above: DataFrame) -> DataFrame:
    """(host, _key, _len, cut, left, all): for texts with frequent lines, their hashes and the words left and before.

    Copies of a text multiply both sums alike, so only the ratio of the two is used.
    """
    hit = lines.join(above.withColumn("_f", F.lit(True)), ["host", "line"], "left")
    per = hit.groupBy("host", "_key", "_len").agg(
        F.sum("words").alias("all"), F.sum(F.when(F.col("_f").isNull(), F.col("words")).otherwise(0)).alias("left"),
        F.collect_set(F.when(F.col("_f"), F.col("line"))).alias("cut"))
    return per.filter(F.col("left") < F.col("all"))


def _depleted() -> Column:
    few = (F.col("left") < F.col("all") * LEFT_SHARE) | (F.col("left") * F.col("n_words") < F.col("all") * LEFT_WORDS)
    return F.coalesce(few, F.lit(False))


def rate(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, depleted, kept.

    Null text has no words and fails the base rule; a null id is kept as it is; repeated rows each get a
    row; an empty table gives an empty result; no other column is read, so clashing names do no harm.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), _host(host), F.col(text).alias("text"), *text_key(F.col(text)))
    # Stored: a filter on the result must not be pushed into the array expressions and repeated for each element.
    rated = stored(measures(base, "text"), "measures")
    out = rated.join(cut_texts(*frequent_lines(docs, host, text, long_words)).drop("cut"), KEY, "left").withColumn("depleted", _depleted())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "depleted",
                      (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def clean(docs: DataFrame, host: str = "source", text: str = "text", n_chars: str = "n_chars", long_words: int | None = LONG_WORDS) -> DataFrame:
    """The documents that are kept, without the lines above their host's limits; columns as in ``docs``.

    A document without such lines keeps its text untouched.  Verdicts are made once for each distinct
    text of a host and joined to the documents.  Null, empty and wordless texts fail the base rule and go; a
    null id or host is kept as it is; repeated rows share their text's verdict; an empty table gives an
    empty result; other columns are passed on, whatever their names.
    """
    names = docs.columns
    base = docs.select(_host(host), F.col(text).alias("text"), *text_key(F.col(text)))
    rated = stored(measures(base, "text").select(*KEY, "n_words", "base_failed"), "measures").dropDuplicates(KEY)
    verdict = rated.join(cut_texts(*frequent_lines(docs, host, text, long_words)), KEY, "left").filter(~F.col("base_failed") & ~_depleted()).select(*KEY, "cut")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row"), F.col(text).alias("whole"), _host(host), *text_key(F.col(text)))
    gone = lambda x: F.array_contains("cut", F.xxhash64(normal(x))) & (normal(x) != "")
    rest = F.array_join(F.filter(F.split("whole", "\n"), lambda x: ~gone(x)), "\n")
    out = keyed.join(verdict, KEY).withColumn("whole", F.when(F.col("cut").isNull(), F.col("whole")).otherwise(rest))
    count = F.when(F.col("cut").isNull(), F.col("row")[n_chars]).otherwise(F.length("whole")) if n_chars in names else None
    fixed = {text: F.col("whole"), n_chars: count}
    return out.select(*[(fixed[c] if c in fixed else F.col("row")[c]).alias(c) for c in names])


#: ``rate`` as DuckDB SQL; document ids must be unique, and windows and lines are compared as texts, not by hash.
RATE_SQL = f"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '{WORD}+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id
), texts AS (
  SELECT DISTINCT host, text FROM d
), lines AS (
  SELECT host, text, lower(trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))) AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS x FROM texts)
), above AS (
  SELECT c.host, c.line FROM (SELECT host, line, count(DISTINCT text) AS docs FROM lines WHERE line <> '' GROUP BY host, line) c
  JOIN (SELECT host, count(*) AS texts FROM texts GROUP BY host) h ON h.host = c.host
  WHERE docs > {LINE_DOCS} AND (docs > texts * CAST({LINE_SHARE} AS DOUBLE) OR length(c.line) - length(replace(c.line, ' ', '')) + 1 >= {LONG_WORDS})
), cut AS (
  SELECT l.host, l.text, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1) AS al,
    sum(CASE WHEN a.line IS NULL THEN length(l.line) - length(replace(l.line, ' ', '')) + 1 ELSE 0 END) AS rest
  FROM lines l LEFT JOIN above a ON a.host = l.host AND a.line = l.line WHERE l.line <> '' GROUP BY l.host, l.text
), v AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(rest < al AND (rest < al * CAST({LEFT_SHARE} AS DOUBLE) OR rest * n_words < al * {LEFT_WORDS}), false) AS depleted
  FROM m LEFT JOIN cut ON cut.host = m.host AND cut.text = m.text
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, depleted, NOT base_failed AND NOT depleted AS kept FROM v"""
