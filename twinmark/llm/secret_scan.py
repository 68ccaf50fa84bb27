"""Secret scans: located credentials, and how widely each one is owned across the corpus.

Only DataFrame expressions.  Spark's regular expressions give the matches of a text but not their
places; the pieces between the matches give these, as running sums of lengths over the rows of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Long mixed tokens: candidates of no known kind, taken only if they look live.
OTHER = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
ASSIGN_CHARS = 8
#: A value that more owners than this have is a copied example; one of fewer is owner-specific and looks live.
LIVE_OWNERS = 2
#: The same for repositories, where the caller's repositories are fine enough to tell copies apart.
LIVE_REPOSITORIES = 20
MASK = "[SECRET]"


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: everything found in it depends on the text alone."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def _suspects(t: Column) -> list[Column]:
    """By kind, a cheap test that holds wherever the kind's pattern could match."""
    low = F.lower(t)
    words = F.lit(False)
    for k in KEYWORDS:
        words = words | low.contains(k)
    return [words, t.contains("AKIA"), t.rlike(HEX), t.rlike(OTHER)]


def _found(t: Column, kind: int, pattern: str, group: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.transform(F.split(t, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), F.octet_length(x).alias("bytes"))).alias("gaps"),
                    F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("values"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, kind, start, end, value, byte): the matches of every kind in each distinct text, in code points.

    ``kind`` is the place in ``KINDS``; ``byte`` is where a match ends, in bytes of UTF-8.  A row's arrays hold one text's matches; places are a window sum
    over one text and kind.  Long mixed tokens must hold an upper-case and a lower-case letter and a digit.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    patterns = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (OTHER, 0))
    tests = _suspects(F.col("t"))
    marked = docs.select(t.alias("t")).select("t", *[x.alias(f"k{i}") for i, x in enumerate(tests)]).filter("k0 or k1 or k2 or k3")
    found = F.array(*[F.when(F.col(f"k{i}"), _found(F.col("t"), i, p, g)) for i, (p, g) in enumerate(patterns)])
    rows = marked.select(text_key(F.col("t")).alias("key"), F.explode(found).alias("f")).filter("f is not null and size(f.all) > 0") \
        .select("key", "f.*").dropDuplicates(["key", "kind"])
    each = rows.select("key", "kind", F.posexplode(F.arrays_zip("gaps", "all", "values")).alias("at", "m")).filter("m.all is not null") \
        .select("key", "kind", "at", F.col("m.gaps").alias("gap"), F.length("m.all").alias("len"), F.octet_length("m.all").alias("bytes"), F.col("m.values").alias("value"))
    before = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap.n").cast("long") + F.col("len")).over(before)
    byte = F.sum(F.col("gap.bytes").cast("long") + F.col("bytes")).over(before)
    placed = each.select("key", "kind", "value", (end - F.col("len")).alias("start"), end.alias("end"), byte.alias("byte"))
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    return placed.filter(F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_CHARS).when(F.col("kind") == 3, mixed).otherwise(F.lit(True)))


def ownership(found: DataFrame, docs: DataFrame, owner: Column, repository: Column, text: str = "text") -> DataFrame:
    """(value, owners, repositories): in how many each candidate value is found, over all documents."""
    where = docs.select(text_key(F.col(text)).alias("key"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    held = where.join(found.select("key").distinct(), "key", "left_semi").distinct().join(found.select("key", "value").distinct(), "key")
    pairs = held.select(F.xxhash64("value").alias("h"), "value", "owner", "repository").distinct()
    return pairs.groupBy("h", "value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")) \
        .select("value", "owners", "repositories")


def judged(docs: DataFrame, owner: Column, repository: Column, text: str = "text", repositories: int | None = None) -> DataFrame:
    """The spans of ``candidates`` that count, with ``live``: all base spans, and the long mixed tokens that look live.

    A value that few owners have looks live.  With ``repositories``, a value found in more repositories than
    that is a widely copied example, however few owners it has.
    """
    found = stored(candidates(docs, text), "candidates")
    live = F.col("owners") <= LIVE_OWNERS
    if repositories is not None:
        live = live & (F.col("repositories") <= repositories)
    return found.join(ownership(found, docs, owner, repository, text), "value").withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))


def scan_texts(docs: DataFrame, owner: Column, repository: Column, text: str = "text", repositories: int | None = None) -> DataFrame:
    """One row per distinct text with a span: key, n_assign, n_access, n_hex, n_live, n_example, base, spans.

    ``base`` and ``spans`` are arrays of (start, kind, end) in order; ``spans`` adds the long mixed tokens
    that look live.  n_example counts the base spans whose value is widely copied, n_live all other spans.
    """
    span = F.struct("start", "kind", "end")
    base = F.col("kind") < 3
    count = lambda c: F.count(F.when(c, 1))
    return judged(docs, owner, repository, text, repositories).groupBy("key").agg(
        *[count(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        count(F.col("live")).alias("n_live"), count(base & ~F.col("live")).alias("n_example"),
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas; empty for none."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def scan(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text",
         repositories: int | None = LIVE_REPOSITORIES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base, spans (texts), n_live, n_example.

    Null and empty texts have no spans; a null owner or repository is one of its own; equal texts have
    equal spans and are scanned once; repeated rows each get a row; an empty table gives an empty result;
    other columns are not read.
    """
    texts = scan_texts(docs, owner, repository, text, repositories)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key")).join(texts, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", *[zero(c) for c in ("n_assign", "n_access", "n_hex")], written(F.col("base")).alias("base"),
                       written(F.col("spans")).alias("spans"), zero("n_live"), zero("n_example"))


def kept_pieces(spans: DataFrame) -> DataFrame:
    """(key, pieces, end): what stands between the values of a text's spans, as (to, from) in bytes, and where the last value ends.

    Values that overlap are one; the window holds the spans of one text.
    """
    values = spans.select("key", (F.col("byte") - F.octet_length("value")).alias("to"), "byte")
    before = F.max("byte").over(Window.partitionBy("key").orderBy("to", "byte").rowsBetween(Window.unboundedPreceding, -1))
    pieces = values.select("key", "to", "byte", F.coalesce(before, F.lit(0)).alias("from"))
    apart = F.when(F.col("to") >= F.col("from"), F.struct("to", "from"))
    return pieces.groupBy("key").agg(F.array_sort(F.collect_list(apart)).alias("pieces"), F.max("byte").alias("end"))


def mask(docs: DataFrame, owner: Column, repository: Column, text: str = "text", n_chars: str = "n_chars", repositories: int | None = LIVE_REPOSITORIES) -> DataFrame:
    """``docs`` with the value of every span masked, whole; no document is dropped.

    Values are joined where they overlap, so nothing of a credential is left.  Texts without a span, null and
    empty texts are untouched; equal texts get equal masks; repeated rows each stay; an empty table gives an
    empty result; other columns are passed on, whatever their names.
    """
    names = docs.columns
    texts = kept_pieces(judged(docs, owner, repository, text, repositories))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_key(F.col(text)).alias("key"))
    raw = F.col("row")[text].cast("binary")
    one = F.transform("pieces", lambda p: F.substr(raw, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")).cast("string"))
    tail = F.substr(raw, (F.col("end") + 1).cast("int"), F.octet_length(raw)).cast("string")
    masked = F.concat(F.array_join(one, MASK), F.lit(MASK), tail)
    new = F.when(F.col("end").isNull(), F.col("row")[text]).otherwise(masked)
    out = keyed.join(texts, "key", "left").withColumn("new", new)
    count = F.when(F.col("end").isNull(), F.col("row")[n_chars]).otherwise(F.length("new")) if n_chars in names else None
    fixed = {text: F.col("new"), n_chars: count}
    return out.select(*[(fixed[c] if c in fixed else F.col("row")[c]).alias(c) for c in names])


def _sql_kind(kind: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, {kind} AS kind, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}', 0) AS a, regexp_extract_all(t, '{quoted}', {group}) AS v FROM d"


#: ``scan`` with sources as owners and distinct texts as repositories, as DuckDB SQL; document ids must be unique.
SCAN_SQL = f"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents
), found AS (
  {' UNION ALL '.join(_sql_kind(k, p, g) for k, (p, g) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (OTHER, 0))))}
), each AS (
  SELECT doc_id, kind, i, length(g[i]) AS gap, length(a[i]) AS len, v[i] AS value FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM found)
), placed AS (
  SELECT doc_id, kind, len, value, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM each
), kept AS (
  SELECT doc_id, kind, value, e - len AS s, e FROM placed WHERE CASE kind WHEN 0 THEN length(value) >= {ASSIGN_CHARS}
    WHEN 3 THEN regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') ELSE true END
), owned AS (
  SELECT value, count(DISTINCT owner) <= {LIVE_OWNERS} AND count(DISTINCT t) <= {LIVE_REPOSITORIES} AS live FROM kept JOIN d ON d.doc_id = kept.doc_id GROUP BY value
), spans AS (
  SELECT kept.*, live, ({list(KINDS)})[kind + 1] || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS x
  FROM kept JOIN owned ON owned.value = kept.value WHERE kind < 3 OR live
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
    count(*) FILTER (WHERE live) AS nl, count(*) FILTER (WHERE kind < 3 AND NOT live) AS ne,
    string_agg(x, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind, e) AS al FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(al, '') AS spans, CAST(coalesce(nl, 0) AS BIGINT) AS n_live, CAST(coalesce(ne, 0) AS BIGINT) AS n_example
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""
