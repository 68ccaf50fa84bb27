"""Source divergence audit: how far the word frequencies of a language's sources lie apart, and by which terms.

The tokenizer is one translate table: ``bytes.translate`` lowers letters and blanks separators in one pass,
``bytes.split`` gives the terms, and a ``Counter`` for each document its frequencies; tasks add these up by
group and term, Spark adds up the rest, and only terms of enough documents are compared.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Documents of a language that a term must stand in.
LEAST_DOCS = 10
#: Terms listed for each group.
TERMS = 10
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000
#: (group, term) entries that a task counts before it hands them on, and terms that it compares at once.
CACHE, ROWS = 500_000, 8_192
#: Letters are lowered, bytes outside ASCII kept, all others separate terms.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> Counter:
    """Frequency of each term of one UTF-8 text."""
    return Counter((text or b"").translate(TABLE).split())


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, source, c, d): occurrences and documents of each term in each group, over all rows of ``texts``."""
    def run(batches):
        def flush(groups):
            for (lang, source), (c, d) in groups.items():
                n = len(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array(list(c), pa.binary()), pa.array([source] * n, pa.string()),
                     pa.array(list(c.values()), pa.int64()), pa.array(list(map(d.__getitem__, c)), pa.int64())], ["lang", "term", "source", "c", "d"])

        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = terms_of(text)
                c, d = groups.setdefault((lang, source), (Counter(), Counter()))
                c.update(own)
                d.update(own.keys())
            if sum(len(c) for c, _ in groups.values()) >= CACHE:
                yield from flush(groups)
                groups = {}
        yield from flush(groups)

    rows = texts.select("lang", "source", "text").mapInArrow(run, "lang string, term binary, source string, c long, d long")
    return rows.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def shares(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kinds)), exactly: long division by thousands stays within 64 bits."""
    by, out, rest = total + 2 * kinds, np.zeros(np.broadcast(count, total).shape, np.int64), count + 2
    whole, rest = np.divmod(rest, by)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def compare(kept: DataFrame, sources: dict[str, list[str]], totals: dict[tuple[str, str], int], kinds: dict[str, int], terms: int) -> DataFrame:
    """(lang, source, part, item, value): partial sums for each pair of sources, and each task's best terms.

    ``kept`` has a row for each term of a language, with its counts by source.  A task holds the sums of all
    pairs of a language's sources, as many as the result has rows.
    """
    total = {lang: np.array([totals.get((lang, s), 0) for s in own], np.int64) for lang, own in sources.items()}

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def rows(lang, source, part, item, value):
            n = len(item)
            return pa.RecordBatch.from_arrays([pa.array([x] * n, pa.string()) for x in (lang, source, part)] + [pa.array(item, pa.string()), pa.array(value, pa.int64())],
                                              ["lang", "source", "part", "item", "value"])

        for batch in slices(batches, ROWS):
            for lang in batch.column(0).unique().to_pylist():
                own, v = batch.filter(pc.equal(batch.column(0), lang)), kinds[lang]
                own = own.take(pc.sort_indices(own, sort_keys=[("term", "ascending")]))  # byte order: the order of ties
                names, cells = sources[lang], own.column(2)
                at = cells.value_parent_indices().to_numpy()
                found, n = cells.flatten().flatten()
                count = np.zeros((len(cells), len(names)), np.int64)
                count[at, pc.index_in(found, pa.array(names, pa.string())).to_numpy()] = n.to_numpy()
                p = shares(count, total[lang], v)
                held = sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                for a in range(len(names)):
                    held[a] += apart(p[:, a:a + 1], p).sum(0)
                q = shares(count.sum(1), total[lang].sum(), v)[:, None]
                above = (count > 0) & (p > q)
                f = np.where(above, apart(p, q), -1)
                for a, source in enumerate(names):
                    best = np.argsort(-f[:, a], kind="stable")[:terms]
                    best = best[above[best, a]]
                    if len(best):
                        yield rows(lang, source, "term", own.column(1).take(pa.array(best)).cast(pa.string()).to_pylist(), f[best, a])
        for lang, held in sums.items():
            for a, source in enumerate(sources[lang]):
                others = [b for b in range(len(held)) if b != a]
                if others:
                    yield rows(lang, source, "pair", [sources[lang][b] for b in others], held[a, others])

    return kept.select("lang", "term", "cells").mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of a language and a source, how far it lies from the others.

    Part ``pair``: every other source of the language, with the distance summed over all kept terms, the
    farthest first.  Part ``term``: the ``terms`` terms by which the group lies above its whole language.
    Ties go by item in UTF-8 order.  Null text, language and source are empty; an empty text has no terms,
    but makes its group; a language without kept terms has pairs of value 0; repeated rows are documents of
    their own; an empty table gives an empty result; other columns are not read.

    The driver holds the list of groups, of which the result has all pairs, and a total for each.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).cast("binary").alias("text"))
    cell = F.struct("source", "c")
    kept = stored(term_counts(texts).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(cell).alias("cells"))
                  .filter(F.col("d") >= least_docs).select("lang", "term", "cells"), "terms")
    groups = stored(texts.select("lang", "source").distinct(), "groups")
    sources: dict[str, list[str]] = {}
    for r in groups.sort("lang", "source").collect():
        sources.setdefault(r.lang, []).append(r.source)
    each = kept.select("lang", F.explode("cells").alias("x"))
    totals = {(r.lang, r.source): r.n for r in each.groupBy("lang", "x.source").agg(F.sum("x.c").alias("n")).collect()}
    kinds = {r.lang: r.v for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}
    found = stored(compare(kept, sources, totals, kinds, terms), "compared")
    others = groups.groupBy("lang").agg(F.collect_list("source").alias("all"))
    pairs = groups.join(others, "lang").select("lang", "source", F.explode(F.filter("all", lambda x: x != F.col("source"))).alias("item"))
    summed = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return best(pair).unionByName(best(found.filter("part = 'term'")).filter(F.col("rank") <= terms))


_UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: ``audit`` as DuckDB SQL.
AUDIT_SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS all_c FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}
), counted AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), kinds AS (
  SELECT lang, count(*) AS v, sum(all_c) AS n FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c, 0) + 2)) // (coalesce(t.n, 0) + 2 * v) AS p, 1 + (CAST({UNIT} AS HUGEINT) * (all_c + 2)) // (kinds.n + 2 * v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN kinds ON kinds.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counted x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM cells WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= {TERMS}"""
