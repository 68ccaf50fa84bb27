"""Phrase collocations from count streams laid out in prefix and suffix order.

Words, pairs and triples of neighbouring words are counted over the whole corpus, one order after the other;
each order's counts are a stored stream.  A phrase's parts are then found by merging streams in lockstep:
sorted by its first words (prefix order) for the left part, by its last words (suffix order) for the right
part, and longer phrases along both orders for the extensions.  All of these are sort-merge joins.

A phrase of ``least`` occurrences holds only words and pairs of ``least`` or more, so tasks leave out all
others while they count, as long as the words and pairs that qualify are few enough to be held in a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Occurrences that a phrase needs, and the share (in per cent) that makes a longer phrase swallow it.
LEAST, SWALLOW = 10, 50
#: Phrases listed for each language, and what a score of 1 is written as.
TOP, UNIT = 2_000, 1_000_000
#: Distinct words that a task counts or remembers at once; words that a task takes phrases from at once.
CACHE, CHUNK = 400_000, 2_000_000
#: Words and pairs that qualify are sent to the tasks only up to these numbers (some 30 and 64 MB).
HELD_WORDS, HELD_PAIRS = 1_000_000, 4_000_000
#: Ends a piece; no word holds it.
MARK = b"\n"
SEED = 42
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", MARK * 9 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only), with ``MARK`` between pieces and at the end."""
    return [w for w in (text or b"").lower().translate(_PIECES).replace(MARK, b" \n ").split(b" ") if w] + [MARK]


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) over all rows of ``texts`` (lang, text); the empty word counts all words of the language."""
    def run(batches):
        def flush(counts):
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                                                 ["lang", "word", "f"])

        counts: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(text)
                own = counts.setdefault(lang, Counter())
                own.update(found)
                own[b""] += len(found) - found.count(MARK)
            if sum(map(len, counts.values())) >= CACHE:
                yield from flush(counts)
                counts = {}
        yield from flush(counts)

    rows = texts.mapInArrow(run, "lang string, word binary, f long").filter(F.col("word") != F.lit(MARK))
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Numbered(dict):
    """Ids of the words of one language that a phrase may hold; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Hashed(dict):
    """Ids of all words of one language: 63 bits of the hash; a bounded number is remembered."""

    def __init__(self, lang: str):
        import xxhash

        super().__init__()
        self.of, self.seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode(), SEED)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = -1 if word == MARK else self.of(word, self.seed) >> 1
        return out


def numbered(words: DataFrame, held: int) -> tuple[DataFrame, Callable[[str], dict]]:
    """(id, lang, word, f), and what gives a language's ids by word (-1: in no phrase).

    Up to ``held`` words, ids are places in the order of language and word, and all other words are left
    out.  Beyond that, an id is a hash, and every word has one.
    """
    if words.count() > held:
        return words.select(F.shiftrightunsigned(F.xxhash64("lang", "word"), 1).alias("id"), "lang", "word", "f"), Hashed
    table = words.sort("lang", "word").toArrow()
    frame = table.append_column("id", pa.array(range(table.num_rows), pa.int64())).select(["id", "lang", "word", "f"])
    lists = {lang: (pc.index(table["lang"], lang).as_py(), table.filter(pc.equal(table["lang"], lang))["word"].combine_chunks()) for lang in table["lang"].unique().to_pylist()}

    def places(lang):
        at, own = lists.get(lang, (0, pa.array([], pa.binary())))
        out = Numbered(zip(own.to_pylist(), range(at, at + len(own))))
        out[MARK] = -1
        return out

    return stored(words.sparkSession.createDataFrame(frame), "numbered"), places


def phrases(texts: DataFrame, coder: Callable[[str], dict], size: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(a, b, n) or (a, b, c, n): counts of phrases of ``size`` words by id, over all rows of ``texts``.

    ``pairs``, sorted a << 32 | b of numbered words, are those that a triple may hold; without it any may be held.
    """
    names = ["a", "b", "c"][:size]

    def run(batches):
        def flush(parts):
            ids, x = np.unique(np.concatenate(parts), return_inverse=True)
            y = ids[x]
            whole = (y[:-1] >= 0) & (y[1:] >= 0)
            key = x[:-1] * len(ids) + x[1:]
            if size == 3:
                first, own = np.unique(key, return_inverse=True)
                if pairs is not None:
                    wanted = ids[first // len(ids)] << 32 | ids[first % len(ids)]
                    at = np.searchsorted(pairs, wanted)
                    whole &= (pairs[np.minimum(at, len(pairs) - 1)] == wanted)[own] if len(pairs) else False
                whole = whole[:-1] & whole[1:]
                key = own[:-1] * len(ids) + x[2:]
            keys, n = np.unique(key[whole], return_counts=True)
            head, last = keys // len(ids), ids[keys % len(ids)]
            columns = [ids[head], last] if size == 2 else [ids[first[head] // len(ids)], ids[first[head] % len(ids)], last]
            for at in range(0, len(keys), CACHE):
                yield pa.RecordBatch.from_arrays([pa.array(v[at:at + CACHE]) for v in (*columns, n)], [*names, "n"])

        langs, parts, held = {}, [np.array([-1, -1])], 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(text)
                if lang not in langs:
                    langs[lang] = coder(lang)
                parts.append(np.fromiter(map(langs[lang].__getitem__, found), np.int64, len(found)))
                held += len(found)
                if held >= CHUNK:
                    yield from flush(parts)
                    parts, held = [np.array([-1, -1])], 0
        if held:
            yield from flush(parts)

    rows = texts.mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "n"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("f"))


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Two streams in the order of ``on``, merged in lockstep."""
    return left.join(right.hint("merge"), on, how)


def estimated(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase that no longer one swallows; ``words`` has every id of a phrase."""
    def word(name, f):
        return words.select(F.col("id").alias(name), F.col("word").alias(f"w{name}"), F.col("f").alias(f))

    def score(left, right):
        n = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products of counts pass 64 bits
        return F.call_function("div", n("f") * n("f") * F.lit(UNIT).cast("decimal(7,0)"), n(left) * n(right))

    lang = words.select(F.col("id").alias("a"), "lang")
    prefix = triples.groupBy("a", "b").agg(F.max("f").alias("longer"))
    suffix = triples.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("f").alias("longer2"))
    two = _merged(_merged(pairs, prefix, ["a", "b"], "left"), suffix, ["a", "b"], "left")
    swallowed = 100 * F.coalesce(F.greatest("longer", "longer2"), F.lit(0)) >= SWALLOW * F.col("f")
    two = _merged(_merged(two.filter(~swallowed), word("a", "l"), ["a"]), word("b", "r"), ["b"])
    two = two.select("a", F.concat_ws(" ", F.col("wa").cast("string"), F.col("wb").cast("string")).alias("phrase"), "f", "l", "r", score("l", "r").alias("score"))

    three = _merged(triples, pairs.select("a", "b", F.col("f").alias("ab")), ["a", "b"])  # prefix order
    three = _merged(three, word("a", "fa"), ["a"])
    three = _merged(three, pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("bc")), ["b", "c"])  # suffix order
    three = _merged(_merged(three, word("c", "fc"), ["c"]), word("b", "fb"), ["b"])
    three = three.withColumn("s1", score("fa", "bc")).withColumn("s2", score("ab", "fc"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("a", F.concat_ws(" ", *[F.col(f"w{x}").cast("string") for x in "abc"]).alias("phrase"), "f", F.when(first, F.col("fa")).otherwise(F.col("ab")).alias("l"),
                         F.when(first, F.col("bc")).otherwise(F.col("fc")).alias("r"), F.least("s1", "s2").alias("score"))
    return _merged(two.unionByName(three), lang, ["a"]).select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, held_words: int = HELD_WORDS, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the weakest cut, ``n`` all words of the language;
    score is floor(``UNIT`` * a * a / (l * r)).  Ranked by score, then a, then phrase in UTF-8 order.  A null
    language is ``und``; null, empty and wordless texts have no words; repeated rows count each; an empty
    table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    counted = stored(word_counts(texts).filter((F.col("f") >= least) | (F.col("word") == F.lit(b""))), "words")
    frequent = counted.filter((F.col("word") != F.lit(b"")) & (F.col("f") >= least))
    words, coder = numbered(frequent, held_words)
    pairs = stored(phrases(texts, coder, 2).filter(F.col("f") >= least), "pairs")
    few = None
    if words.count() <= held_words and pairs.count() <= held_pairs:
        table = pairs.select("a", "b").toArrow()
        few = np.sort(table["a"].to_numpy() << 32 | table["b"].to_numpy())
    triples = stored(phrases(texts, coder, 3, few).filter(F.col("f") >= least), "triples")
    ranked = estimated(words, pairs, triples).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase")))).filter(F.col("rank") <= top)
    total = counted.filter(F.col("word") == F.lit(b"")).select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "".join(map(chr, range(0x41, 0x5B)))
#: ``mine`` as DuckDB SQL.
MINE_SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS w FROM d
), grams AS (
  SELECT lang, unnest(w) AS phrase, 1 AS k FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM pieces
), counted AS (
  SELECT lang, phrase, k, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, phrase, k
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), frequent AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= {LEAST}
), cuts AS (
  SELECT lang, phrase, k, f, w, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.f, c.cut, x.f AS l, y.f AS r, ({UNIT} * c.f * c.f) // (x.f * y.f) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM frequent WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM frequent WHERE k = 3) GROUP BY lang, phrase
), left_over AS (
  SELECT s.* FROM weakest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase AND s.k = 2 WHERE o.f IS NULL OR 100 * o.f < {SWALLOW} * s.f
)
SELECT s.lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM left_over) s JOIN total ON total.lang = s.lang WHERE rank <= {TOP}"""
