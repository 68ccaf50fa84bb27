"""DuckDB spellings of the Column expressions, used to write the oracle SQL.

Each helper returns a SQL fragment over the given SQL expression(s).  They mirror
``twinmark.functions`` one to one so a query and its oracle read alike.
"""

from __future__ import annotations

from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]::VARCHAR[]"


def tokens_ws(e: str) -> str:
    return f"regexp_extract_all({e}, {q(T.TOKEN_PATTERN)})"


def tokens_word(e: str) -> str:
    return f"regexp_extract_all({e}, {q(T.P6_PATTERN)})"


def as_text(e: str) -> str:
    return f"regexp_replace(CAST({e} AS VARCHAR), {q('^[' + T.WS_CLASS + ']+|[' + T.WS_CLASS + ']+$')}, '', 'g')"


def strip_punct_paired(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, {q(T.P1_PATTERN)}, '', 'g'), {q(T.P1_TRIM)}))"


def strip_punct_all(e: str) -> str:
    return f"regexp_replace({e}, {q(T.P2_PATTERN)}, '', 'g')"


def remove_stopwords(e: str, lang: str = "spanish") -> str:
    return f"list_filter({e}, lambda x: NOT list_contains({str_list(T.stop_words(lang))}, x))"


def content_words(e: str, lang: str = "spanish", min_keep: int = 3) -> str:
    f = remove_stopwords(e, lang)
    return f"CASE WHEN len({f}) < {min_keep} THEN {e} ELSE {f} END"


def count_in(e: str, words) -> str:
    return f"len(list_filter({e}, lambda x: list_contains({str_list(words)}, x)))"


def try_divide(x: str, y: str, val: float = 0.0) -> str:
    return f"coalesce(CAST({x} AS DOUBLE) / nullif(CAST({y} AS DOUBLE), 0.0), {val!r})"


def shared_count(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: list_contains({b}, x)))"


def jaccard(a: str, b: str) -> str:
    return try_divide(f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))")


def dice(a: str, b: str) -> str:
    return try_divide(f"2 * len(list_intersect({a}, {b}))",
                      f"len(list_distinct({a})) + len(list_distinct({b}))")


def join_parts(parts, sep: str) -> str:
    return (" || " + q(sep) + " || ").join(parts)


def bigrams(w: str, sep: str = " ") -> str:
    return (f"CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), "
            f"lambda i: {join_parts([f'{w}[i]', f'{w}[i + 1]'], sep)}) ELSE {w} END")


def trigrams(w: str, sep: str = " ") -> str:
    return (f"CASE WHEN len({w}) > 2 THEN list_transform(range(1, len({w}) - 1), "
            f"lambda i: {join_parts([f'{w}[i]', f'{w}[i + 1]', f'{w}[i + 2]'], sep)}) "
            f"ELSE {bigrams(w, sep)} END")


def fourgrams(w: str, sep: str = " ") -> str:
    return (f"CASE WHEN len({w}) > 3 THEN list_transform(range(1, len({w}) - 2), "
            f"lambda i: {join_parts([f'{w}[i + {d}]' for d in range(4)], sep)}) "
            f"ELSE {trigrams(w, sep)} END")


def count_parts(g: str, sep: str) -> str:
    return f"((length({g}) - length(replace({g}, {q(sep)}, ''))) // {len(sep)} + 1)"


def keep_len(grams: str, n: int, sep: str) -> str:
    return f"list_filter({grams}, lambda g: {count_parts('g', sep)} = {n})"


def ngrams(w: str, n: int, sep: str = " ") -> str:
    if n == 1:
        return w
    if n == 2:
        return bigrams(w, sep)
    if n == 3:
        return trigrams(w, sep)
    if n == 4:
        return fourgrams(w, sep)
    if n == 12:
        return f"list_concat({w}, {keep_len(bigrams(w, sep), 2, sep)})"
    if n == 123:
        return f"list_concat(list_concat({w}, {keep_len(bigrams(w, sep), 2, sep)}), {keep_len(trigrams(w, sep), 3, sep)})"
    return "[]::VARCHAR[]"


def plain_grams(w: str, n: int) -> str:
    return (f"CASE WHEN len({w}) >= {n} THEN list_distinct(list_transform(range({n}, len({w}) + 1), "
            f"lambda i: array_to_string({w}[i - {n - 1}:i], ''))) ELSE []::VARCHAR[] END")


def edit_dist(a: str, b: str) -> str:
    return try_divide(f"levenshtein({a}, {b})", f"greatest(length({a}), length({b}))")


def bigrams_skip(w: str, sep: str, skip: int) -> str:
    return (f"CASE WHEN len({w}) > 1 THEN flatten(list_transform(range(1, len({w})), lambda i: "
            f"list_transform(list_filter(range(1, {skip + 2}), lambda k: i + k <= len({w})), "
            f"lambda k: {join_parts([f'{w}[i]', f'{w}[i + k]'], sep)}))) ELSE {w} END")


def trigrams_skip(w: str, sep: str, skip: int) -> str:
    return (f"CASE WHEN len({w}) > 2 THEN flatten(list_transform(range(1, len({w}) - 1), lambda i: "
            f"flatten(list_transform(range(1, {skip + 2}), lambda k1: list_transform("
            f"list_filter(range(1, {skip + 2}), lambda k2: i + k1 <= len({w}) AND i + k1 + k2 <= len({w})), "
            f"lambda k2: {join_parts([f'{w}[i]', f'{w}[i + k1]', f'{w}[i + k1 + k2]'], sep)}))))) "
            f"ELSE {bigrams_skip(w, sep, skip)} END")


def biterms(w: str, sep: str = " ") -> str:
    return (f"CASE WHEN len({w}) > 1 THEN flatten(list_transform(range(1, len({w})), lambda i: "
            f"list_transform(range(i + 1, len({w}) + 1), lambda j: {join_parts([f'{w}[i]', f'{w}[j]'], sep)}))) "
            f"ELSE {w} END")


def triterms(w: str, sep: str = " ") -> str:
    return (f"CASE WHEN len({w}) > 2 THEN flatten(list_transform(range(1, len({w}) - 1), lambda i: "
            f"flatten(list_transform(range(i + 1, len({w})), lambda j: list_transform(range(j + 1, len({w}) + 1), "
            f"lambda k: {join_parts([f'{w}[i]', f'{w}[j]', f'{w}[k]'], sep)}))))) ELSE {biterms(w, sep)} END")


def fourterms(w: str, sep: str = " ") -> str:
    return (f"CASE WHEN len({w}) > 3 THEN flatten(list_transform(range(1, len({w}) - 2), lambda i: "
            f"flatten(list_transform(range(i + 1, len({w}) - 1), lambda j: flatten(list_transform(range(j + 1, len({w})), "
            f"lambda k: list_transform(range(k + 1, len({w}) + 1), "
            f"lambda m: {join_parts([f'{w}[i]', f'{w}[j]', f'{w}[k]', f'{w}[m]'], sep)}))))))) "
            f"ELSE {triterms(w, sep)} END")


def chars(e: str) -> str:
    return f"regexp_extract_all({e}, '(?s).')"
