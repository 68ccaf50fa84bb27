"""Oracle SQL for the pair views (same definitions as ``twinmark.sources.pairs``)."""

CONV_PAIRS = """SELECT a.conv_id, a.turn, a.text AS s1, b.text AS s2
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'"""

DOC_PAIRS = """SELECT p.doc_id AS pair_id, p.prev_id, p.lang, d1.text AS s1, d2.text AS s2
FROM (SELECT doc_id, lang, lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS prev_id
      FROM documents) p
JOIN documents d1 ON d1.doc_id = p.prev_id
JOIN documents d2 ON d2.doc_id = p.doc_id"""

LABELLED_DOC_PAIRS = f"""SELECT dp.*, CAST(l1.quality = l2.quality AS INTEGER) AS label
FROM ({DOC_PAIRS}) dp
JOIN labels l1 ON l1.doc_id = dp.prev_id
JOIN labels l2 ON l2.doc_id = dp.pair_id"""


SPLIT_DOC_PAIRS = f"""SELECT dp.*, CASE WHEN l1.doc_id IS NOT NULL AND l2.doc_id IS NOT NULL
  THEN CAST(l1.quality = l2.quality AS INTEGER) ELSE -1 END AS label
FROM ({DOC_PAIRS}) dp
LEFT JOIN labels l1 ON l1.doc_id = dp.prev_id
LEFT JOIN labels l2 ON l2.doc_id = dp.pair_id"""


def with_views(body: str, **views: str) -> str:
    """``WITH name AS (...), ... body``."""
    ctes = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in views.items())
    return f"WITH {ctes}\n{body}"
