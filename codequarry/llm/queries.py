"""Queries of the operators over training text, with SQL where it can express them."""

from ..session import load
from . import bpe, credentials, documented, encoding, leaks, origin, pairs, syntax

QUERIES = {
    "p1_found": lambda s, d: pairs.broken_pairs(load(s, d, "spec_tasks")),
    "p2_found": lambda s, d: syntax.syntax_errors(load(s, d, "files")).select("file_no").distinct(),
    "p2_errors": lambda s, d: syntax.syntax_errors(load(s, d, "files")),
    "p2_rates": lambda s, d: syntax.error_rates(load(s, d, "files")),
    "p4_found": lambda s, d: documented.documented(load(s, d, "code_functions"), load(s, d, "code_methods")).select("unit_no").distinct(),
    "p4_pairs": lambda s, d: documented.documented(load(s, d, "code_functions"), load(s, d, "code_methods")),
    "p5_found": lambda s, d: credentials.credentials(load(s, d, "files"), load(s, d, "code_functions"), load(s, d, "code_methods")),
    "p5_redacted": lambda s, d: credentials.redacted(load(s, d, "files"), load(s, d, "code_functions"), load(s, d, "code_methods")),
    "p6_found": lambda s, d: origin.origin(load(s, d, "files")).where("origin <> 'hand_written'").select("file_no").distinct(),
    "p6_origin": lambda s, d: origin.origin(load(s, d, "files")),
    "p6_hand_written": lambda s, d: origin.hand_written(load(s, d, "files")),
    "p8_ids": lambda s, d: bpe.encode_corpus(load(s, d, "documents")),
    "p8_decoded": lambda s, d: bpe.decode_corpus(bpe.encode_corpus(load(s, d, "documents"))),
    "p9_found": lambda s, d: leaks.passages(load(s, d, "documents"), load(s, d, "eval_items")),
    "p10_found": lambda s, d: encoding.garbled_texts(load(s, d, "documents")).select("doc_id").distinct(),
    "p10_restored": lambda s, d: encoding.garbled_texts(load(s, d, "documents")),
    "p9_leaks": lambda s, d: leaks.leaked_items(load(s, d, "documents"), load(s, d, "eval_items")),
}

_WORDS = r"'[\p{L}\p{N}]+(?:[_''’][\p{L}\p{N}]+)*'"
#: Escapes undone or dropped as far as SQL can; the operator decodes them.
_NORM = r"""lower(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
 CASE WHEN contains(text, '%') THEN coalesce(TRY(url_decode(text)), text) ELSE text END, '\\+u([0-9a-fA-F]{4})', '', 'g') , '\\+[nrtfv]', ' ', 'g'), '&amp;', '&'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&rsquo;', '’'), '&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);', ' ', 'g'), '\\+([^\w\s])', '\1', 'g'))"""
#: Seeds of six words meet; on each diagonal every stretch between two equal words is looked at.
_PASSAGES = f"""WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all({_NORM}, {_WORDS}) AS ws FROM documents WHERE text <> ''),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), {_WORDS}) AS ws FROM eval_items WHERE len(regexp_extract_all(lower(text), {_WORDS})) >= 18),
dp AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 4)) AS p FROM d), dg AS (SELECT doc_id, p, array_to_string(ws[p:p + 5], ' ') AS g FROM dp),
ip AS (SELECT item_id, ws, unnest(range(1, len(ws) - 4)) AS q FROM i), ig AS (SELECT item_id, q, array_to_string(ws[q:q + 5], ' ') AS g FROM ip),
l AS (SELECT DISTINCT doc_id, item_id, p - q AS off FROM dg JOIN ig USING (g)),
q AS (SELECT l.*, d.ws AS dw, i.ws AS iw, unnest(range(greatest(1, 1 - off), least(len(i.ws), len(d.ws) - off) + 1)) AS q FROM l JOIN d USING (doc_id) JOIN i USING (item_id)),
s AS (SELECT doc_id, item_id, off, q, iw[q] = dw[q + off] AS same FROM q),
c AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id, off ORDER BY q) AS missed FROM s),
h AS (SELECT * FROM c WHERE same)
SELECT DISTINCT a.doc_id, a.item_id FROM h a JOIN h e ON e.doc_id = a.doc_id AND e.item_id = a.item_id AND e.off = a.off AND e.q >= a.q + 17 AND 9 * (e.missed - a.missed) <= e.q - a.q + 1"""

SQL: dict[str, str] = {
    "p9_found": _PASSAGES,
    # exact round trip
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
