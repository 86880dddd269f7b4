"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from pyspark.sql import functions as F

from varigrid.llm import ann, bpe, decontamination, html_extract, language_id, lm_scoring, minhash_dedup, secret_scan, substring_dedup, token_files


def _held_out_rows(spark, sf_dir):
    """What SQL can express of operator 3."""
    return language_id.query(spark, sf_dir).select("doc_id", "held_out")


def _base_spans(spark, sf_dir):
    """What SQL can express of operator 8."""
    return secret_scan.query(spark, sf_dir).drop("spans")


def _base_scores(spark, sf_dir):
    """What SQL can express of operator 10; sums of logarithms in any order agree to six decimals."""
    return lm_scoring.query(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


QUERIES = {
    "op10_lm_scoring": lm_scoring.query,
    "op1_minhash_dedup": minhash_dedup.query,
    "op2_ann": ann.query,
    "op3_language_id": language_id.query,
    "op4_bpe": bpe.query,
    "op5_html_extract": html_extract.query,
    "op6_decontamination": decontamination.query,
    "op7_token_files": token_files.query,
    "op8_secret_scan": secret_scan.query,
    "op9_substring_dedup": substring_dedup.query,
    "language_held_out": _held_out_rows,
    "secret_base_spans": _base_spans,
    "lm_base_scores": _base_scores,
}

_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], range(0, 8 * length(CAST(doc_id AS VARCHAR)))), lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[CAST(i // 8 + 1 AS INTEGER)]) ELSE 0 END) >> 1, CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[CAST(i // 8 + 1 AS INTEGER)]) ELSE 0 END) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), CAST(4294967295 AS BIGINT))"""

_HELD_OUT = f"SELECT doc_id, {_CRC} % 4 = 2 AS held_out FROM documents"

_EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"(?:{_EITHER_CASE})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_KINDS = (("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))

_SPANS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {i} AS o, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS p FROM d" for i, (kind, rx) in enumerate(_KINDS))}),
x AS (SELECT doc_id, kind, o, m[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
f AS (SELECT doc_id, kind, o, s, s + length(v) AS e FROM x WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(v, '{_ASSIGN}', 1)) >= 6 WHEN 'access' THEN length(v) >= 20 ELSE length(v) >= 24 END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o), '')) AS base_sha256 FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""

_BASE_SCORES = f"""WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x09-\\x0D\\x20]+'), ['']) AS toks FROM documents),
t AS (SELECT doc_id, held_out, unnest(toks) AS tok FROM d),
c AS (SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY tok),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.tok) AS n_known, n.n AS train_tokens, round(sum(log10((coalesce(c, 0) + CAST(0.1 AS DOUBLE)) / (n.n + CAST(0.1 AS DOUBLE) * (n.v + 1)))), 6) AS base_score FROM t LEFT JOIN c ON t.tok = c.tok, n GROUP BY doc_id, held_out, n.n"""

_WORDS = r"""words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x09-\x0D\x20]+') AS w FROM documents)),
n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id)"""

_NEAR_DUPLICATES = f"""WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
runs AS (SELECT words.doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY words.doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words JOIN n ON words.doc_id = n.doc_id),
shingles AS (SELECT DISTINCT doc_id, md5(s) AS s FROM runs WHERE i <= greatest(n - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_ JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.low FROM reach JOIN links ON reach.doc_id = links.a WHERE reach.low < links.b),
least_ AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_ ON d.doc_id = least_.doc_id LEFT JOIN sizes ON d.doc_id = sizes.doc_id"""

_SUBSTRINGS = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
runs AS (SELECT words.doc_id, word, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY words.doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS s FROM words JOIN n ON words.doc_id = n.doc_id),
first_ AS (SELECT s, min(doc_id) AS f FROM runs WHERE i <= n - 49 GROUP BY s),
hits AS (SELECT runs.*, CASE WHEN i <= n - 49 AND f < doc_id THEN 1 ELSE 0 END AS hit FROM runs LEFT JOIN first_ ON runs.s = first_.s),
marked AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits),
done AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id"""

#: The others aren't expressible: models, vocabularies and page trees; they are tested against brute force. Of three,
#: what SQL can express has a query of its own.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": _NEAR_DUPLICATES,
    "op9_substring_dedup": _SUBSTRINGS,
    "language_held_out": _HELD_OUT,
    "secret_base_spans": _SPANS,
    "lm_base_scores": _BASE_SCORES,
}
