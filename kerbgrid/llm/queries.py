"""The registered queries of this subpackage: one thin query for each operator."""

from __future__ import annotations

from kerbgrid.llm import decontaminate, jaccard, langid, licenses, media, mixing, oracles, pieces, pii, repeats, secrets, tries, warc, whitening
from kerbgrid.llm.common import table


def op1_piece_dropout(spark, sf_dir):
    return pieces.piece_report(table(spark, sf_dir, "documents"))


def op2_repeated_strings(spark, sf_dir):
    return repeats.repeats_report(table(spark, sf_dir, "documents"))


def op3_media_fingerprints(spark, sf_dir):
    return media.media_report(table(spark, sf_dir, "documents"))


def op4_jaccard_relations(spark, sf_dir):
    return jaccard.jaccard_report(table(spark, sf_dir, "documents"))


def op5_license_index(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op6_pii_anchors(spark, sf_dir):
    return pii.personal_report(table(spark, sf_dir, "documents"))


def op7_secret_automaton(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_warc_archives(spark, sf_dir):
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op9_language_id(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op10_template_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark, sf_dir):
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_lanczos_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_pareto_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


# Those columns of five operators that SQL can express, each with its SQL.
def media_bytes(spark, sf_dir):
    return op3_media_fingerprints(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_counts(spark, sf_dir):
    return op5_license_index(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def personal_counts(spark, sf_dir):
    return op6_pii_anchors(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_counts(spark, sf_dir):
    return op7_secret_automaton(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def embedding_deviations(spark, sf_dir):
    return op12_lanczos_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = {
    "media_bytes": """WITH x AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents), y AS (SELECT *, greatest((n + 63) // 64 * 64, 64) AS p FROM x)
SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(b || repeat('\x00'::BLOB, p - n)) AS payload_sha256 FROM y""",
    "license_counts": rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT *, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache, list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl FROM w)
SELECT doc_id, len(w) AS n_words, len(mit) + len(apache) + len(gpl) AS n_base, list_min(mit || apache || gpl) - 1 AS first_word, list_max(mit || apache || gpl) - 1 AS last_word,
concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM h""",
    "personal_counts": r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT) > 255, true))) = 0)) AS n_ip,
len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda m: regexp_replace(m, '[ -]', '', 'g')), lambda d: len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN d[i] > '4' THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END)) % 10 = 0)) AS n_card,
len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM x""",
    "secret_counts": r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: len(v) >= 12)) AS n_assign,
len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: len(v) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: len(v) >= 16)) AS n_hex FROM x""",
}
QUERIES = {f.__name__: f for f in (op1_piece_dropout, op2_repeated_strings, op3_media_fingerprints, op4_jaccard_relations, op5_license_index, op6_pii_anchors, op7_secret_automaton, op8_warc_archives, op9_language_id, op10_template_decontamination, op11_prefix_trie, op12_lanczos_whitening, op13_pareto_mix, embedding_deviations, media_bytes, license_counts, personal_counts, secret_counts)}
ORACLES = {"op8_warc_archives": warc.ORACLE} | oracles.ORACLES | _SQL
