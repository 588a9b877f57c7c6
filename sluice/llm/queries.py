"""The queries of the training-data operators, with the parameters they run with in production."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, decontam, fill_middle, html_extract, manifest, pii, quality, simhash, substring_dedup, suffix_dedup, token_store, url_filter
from .common import shared_dir, table

#: The rules that op1 judges by.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_decontam(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), as_text=False).withColumnRenamed("kept", "kept_sha256")


def op6_quality(spark, sf_dir):
    return quality.grade(table(spark, sf_dir, "documents"))


def op7_token_store(spark, sf_dir):
    path = shared_dir(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_store.read(spark, path)


def op8_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op10_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_manifest(spark, sf_dir):
    return manifest.prove(table(spark, sf_dir, "documents"), tamper=manifest.sampled())


def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), as_bytes=False).withColumnRenamed("kept", "kept_sha256")


def op13_fill_middle(spark, sf_dir):
    return fill_middle.transform(table(spark, sf_dir, "documents"), as_text=False)


def quality_base(spark, sf_dir):
    """The base columns of op6, which SQL can express."""
    return quality.measure(table(spark, sf_dir, "documents")).drop("pattern")


def pii_base(spark, sf_dir):
    """The base counts of op9, which SQL can express."""
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontam, op3_chat, op4_bpe, op5_substring_dedup, op6_quality, op7_token_store, op8_simhash, op9_pii, op10_html_extract, op11_manifest, op12_suffix_dedup, op13_fill_middle, quality_base, pii_base)}

def _tree(name: str, levels: int) -> str:
    """CTEs {name}1 to {name}levels over {name}0 (g, i, n, d): each level's nodes, of n in their group."""
    return ",\n        ".join(f"{name}{k} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}{k - 1} GROUP BY g, i // 16, n)" for k in range(1, levels + 1))


def _siblings(name: str, levels: int, at: str, first: int) -> str:
    """The siblings of each of ``at`` (r, g, i), by level."""
    return " UNION ALL ".join(f"SELECT x.r, {first + k} AS level, t.i, t.d FROM {at} x JOIN {name}{k} t ON t.g = x.g AND t.i // 16 = x.i // {16 ** (k + 1)} AND t.i <> x.i // {16**k} AND t.n > 1" for k in range(levels))


def _folded(name: str, levels: int, before: str, out: str) -> str:
    """CTEs {out}1 to {out}levels: the digests that ``before`` (r, g, i, d) fold to."""
    froms = [before, *(f"{out}{k}" for k in range(1, levels))]
    return ",\n        ".join(
        f"{out}{k + 1} AS (SELECT x.r, x.g, x.i // 16 AS i, CASE WHEN t.n > 1 THEN sha256(string_agg(CASE WHEN t.i = x.i THEN x.d ELSE t.d END, '' ORDER BY t.i)) ELSE x.d END AS d FROM {f} x JOIN {name}{k} t ON t.g = x.g AND t.i // 16 = x.i // 16 GROUP BY x.r, x.g, x.i, x.d, t.n)"
        for k, f in enumerate(froms)
    )


#: Levels for which the SQL of op11 is written out: a source of 16^6 rows, 16^3 sources.
_LEVELS, _OVER = 6, 3
_CODED = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MANIFEST = rf"""
        WITH d AS (SELECT row_number() OVER () AS r, *, sha256({" || ".join(_CODED.format(c=c) for c in manifest.COLUMNS)}) AS leaf, sha256({" || ".join(_CODED.format(c=_LOWERED if c == "text" else c) for c in manifest.COLUMNS)}) AS tampered,
                          list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                                      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS crc FROM documents),
        s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
        l AS (SELECT r, g, doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN tampered ELSE leaf END AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
              FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        t0 AS (SELECT g, i, n, leaf AS d FROM l),
        {_tree("t", _LEVELS)},
        u0 AS (SELECT 0 AS g, t{_LEVELS}.g AS i, s.n, d FROM t{_LEVELS} JOIN s USING (g)),
        {_tree("u", _OVER)},
        sub AS (SELECT r, 0 AS g, g AS i FROM l),
        sib AS ({_siblings("t", _LEVELS, "l", 0)} UNION ALL {_siblings("u", _OVER, "sub", _LEVELS)}),
        proof AS (SELECT r, sha256(string_agg(d, '' ORDER BY level, i)) AS p FROM sib GROUP BY r),
        {_folded("t", _LEVELS, "l", "f")},
        v0 AS (SELECT r, 0 AS g, g AS i, d FROM f{_LEVELS}),
        {_folded("u", _OVER, "v0", "v")}
        SELECT doc_id, leaf, u0.d AS subroot, root.d AS root, coalesce(p, sha256('')) AS proof_sha256, v{_OVER}.d AS folded_root, v{_OVER}.d = root.d AS verified
        FROM l JOIN u0 ON u0.i = l.g JOIN v{_OVER} USING (r) LEFT JOIN proof USING (r), u{_OVER} root"""

_WORDS = r"""SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents"""

ORACLES = {
    "op11_manifest": _MANIFEST,
    "op13_fill_middle": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n, string_split(text, chr(10)) AS l FROM d),
        k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS k2, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS s FROM u),
        c AS (SELECT *, least(length(text), length(array_to_string(l[1:least(k1, k2)], chr(10))) + CASE WHEN least(k1, k2) > 0 THEN 1 ELSE 0 END) AS a,
                     least(length(text), length(array_to_string(l[1:greatest(k1, k2)], chr(10))) + CASE WHEN greatest(k1, k2) > 0 THEN 1 ELSE 0 END) AS b FROM k),
        f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN s THEN 'spm' ELSE 'psm' END AS form,
                     left(text, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS x FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || x || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
    "op3_chat": chat.ORACLE,
    "op5_substring_dedup": f"""
        WITH d AS ({_WORDS}), starts AS (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d), win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
        rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1), gone AS (SELECT DISTINCT r, i + k AS p FROM rep, generate_series(0, 34) t(k)),
        words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        left_ AS (SELECT words.r, count(gone.p) AS n, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS kept FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (r)""",
    "quality_base": rf"""
        WITH d AS ({_WORDS}), starts AS (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d), win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM starts), rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, generate_series(0, 2) t(k) GROUP BY r),
        lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d)
        SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
        FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)""",
    "pii_base": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT r, doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
                     list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS c,
                     list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM d)
        SELECT doc_id, len(e) AS n_email,
               len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST(right(y, 3) AS INT) > 255)) = 0)) AS n_ip,
               len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, length(x)),
                   lambda k: CASE WHEN k % 2 = 1 THEN CAST(x[k] AS INT) ELSE 2 * CAST(x[k] AS INT) - CASE WHEN CAST(x[k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
               len(list_filter(p, lambda x: x BETWEEN 9 AND 15)) AS n_phone FROM m""",
    "op1_url_filter": """
        WITH rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT row_number() OVER () AS n, page_id,
                         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts, rules
                 WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, '/' || split_part(rule, '/', 2) || CASE WHEN rule LIKE '%/%/' THEN '/' ELSE '' END)
                 GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)""",
}
