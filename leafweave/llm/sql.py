"""DuckDB SQL for the results of queries that SQL can express, written from what they should return."""

from __future__ import annotations

from leafweave.llm import quality_rules as q

_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def substring_dedup(window: int = 20) -> str:
    """op5: words of windows that also start earlier."""
    return f"""WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
 s AS (SELECT doc_id, unnest(range(1, len(ws) - {window} + 2)) AS k, ws FROM d WHERE len(ws) >= {window}), h AS (SELECT doc_id, k, array_to_string(ws[k : k + {window - 1}], ' ') AS g FROM s),
 e AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1 AS again FROM h),
 c AS (SELECT w.doc_id, w.k, w.word, coalesce(bool_or(again) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN e ON e.doc_id = w.doc_id AND e.k = w.k)
 SELECT d.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY c.k) FILTER (NOT gone), '')) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""


def suffix_array_dedup(window: int = 200) -> str:
    """op6: bytes of strings that also start elsewhere; a text is looked at as hexadecimal digits."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), s AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {window - 1})) AS k FROM d WHERE length(x) >= {2 * window}),
 h AS (SELECT doc_id, k, md5(substr(x, 2 * k + 1, {2 * window})) AS g FROM s), r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1),
 m AS (SELECT doc_id, k, CASE WHEN k > lag(k) OVER w + {window} THEN 1 WHEN lag(k) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m), sp AS (SELECT doc_id, run, min(k) AS a, max(k) + {window} AS b FROM i GROUP BY ALL),
 kp AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
 p AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(x, 2 * last + 1)) AS rest FROM (SELECT *, max(b) OVER (PARTITION BY doc_id) AS last FROM kp) JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)"""


def _js(p: list[str], r: list[str]) -> str:
    """Jensen-Shannon distance in base 2 of two lists of SQL numbers."""
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    total = " + ".join([half(a, b) for a, b in zip(p, r, strict=True)] + [half(b, a) for a, b in zip(p, r, strict=True)])
    return f"sqrt(greatest(0, least(1, ({total}) / 2)))"


def quality() -> str:
    """op10: counts, distances to the means of each language, verdict."""
    n, k = q.N_COMMON, len(q.CLASSES)
    lists = " ".join(f"WHEN '{lang}' THEN {words.split()!r}" for lang, words in q.COMMON.items())
    classes = ("[^a-z]", "[^A-Z]", "[^0-9]", "[^.,;:''\"?!()-]")
    counts = [f"length(regexp_replace(t, '{c}', '', 'g'))" for c in classes]
    counts += [f"length(regexp_replace(t, '[^\\x21-\\x7E]', '', 'g')) - c0 - c1 - c2 - c3", "length(t) - c0 - c1 - c2 - c3 - c4"]
    c = ", ".join(f"{x} AS c{i}" for i, x in enumerate(counts))
    common = ", ".join(f"len(list_filter(lw, lambda x: x = cw[{i + 1}])) AS w{i}" for i in range(n))
    means = ", ".join([*(f"avg(c{i} / greatest(word_chars, 1)) AS rc{i}" for i in range(k)), *(f"avg(w{i} / n_words) AS rw{i}" for i in range(n))])
    one = _js([f"(c{i} / greatest(word_chars, 1))" for i in range(k)], [f"rc{i}" for i in range(k)])
    sums, refs = " + ".join(f"w{i}" for i in range(n)), " + ".join(f"rw{i}" for i in range(n))
    two = _js([*(f"(w{i} / n_words)" for i in range(n)), f"(1 - ({sums}) / n_words)"], [*(f"rw{i}" for i in range(n)), f"greatest(0, 1 - ({refs}))"])
    base, scatter = q.COMMON_SCATTER
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_SPLIT} AS ws FROM documents),
 g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) > 1 AS twice FROM (SELECT doc_id, k, ws[k : k + 4] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d WHERE len(ws) >= 5))),
 w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k FROM d), a AS (SELECT w.doc_id, coalesce(bool_or(twice) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS again FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.k = w.k),
 rep AS (SELECT doc_id, count(*) FILTER (again) AS n FROM a GROUP BY 1), ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 f AS (SELECT doc_id, lang, len(ws) AS n_words, array_to_string(ws, '') AS t, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CASE lang {lists} END AS cw,
  list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lw FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
 m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {c}, {common} FROM f), r AS (SELECT lang, {means} FROM m WHERE NOT base_failed AND cw IS NOT NULL AND n_words >= {q.MIN_CLASS_WORDS} GROUP BY lang),
 x AS (SELECT m.*, CASE WHEN rc0 IS NOT NULL AND n_words >= {q.MIN_CLASS_WORDS} THEN {one} END AS one, CASE WHEN rc0 IS NOT NULL AND n_words >= {q.MIN_COMMON_WORDS} THEN {two} END AS two FROM m LEFT JOIN r USING (lang))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(one, 0) > {q.MAX_CLASS_DISTANCE} OR coalesce(two, 0) > greatest({q.MAX_COMMON_DISTANCE}, {base} + {scatter} / sqrt(greatest(n_words, 1)))) AS kept,
 round(one, 6) AS class_distance, round(two, 6) AS common_distance FROM x"""
