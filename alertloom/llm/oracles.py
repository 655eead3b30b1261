"""SQL for DuckDB over the same tables, for the queries that SQL can express."""

from __future__ import annotations

from . import quality as q, vector_codes as v
from .queries import TARGETS
from .secrets import RULES

_BLANK = r"[\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _secrets() -> str:
    """Matches and the text between them, one after the other, give each match its place."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = _text(rule.pattern)
        parts.append(
            f"""SELECT doc_id, {k} AS place, '{rule.kind}' AS kind, e - length(m) AS s, e FROM (
                SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
                    SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (
                        SELECT doc_id, regexp_extract_all(txt, {pattern}, 0) AS ms, regexp_extract_all(txt, {pattern}, {rule.group}) AS vs,
                               string_split_regex(txt, {pattern}) AS gs FROM t)))
                WHERE length(v) >= {rule.least}"""
        )
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in RULES)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents), f AS ({" UNION ALL ".join(parts)}),
        a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) AS spans FROM f GROUP BY doc_id)
        SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN a USING (doc_id)"""


def _quality() -> str:
    least, most = q.MEAN_WORD_CHARS
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
        w AS (
            SELECT doc_id, txt, list_filter(string_split_regex(txt, '{_BLANK}+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
        win AS (
            SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'w': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS p FROM w),
        twice AS (SELECT doc_id, p.w AS x FROM win GROUP BY ALL HAVING count(*) > 1),
        rep AS (
            SELECT doc_id, count(DISTINCT pos) AS n FROM (
                SELECT win.doc_id, unnest([p.i, p.i + 1, p.i + 2]) AS pos FROM win JOIN twice ON win.doc_id = twice.doc_id AND p.w = x)
            GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, txt, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(txt, '{_BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(txt, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN rep USING (doc_id)),
        b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (100 * n_symbols > {q.MAX_SYMBOLS} * n_words)
               AND NOT (100 * n_dup_lines > {q.MAX_DUP_LINES} * len(string_split(txt, chr(10))))
               AND word_chars BETWEEN {least} * n_words AND {most} * n_words
               AND NOT (100 * length(regexp_replace(txt, '[^\p{{Lu}}]', '', 'g')) > {q.MAX_SHOUTED} * length(regexp_replace(txt, '[^\p{{L}}]', '', 'g')))
               AND NOT (100 * length(regexp_replace(txt, '[^!?]', '', 'g')) > {q.MAX_STOPS} * n_words) AS kept
        FROM b"""


def _weights(column: str, weights) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _mixing(targets) -> str:
    """The budget is handed down level by level; a leaf takes whole epochs and a prefix of the next one."""
    levels = (("domain", targets.domains), ("lang", targets.langs), ("source", targets.sources))
    parts, parents, last = [], [], f"SELECT *, (sum(tokens) OVER () * {targets.budget_percent}) // 100 AS budget FROM leaf"
    for level, weights in levels:
        keys = ", ".join([*parents, level])
        over = f"PARTITION BY {', '.join(parents)} " if parents else ""
        join = " AND ".join(f"c.{k} = s.{k}" for k in [*parents, level])
        parts.append(
            f"""
        n_{level} AS (SELECT {keys}, {_weights(level, weights)} AS w, sum(tokens) * {targets.max_epochs} AS room, any_value(budget) AS budget
                      FROM c_{level} GROUP BY {keys}),
        o_{level} AS (SELECT *, sum(w) OVER ({over}ORDER BY room / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
                      coalesce(sum(room) OVER ({over}ORDER BY room / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n_{level}),
        f_{level} AS (SELECT *, bool_and(room * ahead <= (budget - used) * w)
                      OVER ({over}ORDER BY room / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM o_{level}),
        s_{level} AS (SELECT {keys}, CASE WHEN filled THEN room ELSE ((budget - sum(CASE WHEN filled THEN room ELSE 0 END) OVER ({over})) * w)
                      // sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({over}) END AS share FROM f_{level}),
        g_{level} AS (SELECT c.* EXCLUDE (budget), s.share AS budget FROM c_{level} c JOIN s_{level} s ON {join})"""
        )
        parts[-1] = f"\n        c_{level} AS ({last})," + parts[-1]
        last, parents = f"SELECT * FROM g_{level}", [*parents, level]
    return f"""
        WITH d AS (SELECT doc_id, coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'unknown') AS domain,
                          coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                          CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
        leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0), {",".join(parts)},
        p AS (SELECT d.*, budget // tokens AS whole, budget % tokens AS rest FROM d JOIN g_source USING (domain, lang, source)),
        r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
                  ORDER BY sha256('{targets.seed}:' || CAST(whole + 1 AS BIGINT) || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p)
        SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS BIGINT) AS epoch FROM (SELECT *, unnest(range(1, CAST(whole AS BIGINT) + 1)) AS e FROM p)
        UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + 1 AS BIGINT) FROM r WHERE rest > 0 AND upto <= rest"""


def _vector_codes() -> str:
    """Every part against every entry, for each round and once more; all vectors are taken to have one length."""

    def assigned(name: str, book: str) -> str:
        square = "list_sum(list_transform(list_zip(x.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""
        {name} AS (SELECT rid, p, any_value(x.part) AS part, min({{'d': CAST({square} AS BIGINT), 'e': b.e}}) AS best
                   FROM parts x JOIN {book} b USING (p) GROUP BY rid, p)"""

    rounds = []
    for k in range(v.ROUNDS):
        rounds.append(assigned(f"near{k}", f"book{k}"))
        rounds.append(
            f"""
        sum{k} AS (SELECT p, e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                       SELECT p, best.e AS e, unnest(part) AS x, unnest(range(len(part))) AS pos FROM near{k}) GROUP BY p, e, pos),
        mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS entry FROM sum{k} GROUP BY p, e),
        book{k + 1} AS (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
        )
    return f"""
        WITH kept AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid,
                   list_transform(embedding, lambda x: CAST(floor({v.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT rid, p, ints[p * (len(ints) // {v.PARTS}) + 1 : (p + 1) * (len(ints) // {v.PARTS})] AS part
                  FROM (SELECT rid, ints, unnest(range({v.PARTS})) AS p FROM kept)),
        book0 AS (SELECT p, rid - 1 AS e, part AS entry FROM parts WHERE rid <= {v.ENTRIES}),{",".join(rounds)},{assigned("last", f"book{v.ROUNDS}")},
        shown AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, pos)) AS digest FROM (
                      SELECT p, e, unnest(entry) AS x, unnest(range(len(entry))) AS pos FROM book{v.ROUNDS})),
        coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
        FROM kept JOIN coded USING (rid), shown"""


SQL: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op3_quality_rules": _quality(),
    "op8_mixing": _mixing(TARGETS),
    "op13_vector_codes": _vector_codes(),
}
