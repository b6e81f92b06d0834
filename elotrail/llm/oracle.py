"""DuckDB SQL of the operators' queries, where SQL expresses them."""

from __future__ import annotations

from .licenses import RULES, SENTENCES, normalise
from .mixing import MAX_REPEATS, WEIGHTS
from .queries import URL_RULES

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licenses() -> str:
    known = ", ".join(f"({_q(normalise(s))}, {_q(i)})" for i, s in SENTENCES.items())
    norm = f"trim(regexp_replace(translate(s, {_FOLD}), '[^a-z0-9]+', ' ', 'g'))"
    # the sequence of a text as one string, <id> for a known sentence and <> for another;
    # each rule in turn replaces its sequence by a mark {rule}
    steps, marks = "seq", []
    for k, (_, ids) in enumerate(RULES):
        steps = f"replace({steps}, {_q(''.join(f'<{i}>' for i in ids))}, '{{{k}}}')"
    for k, (name, _) in enumerate(RULES):
        marks.append(f"({k}, {_q(name)})")
    return f"""
    WITH known(form, id) AS (VALUES {known}),
    rules(k, name) AS (VALUES {', '.join(marks)}),
    cut AS (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS x
            FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?;:]+[ \\t\\n\\r\\f\\v]+') AS l
                  FROM documents)),
    sent AS (SELECT doc_id, x[1] AS i, x[2] AS s FROM cut),
    whole AS (SELECT doc_id, i, s, {norm} AS form FROM sent),
    lines AS (SELECT doc_id, i, unnest(list_zip(range(len(l)), l)) AS x
              FROM (SELECT doc_id, i, CASE WHEN form IN (SELECT form FROM known) THEN [s]
                           ELSE string_split(s, chr(10)) END AS l FROM whole)),
    unit AS (SELECT doc_id, i, x[1] AS j, x[2] AS s FROM lines),
    form AS (SELECT doc_id, i, j, {norm} AS form FROM unit),
    seq AS (SELECT doc_id, count(*) AS n_sentences,
                   string_agg(id, ',' ORDER BY i, j) AS ids,
                   string_agg('<' || coalesce(id, '') || '>', '' ORDER BY i, j) AS seq
            FROM form LEFT JOIN known USING (form) WHERE form <> '' GROUP BY doc_id),
    done AS (SELECT *, {steps} AS marked FROM seq),
    found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
              FROM done JOIN rules ON contains(marked, '{{' || k || '}}') GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
           coalesce(licenses, '') AS licenses,
           coalesce(len(marked) - len(replace(marked, '{{', '')), 0) AS n_matches
    FROM documents d LEFT JOIN done USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _urls() -> str:
    rules = ", ".join(f"({_q(h)}, {_q(p)}, {_q(v)})" for h, p, v in URL_RULES)
    return f"""
    WITH rules(rh, rp, rv) AS (VALUES {rules}),
    cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0
                                 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    part AS (SELECT page_id,
                    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), {_FOLD}) AS host,
                    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM cut),
    fit AS (SELECT host, path, arg_max({{'rule': rh || rp, 'verdict': rv}}, len(rh || rp)) AS best
            FROM (SELECT DISTINCT host, path FROM part) JOIN rules
              ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY host, path)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
    FROM part LEFT JOIN fit USING (host, path)"""


def _mix() -> str:
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    n = MAX_REPEATS
    return f"""
    WITH d AS (SELECT doc_id, source,
                      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                      ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
               FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size,
                 {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
          FROM d GROUP BY source),
    level AS (SELECT *, sum(source_size) OVER () AS total,
                     sum(source_size) OVER () - coalesce(sum({n} * source_size) OVER before, 0) AS free,
                     sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS share
              FROM s WINDOW before AS (ORDER BY source_size / w, w, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    capped AS (SELECT *, min(CASE WHEN {n} * source_size * share <= free * w THEN 1 ELSE 0 END)
                           OVER (ORDER BY source_size / w, w, source NULLS LAST
                                 ROWS UNBOUNDED PRECEDING) AS cap FROM level),
    t AS (SELECT source, source_size, total,
                 CASE WHEN cap = 1 THEN ({n} * source_size)::DOUBLE
                      ELSE (max(CASE WHEN cap = 0 THEN {{'a': share, 'b': free}} END) OVER ()).b::DOUBLE * w
                           / (max(CASE WHEN cap = 0 THEN {{'a': share, 'b': free}} END) OVER ()).a
                 END AS target FROM capped),
    c AS (SELECT d.*, source_size, total, target,
                 sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                 ROWS UNBOUNDED PRECEDING) AS cum
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    q AS (SELECT *, (round * source_size + cum)::DOUBLE / target AS finish
          FROM c, (SELECT unnest(range({n})) AS round) WHERE size > 0),
    run AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, cum, key, doc_id
                                      ROWS UNBOUNDED PRECEDING) AS queued FROM q),
    taken AS (SELECT doc_id, sum(size) AS taken FROM run WHERE 2 * queued - size <= 2 * total
              GROUP BY doc_id)
    SELECT c.doc_id, size, source_size::BIGINT AS source_size, target,
           coalesce(taken, 0)::BIGINT AS taken
    FROM c LEFT JOIN taken USING (doc_id)"""


def _benchmark() -> str:
    words = (f"regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
    WITH item AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
    win AS (SELECT item, least(10, len(w)) AS size,
                   array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k
                  FROM item WHERE len(w) > 0)),
    wins AS (SELECT DISTINCT item, size, win FROM win),
    d AS (SELECT doc_id, {words} AS w FROM documents),
    pos AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
                 FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
    hit AS (SELECT doc_id, pos.size, k, item
            FROM pos JOIN wins ON pos.win = wins.win AND pos.size = wins.size),
    word AS (SELECT doc_id, count(DISTINCT n) AS n_hit
             FROM (SELECT doc_id, unnest(range(k, k + size)) AS n
                   FROM (SELECT DISTINCT doc_id, size, k FROM hit))
             GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
              FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _audit() -> str:
    fails = {"A": "words < 200", "B": "100 * different < 50 * words", "C": "100 * capitals > 2 * chars",
             "D": "marked", "E": "copy"}
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS l,
                 doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
    m AS (SELECT doc_id, part, len(l) AS words, len(list_distinct(l)) AS different, length(t) AS chars,
                 len(regexp_extract_all(t, '[A-Z]')) AS capitals,
                 regexp_matches(t, '[#$%&*|]') AS marked, coalesce(copy, false) AS copy FROM w),
    mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
             FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 [{', '.join(fails.values())}] AS failed FROM m LEFT JOIN mark USING (doc_id)),
    n AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good,
                 count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, failed),
    letter AS (SELECT unnest(range(1, 6)) AS i),
    orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o
               FROM letter a, letter b, letter c, letter d, letter e
               WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    steps AS (SELECT o, i AS step, o[i] AS own, o[1:i - 1] AS before FROM orders, letter),
    x AS (SELECT part, o, step, own, n, good, toxic, failed[own] AS fail,
                 len(list_filter(before, lambda b: failed[b])) > 0 AS gone,
                 len(list_filter(failed, lambda b: b)) AS fails FROM n, steps),
    r AS (SELECT part, o, step, own,
                 sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept,
                 sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed,
                 sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
                 sum(CASE WHEN fail AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::BIGINT AS good_lost,
                 sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM x GROUP BY part, o, step, own)
    SELECT part, array_to_string([substr('ABCDE', i, 1) FOR i IN o], '') AS filter_order,
           step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM r"""


ORACLE = {"op2_license_scans": _licenses(), "op4_url_filters": _urls(), "op9_mixing": _mix(),
          "op10_benchmark_decontamination": _benchmark(), "op12_filter_audit": _audit()}
