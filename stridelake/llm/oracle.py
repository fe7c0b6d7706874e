"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from stridelake.llm.queries import LIST_ENTRIES, MIX_WEIGHTS


def _entries() -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in LIST_ENTRIES)


def _divided(name: str, parent: str, keys: str, weight: str, up: str) -> str:
    """Water-filling of one level in closed form: children by capacity for weight; those that the rest can fill are full."""
    return f"""
        {name}_c AS (SELECT {keys}, sum(cap) AS cap, CAST({weight} AS DOUBLE) AS w FROM leaf GROUP BY ALL),
        {name}_o AS (SELECT c.*, p.given AS budget, sum(c.cap) OVER before AS cap_before, sum(c.w) OVER onward AS w_onward
            FROM {name}_c c JOIN {parent} p ON {up}
            WINDOW before AS (PARTITION BY {parent}_key(p) ORDER BY c.cap / c.w, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   onward AS (PARTITION BY {parent}_key(p) ORDER BY c.cap / c.w, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        {name}_f AS (SELECT *, cap / w <= (budget - coalesce(cap_before, 0)) / w_onward AS is_full FROM {name}_o),
        {name} AS (SELECT {keys}, CASE WHEN is_full THEN cap
            ELSE w * (budget - coalesce(sum(cap) FILTER (is_full) OVER fam, 0)) / sum(w) FILTER (NOT is_full) OVER fam END AS given
            FROM {name}_f WINDOW fam AS (PARTITION BY FAMILY_{name}))"""


def _weight(depth: int, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {w}" for (d, n), w in MIX_WEIGHTS.items() if d == depth) + " ELSE 1 END" if any(d == depth for d, _ in MIX_WEIGHTS) else "1"


def _mixing(budget: float, epochs: int, seed: int) -> str:
    top = _divided("l1", "l0", "domain", _weight(0, "domain"), "true").replace("l0_key(p)", "1").replace("FAMILY_l1", "1")
    mid = _divided("l2", "l1", "domain, lang", _weight(1, "lang"), "p.domain = c.domain").replace("l1_key(p)", "c.domain").replace("FAMILY_l2", "domain")
    low = _divided("l3", "l2", "domain, lang, source", _weight(2, "source"), "p.domain = c.domain AND p.lang = c.lang").replace("l2_key(p)", "c.domain, c.lang").replace("FAMILY_l3", "domain, lang")
    for x in (", domain ROWS", ", domain, lang ROWS", ", domain, lang, source ROWS"):
        top, mid, low = (t.replace(x, x.replace("domain", "c.domain").replace("lang", "c.lang").replace("source", "c.source")) for t in (top, mid, low))
    return rf"""
        WITH d AS (
            SELECT doc_id, 'domain' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN ''
                     ELSE CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4 AS VARCHAR) END AS domain,
                   coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
            FROM documents),
        leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS cap FROM d GROUP BY ALL),
        l0 AS (SELECT least(floor(CAST({budget} AS DOUBLE) * sum(tokens)), sum(cap)) AS given FROM leaf),{top},{mid},{low},
        plan AS (SELECT domain, lang, source, tokens, least(floor(given + 1e-6), cap) AS given FROM l3 JOIN leaf USING (domain, lang, source)),
        cut AS (SELECT *, CASE WHEN tokens > 0 THEN floor(given / tokens) ELSE {epochs} END AS whole FROM plan),
        run AS (SELECT d.*, given, whole, given - whole * tokens AS rest,
                sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(sha256('{seed}:' || CAST(whole AS INTEGER) || ':' || doc_id), 1, 15), doc_id) AS upto
            FROM d JOIN cut USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens, CAST(given AS BIGINT) AS leaf_budget
        FROM run, range({epochs + 1}) r(e) WHERE e < whole OR (e = whole AND rest > 0 AND upto <= rest)"""


_SAID = "\\### Assistant: </turn> ok"

ORACLE = {
    # the last entry of a key on or before the day decides; suffixes and prefixes are matched as strings
    "op1_url_filter": f"""
        WITH listed(list, kind, given, day, action) AS (VALUES {_entries()}),
        entries AS (
            SELECT list, kind, day, action, CASE kind WHEN 'domain' THEN lower(given)
                WHEN 'path' THEN lower(split_part(given, '/', 1)) || substr(rtrim(given, '/'), length(split_part(given, '/', 1)) + 1)
                ELSE lower(regexp_extract(given, '^[^/]*//[^/]*', 0)) || regexp_replace(given, '^[^/]*//[^/]*', '') END AS whole,
                regexp_replace(whole, '^(https://[^/]*):443', '\\1') AS key
            FROM listed),
        pages_at AS (
            SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST((page_id * 7) % 366 AS INTEGER) AS fetched,
                   lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
                   regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*(?::[0-9]*)?([^?#]*)', 1), '/+', '/', 'g') AS path
            FROM pages),
        named AS (
            SELECT page_id, url, e.list, e.kind, e.key, arg_max(e.action = 'add', e.day || CASE e.action WHEN 'add' THEN 'b' ELSE 'a' END) AS active
            FROM pages_at p JOIN entries e ON CAST(e.day AS DATE) <= p.fetched AND p.host <> '' AND (
                (e.kind = 'domain' AND (p.host = e.key OR ends_with(p.host, '.' || e.key)))
                OR (e.kind = 'path' AND (p.host || rtrim(p.path, '/') = e.key OR starts_with(p.host || p.path, e.key || '/')))
                OR (e.kind = 'url' AND p.url = e.key))
            GROUP BY ALL),
        held AS (
            SELECT page_id, url, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
            FROM named WHERE active GROUP BY ALL)
        SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d') AS fetched, coalesce(h.n_entries, 0) AS n_entries,
               coalesce(h.lists, '') AS lists, h.n_entries IS NOT NULL AS blocked
        FROM pages_at p LEFT JOIN held h ON p.page_id IS NOT DISTINCT FROM h.page_id AND p.url IS NOT DISTINCT FROM h.url""",
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        spans AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
        keyed AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS k FROM spans),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keyed) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, range(20) r(j)),
        all_words AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w)
        SELECT w.doc_id, len(w.words) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed,
               sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM w LEFT JOIN (
            SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS kept
            FROM all_words a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id) k USING (doc_id)""",
    "op5_mixing": _mixing(0.9, 2, 7),
    "op6_chat_trees": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
        sized AS (
            SELECT *, length(role) + length(text) + 15
                   + length(role || text) - length(replace(replace(replace(role || text, '\\', ''), '#', ''), '<', '')) AS chars
            FROM rows)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_chosen_path": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS sh FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 4)
            UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT comp.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, comp.doc_id = component_id AS kept
        FROM comp LEFT JOIN n USING (doc_id)""",
}
