"""The catalog's queries again, as plain SQL over the sample tables.

Written from the rules, not from the Spark plans: dates are computed instead of
parsed back, numbers are taken from the columns they were formatted from, and
keywords are compared with the text at every place. Used to check results.
"""

from __future__ import annotations

from buzzlens import schemas
from buzzlens.plans.bindings import SAMPLE_KEYWORDS

AS_OF = "TIMESTAMP '2024-01-19'"
BLANKS = r"'^\s+|\s+$', '', 'g'"


def _ts(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def _day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def _strip(expression: str) -> str:
    return f"regexp_replace({expression}, {BLANKS})"


def _untag(expression: str) -> str:
    return f"regexp_replace({expression}, '(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')"


def _decode(expression: str) -> str:
    for name, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"),
        ("&amp;", "&"),
    ):
        expression = f"replace({expression}, '{name}', '{char}')"
    return expression


def _escape(expression: str) -> str:
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        expression = f"replace({expression}, '{char}', '{name}')"
    return expression


_KINDS = ", ".join(f"'{s}'" for s in schemas.SOURCE_TYPES)
_FIXED_WORDS = ", ".join(f"({e}, '{k}')" for e, k in SAMPLE_KEYWORDS)

# Named sub-queries; each may use the ones before it.
CTES = {
    "docs": f"""
        SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id,
               list_extract([{_KINDS}], CAST(doc_id % 6 AS INTEGER) + 1) AS source_type,
               CASE WHEN doc_id % 6 = 0 THEN 'user' || (doc_id % 97) END AS author,
               split_part(text, chr(10), 1) AS title,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS content,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7919 % 43200 AS INTEGER))
                   AS published_at,
               'https://example.org/id/' || doc_id AS url,
               CASE WHEN doc_id % 6 = 0 THEN doc_id * 7 % 40 END AS upvotes,
               CASE WHEN doc_id % 6 = 0 THEN doc_id % 5 END AS downvotes,
               CASE WHEN doc_id % 6 = 0 THEN doc_id % 3 END AS arrows,
               lang, source, text
        FROM documents""",
    "words": f"""
        SELECT entity_id, keyword, length(keyword) AS len FROM (
            SELECT * FROM (VALUES {_FIXED_WORDS}) AS f(entity_id, keyword)
            UNION ALL
            SELECT item_id + 1000, unnest(list_distinct(regexp_extract_all(text, '[a-z]{{4,}}')))
            FROM benchmark
            UNION ALL SELECT p_partkey + 100000, 'P' || p_partkey FROM part
            UNION ALL SELECT p_partkey + 100000, p_name FROM part)
        WHERE keyword <> ''""",
    "codes": """
        SELECT i AS entity_id, CASE WHEN i IN (4, 8) THEN NULL ELSE CAST(i AS VARCHAR) END
                   AS stock_code
        FROM range(1, 10) AS r(i)
        UNION ALL SELECT item_id + 1000, CAST(item_id + 10 AS VARCHAR) FROM benchmark
        UNION ALL SELECT p_partkey + 100000, 'P' || p_partkey FROM part""",
    "blocks": """
        SELECT document_id, substr(t, i * 200 + 1, 300) AS block FROM (
            SELECT document_id, title || ' ' || content AS t,
                   unnest(range(0, (length(title || ' ' || content) - 1) // 200 + 1)) AS i
            FROM docs)""",
    "places": """
        SELECT document_id, substr(block, p, 100) AS rest FROM (
            SELECT document_id, block, unnest(range(1, least(200, length(block)) + 1)) AS p
            FROM blocks)""",
    "hits": """
        SELECT document_id, entity_id, keyword, CAST(count(*) AS BIGINT) AS hits
        FROM (SELECT document_id, entity_id, keyword FROM places JOIN words
                  ON substr(rest, 1, 4) = substr(keyword, 1, 4)
              WHERE len >= 4 AND starts_with(rest, keyword)
              UNION ALL
              SELECT document_id, entity_id, keyword FROM places JOIN words
                  ON substr(rest, 1, 2) = substr(keyword, 1, 2)
              WHERE len IN (2, 3) AND starts_with(rest, keyword)
              UNION ALL
              SELECT document_id, entity_id, keyword FROM places JOIN words
                  ON substr(rest, 1, 1) = keyword)
        GROUP BY ALL""",
    "entity_hits": """
        SELECT document_id, entity_id, CAST(sum(hits) AS BIGINT) AS mention_count
        FROM hits GROUP BY ALL""",
    "doc_points": """
        SELECT document_id, entity_id,
               coalesce(stock_code, 'entity_' || entity_id) AS stock_code,
               source_type, published_at AS ts, mention_count
        FROM entity_hits JOIN docs USING (document_id) LEFT JOIN codes USING (entity_id)""",
    "event_points": """
        SELECT CAST(user_id AS VARCHAR) AS stock_code, event_type AS source_type, ts,
               1 AS mention_count
        FROM events""",
    "event_bars": """
        SELECT CAST(user_id AS VARCHAR) AS stock_code,
               date_trunc('day', ts) + INTERVAL 330 MINUTE AS ts,
               arg_max(value, ts) AS close,
               CAST(floor(sum(CAST(value AS DECIMAL(18, 4)))) AS BIGINT) AS volume
        FROM events GROUP BY user_id, date_trunc('day', ts)""",
    "snap": f"""
        SELECT stock_code,
               max(close) FILTER (WHERE r = 1) AS close,
               coalesce(max(close) FILTER (WHERE r = 2), max(close) FILTER (WHERE r = 1))
                   AS prev_close,
               max(volume) FILTER (WHERE r = 1) AS latest_volume,
               coalesce(avg(volume) FILTER (WHERE ts >= {AS_OF} - INTERVAL 6 DAY), 0) AS avg_volume
        FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY ts DESC) AS r
              FROM event_bars WHERE ts >= {AS_OF} - INTERVAL 10 DAY AND ts < {AS_OF})
        GROUP BY stock_code""",
    "bars": """
        SELECT 'P' || l_partkey AS stock_code, 'Supplier ' || l_suppkey AS stock_name,
               CASE WHEN l_returnflag = 'R' THEN 'TWSE' ELSE 'TPEX' END AS market,
               l_shipdate AS trading_date,
               CAST(l_extendedprice AS DECIMAL(18, 2)) AS price,
               CAST(l_quantity AS DECIMAL(18, 2)) AS spread,
               CAST(l_discount AS DECIMAL(18, 2)) AS extra,
               CAST(l_quantity * 1000 AS BIGINT) AS volume, l_linenumber
        FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0.08""",
    "ents": """
        SELECT p_partkey + 1 AS entity_id, 'Stock' AS type, p_name AS primary_name,
               'P' || p_partkey AS stock_code
        FROM part
        UNION ALL SELECT -n_nationkey - 1, 'Concept', n_name, NULL FROM nation""",
    "als": """
        SELECT entity_id * 2 AS alias_id, entity_id, coalesce(stock_code, primary_name) AS keyword
        FROM ents
        UNION ALL SELECT entity_id * 2 + 1, entity_id, primary_name FROM ents
        WHERE stock_code IS NOT NULL""",
    "stored_ids": "SELECT p_partkey + 1 AS entity_id FROM part WHERE p_type = 'ECONOMY'",
    "capitals": """
        SELECT document_id, published_at, lang = 'en' AS early,
               unnest(regexp_extract_all(title || ' ' || content, '[A-Z][a-z]{5,}')) AS keyword
        FROM docs""",
    "seen": """
        SELECT keyword, early, count(*) AS n,
               arg_min(document_id, ROW(published_at, document_id)) AS document_id
        FROM capitals GROUP BY ALL""",
    "stored_concepts": """
        SELECT row_number() OVER (ORDER BY md5(keyword)) AS concept_id, document_id, keyword, n,
               n = 2 AS approved
        FROM seen WHERE early""",
    "commands": """
        SELECT o_orderkey AS seq,
               CASE o_orderstatus WHEN 'F' THEN '/approve' ELSE '/reject' END AS command,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS concept_id
        FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "firsts": """
        SELECT concept_id, min(seq) FILTER (WHERE command = '/approve') AS fa,
               min(seq) FILTER (WHERE command = '/reject') AS fr
        FROM commands WHERE concept_id IS NOT NULL GROUP BY concept_id""",
    "promoted": """
        SELECT concept_id, keyword, row_number() OVER (ORDER BY md5(CAST(concept_id AS VARCHAR))) AS n
        FROM stored_concepts JOIN firsts USING (concept_id)
        WHERE NOT approved AND fa IS NOT NULL AND (fr IS NULL OR fa < fr)""",
    "vectors": """
        SELECT CAST(vec_id AS VARCHAR) AS document_id, label,
               CASE WHEN label = 9 THEN embedding[1:63] ELSE embedding END AS embedding
        FROM embeddings""",
    "found_articles": """
        SELECT * FROM docs
        WHERE source_type = 'PttStock' AND published_at >= TIMESTAMP '2024-01-03'
          AND published_at < TIMESTAMP '2024-01-21' AND contains(title, 'e')""",
    "part_status": f"""
        SELECT document_id, lang <> 'es' AS processed,
               CASE WHEN lang = 'de' THEN 0 ELSE 1 END AS entity_match_count,
               lang = 'fr' AS probed
        FROM docs""",
    "hot": """
        SELECT * FROM docs WHERE lang = 'en' AND (upvotes IS NULL OR upvotes >= 10)
        ORDER BY coalesce(upvotes, 0) DESC, published_at, document_id LIMIT 10""",
}


def _with(body: str, *names: str) -> str:
    """``body`` preceded by the sub-queries ``names`` and all they use."""
    needed: set[str] = set()

    def add(name: str) -> None:
        if name in needed:
            return
        needed.add(name)
        for other in CTES:
            if other != name and f" {other}" in CTES[name].replace("(", " ").replace(",", " "):
                words = CTES[name].replace("(", " ").replace(")", " ").replace(",", " ").split()
                for before, word in zip(words, words[1:]):
                    if word == other and before in ("FROM", "JOIN"):
                        add(other)

    for name in names:
        add(name)
    listed = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {listed} {body}" if listed else body


def _quotes(market: str, source: str) -> str:
    return f"""
        SELECT stock_code, stock_name, '{market}' AS market, '{source}' AS data_source,
               {_day('trading_date')} AS trading_date,
               {_ts('trading_date + INTERVAL 330 MINUTE')} AS ts,
               CAST(price AS DOUBLE) AS open, CAST(price + spread AS DOUBLE) AS high,
               CAST(price - spread AS DOUBLE) AS low, CAST(price + extra AS DOUBLE) AS close,
               volume, volume * 7 AS turnover
        FROM bars"""


def _deltas(points: str) -> str:
    return f"""
        SELECT stock_code, current_count, previous_count,
               CASE WHEN previous_count = 0 THEN 100.0
                    ELSE CAST(current_count - previous_count AS DOUBLE) / previous_count * 100
               END AS mention_delta
        FROM (SELECT stock_code,
                     CAST(coalesce(sum(mention_count) FILTER (
                         WHERE ts >= {AS_OF} - INTERVAL 2 DAY), 0) AS BIGINT) AS current_count,
                     CAST(coalesce(sum(mention_count) FILTER (
                         WHERE ts < {AS_OF} - INTERVAL 2 DAY), 0) AS BIGINT) AS previous_count
              FROM {points}
              WHERE ts >= {AS_OF} - INTERVAL 4 DAY AND ts < {AS_OF} GROUP BY stock_code)
        WHERE current_count <> 0"""


def _signals(points: str) -> str:
    return f"""
        SELECT *, CASE type
            WHEN 'Resonance' THEN
                printf('【共振】%s 聲量+%.1f%% / 量比+%.1f%% / 股價+%.2f%%', stock_code,
                       round(mention_delta, 1), round(volume_delta, 1), round(price_delta, 2))
            ELSE printf('【背離】%s 聲量+%.1f%% 但股價%.2f%%，留意出貨風險', stock_code,
                       round(mention_delta, 1), round(price_delta, 2)) END AS summary
        FROM (SELECT *, CASE WHEN volume_delta >= 50 AND price_delta >= 2 THEN 'Resonance'
                             WHEN price_delta <= -1 THEN 'BearishDivergence' END AS type
              FROM (SELECT stock_code, mention_delta,
                           CASE WHEN avg_volume = 0 THEN 0
                                ELSE (latest_volume - avg_volume) / avg_volume * 100 END
                               AS volume_delta,
                           CASE WHEN prev_close = 0 THEN 0
                                ELSE (close - prev_close) / prev_close * 100 END AS price_delta
                    FROM ({_deltas(points)}) JOIN snap USING (stock_code)
                    WHERE mention_delta >= 50))
        WHERE type IS NOT NULL"""


_ALERT_ID = f"sha256(type || '|' || stock_code || '|' || {_ts(AS_OF)})"


def _alerts(points: str) -> str:
    return f"""
        SELECT {_ALERT_ID} AS alert_id, {_ts(AS_OF)} AS triggered_at, type, stock_code,
               stock_code AS stock_name, round(mention_delta, 6) AS mention_delta,
               round(volume_delta, 6) AS volume_delta, round(price_delta, 6) AS price_delta,
               CAST(NULL AS DOUBLE) AS sentiment_avg, summary
        FROM ({_signals(points)})"""


def _signed(column: str, digits: int) -> str:
    return (
        f"CASE WHEN round({column}, {digits}) = 0 THEN '0' "
        f"ELSE printf('%+.{digits}f', round({column}, {digits})) END"
    )


_FORUM = f"""
    SELECT document_id, 'PttStock' AS source_type, coalesce(author, 'anon') AS author,
           {_strip(_escape('title'))} AS title, {_strip("content || '[inner]'")} AS content,
           {_ts('published_at')} AS published_at, url,
           CAST(coalesce(upvotes, 0) AS BIGINT) AS upvotes,
           CAST(coalesce(downvotes, 0) AS BIGINT) AS downvotes,
           CAST(coalesce(arrows, 0) AS BIGINT) AS arrows
    FROM docs WHERE source NOT IN ('src5', 'src6')"""
_RSS_CONTENT = _strip(_untag("'<p><b>' || title || '</b></p>' || content"))
_NEWS = f"""
    SELECT CASE WHEN source = 'src4' THEN 'https://example.org/story-' || document_id
                ELSE 'cnyes_' || document_id END AS document_id,
           'NewsCnyes' AS source_type, 'Story ' || document_id AS title,
           {_RSS_CONTENT} AS content, {_ts('published_at')} AS published_at,
           CASE WHEN source = 'src4' THEN 'https://example.org/story-' || document_id
                ELSE 'https://example.org/news/id/' || document_id END AS url
    FROM docs WHERE source NOT IN ('src0', 'src1', 'src2')"""
_NO_VOTES = (
    "CAST(NULL AS VARCHAR) AS author, CAST(NULL AS BIGINT) AS upvotes, "
    "CAST(NULL AS BIGINT) AS downvotes, CAST(NULL AS BIGINT) AS arrows"
)
_LATEST_MENTION = (
    "PARTITION BY stock_code, source_type, ts ORDER BY CAST(document_id AS BIGINT) DESC, "
    "entity_id DESC"
)
_ARTICLE = f"document_id, title, author, {_ts('published_at')} AS published_at, upvotes"
_ENTITY_ROWS = """
    SELECT entity_id, stock_code, primary_name, type,
           (SELECT count(*) FROM als WHERE als.entity_id = ents.entity_id) AS alias_count
    FROM ents"""
_ENTITY_ORDER = "ORDER BY stock_code ASC NULLS LAST, primary_name, entity_id"
_MAX_ENTITY = "(SELECT max(entity_id) FROM stored_ids)"
_MAX_ALIAS = "(SELECT max(entity_id * 2 + 1) FROM stored_ids)"
_EARLY, _LATE = "2024-02-01 00:00:00.000000", "2024-03-01 00:00:00.000000"
_PENDING = """
    SELECT * FROM stored_concepts WHERE NOT approved ORDER BY n DESC, concept_id LIMIT 5"""

ORACLES: dict[str, str] = {
    "quotes_twse": _with(_quotes("TWSE", "TwseApi"), "bars"),
    "quotes_tpex": _with(_quotes("TPEX", "TpexApi"), "bars"),
    "bars_series": _with(
        f"""
        SELECT stock_code, market,
               CASE market WHEN 'TWSE' THEN 'TwseApi' ELSE 'TpexApi' END AS data_source,
               {_ts('trading_date + INTERVAL 330 MINUTE')} AS ts, CAST(price AS DOUBLE) AS open,
               CAST(price + spread AS DOUBLE) AS high, CAST(price - spread AS DOUBLE) AS low,
               CAST(price + extra AS DOUBLE) AS close, volume,
               CAST(volume * 7 AS DOUBLE) AS turnover, {_day('trading_date')} AS trading_date
        FROM bars""",
        "bars",
    ),
    "bars_lww": f"""
        SELECT 'P' || l_partkey AS stock_code, 'TWSE' AS market,
               {_day('l_shipdate')} AS trading_date,
               {_ts('l_shipdate + INTERVAL 330 MINUTE')} AS ts, l_extendedprice AS close,
               CAST(l_quantity AS BIGINT) AS volume, l_orderkey,
               CAST(l_linenumber AS BIGINT) AS l_linenumber
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey DESC,
            l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) = 1""",
    "roc_dates": f"""
        SELECT o_orderkey,
               CASE o_orderpriority
                   WHEN '1-URGENT' THEN 'ABC' || strftime(o_orderdate, '%m%d')
                   WHEN '2-HIGH' THEN (year(o_orderdate) - 1911) || strftime(o_orderdate, '%m%d')
                   WHEN '3-MEDIUM' THEN lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0') || '0230'
                   ELSE lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0')
                        || strftime(o_orderdate, '%m%d') END AS raw,
               CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')
                      OR o_orderpriority = '2-HIGH' AND year(o_orderdate) >= 2011
                    THEN {_day('o_orderdate')} END AS trading_date
        FROM orders""",
    "forum_dates": f"""
        SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN
                   {_ts('o_orderdate + to_seconds(o_custkey % 86400) - INTERVAL 8 HOUR')} END
                   AS published_at
        FROM orders""",
    "rss_dates": f"""
        SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN
                   {_ts('''o_orderdate + to_seconds(o_custkey % 86400) - to_minutes(
                       CASE o_orderpriority WHEN '1-URGENT' THEN -330 WHEN '2-HIGH' THEN 0
                       ELSE 480 END)''')} END AS published_at
        FROM orders""",
    "rss_items": _with(_NEWS, "docs"),
    "page_links": f"""
        SELECT page_id, pos, regexp_extract(href, '([^/]*?)(?:\\.[^./]*)?$', 1) AS article_id,
               {_decode(_strip('label'))} AS title, '' AS author, href
        FROM (SELECT page_id, unnest(range(0, len(links))) AS pos,
                     unnest(links) AS href, unnest(labels) AS label
              FROM (SELECT page_id,
                        regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a>', 1) AS links,
                        regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a>', 2) AS labels
                    FROM pages))
        WHERE article_id <> ''""",
    "page_articles": f"""
        SELECT page_id, url,
               {_strip(_decode(_untag("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")))}
                   AS title,
               {_strip(_decode(_untag("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")))}
                   AS content
        FROM pages WHERE contains(html, '<article>')""",
    "forum_index": f"""
        SELECT doc_id, pos, 'M.' || doc_id || '.A.' || pos AS article_id, {_strip('line')} AS title,
               source AS author, '/bbs/Stock/M.' || doc_id || '.A.' || pos || '.html' AS href
        FROM (SELECT doc_id, source, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos
              FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))
        WHERE trim(line) <> ''""",
    "forum_articles": _with(_FORUM, "docs"),
    "keyword_hits": _with("SELECT * FROM hits", "hits"),
    "doc_entity_mentions": _with(
        "SELECT document_id, entity_id, mention_count, stock_code "
        "FROM entity_hits LEFT JOIN codes USING (entity_id)",
        "entity_hits", "codes",
    ),
    "doc_match_count": _with(
        f"""
        SELECT document_id, {_ts(AS_OF)} AS processed_at,
               (SELECT count(DISTINCT entity_id) FROM hits WHERE hits.document_id = docs.document_id)
                   AS entity_match_count,
               CAST(NULL AS VARCHAR) AS probed_at
        FROM docs""",
        "docs", "hits",
    ),
    "mentions_series": _with(
        f"SELECT * REPLACE ({_ts('ts')} AS ts) FROM doc_points", "doc_points"
    ),
    "mentions_lww": _with(
        f"SELECT * REPLACE ({_ts('ts')} AS ts) FROM (SELECT * FROM doc_points "
        f"QUALIFY row_number() OVER ({_LATEST_MENTION}) = 1)",
        "doc_points",
    ),
    "mention_counts": _with(
        f"SELECT stock_code, CAST(sum(mention_count) AS BIGINT) AS mention_count "
        f"FROM event_points WHERE ts >= TIMESTAMP '2024-01-05' AND ts < {AS_OF} GROUP BY 1",
        "event_points",
    ),
    "mention_delta": _with(
        f"SELECT * REPLACE (round(mention_delta, 6) AS mention_delta) "
        f"FROM ({_deltas('event_points')})",
        "event_points",
    ),
    "mention_delta_history": _with(
        f"""
        SELECT stock_code, {_ts('w')} AS window_start, c AS current_count, p AS previous_count,
               round(CASE WHEN p = 0 THEN 100.0 ELSE CAST(c - p AS DOUBLE) / p * 100 END, 6)
                   AS mention_delta
        FROM (SELECT stock_code, w, c,
                     CASE WHEN lag(w) OVER o = w - INTERVAL 6 HOUR THEN lag(c) OVER o ELSE 0 END AS p
              FROM (SELECT stock_code, count(*) AS c,
                           time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w
                    FROM event_points GROUP BY ALL)
              WINDOW o AS (PARTITION BY stock_code ORDER BY w))""",
        "event_points",
    ),
    "ohlcv_snapshot": _with(
        "SELECT * REPLACE (round(avg_volume, 6) AS avg_volume) FROM snap", "snap"
    ),
    "signals": _with(_alerts("event_points"), "event_points", "snap"),
    "document_signals": _with(_alerts("doc_points"), "doc_points", "snap"),
    "alert_messages": _with(
        f"""
        SELECT {_ALERT_ID} AS alert_id, type, stock_code,
               CASE type WHEN 'Resonance' THEN '🚀' ELSE '⚠️' END || ' *' || summary || '*'
               || chr(10) || chr(10) || '股票代號：`' || stock_code || '`' || chr(10)
               || '觸發時間：' || strftime({AS_OF}, '%Y-%m-%d %H:%M') || ' UTC' || chr(10)
               || '聲量變化：+' || printf('%.1f', round(mention_delta, 1)) || '%' || chr(10)
               || '量比變化：' || {_signed('volume_delta', 1)} || '%' || chr(10)
               || '股價變化：' || {_signed('price_delta', 2)} || '%' AS message
        FROM ({_signals('event_points')})""",
        "event_points", "snap",
    ),
    "documents_union": _with(f"{_FORUM} UNION ALL BY NAME {_NEWS}", "docs"),
    "doc_validate": _with(
        "SELECT document_id, source_type, "
        "CASE WHEN length(title) > 500 THEN 'title too long' END AS error FROM docs",
        "docs",
    ),
    "doc_insert_if_absent": _with(
        f"SELECT document_id, title, {_ts(f'least(published_at, {AS_OF})')} AS published_at "
        "FROM docs WHERE lang <> 'en'",
        "docs",
    ),
    "recent_ids": _with(
        "SELECT document_id FROM docs WHERE source_type = 'PttStock' "
        f"AND published_at >= {AS_OF} - INTERVAL 7 DAY",
        "docs",
    ),
    "unprocessed_batch": _with(
        f"SELECT document_id, source_type, title, {_ts('published_at')} AS published_at FROM ("
        "SELECT * FROM docs WHERE lang = 'es' ORDER BY published_at, document_id LIMIT 50)",
        "docs",
    ),
    "hot_documents": _with(
        f"SELECT document_id, source_type, {_ts('published_at')} AS published_at, upvotes FROM hot",
        "hot",
    ),
    "doc_status_after_probe": _with(
        f"""
        SELECT document_id, CASE WHEN processed THEN {_ts(AS_OF)} END AS processed_at,
               CAST(entity_match_count AS BIGINT) AS entity_match_count,
               CASE WHEN document_id IN (SELECT document_id FROM hot) THEN '{_EARLY}'
                    WHEN probed THEN {_ts(AS_OF)} END AS probed_at
        FROM part_status""",
        "part_status", "hot",
    ),
    "doc_lookup": _with(
        f"SELECT document_id, source_type, title, {_ts('published_at')} AS published_at "
        "FROM docs WHERE doc_id = 42",
        "docs",
    ),
    "article_search": _with(
        f"SELECT {_ARTICLE} FROM (SELECT * FROM found_articles "
        "ORDER BY upvotes DESC NULLS FIRST, document_id LIMIT 5 OFFSET 5)",
        "found_articles",
    ),
    "article_newest": _with(
        f"SELECT {_ARTICLE} FROM (SELECT * FROM docs WHERE source_type = 'PttStock' "
        "ORDER BY published_at DESC, document_id LIMIT 25)",
        "docs",
    ),
    "page_totals": _with(
        "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS pages "
        "FROM found_articles",
        "found_articles",
    ),
    "whitelist_sync": _with(
        f"""
        SELECT {_MAX_ENTITY} + n AS entity_id, {_MAX_ALIAS} + (n - 1) * 2 + place + 1 AS alias_id,
               CASE place WHEN 0 THEN stock_code ELSE stock_name END AS keyword,
               'Stock' AS type, stock_name AS primary_name, stock_code
        FROM (SELECT *, row_number() OVER (ORDER BY md5(stock_code)) AS n
              FROM (SELECT stock_code, stock_name FROM bars
                    WHERE stock_code NOT IN (SELECT 'P' || (entity_id - 1) FROM stored_ids)
                    QUALIFY row_number() OVER (PARTITION BY stock_code
                        ORDER BY market = 'TPEX', trading_date, stock_name) = 1)),
             range(0, 2) AS r(place)""",
        "bars", "stored_ids",
    ),
    "entity_add": _with(
        f"""
        SELECT {_MAX_ENTITY} + n AS entity_id, {_MAX_ALIAS} + (n - 1) * 2 + place + 1 AS alias_id,
               CASE WHEN type = 'Stock' AND place = 0 THEN 'N' || p_partkey ELSE p_name END
                   AS keyword,
               type, p_name AS primary_name,
               CASE WHEN type = 'Stock' THEN 'N' || p_partkey END AS stock_code
        FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR))) AS n
              FROM (SELECT *, CASE WHEN p_size < 20 THEN 'Stock' WHEN p_size < 40 THEN 'Concept'
                                   ELSE 'Person' END AS type FROM part)
              WHERE p_type <> 'LARGE' AND NOT (type = 'Stock' AND p_type = 'SMALL')),
             range(0, 2) AS r(place)
        WHERE place = 0 OR type = 'Stock'""",
        "stored_ids",
    ),
    "entity_refused": """
        SELECT p_partkey AS request_id, CASE WHEN p_size < 20 THEN 'Stock' ELSE 'Concept' END AS type,
               CASE WHEN p_type = 'LARGE' THEN '' ELSE p_name END AS primary_name,
               CASE WHEN p_size < 20 THEN CASE WHEN p_type = 'SMALL' THEN '' ELSE p_brand END END
                   AS stock_code,
               CASE WHEN p_type = 'LARGE' THEN 'name'
                    WHEN p_size < 20 AND p_type = 'SMALL' THEN 'code' END AS error
        FROM part""",
    "alias_edit": _with(
        """
        SELECT alias_id, entity_id, keyword FROM als
        WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 25 AND p_partkey + 1 = als.entity_id
                          AND als.alias_id = als.entity_id * 2 + p_size % 3)
        UNION ALL
        SELECT (SELECT max(alias_id) FROM als)
                   + row_number() OVER (ORDER BY md5((p_partkey + 1) || '|' || p_brand)),
               p_partkey + 1, p_brand
        FROM part WHERE p_type NOT IN ('PROMO', 'SMALL', 'LARGE')""",
        "als",
    ),
    "cascade_delete": _with(
        "SELECT entity_id, type, primary_name, stock_code, alias_id, keyword "
        "FROM ents LEFT JOIN als USING (entity_id) "
        "WHERE entity_id NOT IN (SELECT p_partkey + 1 FROM part WHERE p_type = 'LARGE')",
        "ents", "als",
    ),
    "entity_aliases": _with(
        "SELECT entity_id, type, primary_name, stock_code, alias_id, keyword "
        "FROM ents LEFT JOIN als USING (entity_id)",
        "ents", "als",
    ),
    "entity_search": _with(
        f"{_ENTITY_ROWS} WHERE contains(stock_code, '1') OR contains(primary_name, '1') "
        f"{_ENTITY_ORDER} LIMIT 20 OFFSET 40",
        "ents", "als",
    ),
    "entity_last_page": _with(
        f"SELECT * FROM ({_ENTITY_ROWS}) QUALIFY row_number() OVER ({_ENTITY_ORDER}) > "
        "((SELECT count(*) FROM ents) - 1) // 20 * 20",
        "ents", "als",
    ),
    "concept_upsert": _with(
        f"""
        SELECT concept_id, c.document_id AS source_document_id,
               CAST(NULL AS VARCHAR) AS associated_stock_code, keyword,
               c.n + coalesce(l.n, 0) AS appearance_count, '{_EARLY}' AS first_discovered_at,
               CASE WHEN l.n IS NULL THEN '{_EARLY}' ELSE '{_LATE}' END AS last_seen_at, approved
        FROM stored_concepts AS c LEFT JOIN (SELECT * FROM seen WHERE NOT early) AS l USING (keyword)
        UNION ALL
        SELECT (SELECT max(concept_id) FROM stored_concepts)
                   + row_number() OVER (ORDER BY md5(keyword)),
               document_id, NULL, keyword, n, '{_LATE}', '{_LATE}', false
        FROM seen WHERE NOT early AND keyword NOT IN (SELECT keyword FROM stored_concepts)""",
        "stored_concepts", "seen",
    ),
    "pending_concepts": _with(
        f"""
        SELECT concept_id, document_id AS source_document_id,
               CAST(NULL AS VARCHAR) AS associated_stock_code, keyword, n AS appearance_count,
               '{_EARLY}' AS first_discovered_at, '{_EARLY}' AS last_seen_at, approved
        FROM ({_PENDING})""",
        "stored_concepts",
    ),
    "concept_refused": f"""
        SELECT sha256(line) AS keyword_sha256, count(*) AS seen_count,
               CASE WHEN {_strip('line')} = '' THEN 'keyword missing' ELSE 'keyword too long' END AS reason
        FROM (SELECT unnest(string_split(split_part(text, chr(10), 1) || chr(10)
                  || substr(text, length(split_part(text, chr(10), 1)) + 2), chr(10))) AS line FROM documents)
        WHERE {_strip('line')} = '' OR length(line) > 100 GROUP BY line""",
    "concept_review_messages": _with(
        f"""
        SELECT concept_id, keyword,
               '🔍 *發現新概念詞彙審核*' || chr(10) || chr(10) || '關鍵字：`' || keyword || '`' || chr(10)
               || '出現次數：' || n || chr(10) || '首次發現：2024-02-01 00:00 UTC' || chr(10)
               || '關聯股票：—' || chr(10) || chr(10) || '請回覆：' || chr(10)
               || '`/approve ' || concept_id || '` 加入白名單' || chr(10)
               || '`/reject ' || concept_id || '` 忽略' AS message
        FROM ({_PENDING})""",
        "stored_concepts",
    ),
    "review_commands": _with(
        """
        SELECT seq, command, concept_id, outcome,
               CASE outcome WHEN 'usage' THEN '用法：' || command || ' <id>'
                            WHEN 'missing' THEN '找不到 concept id=' || concept_id
                            WHEN 'promoted' THEN '✅ 已將「' || keyword || '」加入白名單'
                            WHEN 'already' THEN '「' || keyword || '」已經升級過了'
                            ELSE '🗑 已忽略「' || keyword || '」' END AS reply
        FROM (SELECT seq, command, concept_id, keyword,
                     CASE WHEN concept_id IS NULL THEN 'usage'
                          WHEN keyword IS NULL OR seq > fr THEN 'missing'
                          WHEN command = '/reject' THEN 'removed'
                          WHEN approved OR seq > fa THEN 'already' ELSE 'promoted' END AS outcome
              FROM commands LEFT JOIN firsts USING (concept_id)
              LEFT JOIN stored_concepts USING (concept_id))""",
        "commands", "firsts", "stored_concepts",
    ),
    "apply_reviews": _with(
        """
        SELECT concept_id, keyword, n AS appearance_count,
               approved OR concept_id IN (SELECT concept_id FROM promoted) AS approved
        FROM stored_concepts LEFT JOIN firsts USING (concept_id) WHERE fr IS NULL""",
        "stored_concepts", "firsts", "promoted",
    ),
    "promoted_concepts": _with(
        """
        SELECT (SELECT max(entity_id) FROM ents) + n AS entity_id, 'Concept' AS type,
               keyword AS primary_name, CAST(NULL AS VARCHAR) AS stock_code,
               (SELECT max(alias_id) FROM als) + n AS alias_id, keyword
        FROM promoted""",
        "promoted", "ents", "als",
    ),
    "embedding_insert": _with(
        "SELECT document_id, len(embedding) AS dimension, "
        "round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, "
        "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total "
        "FROM vectors WHERE label >= 3 AND label <> 9",
        "vectors",
    ),
    "existing_embeddings": _with(
        "SELECT document_id FROM docs WHERE document_id IN (SELECT document_id FROM vectors)",
        "docs", "vectors",
    ),
    "embed_documents": _with(
        "SELECT document_id, CAST(1536 AS BIGINT) AS dimension, CAST(0 AS DOUBLE) AS first_value, "
        "CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT document_id FROM hits) "
        "WHERE document_id NOT IN (SELECT document_id FROM vectors)",
        "hits", "vectors",
    ),
}

# Streams give what the batch forms give.
_LAST_EVENT = "(SELECT date_trunc('second', max(ts)) + INTERVAL 1 SECOND FROM events)"

ORACLES |= {
    "stream_quotes": _with(
        f"""
        SELECT stock_code, {_day('trading_date')} AS trading_date,
               CAST(price + extra AS DOUBLE) AS close, volume
        FROM bars QUALIFY row_number() OVER (PARTITION BY stock_code, trading_date
            ORDER BY volume DESC, price + extra DESC) = 1""",
        "bars",
    ),
    "stream_supervised": _with(
        f"""
        SELECT m AS market, stock_code, {_day('trading_date')} AS trading_date,
               CAST(price + extra AS DOUBLE) AS close, volume, starts
        FROM bars, (VALUES ('TWSE', 1), ('TPEX', 2)) AS exchanges(m, starts)
        QUALIFY row_number() OVER (PARTITION BY m, stock_code, trading_date
            ORDER BY volume DESC, price + extra DESC) = 1""",
        "bars",
    ),
    "stream_documents": _with(
        f"SELECT document_id, source_type, title, {_ts('published_at')} AS published_at FROM docs "
        "WHERE length(title) <= 500",
        "docs",
    ),
    "stream_seen_ids": _with(
        f"""
        SELECT document_id, {_ts('published_at - to_days(CAST(60 * (doc_id % 2) AS INTEGER))')} AS published_at FROM docs""",
        "docs",
    ),
    "stream_forum": _with(
        f"SELECT * FROM ({_FORUM}) WHERE CAST(document_id AS BIGINT) % 10 <> 3 AND length(title) <= 500", "docs"
    ),
    "stream_news": _with(f"SELECT *, {_NO_VOTES} FROM ({_NEWS}) WHERE length(title) <= 500", "docs"),
    "stream_mentions_refreshed": _with(
        f"""
        SELECT * REPLACE ({_ts('ts')} AS ts), 1 + CAST(document_id AS BIGINT) % 2 AS dictionary_version
        FROM doc_points WHERE CAST(document_id AS BIGINT) % 2 = 1 OR (entity_id <> 6 AND entity_id < 100000)""",
        "doc_points",
    ),
    "stream_signals_in_turns": "SELECT * FROM ("
    + ORACLES["signals"].replace(AS_OF, f"{_LAST_EVENT[:-1]} WHERE ts < {AS_OF})")
    + ") UNION ALL BY NAME SELECT * FROM (" + ORACLES["signals"].replace(AS_OF, _LAST_EVENT) + ")",
    "stream_review_messages": f"""
        SELECT m.*, '2024-02-01 0' || n || ':30:00.000000' AS pushed_at
        FROM ({ORACLES['concept_review_messages']}) AS m, range(3) AS r(n)""",
    "stream_mentions": ORACLES["mentions_series"],
    "stream_signals": ORACLES["signals"].replace(AS_OF, _LAST_EVENT),
    "stream_mention_deltas": ORACLES["mention_delta_history"],
}
ORACLES["keyword_hits_large"] = ORACLES["keyword_hits"]

# Decoded feeds: fifth lines come twice, sixth and seventh lines not at all.
_TIMES = (
    "FROM bars, unnest(range(CASE WHEN l_linenumber > 5 THEN 0 WHEN l_linenumber = 5 THEN 2 "
    "ELSE 1 END)) AS times(i)"
)
_ROUND_TRIP = f"ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < {AS_OF}"
_AGAIN = "CASE WHEN date_trunc('day', ts) = DATE '2024-01-10' THEN 1 ELSE 0 END"


def _cut_quote(market: str) -> str:
    """Seventh lines as polls, cut after 40 characters: a date, a code, the start of a name."""
    code = {"TWSE": "Code", "TPEX": "SecuritiesCompanyCode"}[market]
    date = (
        "CASE WHEN l_tax = 0.08 THEN '12345' ELSE lpad(CAST(year(l_shipdate) - 1911 AS VARCHAR), 3, '0') "
        "|| strftime(l_shipdate, '%m%d') END"
    )
    return (
        f"""SELECT l_orderkey || '-' || l_linenumber AS key, '[' || substr('{{"Date":"' || {date} || '","{code}":"P' """
        f"""|| l_partkey || '","Name":"Supplier ' || l_suppkey || '"', 1, 40) AS text """
        "FROM lineitem WHERE l_linenumber = 7"
    )


ORACLES |= {
    "feed_listed_json": _with(_quotes("TWSE", "TwseApi").replace("FROM bars", _TIMES), "bars"),
    "feed_otc_json": _with(_quotes("TPEX", "TpexApi").replace("FROM bars", _TIMES), "bars"),
    "feed_rss_xml": _with(f"{_NEWS} AND doc_id % 50 <> 0", "docs"),
    "feed_rejected": _with(
        f"""
        SELECT 'TWSE' AS feed, key, sha256(text) AS text_sha256 FROM ({_cut_quote('TWSE')})
        UNION ALL SELECT 'TPEX', key, sha256(text) FROM ({_cut_quote('TPEX')})
        UNION ALL SELECT 'rss', document_id, sha256('<item>' || CASE WHEN source = 'src0'
            THEN '<title> </title>' ELSE '<title> Story ' || document_id || chr(10) || '</title>' END || '<link>')
        FROM docs WHERE doc_id % 50 = 0""",
        "docs",
    ),
    "bars_round_trip": f"""
        SELECT stock_code, 'TWSE' AS market, {_day('day')} AS trading_date, {_ts('ts')} AS ts,
               open, high, low, close, CAST(volume + {_AGAIN} AS BIGINT) AS volume
        FROM (SELECT CAST(user_id AS VARCHAR) AS stock_code, date_trunc('day', ts) AS day,
                     date_trunc('day', ts) + INTERVAL 330 MINUTE AS ts,
                     arg_min(amount, ROW(ts, event_id)) AS open, max(amount) AS high,
                     min(amount) AS low, arg_max(amount, ROW(ts, event_id)) AS close,
                     floor(sum(CAST(amount AS DECIMAL(18, 4)))) AS volume
              FROM (SELECT *, CAST(CAST(value AS DECIMAL(18, 4)) AS DOUBLE) AS amount FROM events)
              GROUP BY user_id, date_trunc('day', ts))
        WHERE {_ROUND_TRIP}""",
    "mentions_round_trip": f"""
        SELECT CAST(user_id AS VARCHAR) AS stock_code, event_type AS source_type, {_ts('ts')} AS ts,
               CAST(1 + {_AGAIN} AS BIGINT) AS mention_count, event_id
        FROM events WHERE {_ROUND_TRIP}""",
    "stream_quote_files": _with(
        f"""
        SELECT stock_code, {_day('trading_date')} AS trading_date, CAST(price + extra AS DOUBLE) AS close,
               volume, NULL AS text_sha256
        FROM (SELECT * FROM bars WHERE l_linenumber <= 5
              QUALIFY row_number() OVER (PARTITION BY stock_code, trading_date
                  ORDER BY l_linenumber % 3 DESC, volume DESC, price + extra DESC) = 1)
        UNION ALL SELECT NULL, NULL, NULL, NULL, sha256(text) FROM ({_cut_quote('TWSE')})""",
        "bars",
    ),
    "stream_counters": _with(
        """
        SELECT 'quotes' AS job, metric, CAST(sum(n) AS BIGINT) AS rows, batch_id FROM (
            SELECT 'kept' AS metric, l_linenumber % 3 AS batch_id,
                   CASE WHEN l_linenumber = 5 THEN 2 WHEN l_linenumber < 5 THEN 1 ELSE 0 END AS n FROM bars
            UNION ALL SELECT 'unreadable', l_linenumber % 3, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END
            FROM lineitem)
        GROUP BY metric, batch_id""",
        "bars",
    ),
    "stream_process_status": ORACLES["doc_match_count"],
    "stream_process_embeddings": ORACLES["embed_documents"],
    "stream_probe_concepts": _with(
        f"""
        SELECT row_number() OVER (ORDER BY md5(keyword)) AS concept_id,
               arg_min(document_id, ROW(published_at, document_id)) AS source_document_id,
               CAST(NULL AS VARCHAR) AS associated_stock_code, keyword,
               count(*) AS appearance_count, '{_EARLY}' AS first_discovered_at,
               '{_EARLY}' AS last_seen_at, false AS approved
        FROM capitals WHERE document_id IN (SELECT document_id FROM hot) GROUP BY keyword""",
        "capitals", "hot",
    ),
    "stream_reviews": ORACLES["apply_reviews"],
}
