"""DuckDB SQL equivalents of the registered queries (the correctness check).

Each query is written independently in plain SQL over the supplied tables
(``documents``, ``events`` ...).  Doubles are rounded to 6 places on both
sides, because Spark sums in partition order.
"""

from __future__ import annotations

from buzzscore.functions.text import TOKEN_PATTERN, WS, spark_stop_words

ROUND = 6


def rnd(x: str) -> str:
    """Round a double to 6 places; ``+ 0.0`` turns -0.0 into 0.0."""
    return f"(round({x}, {ROUND}) + 0.0::DOUBLE)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def raw_posts_sql(day_grain: bool = True) -> str:
    when = (
        "strftime(e.ts, '%Y-%m-%d') || ' 00:00:00'"
        if day_grain
        else "strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f')"
    )
    return f"""
    SELECT d.doc_id AS post_id,
           '  User_' || CAST(e.user_id AS VARCHAR) || ' ' AS username,
           CASE WHEN d.doc_id % 97 = 13 THEN 'not a date' ELSE {when} END AS timestamp,
           '  ' || d.text || ' ' AS content,
           CAST(floor(e.value) AS BIGINT) AS retweets,
           CAST(d.n_chars % 500 AS BIGINT) AS likes,
           CAST(d.doc_id % 17 AS BIGINT) AS replies,
           CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE ' @' || d.lang END AS mentions,
           '#' || e.event_type AS hashtags
    FROM documents d JOIN events e ON d.doc_id = e.event_id"""


def clean_ctes(day_grain: bool = True) -> str:
    """``raw``, ``normed`` (all rows), ``clean`` (valid + deduplicated)."""
    content = _strip(
        f"translate(regexp_replace(nfc_normalize({_strip('content')}), '{WS}+', ' ', 'g'), "
        "chr(8205) || chr(8204) || chr(65279), '')"
    )
    return f"""
    raw AS ({raw_posts_sql(day_grain)}),
    normed AS (
      SELECT post_id,
             lower({_strip('username')}) AS username,
             TRY_CAST(timestamp AS TIMESTAMP) AS timestamp,
             {content} AS content,
             retweets, likes, replies,
             {_strip("coalesce(mentions, '')")} AS mentions,
             {_strip("coalesce(hashtags, '')")} AS hashtags
      FROM raw),
    deduped AS (
      SELECT * FROM normed WHERE timestamp IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY content, timestamp ORDER BY post_id) = 1),
    clean AS (
      SELECT *, CAST(length(content) AS INTEGER) AS content_length,
             retweets + likes + replies AS total_engagement
      FROM deduped)"""


CLEAN_STATS = f"""
WITH {clean_ctes()}
SELECT (SELECT count(*) FROM raw) AS initial_count,
       (SELECT count(*) FROM normed WHERE timestamp IS NOT NULL) AS after_cleaning,
       count(*) AS final_count,
       (SELECT count(*) FROM normed WHERE timestamp IS NOT NULL) - count(*) AS duplicates_removed,
       {rnd('avg(content_length)')} AS avg_content_length,
       {rnd('avg(total_engagement)')} AS avg_engagement,
       count(DISTINCT username) AS unique_users,
       strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS earliest,
       strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS latest
FROM clean
"""

CLEAN_POSTS = f"""
WITH {clean_ctes()}
SELECT post_id, username, timestamp, content, retweets, likes, replies,
       mentions, hashtags, content_length, total_engagement
FROM clean
"""

DEDUP_POSTS = f"""
WITH {clean_ctes()}
SELECT post_id, timestamp, content FROM deduped
"""

NEWEST_POSTS = f"""
WITH {clean_ctes()}
SELECT username, timestamp, content, total_engagement
FROM clean ORDER BY timestamp DESC, post_id LIMIT 5
"""


def stop_words_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in spark_stop_words()) + "]"


__all__ = ["CLEAN_STATS", "CLEAN_POSTS", "DEDUP_POSTS", "NEWEST_POSTS", "TOKEN_PATTERN"]


CONFORM_DEFAULTS = """
SELECT doc_id AS post_id,
       coalesce(lang, '') AS username,
       '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS timestamp,
       coalesce(text, '') AS content,
       CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS BIGINT) AS retweets,
       CAST(0 AS BIGINT) AS likes,
       CAST(0 AS BIGINT) AS replies,
       '' AS mentions,
       '' AS hashtags,
       'HOLD' AS trading_signal
FROM documents
"""


def collect_recent_sql(since: str) -> str:
    return f"""
SELECT event_type AS tag, ts AS date, 'user_' || CAST(user_id AS VARCHAR) AS "user",
       props AS content
FROM events
WHERE ts >= TIMESTAMP '{since}' AND event_type IN ('click', 'purchase', 'signup', 'view')
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 501
"""


COLLECT_RECENT = collect_recent_sql("2024-01-01 00:00:00")
COLLECT_RECENT_WINDOW = collect_recent_sql("2024-01-28 00:00:00")


def engagement_ctes() -> str:
    return f"""{clean_ctes()},
    est AS (
      SELECT avg(retweets) AS mr, stddev_pop(retweets) AS sr,
             avg(likes) AS ml, stddev_pop(likes) AS sl,
             avg(replies) AS mp, stddev_pop(replies) AS sp,
             min(0.4::DOUBLE * retweets + 0.3::DOUBLE * likes + 0.3::DOUBLE * replies) AS vmin,
             max(0.4::DOUBLE * retweets + 0.3::DOUBLE * likes + 0.3::DOUBLE * replies) AS vmax
      FROM clean),
    eng AS (
      SELECT c.*,
             ((retweets - mr) / CASE WHEN coalesce(sr, 0) = 0 THEN 1 ELSE sr END
              + (likes - ml) / CASE WHEN coalesce(sl, 0) = 0 THEN 1 ELSE sl END
              + (replies - mp) / CASE WHEN coalesce(sp, 0) = 0 THEN 1 ELSE sp END) / 3.0::DOUBLE
               AS engagement_signal,
             0.4::DOUBLE * retweets + 0.3::DOUBLE * likes + 0.3::DOUBLE * replies AS viral_score,
             CASE WHEN vmax = vmin THEN 0.5::DOUBLE
                  ELSE (0.4::DOUBLE * retweets + 0.3::DOUBLE * likes + 0.3::DOUBLE * replies - vmin)
                       / (vmax - vmin) END AS viral_score_norm
      FROM clean c, est)"""


ENGAGEMENT_SIGNAL = f"""
WITH {engagement_ctes()}
SELECT post_id, {rnd('engagement_signal')} AS engagement_signal FROM eng
"""

VIRAL_NORM = f"""
WITH {engagement_ctes()}
SELECT post_id, {rnd('viral_score')} AS viral_score,
       {rnd('viral_score_norm')} AS viral_score_norm
FROM eng
"""


def text_ctes() -> str:
    """Tokens, terms, per-document counts, vocabulary and weights over documents."""
    return f"""
    docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    ndocs AS (SELECT count(*) AS n FROM docs),
    toks AS (
      SELECT doc_id,
             list_filter(regexp_extract_all(strip_accents(lower(text)), '{TOKEN_PATTERN}'),
                         lambda t: NOT list_contains({stop_words_sql()}, t)) AS t
      FROM docs),
    terms AS (
      SELECT doc_id,
             unnest(t || CASE WHEN len(t) > 1
                              THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                              ELSE [] END) AS term
      FROM toks),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
    dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
    top_terms AS (
      SELECT term, df, cf FROM dfs, ndocs
      WHERE df >= 3 AND df <= 0.85::DOUBLE * ndocs.n
      ORDER BY cf DESC, term LIMIT 1000),
    vocab AS (
      SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id,
             CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf,
             ln((1 + ndocs.n) / (1 + df)) + 1 AS idf
      FROM top_terms, ndocs),
    weighted AS (
      SELECT tf.doc_id, v.term, v.term_id, tf.tf * v.idf AS w
      FROM tf JOIN vocab v ON tf.term = v.term),
    normed AS (
      SELECT doc_id, term, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x
      FROM weighted)"""


VOCABULARY = f"""
WITH {text_ctes()}
SELECT term, term_id, df, cf FROM vocab
"""

IDF_TABLE = f"""
WITH {text_ctes()}
SELECT term, {rnd('idf')} AS idf FROM vocab
"""

TFIDF_WEIGHTS = f"""
WITH {text_ctes()}
SELECT doc_id, term, {rnd('x')} AS weight FROM normed
"""

TFIDF_GRAM = f"""
WITH {text_ctes()}
SELECT a.term_id AS term_id_i, b.term_id AS term_id_j, {rnd('sum(a.x * b.x)')} AS gram
FROM normed a JOIN normed b ON a.doc_id = b.doc_id AND a.term_id <= b.term_id
GROUP BY a.term_id, b.term_id
"""


FEATURE_FIXTURE = (
    (7, 1, 0, 0.3),
    (11, 3, 1, 0.8),
    (13, 0, 5, 0.1),
    (17, 7, 0, 0.6),
    (19, 1, 3, 0.5),
    (23, 9, 0, 0.2),
    (29, 0, 1, 0.7),
    (31, 5, 2, 0.4),
)


def scored_ctes(day_grain: bool = True) -> str:
    feats = ",\n".join(
        f"CAST((e.post_id * {a} + d.n_chars * {b} + length(d.source) * {c}) % 100 AS DOUBLE)"
        f" * {scale}::DOUBLE AS text_feature_{i}"
        for i, (a, b, c, scale) in enumerate(FEATURE_FIXTURE, start=1)
    )
    names = ", ".join(f"text_feature_{i}" for i in range(1, len(FEATURE_FIXTURE) + 1))
    eng = engagement_ctes().replace(clean_ctes(), clean_ctes(day_grain))
    return f"""{eng},
    feat AS (SELECT e.*, {feats} FROM eng e JOIN documents d ON e.post_id = d.doc_id),
    flong AS (UNPIVOT (SELECT post_id, {names} FROM feat) ON {names}
              INTO NAME feature VALUE value),
    fvar AS (SELECT feature, var_samp(value) AS variance FROM flong GROUP BY feature),
    franked AS (
      SELECT feature, variance,
             CAST(row_number() OVER (ORDER BY variance DESC NULLS LAST,
                  CAST(regexp_extract(feature, '([0-9]+)$', 1) AS INTEGER)) AS INTEGER) AS rank
      FROM fvar),
    txt AS (
      SELECT post_id, avg(value) AS text_component
      FROM flong JOIN franked USING (feature) WHERE rank <= 5 GROUP BY post_id),
    comp0 AS (SELECT f.*, t.text_component FROM feat f JOIN txt t USING (post_id)),
    cst AS (
      SELECT avg(text_component) AS tm, stddev_samp(text_component) AS tsd,
             avg(engagement_signal) AS em, stddev_samp(engagement_signal) AS esd,
             avg(viral_score_norm) AS vm, stddev_samp(viral_score_norm) AS vsd
      FROM comp0),
    comp AS (
      SELECT c.*,
             0.5::DOUBLE * CASE WHEN tsd > 0 THEN (text_component - tm) / tsd ELSE 0.0 END
             + 0.3::DOUBLE * CASE WHEN esd > 0 THEN (engagement_signal - em) / esd ELSE 0.0 END
             + 0.2::DOUBLE * CASE WHEN vsd > 0 THEN (viral_score_norm - vm) / vsd ELSE 0.0 END
               AS composite_signal
      FROM comp0 c, cst),
    sst AS (SELECT avg(composite_signal) AS sm, stddev_samp(composite_signal) AS ssd FROM comp),
    conf AS (
      SELECT c.*,
             CASE WHEN ssd > 0
                  THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
                         1.0::DOUBLE - abs(composite_signal - sm) / (3.0::DOUBLE * ssd)))
                  ELSE 1.0::DOUBLE END AS signal_confidence
      FROM comp c, sst),
    scored AS (
      SELECT *,
             CASE WHEN composite_signal > 0.5 AND signal_confidence > 0.7 THEN 'STRONG_BUY'
                  WHEN composite_signal > 0.2 AND signal_confidence > 0.6 THEN 'BUY'
                  WHEN composite_signal < -0.5 AND signal_confidence > 0.7 THEN 'STRONG_SELL'
                  WHEN composite_signal < -0.2 AND signal_confidence > 0.6 THEN 'SELL'
                  ELSE 'HOLD' END AS trading_signal
      FROM conf)"""


TOP_FEATURES = f"""
WITH {scored_ctes()}
SELECT feature, {rnd('variance')} AS variance, rank FROM franked WHERE rank <= 5
"""

COMPOSITE_SCORES = f"""
WITH {scored_ctes()}
SELECT post_id, {rnd('text_component')} AS text_component,
       {rnd('composite_signal')} AS composite_signal,
       {rnd('signal_confidence')} AS signal_confidence
FROM scored
"""

SIGNALS = f"""
WITH {scored_ctes()}
SELECT username, timestamp, content, retweets, likes, replies,
       {rnd('composite_signal')} AS composite_signal,
       {rnd('signal_confidence')} AS signal_confidence, trading_signal
FROM scored
"""

SIGNAL_DISTRIBUTION = f"""
WITH {scored_ctes()}
SELECT trading_signal, count(*) AS count,
       {rnd('100.0::DOUBLE * count(*) / (SELECT count(*) FROM scored)')} AS percent
FROM scored GROUP BY trading_signal
"""

SUMMARY_REPORT = f"""
WITH {scored_ctes()}
SELECT count(*) AS total_posts, min(timestamp) AS earliest, max(timestamp) AS latest,
       count(DISTINCT username) AS unique_users,
       {rnd('avg(composite_signal)')} AS composite_mean,
       {rnd('stddev_samp(composite_signal)')} AS composite_std,
       {rnd('min(composite_signal)')} AS composite_min,
       {rnd('max(composite_signal)')} AS composite_max,
       {rnd('1.96::DOUBLE * stddev_samp(composite_signal) / sqrt(count(*))')} AS margin_of_error,
       {rnd('avg(signal_confidence)')} AS avg_confidence,
       count(*) FILTER (WHERE signal_confidence > 0.7) AS high_confidence,
       {rnd('100.0::DOUBLE * count(*) FILTER (WHERE signal_confidence > 0.7) / count(*)')}
         AS high_confidence_pct
FROM scored
"""

HOURLY_TREND = f"""
WITH {scored_ctes(day_grain=False)}
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket_start,
       time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS bucket_end,
       count(*) AS posts,
       {rnd('avg(composite_signal)')} AS mean_signal,
       {rnd('min(composite_signal)')} AS min_signal,
       {rnd('max(composite_signal)')} AS max_signal
FROM scored GROUP BY 1, 2
"""

SIGNAL_HISTOGRAM = f"""
WITH {scored_ctes()},
    hst AS (SELECT min(composite_signal) AS lo, max(composite_signal) AS hi FROM scored),
    hb AS (SELECT CASE WHEN hi = lo THEN lo - 0.5::DOUBLE ELSE lo END AS start,
                  (CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END) / 30.0::DOUBLE AS width
           FROM hst),
    binned AS (
      SELECT least(greatest(CAST(floor((composite_signal - start) / width) AS INTEGER) + 1, 1), 30)
               AS bin, start, width
      FROM scored, hb WHERE composite_signal IS NOT NULL)
SELECT bin, {rnd('start + (bin - 1) * width')} AS bin_lower, {rnd('start + bin * width')} AS bin_upper,
       count(*) AS count
FROM binned GROUP BY bin, start, width
"""

SAMPLE_ORDER = "md5('42' || '|' || CAST(post_id AS VARCHAR)), post_id"

SCATTER_SAMPLE = f"""
WITH {scored_ctes(day_grain=False)},
    samp AS (SELECT * FROM scored ORDER BY {SAMPLE_ORDER} LIMIT 1000)
SELECT post_id, timestamp, {rnd('composite_signal')} AS composite_signal,
       {rnd('signal_confidence')} AS signal_confidence, {rnd('viral_score_norm')} AS viral_score_norm
FROM samp
"""

PIE_SAMPLE = f"""
WITH {scored_ctes(day_grain=False)},
    samp AS (SELECT * FROM scored ORDER BY {SAMPLE_ORDER} LIMIT 1000)
SELECT trading_signal, count(*) AS count,
       {rnd('round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM samp), 1)')} AS percent
FROM samp GROUP BY trading_signal
"""


CSV_WITHOUT_ID = f"""
WITH {clean_ctes()}
SELECT timestamp, content, content_length FROM clean
"""

CSV_COLLECTOR = f"""
WITH {clean_ctes()}
SELECT username, timestamp, content, 0.0::DOUBLE AS retweets, '' AS hashtags FROM normed
"""

CSV_FLOAT_METRICS = f"""
WITH raw AS ({raw_posts_sql()})
SELECT post_id, retweets + 0.5::DOUBLE AS retweets, CAST(likes AS DOUBLE) AS likes,
       CAST(replies AS DOUBLE) AS replies
FROM raw
"""


def _nan_clean(value: str) -> str:
    """The cleaned posts with ``value`` as the retweets of every seventh post."""
    return f"""{clean_ctes().replace("clean AS (", "clean0 AS (")},
    clean AS (
      SELECT * REPLACE (CASE WHEN post_id % 7 = 3 THEN {value} ELSE CAST(retweets AS DOUBLE) END AS retweets)
      FROM clean0)"""


def _engagement_nan(value: str) -> str:
    ctes = engagement_ctes().replace(clean_ctes(), _nan_clean(value))
    return f"""
WITH {ctes}
SELECT post_id, {rnd('engagement_signal')} AS engagement_signal, {rnd('viral_score')} AS viral_score FROM eng
"""


ENGAGEMENT_NAN = _engagement_nan("0.0::DOUBLE")
ENGAGEMENT_NAN_STRICT = _engagement_nan("NULL")

SVD_ISOMETRY = f"""
WITH {text_ctes().replace("LIMIT 1000", "LIMIT 20")},
dots AS (
  SELECT a.doc_id, a.doc_id = b.doc_id AS own, sum(a.x * b.x) AS d
  FROM normed a JOIN normed b ON a.term_id = b.term_id AND b.doc_id IN (a.doc_id, a.doc_id - 1)
  GROUP BY ALL)
SELECT docs.doc_id, {rnd("coalesce(max(d) FILTER (WHERE own), 0)")} AS norm2,
       {rnd("coalesce(max(d) FILTER (WHERE NOT own), 0)")} AS with_previous
FROM docs LEFT JOIN dots USING (doc_id) GROUP BY docs.doc_id
"""

SVD_RANDOMIZED = f"""
WITH {text_ctes().replace("LIMIT 1000", "LIMIT 20000")},
posts AS (SELECT sum(x * x) AS total FROM normed),
k AS (SELECT unnest(range(0, 20)) AS k)
SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j,
       CASE WHEN a.k = b.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS orthonormal,
       CASE WHEN a.k = b.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS uncorrelated,
       {rnd('total')} AS total, TRUE AS captured
FROM k a JOIN k b ON a.k <= b.k, posts
"""


# --- types, losses, a model fitted on a sample -----------------------------------------

_POST_TEXTS = ("post_id", "username", "timestamp", "retweets", "likes", "replies", "mentions", "hashtags")

INFERRED_TYPES = f"""
WITH raw AS ({raw_posts_sql()}),
ev AS (
  SELECT event_id AS post_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
         CASE WHEN event_id % 2 = 0 THEN CAST(CAST(value AS DECIMAL(20, 2)) AS VARCHAR) END AS retweets,
         strftime(ts, '%Y-%m-%d') AS day, CAST(event_type = 'purchase' AS VARCHAR) AS paid, user_id AS hashtags
  FROM events),
vals AS (
  SELECT unnest({list(_POST_TEXTS)}) AS col, unnest([{", ".join(f"CAST({c} AS VARCHAR)" for c in _POST_TEXTS)}]) AS v FROM raw
  UNION ALL
  SELECT unnest(['post_id', 'timestamp', 'retweets', 'day', 'paid', 'hashtags']),
         unnest([CAST(post_id AS VARCHAR), timestamp, retweets, day, paid, CAST(hashtags AS VARCHAR)]) FROM ev),
kinds AS (
  SELECT col, trim(v) AS v,
         CASE WHEN v IS NULL THEN NULL
              WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN 'b long'
              WHEN regexp_full_match(trim(v), '[+-]?[0-9]+[.][0-9]+') THEN 'c double'
              WHEN lower(trim(v)) IN ('true', 'false') THEN 'a boolean'
              WHEN TRY_CAST(trim(v) AS DATE) IS NOT NULL AND length(trim(v)) = 10 THEN 'd date'
              WHEN TRY_CAST(trim(v) AS TIMESTAMP) IS NOT NULL THEN 'e timestamp'
              ELSE 'f string' END AS kind
  FROM vals),
acc AS (SELECT col, kind, count(*) AS n, min(left(v, 40)) AS example FROM kinds GROUP BY ALL),
per AS (
  SELECT col, sum(n) AS n, coalesce(sum(n) FILTER (kind IS NULL), 0) AS nulls,
         list(kind ORDER BY kind) FILTER (kind IS NOT NULL) AS k,
         list(substr(kind, 3) || ' x ' || n || ' (' || example || ')' ORDER BY kind) FILTER (kind IS NOT NULL) AS why
  FROM acc GROUP BY col)
SELECT col AS "column",
       CASE WHEN k IS NULL THEN 'string' WHEN len(k) = 1 THEN substr(k[1], 3)
            WHEN k = ['b long', 'c double'] THEN 'double' WHEN k = ['d date', 'e timestamp'] THEN 'timestamp'
            ELSE 'string' END AS type,
       CAST(n AS BIGINT) AS rows, CAST(nulls AS BIGINT) AS nulls,
       CASE WHEN len(k) > 1 THEN array_to_string(why[2:], ', ') END AS widened_by
FROM per
"""

CAST_LOSSES = """
WITH t AS (
  SELECT doc_id % 11 = 0 AS word, 'id' || doc_id AS word_text,
         doc_id % 3 = 0 AND n_chars IS NOT NULL AS part, n_chars || '.5' AS part_text, n_chars,
         coalesce(n_chars > 1000, false) AS large, doc_id
  FROM documents)
SELECT 'post_id' AS "column", count(doc_id) AS present, count(*) FILTER (word) AS lost, min(word_text) FILTER (word) AS example FROM t
UNION ALL SELECT 'timestamp', count(*), 0, NULL FROM t
UNION ALL SELECT 'retweets', count(n_chars), count(*) FILTER (part), min(part_text) FILTER (part) FROM t
UNION ALL SELECT 'likes', count(*) FILTER (large OR doc_id % 2 = 0), count(*) FILTER (large),
                 CASE WHEN count(*) FILTER (large) > 0 THEN '99999999999999999999' END FROM t
UNION ALL SELECT 'replies', count(*), 0, NULL FROM t
"""

VOCABULARY_ON_SAMPLE = f"""
WITH half AS (
  SELECT doc_id FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id
  LIMIT (SELECT count(*) // 2 FROM documents)),
{text_ctes()
    .replace("ndocs AS (SELECT count(*) AS n FROM docs)", "ndocs AS (SELECT count(*) AS n FROM half)")
    .replace("FROM tf GROUP BY term)", "FROM tf WHERE doc_id IN (SELECT doc_id FROM half) GROUP BY term)")}
SELECT d.doc_id, CAST(count(x) AS INTEGER) AS n_terms, {rnd('coalesce(sum(x), 0)')} AS weight
FROM docs d LEFT JOIN normed ON d.doc_id = normed.doc_id GROUP BY d.doc_id
"""

# --- metrics and tags out of JSON ------------------------------------------------------

_PROPS = """
made AS (
  SELECT event_id, regexp_extract(props, '[0-9]+') AS num, CASE event_id % 7
    WHEN 0 THEN props
    WHEN 1 THEN '{"k": "' || num || '", "tags": ["a", "' || event_type || '"]}'
    WHEN 2 THEN '{"m": {"likes": ' || num || '}, "score": ' || num || '.5}'
    WHEN 3 THEN '{"k": "n/a", "m": {"likes": "' || event_type || '"}, "score": "x", "tags": []}'
    WHEN 4 THEN '{"k": ' || num
    WHEN 5 THEN '{"k": null, "m": null, "score": 7}' END AS props
  FROM events),
parsed AS (
  SELECT event_id, props IS NOT NULL AND NOT json_valid(props) AS malformed,
    CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS v FROM made),
taken AS (
  SELECT event_id, malformed, v,
    try_cast(v ->> '$.k' AS BIGINT) AS k, try_cast(v ->> '$.m.likes' AS BIGINT) AS likes, try_cast(v ->> '$.score' AS DOUBLE) AS score,
    CASE WHEN json_type(v, '$.tags') = 'ARRAY' THEN array_to_string(CAST(v -> '$.tags' AS VARCHAR[]), ',') END AS tags
  FROM parsed),
marked AS (
  SELECT *, v ->> '$.k' IS NOT NULL AND k IS NULL AS bad_k, v ->> '$.m.likes' IS NOT NULL AND likes IS NULL AS bad_likes,
    v ->> '$.score' IS NOT NULL AND score IS NULL AS bad_score, v ->> '$.tags' IS NOT NULL AND tags IS NULL AS bad_tags
  FROM taken)"""

PROPS_SHREDDED = f"""
WITH {_PROPS}
SELECT event_id, k, likes, score, tags, malformed,
  concat_ws(',', CASE WHEN bad_k THEN 'k' END, CASE WHEN bad_likes THEN 'likes' END,
    CASE WHEN bad_score THEN 'score' END, CASE WHEN bad_tags THEN 'tags' END) AS misfits
FROM marked
"""

PROPS_ACCOUNT = f"WITH {_PROPS}" + " UNION ALL ".join(
    f"""
SELECT '{c}' AS field, count(*) AS n_rows, count(*) FILTER (malformed) AS n_malformed,
  count({c}) AS n_fit, count(*) FILTER (bad_{c}) AS n_misfit FROM marked"""
    for c in ("k", "likes", "score", "tags")
)

PROPS_KINDS = f"""
WITH {_PROPS},
keys AS (SELECT v, unnest(json_keys(v)) AS key FROM parsed WHERE json_type(v) = 'OBJECT')
SELECT key, CASE json_type(v, '$.' || key) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'text'
    WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, count(*) AS n
FROM keys GROUP BY ALL
"""

# --- time ------------------------------------------------------------------------------

_SESSIONS = """
marked AS (
  SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER u <= 21600000000 THEN 0 ELSE 1 END AS new
  FROM events WHERE ts IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (
  SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
  FROM numbered GROUP BY user_id, session)"""

_POST_TIMES = """
posts AS (
  SELECT e.event_id AS post_id, e.user_id, CAST(date_trunc('minute', e.ts) AS TIMESTAMP) AS posted
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""

SESSIONS = f"""
WITH {_SESSIONS}
SELECT user_id, session_start, session_end, n_events FROM sessions
"""

ASOF_EVENT = f"""
WITH {_POST_TIMES},
last_of AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT p.post_id, p.user_id, p.posted, e.event_id, e.ts, e.event_type
FROM posts p ASOF LEFT JOIN last_of e ON p.user_id = e.user_id AND p.posted > e.ts
"""

POSTS_IN_SESSIONS = f"""
WITH {_SESSIONS}, {_POST_TIMES}
SELECT p.post_id, p.user_id, p.posted, s.session_start, s.session_end, s.n_events
FROM posts p JOIN sessions s ON p.user_id = s.user_id AND p.posted BETWEEN s.session_start AND s.session_end
"""

SIGNAL_CUBE = f"""
WITH {scored_ctes(day_grain=False)},
cells AS (
  SELECT CAST(timestamp AS DATE) AS day, trading_signal AS label, hashtags AS tag FROM scored),
cubed AS (
  SELECT day, label, tag, grouping(day, label, tag) AS level, count(*) AS posts
  FROM cells GROUP BY CUBE (day, label, tag))
SELECT day, label, tag, level, posts,
       {rnd("100.0::DOUBLE * posts / max(posts) FILTER (level & 2 = 2) OVER (PARTITION BY day, tag, level & 5)")} AS percent
FROM cubed
"""

WEEK_SKETCHES = """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL)
SELECT CAST(d.day - 6 AS DATE) AS first_day, d.day AS last_day, count(*) AS posts, count(DISTINCT e.user_id) AS users,
       TRUE AS users_within, TRUE AS median_within
FROM days d JOIN events e ON CAST(e.ts AS DATE) BETWEEN d.day - 6 AND d.day
GROUP BY d.day
"""
