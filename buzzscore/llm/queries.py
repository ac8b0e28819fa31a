"""The registered queries of this package, and their SQL.

Each ``opN`` query applies one operator, with its production parameters, to a
whole table; what it returns beside the operator's columns is derived from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.llm import conversation_repair, decontaminate, filter_audit, jaccard_join, licenses, line_dedup, mixing, suffix_dedup, token_files, topk, toxicity, url_filter, warc
from buzzscore.llm.common import read_table, scratch

# --- parameters of the registered queries -------------------------------------
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}


def source_domain(source: Column) -> Column:
    """The domain of a source of the test tables, by the number in its name."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)", 1), F.lit(""))
    digit = F.when(number == "", 0).otherwise(F.substring(number, -1, 1).cast("int"))
    return F.when(digit < 5, "web").when(digit < 8, "books").otherwise("code")


# ------------------------------------------------------------------------------
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


OP1_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)
  WHERE trim(ls[i] || ls[i + 1] || ls[i + 2]) <> ''),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS rn FROM w)
  WHERE rn > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) AS v(k)),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
marked AS (
  SELECT lines.doc_id, lines.i, line, c.i IS NOT NULL AS gone
  FROM lines LEFT JOIN covered c ON lines.doc_id = c.doc_id AND lines.i = c.i),
runs AS (SELECT *, gone AND NOT lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY i) AS starts FROM marked),
done AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, done.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM documents d LEFT JOIN done USING (doc_id)
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar_texts(docs).select(
        F.col("id").alias("doc_id"), "class_id", "group_id", "n_copies", "n_texts", "n_links"
    )


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE c * 10 >= 8 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT l.a, r.other FROM reach r JOIN links l ON l.b = r.doc_id),
groups AS (SELECT doc_id, min(other) AS group_id FROM reach GROUP BY doc_id),
classes AS (
  SELECT d.doc_id, least(d.doc_id, min(l.b)) AS class_id, count(l.b) AS n_copies
  FROM documents d LEFT JOIN links l ON l.a = d.doc_id AND l.same GROUP BY d.doc_id),
counts AS (
  SELECT l.a AS doc_id, count(*) AS n_links, count(DISTINCT c.class_id) FILTER (WHERE NOT l.same) AS n_texts
  FROM links l JOIN classes c ON c.doc_id = l.b GROUP BY l.a)
SELECT c.doc_id, class_id, group_id, n_copies, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts,
       CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM classes c JOIN groups USING (doc_id) LEFT JOIN counts ON counts.doc_id = c.doc_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path).select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("refers_page")).cast("long").alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(pages, URL_RULES, model).drop("url")


def benchmark_index(spark: SparkSession, sf_dir: str) -> decontaminate.Benchmark:
    return decontaminate.build_index(read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, benchmark_index(spark, sf_dir))
    items = F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), items.alias("items"))


def _tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def _grams_sql(words: str, n: str) -> str:
    """The distinct runs of ``n`` words."""
    return f"list_distinct(list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' ')))"


_ANSWER = r"(?s)\A(.*[.!?\n])\s*(\S.*?)\s*\z"
OP6_SQL = f"""
WITH i0 AS (SELECT item_id, regexp_replace(coalesce(text, ''), '(?s)[.!?\\s]+\\z', '') AS t FROM benchmark),
i1 AS (SELECT *, regexp_extract(t, '{_ANSWER}', 1) AS first, regexp_extract(t, '{_ANSWER}', 2) AS last FROM i0),
item AS (
  SELECT item_id, {_tokens_sql("CASE WHEN last <> '' THEN first ELSE t END")} AS q, {_tokens_sql("last")} AS a FROM i1),
size AS (
  SELECT count(*) AS n, avg(len(q) + len(a)) AS avg_len, greatest(max(len(q) + len(a)), 3) AS stride
  FROM item WHERE len(q) + len(a) > 0),
tf AS (
  SELECT item_id, len, term, count(*) AS tf
  FROM (SELECT item_id, len(q) + len(a) AS len, unnest(list_concat(q, a)) AS term FROM item) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT item_id, term,
         ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS score
  FROM tf JOIN df USING (term), size),
impact AS (SELECT item_id, term, score / sum(score) OVER (PARTITION BY item_id) AS impact FROM scored),
doc AS (SELECT doc_id, {_tokens_sql("coalesce(text, '')")} AS w FROM documents),
passage AS (
  SELECT doc_id, b, w[b + 1:b + 2 * stride] AS w
  FROM (SELECT doc_id, w, stride, unnest(range(0, len(w), stride)) AS b FROM doc, size)),
found AS (
  SELECT doc_id, b, item_id
  FROM (SELECT DISTINCT doc_id, b, unnest(w) AS term FROM passage) JOIN impact USING (term)
  GROUP BY ALL HAVING sum(impact) >= 0.5 - 1e-9),
checked AS (
  SELECT DISTINCT doc_id, item_id
  FROM (SELECT f.*, p.w, q, a, least(3, len(q)) AS nq, least(3, len(a)) AS na
        FROM found f JOIN passage p USING (doc_id, b) JOIN item USING (item_id))
  WHERE (nq = 0 OR 2 * len(list_intersect({_grams_sql("q", "nq")}, {_grams_sql("w", "nq")})) >= len({_grams_sql("q", "nq")}))
    AND (na = 0 OR 2 * len(list_intersect({_grams_sql("a", "na")}, {_grams_sql("w", "na")})) >= len({_grams_sql("a", "na")})))
SELECT d.doc_id, count(item_id) > 0 AS contaminated,
       coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS items
FROM documents d LEFT JOIN checked USING (doc_id) GROUP BY d.doc_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_documents(docs).drop("text")


def mix_documents(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, source_domain(F.col("source")), DOMAIN_WEIGHTS, LANG_WEIGHTS)


def _share_sql(children: str, parent: str, names: str) -> str:
    """One level of the sharing: ``children`` has weight, capacity and budget."""
    order = f"PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {names}"
    return f"""
  SELECT * EXCLUDE (before, left_, used_up, rest, open_),
         CASE WHEN used_up THEN capacity ELSE CAST((CAST(weight AS HUGEINT) * rest) // open_ AS BIGINT) END AS granted
  FROM (SELECT *, budget - coalesce(sum(capacity) FILTER (WHERE used_up) OVER (PARTITION BY {parent}), 0) AS rest,
          sum(weight) FILTER (WHERE NOT used_up) OVER (PARTITION BY {parent}) AS open_
        FROM (SELECT *, CAST(capacity AS HUGEINT) * left_ <= CAST(weight AS HUGEINT) * (budget - before) AS used_up
              FROM (SELECT *,
                      coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                      sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
                    FROM ({children}))))"""


def _case_sql(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang_, coalesce(source, '(none)') AS source_, lang, source,
         len(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) AS tokens,
         CASE WHEN digit < 5 THEN 'web' WHEN digit < 8 THEN 'books' ELSE 'code' END AS domain
  FROM (SELECT *, coalesce(CAST(nullif(right(regexp_extract(source, '([0-9]+)', 1), 1), '') AS INTEGER), 0) AS digit
        FROM documents)),
leaves AS (
  SELECT domain, lang_, source_, sum(tokens) AS tokens, sum(tokens) * 2 AS capacity FROM d GROUP BY ALL),
by_lang AS (SELECT domain, lang_, sum(capacity) AS capacity FROM leaves GROUP BY ALL),
top AS ({_share_sql(f"SELECT 0 AS root, domain, sum(capacity) AS capacity, {_case_sql('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * 0.5) AS BIGINT) FROM d) AS budget FROM by_lang GROUP BY domain", "root", "domain")}),
mid AS ({_share_sql(f"SELECT by_lang.*, {_case_sql('lang_', LANG_WEIGHTS)} AS weight, top.granted AS budget FROM by_lang JOIN top USING (domain)", "domain", "lang_")}),
low AS ({_share_sql("SELECT leaves.*, 1 AS weight, mid.granted AS budget FROM leaves JOIN mid USING (domain, lang_)", "domain, lang_", "source_")}),
placed AS (
  SELECT d.*, low.granted // low.tokens AS full_, low.granted % low.tokens AS part,
         md5('7:' || CAST(low.granted // low.tokens AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS spot
  FROM d JOIN low USING (domain, lang_, source_) WHERE low.tokens > 0),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang_, source_ ORDER BY spot) AS upto FROM placed),
cuts AS (SELECT domain, lang_, source_, min(spot) AS cut FROM upto WHERE part > 0 AND upto > part GROUP BY ALL),
last AS (
  SELECT placed.*, CASE WHEN spot < cut THEN full_ ELSE full_ - 1 END AS last_
  FROM placed LEFT JOIN cuts USING (domain, lang_, source_))
SELECT doc_id, lang, source, domain, CAST(tokens AS BIGINT) AS tokens, CAST(unnest(range(0, CAST(last_ AS BIGINT) + 1)) AS BIGINT) AS epoch
FROM last WHERE last_ >= 0
"""


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by checksum; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, sf_dir)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_substrings(docs).select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# hex of a kept run, without the rest of a character at either end
_WHOLE = (
    "regexp_replace(regexp_replace(p, '^([89AB][0-9A-F])+', ''), "
    "'([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '')"
)
OP10_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (  -- 800 bytes from each 400th, for the 400 windows that start there
  SELECT doc_id, n, j, substr(h, 800 * j + 1, 1600) AS h
  FROM (SELECT doc_id, n, h, unnest(range(0, (n - 400) // 400 + 1)) AS j FROM d WHERE n >= 400)),
w AS (
  SELECT doc_id, 400 * j + k AS s, md5(substr(h, 2 * k + 1, 800)) AS m
  FROM (SELECT doc_id, h, j, unnest(range(0, least(400, n - 399 - 400 * j))) AS k FROM b)),
f AS (SELECT doc_id, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM f),
r AS (SELECT *, sum(CASE WHEN s <= prev + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS b FROM r GROUP BY ALL),
pieces AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop,
         string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS k,
         string_agg({whole}, '' ORDER BY a) AS t
  FROM (SELECT pieces.*, d.h, substr(d.h, 2 * c + 1, 2 * (a - c)) AS p FROM pieces JOIN d USING (doc_id)) GROUP BY doc_id),
tail AS (SELECT d.doc_id, substr(h, 2 * coalesce(stop, 0) + 1) AS p FROM d LEFT JOIN kept USING (doc_id)),
text AS (SELECT doc_id, {whole} AS t FROM tail)
SELECT d.doc_id, decode(unhex(coalesce(kept.t, '') || text.t)) AS text, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) JOIN text ON text.doc_id = d.doc_id
""".replace("{whole}", _WHOLE)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    return filter_audit.audit(spark, path, read_table(spark, sf_dir, "labels")).drop("filter")


OP11_SQL = """
WITH RECURSIVE w AS (
  SELECT *, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT coalesce(lang, '') AS part, coalesce(good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) > 3 * length(coalesce(text, '')) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(coalesce(text, ''), '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY coalesce(text, '')) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE len(o) < 5 AND NOT contains(o, x)),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE len(o) = 5),
counts AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
t AS (
  SELECT *, contains(fails, substr(o, step, 1)) AS here, regexp_matches(fails, '[' || substr(o, 1, step - 1) || '_]') AS gone
  FROM counts, steps),
s AS (
  SELECT part, o AS filter_order, step, substr(o, step, 1) AS x,
         coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = substr(o, step, 1)), 0) AS unique_fails,
         coalesce(sum(n) FILTER (WHERE here AND NOT gone AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (WHERE here AND NOT gone AND toxic), 0) AS toxic_lost
  FROM t GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


# The forward search: a row per conversation, place and state, with its cheapest way; edits are compared as text.
OP12_SQL = """
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
b AS (  -- CRC-32 a bit at a time: each byte is followed by eight shifts
  SELECT *, flatten(list_transform(range(1, len(key) + 1), lambda i: [ord(substr(key, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])) AS bits
  FROM k),
c AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bits),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END),
             CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM b),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \\t-\\r]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ \\t-\\r]*$') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
steps(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
names(r, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
ins(q, q2, cost, edits, lines) AS (  -- none, one or two insertions
  SELECT unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), 0, '', CAST([] AS VARCHAR[])
  UNION ALL SELECT ins.q, s.q2, cost + 2, edits || 'I', list_append(lines, name || ':')
  FROM ins JOIN steps s ON s.q = ins.q2 JOIN names USING (r) WHERE len(edits) < 2),
way AS (
  SELECT conv_id, 0 AS i, 0 AS q, 0 AS cost, '' AS edits, CAST([] AS VARCHAR[]) AS lines FROM totals
  UNION ALL
  SELECT conv_id, i, q, w.cost, w.edits, w.lines FROM (
    SELECT conv_id, i, q, min(struct_pack(cost := cost, edits := edits, lines := lines)) AS w FROM (
      SELECT w.conv_id, f.i, e.q2 AS q, w.cost + ins.cost + e.cost + CASE WHEN e.edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
             w.edits || ins.edits || e.edit AS edits,
             list_concat(list_concat(w.lines, ins.lines), CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[])
               WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.name || ':' || f.text] END) AS lines
      FROM way w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.q = w.q
      JOIN (SELECT q, q2, r, 'K' AS edit, 0 AS cost, NULL AS name FROM steps
            UNION ALL SELECT q, q2, NULL, 'R', 2, name FROM steps JOIN names USING (r)
            UNION ALL SELECT unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), NULL, 'D', 3, NULL) e
        ON e.q = ins.q2 AND (e.edit <> 'K' OR e.r = f.r) AND (e.edit = 'D' OR fault NOT IN ('blank', 'duplicate')))
    GROUP BY conv_id, i, q)),
done AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost + ins.cost, edits := w.edits || ins.edits, lines := list_concat(w.lines, ins.lines))) AS w
  FROM way w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN ins ON ins.q = w.q
  WHERE ins.q2 IN (0, 3) GROUP BY w.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
       coalesce(w.edits, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_topk": op9_topk,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_files": op13_token_files,
}
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op9_topk": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
