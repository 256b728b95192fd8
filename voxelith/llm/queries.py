"""The dealt operators as registered queries over the given tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm import basic_factor_runs, blob_ledger, deleted_interpolation, dictionary_resampling, fast_sketch_dedup, line_frequency, page_differencing, perspective_rotation, token_blocks, url_markov, window_packing, winnowing, word_backoff_language
from voxelith.llm.text import id_crc, read_table
from voxelith.plans.registry import Query
from voxelith.session import cut_lineage

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_deleted_interpolation")
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a trigram model; a seventh is never learned from."""
    docs = read_table(spark, sf_dir, "documents")
    remainder = F.pmod(id_crc(), F.lit(7))
    return deleted_interpolation.score(docs, train=remainder != 2, deleted=remainder == 3, order=3).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


LINE_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
    SELECT doc_id, source, raw, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS lw,
           CASE WHEN letters <> '' THEN letters ELSE trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) END AS norm
    FROM (SELECT *, trim(regexp_replace(lower(raw), '[^\p{{L}}]+', ' ', 'g')) AS letters FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM d))),
common AS (
    SELECT source, norm FROM lines WHERE norm <> ''
    GROUP BY source, norm HAVING count(DISTINCT doc_id) > {line_frequency.LIMIT}),
removed AS (
    SELECT doc_id, sum(lw) AS removed FROM lines JOIN common ON lines.norm = common.norm AND lines.source IS NOT DISTINCT FROM common.source GROUP BY doc_id),
dup AS (
    SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines WHERE lw > 0 GROUP BY doc_id),
grams AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
base AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - removed_words >= {line_frequency.LEAST_WORDS} AND n_words - removed_words >= n_words * CAST({line_frequency.LEAST_SHARE} AS DOUBLE) AS kept
FROM judged
"""


@query("op2_line_frequency", LINE_SQL)
def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and repetition rules of all documents, with boilerplate lines of each source counted."""
    return line_frequency.judge(read_table(spark, sf_dir, "documents"))


@query("op3_token_blocks")
def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in patched frame-of-reference blocks and read back."""
    shards = token_blocks.write_shards(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_blocks.read_documents(shards)


@query("op4_fast_sketch_dedup")
def op4_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents, on 2-word shingles."""
    return fast_sketch_dedup.near_copies(read_table(spark, sf_dir, "documents"), shingle_words=2)


@query("op5_window_packing")
def op5_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return window_packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1)


def _ledger_sql() -> str:
    """Base and further spans from the pieces between matches, as in the query, for DuckDB."""
    parts = []
    for rank, rule in enumerate(blob_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
                   before + sum(gap_length) OVER w + coalesce(sum(hit_length) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                   hit_length, part_length, nth
            FROM (SELECT doc_id, 0 AS before, unnest(range(1, len(hits) + 1)) AS nth,
                         unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap_length,
                         unnest(list_transform(hits, lambda x: length(x))) AS hit_length,
                         unnest(list_transform(parts, lambda x: length(x))) AS part_length
                  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits,
                               regexp_extract_all(t, '{pattern}', {rule.group}) AS parts,
                               regexp_split_to_array(t, '{pattern}') AS gaps
                        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{pattern}')))
            WINDOW w AS (PARTITION BY doc_id ORDER BY nth)
            QUALIFY part_length >= {rule.least}""")
    return f"""
        WITH spans AS ({" UNION ALL ".join(parts)}),
        named AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + hit_length AS BIGINT) AS name FROM spans),
        grouped AS (
            SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
                   count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                   string_agg(name, ',' ORDER BY start, rank) FILTER (WHERE base) AS base_spans,
                   string_agg(name, ',' ORDER BY start, rank) AS spans
            FROM named GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN grouped g ON d.doc_id = g.doc_id"""


@query("op6_blob_ledger", _ledger_sql())
def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: each distinct text is scanned once, findings go to all its documents."""
    addressed = blob_ledger.address(read_table(spark, sf_dir, "documents"), ["doc_id"])
    ledger = cut_lineage(blob_ledger.scan_unseen(addressed, ["doc_id"], blob_ledger.RULES))
    found = blob_ledger.findings(addressed.drop("text"), ledger, blob_ledger.RULES)
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in blob_ledger.BASE_RULES]))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(blob_ledger.written(base).cast("binary"), 256).alias("base_sha256"),
        blob_ledger.written(F.col("found")).alias("spans"),
    )


WINNOWING_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
occ AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op8_winnowing", WINNOWING_SQL)
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    docs = read_table(spark, sf_dir, "documents")
    found = winnowing.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(winnowing.words(F.col("text"))).cast("bigint").alias("n_words"))
    same = F.col("c.doc_id").eqNullSafe(F.col("f.doc")) & (F.col("c.mark") == F.col("f.mark"))
    return counted.alias("c").join(found.alias("f"), same, "left").select(
        "c.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


ROTATION_SQL = f"""
WITH r AS (
    SELECT conv_id, turn,
           replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS role,
           replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS text
    FROM conversations),
t AS (
    SELECT DISTINCT conv_id, CAST(floor(turn / {perspective_rotation.PART_TURNS}.0) AS BIGINT) AS part, turn, role, text FROM r WHERE turn IS NOT NULL
    UNION ALL
    SELECT conv_id, -1 - (n - 1) // {perspective_rotation.PART_TURNS} AS part, n AS turn, role, text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role, text) AS n FROM r WHERE turn IS NULL)),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
e AS (
    SELECT t.conv_id, part, turn, role, perspective, text, role = perspective AS own,
           '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head
    FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
    SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, part, perspective ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
    FROM e)
SELECT conv_id, part, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_target,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) AS BIGINT), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM p GROUP BY conv_id, part, perspective
"""


@query("op7_perspective_rotation", ROTATION_SQL)
def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written from the view of each of their participants."""
    return perspective_rotation.rotate(read_table(spark, sf_dir, "conversations"))


URL_RULES = [
    url_markov.Rule("allow", "com", "/"),
    url_markov.Rule("block", "example.com", "/en/"),
    url_markov.Rule("allow", "www.example.com", "/en/"),
    url_markov.Rule("block", "net", "/es/"),
    url_markov.Rule("block", "net", "/fr/"),
]


def _url_sql() -> str:
    """The rules as a table, the model level by level."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    k, w = url_markov.ORDER, url_markov.WEIGHT
    levels = [
        f"""m0 AS (
            SELECT right(gram, 1) AS gram, (sum(a) + {w} * {1 / url_markov.ALPHABET}) / ((SELECT sum(a) FROM g) + {w}) AS pa,
                   (sum(r) + {w} * {1 / url_markov.ALPHABET}) / ((SELECT sum(r) FROM g) + {w}) AS pr
            FROM g GROUP BY 1)"""
    ]
    for n in range(1, k + 1):
        levels.append(f"""
        l{n} AS (SELECT right(gram, {n + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1),
        c{n} AS (SELECT left(gram, {n}) AS context, sum(a) AS a, sum(r) AS r FROM l{n} GROUP BY 1),
        m{n} AS (
            SELECT l.gram, (l.a + {w} * m.pa) / (c.a + {w}) AS pa, (l.r + {w} * m.pr) / (c.r + {w}) AS pr
            FROM l{n} l JOIN c{n} c ON left(l.gram, {n}) = c.context JOIN m{n - 1} m ON right(l.gram, {n}) = m.gram)""")
    return f"""
    WITH u AS (
        SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (
        SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{url_markov.UPPER}', '{url_markov.LOWER}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    rules(verdict, host, path) AS (VALUES {rules}),
    fit AS (
        SELECT h.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM (SELECT DISTINCT url, host, path FROM h) h JOIN rules r
          ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
        GROUP BY h.url),
    d AS (
        SELECT h.url, rest, fit.verdict AS label, left(md5(h.url), 1) < '{url_markov.CALIBRATION}' AS held
        FROM (SELECT DISTINCT url, rest FROM h) h LEFT JOIN fit ON h.url = fit.url),
    q AS (
        SELECT url, label, held, t[i:i + {k}] AS gram
        FROM (SELECT url, label, held, t, unnest(range(1, length(t) - {k} + 1)) AS i
              FROM (SELECT *, repeat(chr(2), {k}) || translate(rest, '{url_markov.UPPER}', '{url_markov.LOWER}') || chr(3) AS t FROM d))),
    g AS (
        SELECT gram, sum(CASE WHEN label = 'allow' AND NOT held THEN 1 ELSE 0 END) AS a, sum(CASE WHEN label = 'block' AND NOT held THEN 1 ELSE 0 END) AS r
        FROM q GROUP BY gram),
    {", ".join(levels)},
    s AS (
        SELECT url, any_value(label) AS label,
               greatest(-{url_markov.LARGEST_BIN}, least({url_markov.LARGEST_BIN}, CAST(floor(round(sum(ln(pa / pr)) / count(*), 9) * {url_markov.BINS_PER_UNIT}) AS BIGINT))) AS bin
        FROM q JOIN m{k} ON q.gram = m{k}.gram WHERE label IS NULL OR held GROUP BY url),
    b AS (SELECT bin, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS r FROM s WHERE label IS NOT NULL GROUP BY bin),
    j AS (
        SELECT greatest(coalesce(lag(bin) OVER (ORDER BY bin) + 1, least(bin, 0)), least(bin, 0)) AS bin, (ta - coalesce(sum(a) OVER w, 0)) / ta + coalesce(sum(r) OVER w, 0) / tr AS gain
        FROM b, (SELECT sum(a) AS ta, sum(r) AS tr FROM b) WHERE ta > 0 AND tr > 0
        WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    best AS (SELECT coalesce((SELECT bin FROM j ORDER BY gain DESC, abs(bin), bin LIMIT 1), 0) AS bin)
    SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN s.bin >= best.bin THEN 'allow' ELSE 'block' END) AS verdict,
           CASE WHEN fit.rule IS NULL THEN s.bin END AS score_bin
    FROM h LEFT JOIN fit ON h.url = fit.url LEFT JOIN s ON h.url = s.url, best
    """


@query("op9_url_markov", _url_sql())
def op9_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the rules or else by the ratio of the two models."""
    return url_markov.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@query("op10_word_backoff_language")
def op10_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on those outside the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    model = word_backoff_language.fit(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return word_backoff_language.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


CRC32_SQL = """list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform({bytes}, lambda b: [CAST(b AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END)"""


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's bytes: a byte is added, then eight bits (256) are shifted out."""
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(1, strlen({text}) + 1), lambda k: CAST('0x' || substr({digits}, 2 * k - 1, 2) AS BIGINT))"
    return f"xor({CRC32_SQL.format(bytes=values)}, 4294967295)"


RESAMPLING_SQL = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
t AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
df AS (
    SELECT doc_id, unnest(w) AS f FROM d
    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
tf AS (
    SELECT unnest(w) AS f FROM t
    UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
dc AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY doc_id, f),
b AS MATERIALIZED (SELECT f, {_crc32_sql("f")} % 10000 AS bucket FROM (SELECT f FROM dc UNION SELECT f FROM tf)),
s AS (SELECT bucket, sum(n) AS n FROM dc JOIN b USING (f) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS n FROM tf JOIN b USING (f) GROUP BY bucket),
g AS (
    SELECT bucket, CAST(floor(1000 * ln(
        CAST(coalesce(u.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000)
        / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM u) + 10000)))) AS BIGINT) AS gain
    FROM s LEFT JOIN u USING (bucket)),
w AS (
    SELECT doc_id, sum(n) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
    FROM dc JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
    SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || d.doc_id), 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
o AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS total FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * total // 100 THEN place END AS rank
FROM o
"""


@query("op11_dictionary_resampling", RESAMPLING_SQL)
def op11_dictionary_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for likeness to the benchmark's texts; a quarter of the long enough ones is drawn."""
    drawn = dictionary_resampling.resample(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# On these pages markup decides in the end (see the module), and SQL can follow it.
PAGES_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(?:p|h1|br)\b[^>]*(?:>|$)', ' ', 'g'), '</?[a-z][^>]*(?:>|$)', '', 'g') AS body FROM a),
e AS (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS body
    FROM t)
SELECT page_id, url, trim(regexp_replace(body, '[\s\x0B]+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(body, '[\s\x0B]+', ' ', 'g'))) AS BIGINT) AS n_chars FROM e
"""


@query("op12_page_differencing", PAGES_SQL)
def op12_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, differenced against the page of its host with the nearest URL."""
    return page_differencing.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


RUN_LEVELS = 21  # lengths up to a million words, so runs of periods up to that


def _runs_sql() -> str:
    """Factors named by their halves; neighbouring places with one distance to the next occurrence."""
    levels = []
    for k in range(RUN_LEVELS):
        m = 1 << k
        source = "SELECT doc_id, i, md5(v) AS name FROM p" if k == 0 else f"""
            SELECT a.doc_id, a.i, md5(a.name || b.name) AS name FROM l{k - 1} a JOIN l{k - 1} b ON a.doc_id = b.doc_id AND b.i = a.i + {m // 2}"""
        levels.append(f"""
        l{k} AS MATERIALIZED (SELECT * FROM ({source}) QUALIFY count(*) OVER (PARTITION BY doc_id, name) > 1),
        r{k} AS (
            SELECT doc_id, min(i) AS start, max(i) + {m} + period - min(i) AS length, period
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island
                  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, name ORDER BY i) - i AS period FROM l{k}) WHERE period <= {m})
            GROUP BY doc_id, period, island
            HAVING max(i) + {m} + period - min(i) >= greatest(6, 4 * period))""")
    return rf"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
    e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS shares FROM d),
    f AS (SELECT *, 1 + (n - a) // shares AS p FROM e),
    t AS (
        SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
                            THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM f),
    p AS (SELECT doc_id, unnest(w) AS v, unnest(range(0, len(w))) AS i FROM t),
    {", ".join(levels).strip()},
    runs AS ({" UNION ".join(f"SELECT * FROM r{k}" for k in range(RUN_LEVELS))}),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT p.doc_id, string_agg(v, ' ' ORDER BY p.i) AS words FROM p ANTI JOIN dropped ON p.doc_id = dropped.doc_id AND p.i = dropped.i GROUP BY p.doc_id),
    listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text,
               first(struct_pack(s := start, l := length, q := period) ORDER BY length DESC, start, period) AS best
        FROM runs GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
           sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
    FROM t LEFT JOIN listed ON t.doc_id = listed.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id"""


@query("op13_basic_factor_runs", _runs_sql())
def op13_basic_factor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents; in a tenth of them a tail is first made periodic."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", id_crc().alias("h"), F.floor(id_crc() / 10).cast("bigint").alias("g"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    words = F.when(chosen, F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]"), ""))
    docs = docs.withColumn("w", words).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    source = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    text = F.when(F.col("n") > 0, F.array_join(F.transform(source, lambda i: F.get(F.col("w"), i)), " ")).otherwise(F.col("text"))
    found = basic_factor_runs.find_runs(docs.select("doc_id", text.alias("text"))).withColumn("best", basic_factor_runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
