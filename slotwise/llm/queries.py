"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import codes, decontaminate, language, lexical, lines, mixing, pii, repeats, secrets, simhash, topk, toxicity, urls
from slotwise.llm.texts import crc_of


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [_count(F.col("base"), k) for k in secrets.SHAPES]
    return found.select("row.doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def _count(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, remainder = _table(spark, folder, "documents"), crc_of("doc_id") % 3
    field = toxicity.fit(docs.select("doc_id", "text"), _table(spark, folder, "labels").filter(remainder != 1))
    rows = docs.select("doc_id", "text", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"))
    found = toxicity.score(rows, field, keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.search(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    spans = F.col("spans")
    counts = [_count(spans, k) for k in pii.BASE]
    base = F.filter(spans, lambda s: s.kind.isin(*pii.BASE))
    return found.select("row.doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.deduplicate(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    remainder = crc_of("doc_id") % 4
    model = language.fit(docs.filter(remainder != 2), "text", "lang", "doc_id")
    found = language.identify(docs.select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out")), model, keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.group(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


# The rules of the url filter, and the words that mark a host without a rule.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "phishing", "pills", "poker", "porn", "slots", "spam", "xxx")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    found = urls.judge(_table(spark, folder, "pages").select("page_id", "url"), rules, BLOCKED_WORDS, keep=["page_id"])
    return found.select("row.page_id", "host", "path", "rule", "verdict")


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(_table(spark, folder, "embeddings"), F.col("key") % 50 == 0)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found, books = codes.encode(_table(spark, folder, "embeddings"), keep=["vec_id", "label"])
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    error = F.aggregate("errors", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = found.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), error.alias("error"))
    return codes.with_label_sums(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


# The limits of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30


def op12_line_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.clean(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"], with_text=False)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_decontamination, op4_pii, op5_mixing, op6_repeats, op7_language_id, op8_simhash, op9_url_filter, op10_top_k,
                                  op11_vector_codes, op12_line_cleaning, op13_lexical_search)}


def _texts(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _codes_sql() -> str:
    """Lloyd rounds with full comparisons: assignment a, codebook b, in turn."""
    steps = []
    for r in range(codes.ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT uid, p, any_value(x) AS x, min(d * {codes.ENTRIES} + e) % {codes.ENTRIES} AS e, min(d) AS d
    FROM (SELECT uid, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN b{r} ON parts.p = b{r}.p) GROUP BY uid, p)""")
        if r < codes.ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY j) AS c
    FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS k FROM a{r}, (SELECT unnest(range(1, w + 1)) AS j FROM width) GROUP BY p, e, j) GROUP BY p, e) n USING (p, e))""")
    last = codes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
width AS (SELECT greatest(1, (max(len(v)) + {codes.PARTS - 1}) // {codes.PARTS}) AS w FROM kept),
parts AS MATERIALIZED (SELECT uid, vec_id, v, p, list_resize(v, {codes.PARTS} * w, 0)[p * w + 1:p * w + w] AS x FROM kept, width, (SELECT unnest(range({codes.PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, v) - 1 AS e, x AS c FROM parts QUALIFY e < {codes.ENTRIES}),
{",".join(chr(10) + s for s in steps).strip()},
coded AS (SELECT uid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY uid),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (uid), book"""


def _lines_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    end, half = lines.SENTENCE_END.replace("'", "''"), lines.MOST_LOST
    bare = f"trim({low.format('x')}, '{lines.MENU_TRIM}')"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT uid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
lined AS MATERIALIZED (SELECT uid, i, line, regexp_extract_all(line, '{lines.WORD}') AS ws, row_number() OVER (PARTITION BY uid, line ORDER BY i) AS nth FROM cut WHERE regexp_matches(line, '{lines.WORD}')),
judged AS (SELECT *, len(list_filter(ws, lambda x: list_contains({_texts(lines.SEPARATORS)}, x))) AS apart, list_transform(ws, lambda x: {bare}) AS bare,
    list_sum(list_transform(ws, lambda x: length(x))) AS chars FROM lined),
per_doc AS (SELECT uid, sum(len(ws)) AS n_words, sum(chars) AS word_chars, count_if(nth > 1) AS n_dup_lines, sum(CASE WHEN (apart >= 2 AND 4 * apart >= len(ws))
    OR (list_contains({_texts(lines.MENU)}, bare[1]) AND len(list_filter(bare, lambda x: x = '' OR list_contains({_texts(lines.MENU)}, x))) = len(ws))
    OR {" OR ".join(f"contains({low.format('line')}, '{b}')" for b in lines.BOILERPLATE)}
    OR len(list_filter(ws, lambda x: regexp_matches(x, '{end}$'))) = 0 OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > chars
    OR 5 * len(list_filter(ws, lambda x: regexp_matches(x, '{lines.DOUBLED}$'))) > len(ws) THEN len(ws) ELSE 0 END) AS lost FROM judged GROUP BY uid),
worded AS MATERIALIZED (SELECT uid, regexp_extract_all(text, '{lines.WORD}') AS ws FROM docs),
windows AS (SELECT uid, unnest(range(1, len(ws) - {lines.WINDOW - 2})) AS i, ws FROM worded WHERE len(ws) >= {lines.WINDOW}),
twice AS (SELECT uid, list(i) AS places FROM (SELECT uid, i, ws[i:i + {lines.WINDOW - 1}] AS w FROM windows) GROUP BY uid, w HAVING count(*) > 1),
repeated AS (SELECT uid, count(DISTINCT place + o) AS n FROM (SELECT uid, unnest(places) AS place FROM twice), (SELECT unnest(range({lines.WINDOW})) AS o) GROUP BY uid),
counted AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM docs LEFT JOIN per_doc USING (uid) LEFT JOIN repeated USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AND lost <= {half} * n_words AS kept FROM counted"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_line_cleaning": _lines_sql(),
    "op13_lexical_search": f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ws FROM documents),
sized AS MATERIALIZED (SELECT * FROM docs WHERE len(ws) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM sized),
tfs AS MATERIALIZED (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(ws) AS term FROM sized) GROUP BY uid, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, total GROUP BY term),
items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ws FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS c FROM (SELECT item, item_id, unnest(ws) AS term FROM items) GROUP BY item, item_id, term),
scored AS (SELECT item, item_id, uid, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(ws) * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (uid), total GROUP BY item, item_id, uid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, uid) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op9_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS name FROM cut),
parts AS (SELECT page_id, row_number() OVER () AS n, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path FROM named),
rules(r_host, r_path, said) AS (VALUES {", ".join(map(str, URL_RULES))}),
best AS (SELECT n, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(said, length(r_host || r_path)) AS said
    FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {list(BLOCKED_WORDS)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (n)""",
    "op10_top_k": """
WITH kept AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT q.uid AS quid, q.vec_id AS query_id, c.uid, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS score
    FROM kept q JOIN kept c ON q.uid <> c.uid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id, uid) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5""",
}
