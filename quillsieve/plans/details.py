"""Queries of the smaller operators: scalars, filters, checks and counters, each on whole driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.functions import udfs
from quillsieve.operators import chat, checks, curation, metrics, nearness, rollouts
from quillsieve.operators import votes as V
from quillsieve.plans import curate
from quillsieve.plans.catalogue import PAIRS, corpus, long, official, query, read
from quillsieve.plans.scratch import stored

# --- scalars ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderkey % 6 IN (0, 1, 2, 3) AS valid FROM orders")
def valid_flags(spark, sf_dir):
    k = (F.col("o_orderkey") % 6).cast("int")
    words = F.element_at(F.array(*map(F.lit, ["Yes", " TRUE ", "valid\n", "1", "no", ""])), k + 1)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.is_true(words).alias("valid"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'y = ' || turn || chr(10) END AS code FROM conversations")
def code_blocks(spark, sf_dir):
    """The last fenced program of each turn."""
    n = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n```python\nx = 0\n```\nor\n```\ny = "), n, F.lit("\n```\n"))).otherwise(F.concat("text", F.lit(" ``` open")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.code_block(text).alias("code"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE [" + ", ".join("'" + T.PROMPTS[k].replace("'", "''") + "'" for k in ("default", "concise", "verify", "rigor")) + "][p_partkey % 5 + 1] END AS prompt FROM part")
def prompt_styles(spark, sf_dir):
    style = F.element_at(F.array(*map(F.lit, ["default", "concise", "verify", "rigor", "unknown"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.prompt(style).alias("prompt"))


@query("""WITH r AS (SELECT event_id AS id, event_type = 'purchase' AS ok, trim(event_type) AS out, left(user_id || ' failed', 400) AS err FROM events)
SELECT id, 'Program output:' || chr(10) || '```' || chr(10) || CASE WHEN ok THEN out ELSE out || chr(10) || '[error] ' || err END || chr(10) || '```' || chr(10) || 'Go on.' AS feedback,
'Program output:' || chr(10) || '```' || chr(10) || '[' || CASE WHEN ok THEN 'ok' ELSE 'error' END || '] ' || err || chr(10) || '```' || chr(10) || 'Again.' AS repair FROM r""")
def run_messages(spark, sf_dir):
    """What the model is told about a run, for a final answer and for a repair."""
    status = F.when(F.col("event_type") == "purchase", "ok").otherwise("error")
    err = F.concat(F.col("user_id").cast("string"), F.lit(" failed\n"))
    out = F.concat(F.lit("\n"), "event_type", F.lit(" "))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.feedback(status, out, err, "Go on.").alias("feedback"), T.repair_request(status, err, "Again.").alias("repair"))


@query("""SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS joined, sha256(arg_min(text, turn)) AS first, sha256(arg_max(text, turn)) AS last FROM conversations GROUP BY conv_id""")
def completion_texts(spark, sf_dir):
    chats = chat.collect_chats(read(spark, sf_dir, "conversations"))
    m = F.col("messages")
    forms = T.flatten_completion(m), T.flatten_completion(F.element_at(m, 1), "struct"), T.flatten_completion(F.element_at(m, -1)["content"], "string")
    return chats.select(F.col("id").alias("conv_id"), *[F.sha2(f, 256).alias(n) for f, n in zip(forms, ("joined", "first", "last"))])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS reward FROM orders")
def rewards(spark, sf_dir):
    """Only the very integer counts, and commas in the gold answer don't matter."""
    k = F.col("o_orderkey")
    said = F.element_at(F.array(F.concat(F.lit("so\nFinal answer: 1,"), F.lpad((k % 1000).cast("string"), 3, "0")), F.concat(F.lit("Final answer: "), (k + 1).cast("string")), F.lit("no idea")), (k % 3 + 1).cast("int"))
    gold = F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), metrics.reward(T.extract_reward(said), F.when(k % 3 == 1, "none").otherwise(gold)).alias("reward"))


@query("""WITH t AS (SELECT doc_id, text, '{' || doc_id || '}' AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, '\\frac{1}' || v || '|' || doc_id || '\\%' AS found, CAST(doc_id AS VARCHAR) AS answer FROM t""".replace("\\\\", "\\"))
def boxed_contents(spark, sf_dir):
    """Nested braces after whole texts; the texts have no boxes of their own."""
    i = F.col("doc_id").cast("string")
    docs = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat("text", F.lit(" \\boxed{\\frac{1}{"), i, F.lit("}} and \\boxed{"), i, F.lit("\\%} {")).alias("t"))
    return docs.select("doc_id", F.array_join(udfs.boxed_values("t"), "|").alias("found"), udfs.boxed_answer(F.col("t")).alias("answer"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN source NOT IN ('src1', 'src2') THEN CASE WHEN n_chars % 2 = 0 THEN 'even' WHEN lang <> 'en' THEN 'language' END END AS reason FROM documents WHERE source NOT IN ('src1', 'src2')""")
def source_reasons(spark, sf_dir):
    """Rows of other sources vanish uncounted; the first rule that a row fails is its reason."""
    rules = curation.source_reason([("even", F.col("n_chars") % 2 == 0), ("language", F.col("lang") != "en")], F.col("source").isin("src1", "src2"))
    return rules(read(spark, sf_dir, "documents")).select("doc_id", "reason")


@query("SELECT l_orderkey AS id, count(*) AS support FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4")
def supported_ids(spark, sf_dir):
    support = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("support"))
    return curation.support_range(support, 2, 4)


@query("SELECT doc_id, n_chars >= 498 AS truncated, n_chars % 3 = 0 AS cut_off FROM documents")
def truncation_flags(spark, sf_dir):
    reason = F.when(F.col("n_chars") % 3 == 0, "length").when(F.col("n_chars") % 3 == 1, "stop")
    return read(spark, sf_dir, "documents").select("doc_id", rollouts.truncated(F.col("n_chars"), 500).alias("truncated"), rollouts.cut_off(reason).alias("cut_off"))


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant')")
def trainable_chats(spark, sf_dir):
    chats = chat.collect_chats(read(spark, sf_dir, "conversations"))
    masked = chats.select("id", F.transform(chat.label_mask(F.col("messages")), lambda t: t["label"]).alias("labels"))
    return masked.filter(F.exists("labels", lambda x: x.isNotNull())).select(F.col("id").alias("conv_id"))


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def head_rows(spark, sf_dir):
    return curation.first_rows(read(spark, sf_dir, "events").select("event_id", F.struct("ts", "event_id").alias("ord")), 100).select("event_id")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS ord FROM events GROUP BY user_id")
def last_writes(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("ord"))
    return curation.last_write(rows)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def selected_ids(spark, sf_dir):
    """Semi-join: ids that a gate selects."""
    chosen = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(chosen, "id", "left_semi")


@query("""WITH c AS (SELECT l_orderkey AS id, l_suppkey % 3 AS a, max(l_partkey * 8 + l_linenumber) AS last FROM lineitem GROUP BY 1, 2)
SELECT id, CAST(a AS VARCHAR) AS answer, last AS n FROM c""")
def overwritten_counts(spark, sf_dir):
    """Spellings of one answer in one pool: the last one's count stands."""
    a = (F.col("l_suppkey") % 3).cast("string")
    n = F.col("l_partkey") * 8 + F.col("l_linenumber")
    spelled = F.when(n % 2 == 0, F.concat(F.lit(" 0"), a)).otherwise(F.concat(a, F.lit(".0")))
    return V.overwritten(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("ord"), spelled.alias("answer"), n.alias("n")))


# --- checks ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 IN (1, 2)")
def non_integer_answers(spark, sf_dir):
    k = F.col("p_partkey")
    answer = F.element_at(F.array(k.cast("string"), F.lit("1.5"), F.lit(None).cast("string"), F.concat(F.lit("-"), k.cast("string"))), (k % 4 + 1).cast("int"))
    return checks.non_integers(read(spark, sf_dir, "part").select(k.alias("id"), answer.alias("answer"))).select("id")


@query("SELECT count(*) AS n, true AS as_expected, true AS other_refused FROM orders")
def row_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    n = rows.count()

    def passes(expected: int) -> bool:
        try:
            checks.require_count(rows, expected)
        except checks.CheckError:
            return False
        return True

    return spark.createDataFrame([(n, passes(n), not passes(n + 1))], "n bigint, as_expected boolean, other_refused boolean")


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def unknown_references(spark, sf_dir):
    known = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    return checks.unknown_ids(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), known)


@query("SELECT source, 51 AS quota, count(*) AS available FROM documents GROUP BY 1 HAVING count(*) < 51 UNION ALL SELECT 'absent', 3, 0")
def short_quotas(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    quotas = docs.select("source").distinct().filter("source is not null").withColumn("quota", F.lit(51)).unionByName(spark.createDataFrame([("absent", 3)], "source string, quota int"))
    return curation.short_strata(docs, "source", quotas)


@query("SELECT doc_id FROM documents WHERE n_chars > 1000")
def too_long_rows(spark, sf_dir):
    return checks.too_long(read(spark, sf_dir, "documents"), F.col("n_chars"), 1000).select("doc_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW'")
def unanswered_rows(spark, sf_dir):
    answer = F.when(~F.coalesce(F.col("o_orderpriority") == "5-LOW", F.lit(False)), F.col("o_orderstatus"))
    return checks.missing_answers(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answer.alias("answer"))).select("id")


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'fr')")
def unknown_values(spark, sf_dir):
    known = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return checks.unknown_keys(read(spark, sf_dir, "documents").filter("lang is not null"), known, "lang")


@query("SELECT 'columns' AS what, true AS passes, true AS refused UNION ALL SELECT 'parameters', true, true")
def plain_requirements(spark, sf_dir):
    """Required columns and valid parameters, with one call that holds and one that doesn't."""

    def refused(call) -> bool:
        try:
            call()
        except checks.CheckError:
            return True
        return False

    orders = read(spark, sf_dir, "orders")
    rows = [
        ("columns", not refused(lambda: checks.require_columns(orders, "o_orderkey")), refused(lambda: checks.require_columns(orders, "o_orderkey", "answer"))),
        ("parameters", not refused(lambda: checks.require_parameters(top_p=True)), refused(lambda: checks.require_parameters(top_p=False))),
    ]
    return spark.createDataFrame(rows, "what string, passes boolean, refused boolean")


@query("SELECT o_orderkey AS id, o_orderkey % 5 > 0 AS same FROM orders")
def order_warnings(spark, sf_dir):
    """Whether two inputs have their ids at the same places: per id, and the check's own word on all of them."""
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"))
    b = a.withColumn("ord", F.when(F.col("id") % 5 > 0, F.col("ord")).otherwise(-F.col("ord") - 1))
    if checks.same_order(a, b) or not checks.same_order(a, a):
        raise checks.CheckError("orders of ids are told apart wrongly")
    return a.join(b.select("id", F.col("ord").alias("other")), "id").select("id", (F.col("ord") == F.col("other")).alias("same"))


# --- counters --------------------------------------------------------------------------------------------------


@query("SELECT CASE event_type WHEN 'purchase' THEN 'no_code' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def run_counters(spark, sf_dir):
    status = F.when(F.col("event_type") != "purchase", F.col("event_type"))
    return rollouts.round_counters(read(spark, sf_dir, "events").select(status.alias("status")))


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') / 2.0 AS per_second, round(count(*) FILTER (WHERE event_type <> 'purchase') / (count(*) FILTER (WHERE event_type = 'purchase') / 2.0), 9) AS eta_seconds FROM events")
def progress_rate(spark, sf_dir):
    n = read(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "purchase"), F.count(F.lit(1))).first()  # one row
    rate = metrics.throughput(n[0], n[1], 2.0)
    return spark.createDataFrame([(n[0], n[1], rate["per_second"], round(rate["eta_seconds"], 9))], "done bigint, total bigint, per_second double, eta_seconds double")


@query("""SELECT user_id AS id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(event_type)) AS BIGINT) AS chars FROM events GROUP BY 1""")
def zipped_lists(spark, sf_dir):
    """Lists that belong together by place, zipped and taken apart again."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    lists = rows.select("id", F.transform("e", lambda x: x["event_type"]).alias("types"), F.transform("e", lambda x: F.length(x["event_type"])).alias("sizes"))
    pairs = lists.select("id", F.explode(F.arrays_zip("types", "sizes")).alias("z")).filter(F.length("z.types") == F.col("z.sizes"))
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(long("z.sizes")).alias("chars"))


# --- near duplicates -------------------------------------------------------------------------------------------


_TOK = T.tokens_sql("text")
NEAR = f"""w AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, {_TOK} AS w FROM documents) WHERE len(w) > 0 AND doc_id IS NOT NULL GROUP BY w),
s AS (SELECT id, w, list_distinct(w) AS s FROM w),
g AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w)),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM g x JOIN g y ON x.g = y.g AND x.id < y.id),
j AS (SELECT a, b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS jaccard, least(len(x.w), len(y.w)) / greatest(len(x.w), len(y.w)) AS ratio
  FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b)"""


@query(f"WITH {NEAR} SELECT a AS doc_id, b AS other_id, round(jaccard, 9) AS jaccard, round(ratio, 9) AS ratio, 'near_token' AS kind FROM j WHERE jaccard >= 0.85 AND ratio >= 0.8")
def near_dup_documents(spark, sf_dir):
    """Documents against documents at the production thresholds, pairs of representatives of equal texts."""
    near = nearness.near_copies(corpus(spark, sf_dir).select("id", "text"), store=stored)
    return near.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("other_id"), F.round("jaccard", 9).alias("jaccard"), F.round("ratio", 9).alias("ratio"), "kind")


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT 1000000 + 3 * item_id, text FROM benchmark UNION ALL SELECT 1000001 + 3 * item_id, text || ' indeed' FROM benchmark UNION ALL SELECT 1000002 + 3 * item_id, replace(text, 'e ', 'ee ') FROM benchmark),
w AS (SELECT id, {_TOK} AS w FROM d), o AS (SELECT DISTINCT array_to_string({_TOK}, ' ') AS norm FROM benchmark)
SELECT id, CASE WHEN len(w) = 0 THEN 'empty' ELSE 'exact' END AS contamination FROM w WHERE len(w) = 0 OR array_to_string(w, ' ') IN (SELECT norm FROM o)""")
def known_texts(spark, sf_dir):
    """Empty texts and copies of official ones among the documents, the items and edited items."""
    return nearness.contamination(edited_corpus(spark, sf_dir), official(spark, sf_dir), store=stored, near=False)


def edited_corpus(spark, sf_dir) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    # as it is, with a word more, and with each final e before a space doubled, which keeps characters better than words
    forms = [F.col("text"), F.concat("text", F.lit(" indeed")), F.replace("text", F.lit("e "), F.lit("ee "))]
    edited = [items.select((F.lit(1_000_000 + k) + 3 * F.col("item_id")).alias("id"), form.alias("text")) for k, form in enumerate(forms)]
    return reduce(DataFrame.unionByName, edited, corpus(spark, sf_dir).select("id", "text"))


def contaminated(spark, sf_dir) -> DataFrame:
    return nearness.contamination(edited_corpus(spark, sf_dir), official(spark, sf_dir), store=stored)


@query()
def near_dup_sequence(spark, sf_dir):
    """Contamination with sequence ratios over documents, items and edited items; tests hold the ratio against difflib."""
    return contaminated(spark, sf_dir).withColumnRenamed("id", "doc_id")


LETTERED = " + ".join(f"least(strlen(x) - strlen(replace(x, '{c}', '')), strlen(y) - strlen(replace(y, '{c}', '')))" for c in nearness.LETTERS)


@query(f"""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT 1000000 + 3 * item_id, text FROM benchmark UNION ALL SELECT 1000001 + 3 * item_id, text || ' indeed' FROM benchmark UNION ALL SELECT 1000002 + 3 * item_id, replace(text, 'e ', 'ee ') FROM benchmark),
a AS (SELECT id, {_TOK} AS w FROM d), b AS (SELECT item_id AS id, {_TOK} AS w FROM benchmark),
o AS (SELECT id, array_to_string(w, ' ') AS x, len(w) AS n, len(list_distinct(w)) AS ns FROM a WHERE len(w) > 0), p AS (SELECT id AS item_id, array_to_string(w, ' ') AS y, len(w) AS m, len(list_distinct(w)) AS mt FROM b),
ga AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM a WHERE len(w) > 0)),
gb AS (SELECT DISTINCT id AS item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM b WHERE len(w) > 0)),
c AS (SELECT DISTINCT id, item_id FROM ga JOIN gb USING (g)),
j AS (SELECT id AS doc_id, item_id, x, y, ns, mt, least(n, m) / greatest(n, m) AS ratio FROM c JOIN o USING (id) JOIN p USING (item_id) WHERE least(n, m) / greatest(n, m) >= 0.8),
q AS (SELECT *, 2 * ({LETTERED}) / (strlen(x) + strlen(y)) AS quick FROM j)
SELECT doc_id, item_id, least(ns, mt) / greatest(ns, mt) >= 0.85 AS tokens_may, ratio >= 0.85 AND quick >= 0.92 AS sequence_may, round(quick, 9) AS quick FROM q WHERE least(ns, mt) / greatest(ns, mt) >= 0.85 OR (ratio >= 0.85 AND quick >= 0.92)""")
def near_sequence_bounds(spark, sf_dir):
    """Pairs of texts and items that lengths and letters leave for the comparison of tokens and of sequences."""
    items = stored(nearness.token_table(official(spark, sf_dir)))
    docs = stored(nearness.alike_in_length(nearness.token_table(edited_corpus(spark, sf_dir)), items))
    pairs = stored(nearness.shingle_pairs(docs, items, alike=True, store=stored))
    found = nearness.bounded_pairs(pairs, docs, items, store=stored)
    return found.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "tokens_may", "sequence_may", F.round("quick", 9).alias("quick"))


# --- the curation job ------------------------------------------------------------------------------------------

def _curation(spark, sf_dir):
    docs = corpus(spark, sf_dir).filter("id is not null").select(F.col("id").alias("ord"), "id", F.col("text").alias("question"), F.col("text").alias("solution"), "lang", "source")
    sources = [
        curate.Source("main", docs, {"en": 12}, "lang", (("odd", F.col("id") % 10 == 3),), F.col("lang") != "en"),
        curate.Source("more", docs, {"fr": 6}, "lang", silent=~F.col("lang").isin("fr", "en")),
    ]
    excluded = docs.filter("source = 'src0'").select(T.normalized(F.col("question")).alias("norm"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    none = F.array().cast("array<struct<user:string,assistant:string>>")
    said = F.struct(F.lit("assistant").alias("role"), F.col("solution").alias("content"))
    rendered = chat.render(F.array_append(chat.prompt_messages(F.lit(T.PROMPTS["default"]), none, F.col("question")), said))
    judged = curate.judge(sources, items, excluded, curate.Limits(32, 900, 1500), sequence=udfs.count_words(rendered), sequences=False)
    return judged, curate.choose(judged, sources, 2026)


SEQUENCE = f"'{chat.START}system\n{T.PROMPTS['default']}{chat.END}{chat.START}user\n' || text || '{chat.END}{chat.START}assistant\n' || text || '{chat.END}'"
CURATED = f"""{PAIRS}, dd AS (SELECT doc_id, text, lang, source, array_to_string({_TOK}, ' ') AS norm, len(regexp_extract_all(text, '\\S+')) AS n FROM documents WHERE doc_id IS NOT NULL),
oo AS (SELECT DISTINCT array_to_string({_TOK}, ' ') AS norm FROM benchmark), nn AS (SELECT DISTINCT doc_id FROM j WHERE jaccard >= 0.85 AND ratio >= 0.8),
rr AS (SELECT 0 AS k, 'main' AS src, * FROM dd WHERE lang = 'en' UNION ALL SELECT 1, 'more', * FROM dd WHERE lang IN ('en', 'fr')),
ff AS (SELECT *, CASE WHEN src = 'main' AND doc_id % 10 = 3 THEN 'main_odd' END AS early, CASE WHEN regexp_matches(text, '{T.VISUAL}') THEN 'visual_or_url' WHEN norm = '' THEN 'official_empty'
  WHEN norm IN (SELECT norm FROM oo) THEN 'official_exact' WHEN doc_id IN (SELECT doc_id FROM nn) THEN 'official_near_token' WHEN n < 32 THEN 'solution_too_short' WHEN n > 900 THEN 'solution_too_long' WHEN len(regexp_extract_all({SEQUENCE}, '\\S+')) > 1500 THEN 'sequence_too_long' END AS failed FROM rr),
kk AS (SELECT norm FROM dd WHERE source = 'src0'),
fa AS (SELECT norm, min(k * 1000000000000 + doc_id) AS begin_at FROM ff WHERE early IS NULL AND failed IS NULL AND norm NOT IN (SELECT norm FROM kk) GROUP BY norm),
ju AS (SELECT src, doc_id, text, lang, CASE WHEN early IS NOT NULL THEN early WHEN norm IN (SELECT norm FROM kk) OR k * 1000000000000 + doc_id > begin_at THEN 'external_duplicate' ELSE failed END AS rejection FROM ff LEFT JOIN fa USING (norm)),
pl AS (SELECT src, doc_id, row_number() OVER (PARTITION BY src, lang ORDER BY sha256('2026:' || src || ':' || text), doc_id) AS p FROM ju WHERE rejection IS NULL AND ((src = 'main' AND lang = 'en') OR (src = 'more' AND lang = 'fr')))"""


@query(f"WITH {CURATED} SELECT src AS source, ju.doc_id, rejection, coalesce(p <= CASE src WHEN 'main' THEN 12 ELSE 6 END, false) AS chosen FROM ju LEFT JOIN pl USING (src, doc_id)")
def curation_job(spark, sf_dir):
    """Two sources that share rows: pre-filter, known texts, rules, first accepted, quotas."""
    judged, chosen = _curation(spark, sf_dir)
    marked = judged.join(chosen.select("source", "id", F.lit(True).alias("chosen")), ["source", "id"], "left")
    return marked.select("source", F.col("id").alias("doc_id"), "rejection", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"WITH {CURATED} SELECT rejection, count(*) AS n FROM ju WHERE rejection IS NOT NULL GROUP BY rejection")
def curation_counts(spark, sf_dir):
    """The rejections section of the job's manifest."""
    judged, chosen = _curation(spark, sf_dir)
    found = curate.counted(judged, chosen, 2026)["rejections"]
    return spark.createDataFrame(sorted(found.items()), "rejection string, n bigint")


# --- rounds of the stub provider, whose texts SQL can hash as well -----------------------------------------------


def _byte(i: int, h: str = "h") -> str:
    return f"CAST('0x' || substr({h}, {2 * i + 1}, 2) AS INTEGER)"


def _said(h: str, told: str) -> str:
    """The stub's text by its hash; `told` is whether the chat shows program output."""
    v = f"({_byte(0, h)} % 7)"
    program = f"'Try this.' || chr(10) || '```python' || chr(10) || 'print(' || CASE WHEN {_byte(2, h)} % 5 = 0 THEN '1 // 0' ELSE CAST({v} AS VARCHAR) END || ')' || chr(10) || '```' || chr(10) || 'Final answer: ' || {v}"
    return f"CASE WHEN {told} OR {_byte(1, h)} % 3 = 0 THEN 'Final answer: ' || {v} ELSE {program} END"


def _chat(prompt: str) -> str:
    return "'system:" + T.PROMPTS[prompt].replace("'", "''") + "' || chr(10) || 'user:' || text"


ASKED = f"a AS (SELECT item_id AS id, k AS sample_index, {_chat('concise')} AS chat FROM benchmark, (SELECT unnest(range(3)) AS k)), b AS (SELECT *, sha256('5:' || sample_index || ':' || chat) AS h FROM a)"


def _requests(spark, sf_dir, style: str) -> DataFrame:
    none = F.array().cast("array<struct<user:string,assistant:string>>")
    items = read(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("id"), chat.prompt_messages(T.prompt(F.lit(style)), none, F.col("text")).alias("messages"))


@query(f"WITH {ASKED} SELECT id, CAST(sample_index AS BIGINT) AS sample_index, {_said('h', 'false')} AS response, CAST(16 + {_byte(3)} % 64 AS BIGINT) AS response_tokens, {_byte(3)} % 11 = 0 AS truncated FROM b")
def stub_generations(spark, sf_dir):
    """Three samples a question through the thread pools of the generate operator."""
    got = rollouts.generate(_requests(spark, sf_dir, "concise"), rollouts.StubProvider(), 3, 64, 5)
    return got.filter("error is null").select("id", long("sample_index").alias("sample_index"), "response", long("response_tokens").alias("response_tokens"), "truncated")


@query(f"WITH {ASKED}, r AS (SELECT id, {_said('h', 'false')} AS response, {_byte(3)} % 11 = 0 AS cut FROM b WHERE sample_index = 0) SELECT id, response, cut AS retried_truncated, CASE WHEN cut THEN response END AS initial_response FROM r")
def retried_generations(spark, sf_dir):
    """Greedy texts; truncated ones are asked again with a larger budget, which the stub answers alike."""
    from quillsieve.plans.scratch import scratch_folder

    got = rollouts.with_retry(_requests(spark, sf_dir, "concise"), rollouts.StubProvider(), scratch_folder(spark), 64, 2048, 5)
    return got.select("id", "response", "retried_truncated", "initial_response")


_NUDGE, _NONE = (x.replace("'", "''") for x in (rollouts.FINAL_NUDGE, rollouts.NO_CODE_FOUND))
ROUNDS = f"""a AS (SELECT item_id AS id, k AS sample_index, {_chat('program')} AS chat FROM benchmark, (SELECT unnest(range(3)) AS k)),
b AS (SELECT *, sha256('5:' || sample_index || ':' || chat) AS h FROM a), c AS (SELECT *, {_said('h', 'false')} AS round1, nullif(regexp_extract({_said('h', 'false')}, 'print.([^)]*)', 1), '') AS printed FROM b),
d AS (SELECT *, CASE WHEN printed IS NULL THEN NULL WHEN printed = '1 // 0' THEN 'error' ELSE 'ok' END AS status FROM c),
e AS (SELECT *, CASE WHEN status IS NULL THEN '{_NONE}' ELSE 'Program output:' || chr(10) || '```' || chr(10) || CASE WHEN status = 'ok' THEN printed ELSE '(no output)' || chr(10) || '[error] ZeroDivisionError: division by zero' END
  || chr(10) || '```' || chr(10) || '{_NUDGE}' END AS told FROM d),
f AS (SELECT *, sha256('12:0:' || chat || chr(10) || 'assistant:' || round1 || chr(10) || 'user:' || told) AS h2 FROM e), g AS (SELECT *, {_said('h2', 'status IS NOT NULL')} AS final FROM f),
s AS (SELECT *, regexp_extract(final, 'Final answer: ([0-9]+)', 1) AS prediction FROM g)"""


def _single_round(spark, sf_dir) -> DataFrame:
    from quillsieve.plans.catalogue import printed
    from quillsieve.plans.scratch import scratch_folder

    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    config = rollouts.RolloutConfig(samples=3, repair_rounds=0, seed=5)
    return rollouts.trajectories(questions, rollouts.StubProvider(), scratch_folder(spark), config, execute=rollouts.programs(runner=printed))


@query(f"WITH {ROUNDS} SELECT id, CAST(sample_index AS BIGINT) AS sample_index, status, sha256(round1) AS first, sha256(final) AS final, prediction FROM s")
def rollout_texts(spark, sf_dir):
    """Sample, run, final answer: every text, run and prediction of a round."""
    got = _single_round(spark, sf_dir)
    return got.select("id", long("sample_index").alias("sample_index"), "status", F.sha2("round1_text", 256).alias("first"), F.sha2("final_text", 256).alias("final"), "prediction")


@query(f"""WITH {ROUNDS}, v AS (SELECT id, prediction AS answer, count(*) AS n FROM s WHERE status = 'ok' AND printed = prediction GROUP BY 1, 2),
t AS (SELECT id, max(answer) FILTER (WHERE n = m) AS top, count(*) FILTER (WHERE n = m) AS ties, CAST(sum(n) AS BIGINT) AS total FROM (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM v) GROUP BY id)
SELECT i.id, CASE WHEN ties = 1 THEN top END AS prediction, coalesce(total, 0) AS verified_support, 3 AS n_samples FROM (SELECT DISTINCT id FROM s) i LEFT JOIN t USING (id)""")
def rollout_pool(spark, sf_dir):
    """The verified votes of a round's samples."""
    return rollouts.tool_pool(_single_round(spark, sf_dir))
