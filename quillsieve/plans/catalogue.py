"""Named queries over the driver tables and the DuckDB SQL they are held against.

The driver tables stand in for the relations of the workload: lines of an order are voters on it, events of a
user are samples, documents are corpus rows, benchmark items are official questions, conversations are chats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.functions import udfs
from quillsieve.operators import chat, checks, curation, gates, metrics, nearness, rollouts
from quillsieve.operators import votes as V
from quillsieve.plans.scratch import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def long(c):
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


# --- votes -----------------------------------------------------------------------------------------------------

VOTES = """v AS (SELECT l_orderkey AS id, l_linenumber AS idx, CAST(CAST(floor(max(l_quantity)) AS BIGINT) % 3 AS VARCHAR) AS answer,
  max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"""


def tops_sql(source: str, name: str, amount: str = "count(*)") -> str:
    return f"""{name}_h AS (SELECT id, answer, CAST({amount} AS BIGINT) AS n FROM {source} WHERE answer IS NOT NULL GROUP BY 1, 2),
{name} AS (SELECT id, max(n) AS support, max(answer) FILTER (WHERE n = m) AS top, count(*) FILTER (WHERE n = m) AS ties, CAST(sum(n) AS BIGINT) AS total
  FROM (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM {name}_h) GROUP BY id)"""


def largest_flag():
    """The largest of flags of one character, as a number under way: text in an aggregate would have it sort."""
    return F.char(F.max(F.ascii("l_returnflag")))


def votes_of(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("idx"))
    return lines.agg((F.max("l_quantity").cast("bigint") % 3).cast("string").alias("answer"), largest_flag().alias("flag"))


MAJORITY = f"""{VOTES}, {tops_sql('v', 't')}, fb AS (SELECT id, max(answer) FILTER (WHERE idx = 1) AS fallback FROM v GROUP BY id),
m AS (SELECT fb.id, CASE WHEN ties = 1 AND support >= 2 THEN top ELSE fallback END AS answer, coalesce(support, 0) AS support,
  CASE WHEN ties = 1 AND support >= 2 THEN 'majority' ELSE 'fallback' END AS decision FROM fb LEFT JOIN t USING (id))"""


@query(f"WITH {MAJORITY} SELECT * FROM m")
def majority_fallback(spark, sf_dir):
    return V.majority(votes_of(spark, sf_dir), fallback=1)


@query(f"""WITH {MAJORITY}, r AS (SELECT id, count(*) FILTER (WHERE flag = 'R') AS nrisky FROM v GROUP BY id), j AS (SELECT * FROM m JOIN r USING (id))
SELECT 'vote3' AS band, count(*) AS n FROM j WHERE support <= 1 UNION ALL SELECT 'vote45', count(*) FROM j WHERE support IN (2, 3) AND nrisky >= 1
UNION ALL SELECT 'support4', count(*) FROM j WHERE support <= 2 UNION ALL SELECT 'vote5', count(*) FROM j WHERE support <= 3""")
def vote_support_bands(spark, sf_dir):
    votes = votes_of(spark, sf_dir)
    risky = votes.groupBy("id").agg(F.count_if(F.col("flag") == "R").alias("nrisky"))
    wide = V.majority(votes, 1).join(risky, "id")
    config = gates.ChainConfig(low_votes=1, middle_votes=(2, 3), mode_support=2)
    found = gates.bands(F.col("support"), F.col("support"), F.col("nrisky"), config)
    one = wide.agg(*[F.count_if(c).alias(n) for n, c in found.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("n")) for n in found])).alias("r")).select("r.*")


@query(f"WITH {MAJORITY} SELECT support, decision, count(*) AS n FROM m GROUP BY 1, 2")
def support_distribution(spark, sf_dir):
    return metrics.frequencies(V.majority(votes_of(spark, sf_dir), 1), "support", "decision")


ABSTAIN = f"""{VOTES}, a AS (SELECT id, idx, CASE WHEN flag = 'R' THEN NULL ELSE answer END AS answer FROM v),
k AS (SELECT id, coalesce(answer, '~none') AS answer FROM a), {tops_sql('k', 'kt')}, {tops_sql('a', 'it')},
f AS (SELECT id, max(answer) FILTER (WHERE idx = 1) AS own, arg_min(answer, idx) FILTER (WHERE answer IS NOT NULL) AS early FROM a GROUP BY id)"""


@query(f"""WITH {ABSTAIN} SELECT f.id, CASE WHEN kt.ties = 1 AND kt.support >= 2 THEN nullif(kt.top, '~none') ELSE own END AS kept_answer,
CASE WHEN kt.ties = 1 AND kt.support >= 2 THEN 'majority' ELSE 'fallback' END AS kept_decision,
CASE WHEN it.ties = 1 AND it.support >= 2 THEN it.top ELSE coalesce(own, early) END AS ignored_answer,
CASE WHEN it.ties = 1 AND it.support >= 2 THEN 'majority' ELSE 'fallback' END AS ignored_decision
FROM f LEFT JOIN kt USING (id) LEFT JOIN it USING (id)""")
def choose_vote_null_aware(spark, sf_dir):
    votes = votes_of(spark, sf_dir).withColumn("answer", rollouts.abstain(F.col("answer"), F.col("flag") == "R", F.lit(2047)))
    return V.choices(votes, 1)


EVENTS = "e AS (SELECT user_id AS id, event_type AS answer FROM events)"


def samples_of(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("answer"))


@query(f"WITH {EVENTS}, {tops_sql('e', 't')} SELECT id, CASE WHEN ties = 1 AND support >= 15 THEN top END AS answer, support AS n FROM t")
def plurality_mincount(spark, sf_dir):
    return V.pick(V.histogram(samples_of(spark, sf_dir)), 15)


@query(f"WITH {EVENTS}, {tops_sql('e', 't')} SELECT id, CASE WHEN support >= 20 THEN top END AS answer, support AS n FROM t")
def plurality_loose(spark, sf_dir):
    return V.pick(V.histogram(samples_of(spark, sf_dir)), 20, strict=False)


@query(f"WITH {VOTES}, {tops_sql('v', 't')} SELECT id, top AS answer, support AS n FROM t WHERE ties = 1 AND support >= 3")
def unique_mode_floor(spark, sf_dir):
    return V.pick(V.histogram(votes_of(spark, sf_dir)), 3).filter("answer is not null")


@query(f"WITH {EVENTS}, {tops_sql('e', 't')} SELECT id, CASE WHEN ties = 1 AND support / total >= 0.25 THEN top END AS answer, support AS n, total FROM t")
def mode_concentration(spark, sf_dir):
    return V.concentration(V.histogram(samples_of(spark, sf_dir)), 0.25)


@query("""SELECT l_orderkey AS id, CAST(l_suppkey % 5 AS VARCHAR) AS answer, CAST(sum(floor(l_quantity)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def pooled_weighted(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    key = (F.col("l_suppkey") % 5).cast("string")
    # two pools that spell answers differently: 7 and " 07.0", which are one answer
    pools = [
        lines.filter(F.col("l_linestatus").eqNullSafe("O")).select(F.col("l_orderkey").alias("id"), key.alias("answer"), F.col("l_quantity").cast("bigint").alias("n")),
        lines.filter(~F.col("l_linestatus").eqNullSafe("O")).select(F.col("l_orderkey").alias("id"), F.concat(F.lit(" 0"), key, F.lit(".0")).alias("answer"), F.col("l_quantity").cast("bigint").alias("n")),
    ]
    return V.pooled(*pools)


@query(f"WITH {EVENTS}, {tops_sql('e', 't')} SELECT id, total AS valid, (SELECT string_agg(answer || ':' || n, ' ' ORDER BY n DESC, answer) FROM t_h WHERE t_h.id = t.id) AS counts FROM t")
def sample_summary(spark, sf_dir):
    s = V.summary(V.histogram(samples_of(spark, sf_dir)))
    return s.select("id", "valid", F.array_join(F.zip_with("answers", "counts", lambda a, n: F.concat(a, F.lit(":"), n.cast("string"))), " ").alias("counts"))


@query("""WITH s AS (SELECT o_custkey AS id, o_orderkey % 4 AS p, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status, CAST(floor(o_totalprice) AS BIGINT) % 4 AS out FROM orders)
SELECT id, CAST(p AS VARCHAR) AS answer, count(*) AS n FROM s WHERE status = 'ok' AND p = out GROUP BY 1, 2""")
def verified_counts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok")
    output = F.concat(F.lit(" "), (F.floor("o_totalprice") % 4).cast("string"), F.lit("\n"))
    return V.verified(orders.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 4).cast("string").alias("prediction"), status.alias("status"), output.alias("output")))


@query(f"""WITH {VOTES}, {tops_sql('v', 't')} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM t WHERE ties = 1 AND support >= 2)""")
def unsettled_ids(spark, sf_dir):
    return V.unsettled(V.histogram(votes_of(spark, sf_dir)), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 2)


@query(f"WITH {VOTES} SELECT id, count(*) FILTER (WHERE answer = '1') AS votes_one, count(*) FILTER (WHERE flag = 'R') AS nrisky FROM v GROUP BY id")
def conditional_counts(spark, sf_dir):
    return votes_of(spark, sf_dir).groupBy("id").agg(F.count_if(F.col("answer").eqNullSafe("1")).alias("votes_one"), F.count_if(F.col("flag") == "R").alias("nrisky"))


# --- gates -----------------------------------------------------------------------------------------------------

CONFIG = gates.ChainConfig(sample_support=2, low_votes=1, middle_votes=(2, 3), mode_support=2, pointer_votes=2, pointer_repeats=1)


TOPS = ("voters", "samples", "low", "middle", "mode", "repeats")
MAPS = ("mode", "repeats", "codes")


def wide_of(spark, sf_dir) -> DataFrame:
    """The rows that gates read: every pool from one scan as counts, voters from a second, as their doubles count once."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 3).cast("string").alias("p"), (F.col("l_suppkey") % 3).cast("string").alias("s"), F.col("l_quantity").cast("bigint").alias("w"), F.col("l_returnflag").alias("flag"))
    one = F.lit(1).cast("bigint")
    entry = lambda pool, answer, n: F.struct(F.lit(pool).alias("pool") if isinstance(pool, str) else pool.alias("pool"), answer.alias("answer"), n.alias("n"))
    band = F.element_at(F.create_map(*[F.lit(x) for x in ("N", "samples", "R", "low", "A", "middle")]), F.col("flag"))
    pools = [entry(band, F.col("p"), one), entry("mode", F.col("p"), one), entry("repeats", F.col("s"), one), entry("codes", F.col("s"), F.col("w"))]
    counts = lines.select("id", F.explode(F.array(*pools)).alias("e")).select("id", "e.*")
    voters = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("idx")).agg((F.floor(F.max("l_quantity")) % 3).cast("string").alias("answer"), largest_flag().alias("flag"), (F.max("l_partkey") % 3).cast("string").alias("pointer"))
    told = [
        F.struct(F.lit("voters").alias("pool"), F.col("answer"), one.alias("n")),
        F.when(F.col("idx") == 1, F.struct(F.lit("own").alias("pool"), F.col("answer"), one.alias("n"))),
        F.when(F.col("idx") == 2, F.struct(F.lit("pointer").alias("pool"), F.col("pointer").alias("answer"), one.alias("n"))),
        F.when(F.col("flag") == "R", F.struct(F.lit("risky").alias("pool"), F.lit("").alias("answer"), one.alias("n"))),
    ]
    voters = voters.select("id", F.explode(F.array_compact(F.array(*told))).alias("e")).select("id", "e.*")
    per, c = V.pooled_tops(counts.unionByName(voters), (*TOPS, "own", "pointer", "risky"), MAPS), F.col
    clear = F.coalesce(~c("voters.ties") & (c("voters.support") >= 2), F.lit(False))
    return per.filter("voters is not null").select(
        "id", F.when(clear, c("voters.top")).otherwise(c("own.top")).alias("base"), F.coalesce("voters.support", F.lit(0)).alias("support"),
        F.coalesce("risky.total", F.lit(0)).alias("nrisky"), V.single_top(c("samples")).alias("sample_pick"), c("repeats.support").alias("votes"),
        V.single_top(c("low")).alias("low_pick"), V.single_top(c("middle")).alias("middle_pick"), V.single_top(c("mode"), 2).alias("mode"),
        c("codes").alias("code_counts"), c("pointer.top").alias("pointer"), c("mode_map").alias("pool"), c("repeats_map").alias("repeats"),
        F.when(~c("mode.ties") & (c("mode.support") / c("mode.total") >= 0.425), c("mode.top")).alias("concentrated"),
    )


def _pool_sql(name: str, column: str, flag: str | None = None, amount: str = "count(*)") -> str:
    where = f" WHERE l_returnflag = '{flag}'" if flag else ""
    return f"{name}_v AS (SELECT l_orderkey AS id, CAST({column} % 3 AS VARCHAR) AS answer, CAST(floor(l_quantity) AS BIGINT) AS w FROM lineitem{where}), " + tops_sql(f"{name}_v", name, amount)


def _count(pool: str, answer: str) -> str:
    return f"coalesce((SELECT n FROM {pool}_h h WHERE h.id = x.id AND h.answer = {answer}), 0)"


CHAIN = f"""{MAJORITY}, {_pool_sql('sp', 'l_partkey', 'N')}, {_pool_sql('lp', 'l_partkey', 'R')}, {_pool_sql('mp', 'l_partkey', 'A')},
{_pool_sql('pt', 'l_partkey')}, {_pool_sql('su', 'l_suppkey')}, {_pool_sql('code', 'l_suppkey', None, 'sum(w)')},
rk AS (SELECT id, count(*) FILTER (WHERE flag = 'R') AS nrisky FROM v GROUP BY id),
po AS (SELECT l_orderkey AS id, CAST(max(l_partkey) % 3 AS VARCHAR) AS pointer FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
x0 AS (SELECT m.id, m.answer AS base, m.support, nrisky, coalesce(su.support, 0) AS votes, pointer,
  CASE WHEN sp.ties = 1 THEN sp.top END AS spick, CASE WHEN lp.ties = 1 THEN lp.top END AS lpick, CASE WHEN mp.ties = 1 THEN mp.top END AS mpick,
  CASE WHEN pt.ties = 1 AND pt.support >= 2 THEN pt.top END AS mode, code.id IS NOT NULL AS coded
  FROM m JOIN rk USING (id) LEFT JOIN su USING (id) LEFT JOIN sp USING (id) LEFT JOIN lp USING (id) LEFT JOIN mp USING (id) LEFT JOIN pt USING (id) LEFT JOIN code USING (id) LEFT JOIN po USING (id)),
x1 AS (SELECT *, CASE WHEN support = 2 AND spick IS NOT NULL THEN spick ELSE base END AS c1 FROM x0),
x2 AS (SELECT *, CASE WHEN votes IN (2, 3) AND nrisky >= 1 AND mpick IS NOT NULL THEN mpick WHEN votes <= 1 AND lpick IS NOT NULL THEN lpick ELSE c1 END AS c2 FROM x1),
x3 AS (SELECT *, CASE WHEN support <= 2 AND mode IS NOT NULL AND mode IS DISTINCT FROM c2
  AND NOT (coded AND {_count('code', 'x.c2')} > {_count('code', 'x.mode')}) THEN mode ELSE c2 END AS c3 FROM x2 x),
x4 AS (SELECT *, CASE WHEN pointer IS NOT NULL AND pointer IS DISTINCT FROM c3 AND {_count('pt', 'x.pointer')} >= 2
  AND {_count('pt', 'x.pointer')} > {_count('pt', 'x.c3')} AND {_count('su', 'x.pointer')} >= 1 THEN pointer ELSE c3 END AS c4 FROM x3 x)"""


@query(f"WITH {CHAIN} SELECT id, base, c1, c2, c3, c4 FROM x4")
def code_guard_chain(spark, sf_dir):
    return gates.chain(wide_of(spark, sf_dir), CONFIG).select("id", "base", "c1", "c2", "c3", "c4")


@query(f"WITH {CHAIN} SELECT id, pointer, c3 AS before, c4 AS after FROM x4 WHERE c3 IS DISTINCT FROM c4")
def pointer_gate(spark, sf_dir):
    wide = gates.chain(wide_of(spark, sf_dir), CONFIG)
    return wide.filter("not c3 <=> c4").select("id", "pointer", F.col("c3").alias("before"), F.col("c4").alias("after"))


@query(f"""WITH {CHAIN} SELECT id, CASE WHEN votes <= 1 AND lpick IS NOT NULL AND {{}} THEN lpick WHEN votes IN (2, 3) AND mpick IS NOT NULL AND {{}} THEN mpick ELSE base END AS tight,
CASE WHEN nrisky >= 1 AND votes <= 1 AND lpick IS NOT NULL THEN lpick WHEN nrisky >= 1 AND votes IN (2, 3) AND mpick IS NOT NULL THEN mpick ELSE base END AS risky FROM x0""".replace("{}", "true"))
def tool_override(spark, sf_dir):
    wide, c = wide_of(spark, sf_dir), F.col
    picks = {"low": (c("low_pick"), c("low_pick")), "middle": (c("middle_pick"), c("middle_pick"))}
    forms = {"tight": (), "risky": ("low", "middle")}
    return wide.select("id", *[gates.tool_gate(c("base"), c("votes"), c("nrisky"), picks["low"], picks["middle"], bands, CONFIG).alias(name) for name, bands in forms.items()])


@query(f"""WITH {CHAIN}, {_pool_sql('cm', 'l_partkey')}, y AS (SELECT x.*, CASE WHEN cm.ties = 1 AND cm.support / cm.total >= 0.425 THEN cm.top END AS cmode FROM x0 x LEFT JOIN cm USING (id))
SELECT id, CASE WHEN cmode IS NOT NULL AND cmode IS DISTINCT FROM base AND NOT (coded AND {_count('code', 'x.base')} > {_count('code', 'x.cmode')}) THEN cmode ELSE base END AS answer FROM y x""")
def concentration_gate(spark, sf_dir):
    return wide_of(spark, sf_dir).select("id", gates.concentration_gate(F.col("base"), F.col("concentrated"), F.col("code_counts")).alias("answer"))


GOLD = "g AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS gold FROM orders)"


def gold_of(spark, sf_dir) -> DataFrame:
    gold = F.when(~F.coalesce(F.col("o_orderpriority") == "5-LOW", F.lit(False)), (F.col("o_orderkey") % 3).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), gold.alias("gold"))


def _delta(now: str, was: str) -> str:
    return f"""SELECT '{now}' AS stage, count(*) FILTER (WHERE gold IS NOT NULL) AS total, count(*) FILTER (WHERE {now} = gold) AS correct, count(*) FILTER (WHERE {now} IS DISTINCT FROM {was}) AS changed,
count(*) FILTER (WHERE gold IS NOT NULL AND {now} IS NOT DISTINCT FROM gold AND {was} IS DISTINCT FROM gold) AS gained,
count(*) FILTER (WHERE gold IS NOT NULL AND {was} IS NOT DISTINCT FROM gold AND {now} IS DISTINCT FROM gold) AS regressed FROM z"""


@query(f"WITH {CHAIN}, {GOLD}, z AS (SELECT x4.*, gold FROM x4 LEFT JOIN g USING (id)) SELECT *, gained - regressed AS net FROM ({' UNION ALL '.join(_delta(a, b) for a, b in (('base', 'base'), ('c1', 'base'), ('c2', 'c1'), ('c3', 'c2'), ('c4', 'c3')))})")
def stage_delta(spark, sf_dir):
    wide = gates.chain(wide_of(spark, sf_dir), CONFIG).join(gold_of(spark, sf_dir), "id", "left")
    return metrics.stage_delta(wide, ["base", "c1", "c2", "c3", "c4"])


# --- scores ----------------------------------------------------------------------------------------------------


@query(f"WITH {MAJORITY}, {GOLD} SELECT count(*) AS total, count(*) FILTER (WHERE answer = gold) AS correct, round(avg(CASE WHEN answer = gold THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM m JOIN g USING (id) WHERE gold IS NOT NULL")
def ensemble_accuracy(spark, sf_dir):
    scored = metrics.accuracy(V.majority(votes_of(spark, sf_dir), 1).join(gold_of(spark, sf_dir), "id"), "answer", "gold")
    return scored.withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH {VOTES}, {GOLD} SELECT idx, count(*) FILTER (WHERE answer IS NOT DISTINCT FROM gold) AS correct, count(*) AS total FROM v JOIN g USING (id) GROUP BY idx")
def voter_accuracy(spark, sf_dir):
    return metrics.voter_accuracy(votes_of(spark, sf_dir), gold_of(spark, sf_dir))


@query(f"""WITH {MAJORITY} SELECT count(*) FILTER (WHERE decision = 'majority') AS majority_resolved, count(*) FILTER (WHERE decision = 'fallback') AS fallback_used,
count(*) FILTER (WHERE m.answer IS DISTINCT FROM fallback) AS changed_from_fallback, (SELECT count(*) FROM v WHERE flag = 'R') AS abstained_total FROM m JOIN fb USING (id)""")
def decision_counters(spark, sf_dir):
    votes = votes_of(spark, sf_dir)
    return metrics.decision_counters(V.majority(votes, 1), votes, 1, F.col("flag") == "R")


@query("""WITH s AS (SELECT source AS id, CAST(quality AS VARCHAR) AS answer, toxic = 1 AS truncated FROM documents JOIN labels USING (doc_id))
SELECT id, count(*) AS num_samples, count(*) FILTER (WHERE answer = '1') AS n_correct, count(*) FILTER (WHERE truncated) AS truncated, round(count(*) FILTER (WHERE answer = '1') / count(*), 9) AS pass_rate FROM s GROUP BY id""")
def pass_rate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("id"))
    samples = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("id", F.col("quality").cast("string").alias("answer"), (F.col("toxic") == 1).alias("truncated"))
    gold = docs.select("id").distinct().withColumn("gold", F.lit("1"))
    return metrics.pass_rate(samples, gold).withColumn("pass_rate", F.round("pass_rate", 9))


@query("SELECT count(*) FILTER (WHERE NOT a AND b) AS recovered, count(*) FILTER (WHERE a AND NOT b) AS regressed FROM (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels)")
def retry_counters(spark, sf_dir):
    return metrics.retry_counters(read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("initial_ok"), (F.col("toxic") == 0).alias("final_ok")))


@query(f"WITH {VOTES}, {GOLD} SELECT id, coalesce(bool_or(answer = gold), false) AS hit FROM v JOIN g USING (id) GROUP BY id")
def sample_oracle(spark, sf_dir):
    lists = votes_of(spark, sf_dir).groupBy("id").agg(F.collect_list("answer").alias("votes"))  # seven voters at most
    return metrics.oracle(lists.join(gold_of(spark, sf_dir), "id"), "votes", "gold")


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS texts, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS avg_chars FROM documents GROUP BY lang")
def manifest_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query(r"SELECT CAST(min(n) AS BIGINT) AS min_tokens, round(avg(n), 6) AS avg_tokens, CAST(max(n) AS BIGINT) AS max_tokens FROM (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents)")
def token_stats(spark, sf_dir):
    s = metrics.length_stats(read(spark, sf_dir, "documents"), udfs.count_words(F.col("text")))
    return s.select(long("min_tokens").alias("min_tokens"), F.round("avg_tokens", 6).alias("avg_tokens"), long("max_tokens").alias("max_tokens"))


# --- text ------------------------------------------------------------------------------------------------------

TAILED = r"""d AS (SELECT doc_id, text || [chr(10) || 'Final answer: -' || doc_id, ' We get \boxed{ ' || doc_id || ' } so the ANSWER is ' || (doc_id + 1),
' 정답: 1,' || (doc_id % 900 + 100) || ', then 5', ' final answer is \boxed{' || doc_id || '}' || chr(10) || 'x', ''][doc_id % 5 + 1] AS t FROM documents)"""


def tailed(spark, sf_dir) -> DataFrame:
    """Every whole text with one of five endings."""
    i = F.col("doc_id").cast("string")
    ends = [
        F.concat(F.lit("\nFinal answer: -"), i),
        F.concat(F.lit(" We get \\boxed{ "), i, F.lit(" } so the ANSWER is "), (F.col("doc_id") + 1).cast("string")),
        F.concat(F.lit(" 정답: 1,"), (F.col("doc_id") % 900 + 100).cast("string"), F.lit(", then 5")),
        F.concat(F.lit(" final answer is \\boxed{"), i, F.lit("}\nx")),
        F.lit(""),
    ]
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.element_at(F.array(*ends), (F.col("doc_id") % 5 + 1).cast("int"))).alias("t"))


def _extract_sql(patterns) -> str:
    return "replace(coalesce(" + ", ".join(f"regexp_extract_all(t, '{p}', 1)[-1]" for p in patterns) + "), ',', '')"


@query(f"WITH {TAILED} SELECT doc_id, {_extract_sql(T.BOXED_FIRST)} AS boxed_first, {_extract_sql(T.FINAL_FIRST)} AS final_first, {_extract_sql(T.REWARD)} AS rewarded FROM d")
def extract_cascade(spark, sf_dir):
    t = F.col("t")
    return tailed(spark, sf_dir).select("doc_id", T.extract_boxed_first(t).alias("boxed_first"), T.extract_final_first(t).alias("final_first"), T.extract_reward(t).alias("rewarded"))


def _found(p: str) -> str:
    return f"regexp_matches(right(t, 400), '{p}')"


@query(f"WITH {TAILED} SELECT doc_id, t IS NULL OR t = '' OR NOT ({' OR '.join(map(_found, T.STRICT_TAIL))}) AS strict, t IS NULL OR t = '' OR NOT {_found(T.LOOSE_TAIL[0])} AS loose FROM d")
def risky_tail(spark, sf_dir):
    return tailed(spark, sf_dir).select("doc_id", T.risky(F.col("t")).alias("strict"), T.risky_loose(F.col("t")).alias("loose"))


SHAPES = "p AS (SELECT p_partkey AS id, [' ' || p_partkey || chr(10), '0' || p_partkey, '-0', '+' || p_partkey, p_partkey || '.0', '-' || p_partkey || '.7', '1e3', '1,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'), 'none', p_partkey || 'd', '1_000', '', 'inf', '−' || p_partkey || '°', repeat('9', 25)][p_partkey % 15 + 1] AS s FROM part)"


def shapes(spark, sf_dir) -> DataFrame:
    i = F.col("p_partkey").cast("string")
    forms = [
        F.concat(F.lit(" "), i, F.lit("\n")), F.concat(F.lit("0"), i), F.lit("-0"), F.concat(F.lit("+"), i), F.concat(i, F.lit(".0")), F.concat(F.lit("-"), i, F.lit(".7")), F.lit("1e3"),
        F.concat(F.lit("1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")), F.lit("none"), F.concat(i, F.lit("d")), F.lit("1_000"), F.lit(""), F.lit("inf"), F.concat(F.lit("−"), i, F.lit("°")), F.lit("9" * 25),
    ]
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*forms), (F.col("p_partkey") % 15 + 1).cast("int")).alias("s"))


_INT = "CAST(CAST(replace({0}, '_', '') AS HUGEINT) AS VARCHAR)"
_LOOSE = (
    r"CASE WHEN regexp_full_match({0}, '[+-]?\d+(_\d+)*') THEN " + _INT
    + r" WHEN regexp_full_match({0}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN CAST(CAST(trunc(CAST({0} AS DOUBLE)) AS BIGINT) AS VARCHAR) END"
)


@query(f"""WITH {SHAPES}, q AS (SELECT id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS o, replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), ',', '') AS c FROM p),
r AS (SELECT *, regexp_replace(regexp_replace(replace(c, '−', '-'), '°$', ''), '\\.0+$', '') AS k FROM q)
SELECT id, {_LOOSE.format('c')} AS loose, {_LOOSE.format('o')} AS output, CASE WHEN regexp_full_match(c, '-?\\d+') THEN {_INT.format('c')} END AS strict,
CASE WHEN regexp_full_match(k, '[+-]?\\d+') THEN {_INT.format('k')} END AS curated FROM r""")
def normalize_int(spark, sf_dir):
    s = F.col("s")
    return shapes(spark, sf_dir).select("id", T.canonical(s).alias("loose"), T.canonical_output(s).alias("output"), T.strict_integer(s).alias("strict"), T.curated_integer(s).alias("curated"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id AS VARCHAR) END AS answer, CASE WHEN doc_id % 3 < 2 THEN 'Half of 8 is 4.' END AS solution FROM documents")
def hash_answers(spark, sf_dir):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    tail = F.when(k == 0, i).when(k == 1, F.concat(i, F.lit(".00"))).otherwise("several")
    got = read(spark, sf_dir, "documents").select("doc_id", T.hash_answer(F.concat(F.lit("Half of 8 is <<8/2=4>>4.\n#### "), tail, F.lit("\n"))).alias("h"))
    return got.select("doc_id", "h.answer", "h.solution")


TOK = {c: T.tokens_sql(c) for c in ("text", "d.text", "k.text")}


@query(f"SELECT doc_id, sha256(array_to_string({TOK['text']}, ' ')) AS norm, CAST(len({TOK['text']}) AS BIGINT) AS n FROM documents")
def normalized_texts(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalized(t), 256).alias("norm"), long(F.size(T.tokens(t))).alias("n"))


@query(r"SELECT item_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'Final answer: ' || item_id) AS body, 'system,user,assistant' AS roles FROM benchmark")
def training_rows(spark, sf_dir):
    solution = F.concat(F.lit("  "), "text", F.lit("\n\nFinal answer: 12 \n"))
    rows = read(spark, sf_dir, "benchmark").select("item_id", T.training_messages(F.col("text"), solution, F.col("item_id").cast("string")).alias("m"))
    return rows.select("item_id", F.sha2(F.element_at("m", 3)["content"], 256).alias("body"), F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"))


@query()
def boxed_parse(spark, sf_dir):
    """Nested braces are not regular; tests hold it against a plain parser."""
    i = F.col("doc_id").cast("string")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" \\boxed{\\frac{1}{"), i, F.lit("}} and \\boxed{"), i, F.lit("\\%}")).alias("t"))
    return docs.select("doc_id", F.array_join(udfs.boxed_values("t"), "|").alias("found"), udfs.boxed_answer(F.col("t")).alias("answer"))


# --- curation --------------------------------------------------------------------------------------------------


def corpus(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def official(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


CASCADE = f"""d AS (SELECT doc_id, text, array_to_string({TOK['text']}, ' ') AS norm, len(regexp_extract_all(text, '\\S+')) AS n FROM documents),
f AS (SELECT doc_id, norm, CASE WHEN regexp_matches(text, '{T.VISUAL}') OR contains(text, '@') THEN 'visual_or_url' WHEN n < 64 THEN 'too_short' WHEN n > 900 THEN 'too_long' END AS failed FROM d),
o AS (SELECT norm, min(doc_id) AS first FROM f WHERE failed IS NULL GROUP BY norm)"""


@query(f"WITH {CASCADE} SELECT doc_id, CASE WHEN doc_id > first THEN 'external_duplicate' ELSE failed END AS rejection FROM f LEFT JOIN o USING (norm)")
def rejection_cascade(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    n = udfs.count_words(F.col("text"))
    rules = [("visual_or_url", F.col("text").rlike(T.VISUAL) | F.col("text").contains("@")), ("too_short", n < 64), ("too_long", n > 900)]
    return curation.rejection(rows, rules, T.normalized(F.col("text")), ord_col="id").select(F.col("id").alias("doc_id"), "rejection")


@query(f"WITH {CASCADE} SELECT f.doc_id FROM f JOIN o ON f.norm = o.norm AND f.doc_id = o.first")
def first_accept_dedup(spark, sf_dir):
    n = udfs.count_words(F.col("text"))
    ok = ~F.col("text").rlike(T.VISUAL) & ~F.col("text").contains("@") & n.between(64, 900)
    return curation.first_accepted(corpus(spark, sf_dir), T.normalized(F.col("text")), ok, "id").select(F.col("id").alias("doc_id"))


@query(f"""WITH o AS (SELECT DISTINCT array_to_string({TOK['text']}, ' ') AS norm FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE source = 'src0'))
SELECT doc_id, array_to_string({TOK['text']}, ' ') IN (SELECT norm FROM o) AS known FROM documents""")
def exact_decontam(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    key = T.text_key(T.normalized(F.col("text"))).alias("key")
    known = official(spark, sf_dir).select("text").unionByName(rows.filter("source = 'src0'").select("text")).select(key).distinct()
    return rows.select("id", key).join(known.withColumn("k", F.lit(True)), "key", "left").select(F.col("id").alias("doc_id"), F.coalesce("k", F.lit(False)).alias("known"))


def _grams(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM (SELECT {key}, {TOK['text']} AS w FROM {table}) WHERE len(w) > 0)"""


PAIRS = f"""a AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')}), c AS (SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)),
s AS (SELECT doc_id, item_id, {TOK['d.text']} AS x, {TOK['k.text']} AS y FROM c JOIN documents d USING (doc_id) JOIN benchmark k USING (item_id)),
j AS (SELECT doc_id, item_id, len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))) AS jaccard, least(len(x), len(y)) / greatest(len(x), len(y)) AS ratio FROM s)"""


@query(f"WITH {PAIRS} SELECT doc_id, item_id, round(jaccard, 9) AS jaccard, round(ratio, 9) AS ratio FROM j")
def ngram_candidates(spark, sf_dir):
    docs, items = (stored(nearness.token_table(side)) for side in (corpus(spark, sf_dir), official(spark, sf_dir)))
    pairs = nearness.shingle_pairs(docs, items, store=stored)
    scored = nearness.near_matches(pairs, docs, items, sequences=False, min_jaccard=0.0, min_ratio=0.0, shared_width=5)
    return scored.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), F.round("jaccard", 9).alias("jaccard"), F.round("ratio", 9).alias("ratio"))


def _changed(n: int) -> str:
    """An item with its first n words replaced by 'w1 w2 ...'."""
    return f"SELECT (item_id + 1) * 1000000 + {n} AS doc_id, array_to_string(list_concat(list_transform(range(1, {n} + 1), lambda k: 'w' || k), (regexp_extract_all(text, '\\S+'))[{n} + 1:]), ' ') AS text FROM benchmark"


EDITED = " UNION ALL ".join(map(_changed, range(4)))
EDITED_PAIRS = PAIRS.replace("documents d USING", "edited d USING").replace("FROM documents)", "FROM edited)")


@query(f"WITH edited AS (SELECT doc_id, text FROM documents UNION ALL {EDITED}), {EDITED_PAIRS} SELECT doc_id, item_id, 'near_token' AS kind FROM j WHERE jaccard >= 0.85 AND ratio >= 0.8")
def near_dup_jaccard(spark, sf_dir):
    """Documents, and items with up to three words replaced: on both sides of the thresholds, since items differ in length."""
    items = official(spark, sf_dir)
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    edited = [items.select(((F.col("id") + 1) * 1_000_000 + n).alias("id"), F.array_join(F.concat(F.array(*[F.lit(f"w{k}") for k in range(1, n + 1)]).cast("array<string>"), F.slice(words, F.lit(n + 1), F.greatest(F.size(words) - n, F.lit(0)))), " ").alias("text")) for n in range(4)]
    docs = stored(nearness.token_table(reduce(DataFrame.unionByName, edited, corpus(spark, sf_dir).select("id", "text"))))
    items = stored(nearness.token_table(items))
    near = nearness.near_matches(nearness.prefix_pairs(docs, items), docs, items, sequences=False, shared_width=5)
    return near.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "kind")


QUOTAS = {"en": 12, "fr": 6, "de": 5, "es": 4}


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('2026:curate:' || lang || ':' || text), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM r WHERE k <= CASE lang WHEN 'en' THEN 12 WHEN 'fr' THEN 6 WHEN 'de' THEN 5 WHEN 'es' THEN 4 ELSE 0 END""")
def quota_sample(spark, sf_dir):
    quotas = spark.createDataFrame(list(QUOTAS.items()), "lang string, quota int")
    rows = corpus(spark, sf_dir)
    checks.require_empty(curation.short_strata(rows, "lang", quotas), "strata with too few rows")
    score = T.stable_score(2026, F.concat(F.lit("curate:"), F.col("lang")), F.col("text"))
    return curation.quota_sample(rows, "lang", quotas, score, "id").select(F.col("id").alias("doc_id"), "lang")


@query("SELECT doc_id FROM documents ORDER BY sha256('2026:top:' || text), doc_id LIMIT 50")
def bottom_k_hash(spark, sf_dir):
    return curation.bottom_k(corpus(spark, sf_dir), T.stable_score(2026, "top", F.col("text")), 50, "id").select(F.col("id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def hash_split(spark, sf_dir):
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return curation.hash_split(corpus(spark, sf_dir), F.col("id"), 0.1, toxic).select(F.col("id").alias("doc_id"))


@query("""WITH c AS (SELECT source, count(*) AS q FROM documents GROUP BY 1), e AS (SELECT source, (137 * q) // (SELECT sum(q) FROM c) AS base, (137 * q) % (SELECT sum(q) FROM c) AS rest FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS k FROM e) SELECT source, CAST(base + CASE WHEN k <= 137 - (SELECT sum(base) FROM e) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def quota_apportion(spark, sf_dir):
    return curation.apportioned(metrics.frequencies(read(spark, sf_dir, "documents"), "source"), "source", "n", 137)


@query("SELECT doc_id, lang, CAST(k AS BIGINT) AS training_repeat FROM (SELECT doc_id, lang, unnest(range(1, CASE lang WHEN 'fr' THEN 3 WHEN 'de' THEN 4 ELSE 2 END)) AS k FROM documents)")
def merge_replicate(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    repeats = spark.createDataFrame([("en", 1), ("fr", 2), ("de", 3)], "lang string, repeats int")
    merged = docs.filter("lang = 'en'").unionByName(docs.filter("not lang <=> 'en'"))
    checks.require_empty(checks.duplicate_ids(merged), "duplicate ids")
    return curation.replicate(merged, "lang", repeats).select(F.col("id").alias("doc_id"), "lang", long("training_repeat").alias("training_repeat"))


@query("""WITH s AS (SELECT doc_id % 50 AS id, count(*) FILTER (WHERE quality = 1) AS n_correct FROM labels GROUP BY 1)
SELECT item_id AS id, n_correct FROM benchmark JOIN s ON item_id = s.id WHERE n_correct BETWEEN 2 AND 2000000 AND item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def band_pool(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    screened = labels.groupBy((F.col("doc_id") % 50).alias("id")).agg(F.count_if(F.col("quality") == 1).alias("n_correct"))
    training = labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return curation.band_pool(official(spark, sf_dir).select("id"), screened, training, 2, 2_000_000).select("id", "n_correct")


# --- chats -----------------------------------------------------------------------------------------------------

RENDERED = f"""c AS (SELECT conv_id, string_agg('{chat.START}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body, arg_min(role, turn) AS first,
string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1),
r AS (SELECT conv_id, roles, CASE WHEN first = 'system' THEN '' ELSE '{chat.START}system' || chr(10) || '{chat.DEFAULT_SYSTEM}<|im_end|>' || chr(10) END || body || '{chat.START}assistant' || chr(10) AS t FROM c)"""


@query(f"WITH {RENDERED} SELECT conv_id, sha256(t) AS digest, length(t) AS n FROM r")
def chat_render(spark, sf_dir):
    chats = chat.collect_chats(read(spark, sf_dir, "conversations"))
    text = chat.render(F.col("messages"), generation_prompt=True)
    return chats.select(F.col("id").alias("conv_id"), F.sha2(text, 256).alias("digest"), long(F.length(text)).alias("n"))


@query(f"WITH {RENDERED} SELECT conv_id FROM r WHERE roles <> 'system,user,assistant'")
def chat_shape_check(spark, sf_dir):
    return checks.bad_chats(chat.collect_chats(read(spark, sf_dir, "conversations"))).select(F.col("id").alias("conv_id"))


@query(rf"""WITH {RENDERED}, w AS (SELECT conv_id, len(regexp_extract_all(t, '\S+')) - 1 AS n FROM r),
a AS (SELECT conv_id, turn, regexp_extract_all(text || '<|im_end|>', '\S+') AS w FROM conversations WHERE role = 'assistant'),
l AS (SELECT conv_id, sum(len(w)) AS n_labels, string_agg(array_to_string(w, ' '), ' ' ORDER BY turn) AS labels FROM a GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_tokens, CAST(coalesce(n_labels, 0) AS BIGINT) AS n_labels, sha256(coalesce(labels, '')) AS labels FROM w LEFT JOIN l USING (conv_id)""")
def assistant_mask(spark, sf_dir):
    """Tokens of the rendered chat, the default system turn among them; the SQL counts them in the rendered text, whose
    generation prompt is one token more."""
    chats = chat.collect_chats(read(spark, sf_dir, "conversations")).select("id", chat.label_mask(F.col("messages")).alias("mask"))
    kept = F.transform(F.filter("mask", lambda t: t["label"].isNotNull()), lambda t: t["label"])
    return chats.select(F.col("id").alias("conv_id"), long(F.size("mask")).alias("n_tokens"), long(F.size(kept)).alias("n_labels"), F.sha2(F.array_join(kept, " "), 256).alias("labels"))


CLASSES = r"[a-z]+|[A-Z]+|[0-9]+|[ \t\n]+|[^a-zA-Z0-9 \t\n]"


def class_encoder():
    """Runs of one class of characters, with ids that SQL can tell: first character and length."""
    import re

    pattern = re.compile(CLASSES)

    def encode(text):
        found = [(ord(m[0][0]) * 1000 + len(m[0]), m.span()) for m in pattern.finditer(text)]
        return [i for i, _ in found], [s for _, s in found]

    return encode


_IDS = "list_transform(regexp_extract_all({0}, '" + CLASSES + "'), lambda x: unicode(x) * 1000 + length(x))"
SPACED = "CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN ' ' ELSE '' END || text"


@query(f"""WITH conversations AS (SELECT conv_id, turn, role, {SPACED} AS text FROM conversations), {RENDERED}, i AS (SELECT conv_id, {_IDS.format("t[:length(t) - 22]")} AS ids FROM r),
a AS (SELECT conv_id, turn, {_IDS.format("text || '<|im_end|>' || chr(10)")} AS ids, text[1] = ' ' AS crosses FROM conversations WHERE role = 'assistant'),
l AS (SELECT conv_id, bool_or(crosses) AS crosses, flatten(list(ids ORDER BY turn)) AS labels FROM a GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(ids) > 900 THEN 1 ELSE len(ids) END AS n_tokens, CASE WHEN len(ids) > 900 THEN 0 WHEN NOT coalesce(crosses, false) THEN len(coalesce(labels, [])) END AS n_labels,
CASE WHEN len(ids) > 900 THEN '7' ELSE array_to_string(ids, ',') END AS ids, CASE WHEN len(ids) > 900 THEN '' WHEN NOT coalesce(crosses, false) THEN coalesce(array_to_string(labels, ','), '') END AS labels FROM i LEFT JOIN l USING (conv_id)""".replace("{{", "{"))
def encoded_labels(spark, sf_dir):
    """Ids and labels by a pluggable tokeniser, whose runs of white space cross into turns that begin with a space."""
    spaced = F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 7 == 0), " ").otherwise("")
    turns = read(spark, sf_dir, "conversations").withColumn("text", F.concat(spaced, "text"))
    chats = chat.collect_chats(turns).select("id", chat.encoded_mask(F.col("messages"), class_encoder, 900, 7).alias("m"))
    kept = F.filter("m.labels", lambda x: x != chat.IGNORED)
    return chats.select(F.col("id").alias("conv_id"), long(F.size("m.ids")).alias("n_tokens"), F.when(F.col("m.labels").isNotNull(), long(F.size(kept))).alias("n_labels"), F.array_join("m.ids", ",").alias("ids"), F.array_join(kept, ",").alias("labels"))


@query(r"""WITH n AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations),
b AS (SELECT *, (row_number() OVER (ORDER BY n DESC, sha256(conv_id || ':' || turn)) - 1) // 16 AS batch FROM n), p AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch) / 8) * 8 AS BIGINT) AS padded FROM b)
SELECT conv_id, turn, batch, padded, padded - n AS pads FROM p""")
def padded_batches(spark, sf_dir):
    """Turns in batches of 16 of like length."""
    turns = read(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return chat.length_batches(turns, udfs.count_words(F.col("text")), key, 16).select("conv_id", "turn", "batch", "padded", "pads")


@query("""SELECT vec_id, round(list_avg(e), 9) AS mean, round(list_avg(e[-16:]), 9) AS tail, round(list_min(list_transform(range(0, greatest(1, len(e) - 15), 8), lambda s: list_avg(e[s + 1:s + 16]))), 9) AS min_group, CAST(len(e) AS BIGINT) AS ntok
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def conf_windows(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", T.confidence(F.col("embedding").cast("array<double>"), 16, 8).alias("c"))
    return vectors.select("vec_id", *[F.round(f"c.{n}", 9).alias(n) for n in ("mean", "tail", "min_group")], long("c.ntok").alias("ntok"))


@query("SELECT item_id, 4 AS turns, sha256(text) AS question FROM benchmark")
def prompt_assembly(spark, sf_dir):
    shots = spark.createDataFrame([(0, "1 + 1?", "Final answer: 2")], "ord int, user string, assistant string")
    out = chat.with_shots(read(spark, sf_dir, "benchmark"), shots, T.prompt(F.lit("concise")), "text")
    return out.select("item_id", F.size("messages").alias("turns"), F.sha2(F.element_at("messages", -1)["content"], 256).alias("question"))


# --- checks and rounds -----------------------------------------------------------------------------------------


@query("""SELECT id, side FROM (SELECT DISTINCT o_orderkey AS id, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def id_set_diff(spark, sf_dir):
    return checks.id_differences(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return checks.duplicate_ids(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT l_partkey AS id FROM lineitem GROUP BY 1 HAVING min(l_returnflag) <> max(l_returnflag) OR (count(l_returnflag) > 0 AND count(l_returnflag) < count(*))")
def gold_conflicts(spark, sf_dir):
    return checks.gold_conflicts(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("answer")))


@query("SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def resume_anti(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return rollouts.remaining(events.select("id"), events.filter("event_type = 'purchase'"))


@query(f"WITH {MAJORITY}, g2 AS (SELECT id, max(answer) AS golden FROM v GROUP BY id) SELECT m.id, answer AS rebuilt, golden FROM m JOIN g2 USING (id) WHERE answer IS DISTINCT FROM golden")
def rebuilt_mismatches(spark, sf_dir):
    votes = votes_of(spark, sf_dir)
    return checks.mismatches(V.majority(votes, 1), votes.groupBy("id").agg(F.max("answer").alias("answer")))


@query()
def rollout_rounds(spark, sf_dir):
    """Rounds of the stub provider with an in-process program runner; provider calls have no SQL."""
    from quillsieve.plans.scratch import scratch_folder

    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    config = rollouts.RolloutConfig(samples=3, no_code_rounds=1, repair_rounds=1, seed=5)
    execute = rollouts.programs(runner=printed)
    samples = rollouts.trajectories(questions, rollouts.StubProvider(), scratch_folder(spark), config, execute=execute)
    return rollouts.tool_pool(samples)


def printed(code: str, timeout: float) -> tuple[str, str, str]:
    """What a program of the form print(<integer>) prints; anything else is an error."""
    inside = code.strip().removeprefix("print(").removesuffix(")")
    return ("ok", inside + "\n", "") if inside.lstrip("-").isdigit() else ("error", "", "ZeroDivisionError: division by zero")


def queries():
    from quillsieve.plans import details, roundtrips, streams  # noqa: F401  they add their own

    return QUERIES


def oracle_sql():
    queries()
    return SQL
