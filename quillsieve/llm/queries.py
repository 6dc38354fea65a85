"""The queries opN_<name>, with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillsieve.llm import bpe, editprints, hostrules, mixing, pii, qualityfm, repeats, resample, sharding, simhash, urltree, warc, whitening
from quillsieve.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark, sf_dir):
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op2_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = qualityfm.train(docs, table(spark, sf_dir, "labels"))
    return qualityfm.digests(qualityfm.score(docs, machine))


def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER))


def op4_histogram_shards(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), n_shards=24)


def op5_repeats(spark, sf_dir):
    return repeats.digests(repeats.remove(table(spark, sf_dir, "documents")))


def op6_host_rules(spark, sf_dir):
    return hostrules.digests(hostrules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op7_edit_fingerprints(spark, sf_dir):
    return editprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.digests(warc.round_trip(table(spark, sf_dir, "pages")))


def op9_mixing(spark, sf_dir):
    return mixing.digests(mixing.mix(table(spark, sf_dir, "documents")))


def op10_simhash(spark, sf_dir):
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_resample(spark, sf_dir):
    return resample.digests(table(spark, sf_dir, "clicks"), "Asia/Kolkata")


def op12_whitening(spark, sf_dir):
    return whitening.digests(table(spark, sf_dir, "embeddings"))


#: Fixed rules of op13.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op13_url_tree(spark, sf_dir):
    """A page shows the document whose id is the last number of its path, so the document's labels are the URL's:
    bad if toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    document = F.regexp_extract(urltree.path_of(F.col("url")), r"([0-9]+)[^0-9]*$", 1).try_cast("long")
    labelled = pages.withColumn("_doc", document).join(bad.withColumnRenamed("doc_id", "_doc"), "_doc", "left")
    return urltree.digests(urltree.judge(labelled, URL_RULES, bad=F.col("bad")))


NUMBERED = (
    op1_pii, op2_quality_fm, op3_bpe, op4_histogram_shards, op5_repeats, op6_host_rules, op7_edit_fingerprints, op8_warc, op9_mixing, op10_simhash,
    op11_resample, op12_whitening, op13_url_tree,
)


def queries():
    return {f.__name__: f for f in NUMBERED}


def _host_rules_sql(host_rate: float = 0.5) -> str:
    """Measures, host sums, moments and verdicts, with the rules spelled out again."""
    rules = {
        "short": "n_words < 20",
        "repetitive": "100 * n_repeat_words > 30 * n_words",
        "symbols": "10 * n_symbols > word_chars",
        "duplicate_lines": "2 * n_dup_lines > n_lines",
        "word_length": "word_chars > 25 * n_words",
    }
    sums = ", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in rules.items())
    moments = ", ".join(f"avg({name} / n) AS {name}_m, var_pop({name} / n) AS {name}_v" for name in rules)
    strength = "CASE WHEN {0}_v > 0 THEN least(greatest({0}_m * (1 - {0}_m) / {0}_v - 1, 1.0), 1e4) ELSE 1.0 END"
    rates = ", ".join(f"({name} + {name}_m * {strength.format(name)}) / (n + {strength.format(name)})" for name in rules)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT rid, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM g JOIN r USING (rid, g))) GROUP BY 1),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
s AS (SELECT host, count(*) AS n, {sums} FROM m GROUP BY host), k AS (SELECT {moments} FROM s),
v AS (SELECT host, greatest({rates}) > {host_rate} AS rejected FROM s, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT rejected AS kept FROM m JOIN v USING (host)"""


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
j AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p JOIN t USING (h))
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""


def _floor_div_sql(a: str, b: str) -> str:
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"


def _resample_sql(cap: int = 3600, ahead: int = 19800) -> str:
    """Successors by a window; the zone is 19800 seconds ahead all year."""
    area = "2 * v * {0} + " + _floor_div_sql("(w - v) * {0} * {0}", "d")
    return f"""WITH p AS (SELECT client_id, click_id, epoch_us(date_trunc('second', ts)) // 1000000 AS s, CAST(floor(100 * value + 0.5) AS HUGEINT) AS v FROM clicks
  WHERE client_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
o AS (SELECT client_id, s, v FROM p QUALIFY row_number() OVER (PARTITION BY client_id, s ORDER BY click_id DESC NULLS LAST, v DESC) = 1),
n AS (SELECT client_id, s, v, lead(s) OVER g AS t, lead(v) OVER g AS w FROM o WINDOW g AS (PARTITION BY client_id ORDER BY s)),
c AS (SELECT client_id, s, v, w, CAST(t - s AS HUGEINT) AS d, unnest([s - (s + {ahead}) % 3600, s - (s + {ahead}) % 3600 + 3600]) AS b FROM n WHERE t - s <= {cap}),
u AS (SELECT client_id, b, v, w, d, CAST(greatest(0, b - s) AS HUGEINT) AS x, CAST(least(d, b + 3600 - s) AS HUGEINT) AS y FROM c WHERE b < s + d),
r AS (SELECT client_id, b, 0 AS k, y - x AS covered, ({area.format("y")}) - ({area.format("x")}) AS area FROM u UNION ALL SELECT client_id, s - (s + {ahead}) % 3600, 1, 0, 0 FROM o),
z AS (SELECT client_id, b, sum(k) AS k, CAST(sum(covered) AS HUGEINT) AS covered, CAST(sum(area) AS HUGEINT) AS area FROM r GROUP BY 1, 2)
SELECT client_id, CAST(b AS BIGINT) AS bucket_start, CAST(k AS BIGINT) AS n_points, CAST(covered AS BIGINT) AS covered_seconds, CAST(area AS BIGINT) AS area2,
  CAST(CASE WHEN covered > 0 THEN {_floor_div_sql("area", "2 * covered")} END AS BIGINT) AS avg_cents FROM z"""


def oracle_sql():
    """Only where SQL can express the result: the others hash, embed, tokenise, learn or follow a schedule."""
    return {"op6_host_rules": _host_rules_sql(), "op8_warc": WARC_SQL, "op11_resample": _resample_sql()}
