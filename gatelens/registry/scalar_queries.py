"""Queries for the scalar Column builders, each over a whole table."""

from pyspark.sql import functions as F

from gatelens.functions import hashing as hs
from gatelens.functions import scalars as sl
from gatelens.functions import text as tx
from gatelens.operators import labels as lb
from gatelens.operators import voice as vo
from gatelens.registry.base import query

PAD = "chr(9) || '  ' || upper(event_type) || ' X' || chr(10)"


@query("scl01_normalise", "SELECT event_id, event_type || ' x' AS v FROM events")
def normalise(t):
    return t.events.select("event_id", sl.normalise(F.expr(PAD)).alias("v"))


@query(
    "scl02_regexp_find_all",
    "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, regexp_replace(text, '[0-9]+', '#', 'g') AS masked, regexp_matches(text, '[0-9]{4}') AS has_year FROM documents",
)
def find_all(t):
    return t.documents.select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).cast("long").alias("n"),
        F.regexp_replace("text", "[0-9]+", "#").alias("masked"),
        F.regexp_like("text", F.lit("[0-9]{4}")).alias("has_year"),
    )


@query("scl03_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) AS d FROM part")
def distance(t):
    return t.part.select("p_partkey", sl.normalised_distance(F.col("p_name"), F.col("p_type")).alias("d"))


@query("scl04_plain_number", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders")
def plain_number(t):
    text = F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), "x", "")
    return t.orders.select("o_orderkey", sl.plain_number(text).alias("n"))


@query("scl05_rupees_text", "SELECT call_id, (amount_paise // 100) || '.' || lpad('' || (amount_paise % 100), 2, '0') AS v FROM v_calls")
def rupees_text(t):
    return t.v_calls.select("call_id", sl.rupees_text("amount_paise").alias("v"))


@query("scl06_fraction_paise", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 * (event_id % 10) ELSE event_id % 100 END AS v FROM events")
def fraction_paise(t):
    digits = F.expr("CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(event_id % 10 AS STRING) ELSE lpad(CAST(event_id % 100 AS STRING), 2, '0') END")
    return t.events.select("event_id", sl.fraction_paise(digits).alias("v"))


@query(
    "scl07_pointer_escape",
    "SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS e, url AS back, true AS valid, false AS bare FROM pages",
)
def pointer_escape(t):
    escaped = sl.escape_token("url")
    return t.pages.select("page_id", escaped.alias("e"), sl.unescape_token(escaped).alias("back"), sl.is_pointer(F.concat(F.lit("/"), escaped)).alias("valid"), sl.is_pointer("url").alias("bare"))


@query(
    "scl08_pointer_resolve",
    "SELECT call_id, args->>'$.fields[1]' AS second, json_exists(args, '$.to.tags[1]') AS nested FROM v_call_args WHERE json_valid(args)",
)
def pointer_resolve(t):
    rows = t.v_call_args.withColumn("v", F.try_parse_json("args")).where("v IS NOT NULL")
    return rows.select(
        "call_id",
        F.try_variant_get(sl.resolve_pointer(F.col("v"), "/fields/1"), "$", "string").alias("second"),
        sl.resolve_pointer(F.col("v"), "/to/tags/1").isNotNull().alias("nested"),
    )


@query("scl09_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', ts) AS back FROM events")
def rfc3339(t):
    text = sl.rfc3339("ts")
    return t.events.select("event_id", text.alias("text"), sl.parse_rfc3339(text).alias("back"))


@query("scl10_day_start", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
def day_start(t):
    return t.events.select("event_id", sl.day_start("ts").alias("day"))


@query("scl11_canonical_time", "SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def canonical_time(t):
    text = F.when(F.col("event_id") % 3 == 0, sl.rfc3339("ts")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.lit("soon"))
    return t.events.select("event_id", sl.is_canonical_time(text).alias("ok"))


@query("scl12_thousandths", "SELECT clip_id, CAST(trunc(score * 1000) AS BIGINT) AS milli FROM v_scores")
def thousandths(t):
    return t.v_scores.select("clip_id", sl.thousandths("score").alias("milli"))


@query("scl13_decibels", "SELECT event_id, round(10 * log10(greatest(value, 1e-12) / 1e-12), 6) AS db FROM events")
def decibels(t):
    return t.events.select("event_id", F.round(sl.decibels(F.col("value"), F.lit(0.0)), 6).alias("db"))


@query("scl14_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def sha256(t):
    return t.documents.select("doc_id", hs.sha256_hex("text").alias("h"))


@query(
    "scl15_base64url",
    "SELECT doc_id, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS b, sha256(text) AS h FROM documents",
)
def base64url(t):
    coded = sl.base64url(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", coded.alias("b"), F.sha2(sl.base64url_decode(coded), 256).alias("h"))


@query(
    "scl16_key_purpose",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'mandate-signer' WHEN 1 THEN 'tree-head-signer' WHEN 3 THEN 'approval-signer' END AS purpose FROM events",
)
def key_purpose(t):
    key = F.expr("CASE event_id % 5 WHEN 0 THEN 'mandate-signer-' || lpad(hex(event_id), 12, '0') WHEN 1 THEN 'gateway' WHEN 2 THEN 'unknown-' || lpad(hex(event_id), 12, '0') WHEN 3 THEN 'approval-signer' ELSE 'mandate-signer-12' END")
    return t.events.select("event_id", sl.key_purpose(F.lower(key)).alias("purpose"))


@query("scl17_id_tag", "SELECT event_id, 'txn_' || CASE WHEN event_id < 1000000 THEN lpad('' || event_id, 6, '0') ELSE '' || event_id END || substr(sha256('42:txn:' || event_id), 1, 4) AS id FROM events")
def id_tag(t):
    return t.events.select("event_id", sl.id_tag("txn", 42, "event_id").alias("id"))


@query(
    "scl18_html_escape",
    "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM pages",
)
def html_escape(t):
    dirty = F.concat(F.col("html"), F.lit("\u0007"))
    return t.pages.select("page_id", tx.html_escape(F.regexp_replace(dirty, tx.CONTROL, "")).alias("safe"))


@query(
    "scl19_canonical_json",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE '{\"a\":[1,{\"x\":null,\"y\":\"é/\"}],\"b\":' || event_id || ',\"z\":{}}' END AS c FROM events",
)
def canonical_json(t):
    doc = F.expr("'{ \"z\": {}, \"b\": ' || event_id || CASE WHEN event_id % 7 = 0 THEN '.5' ELSE '' END || ', \"a\": [1, {\"y\": \"é/\", \"x\": null}] }'")
    return t.events.select("event_id", hs.canonical_json(F.parse_json(doc)).alias("c"))


@query(
    "scl20_type_guards",
    "SELECT call_id, json_type(args, '$.amount_paise') = 'UBIGINT' AS is_int, json_type(args, '$.amount_paise') = 'BOOLEAN' AS is_bool, coalesce(json_type(args, '$.memo') = 'NULL', false) AS null_memo FROM v_call_args WHERE json_valid(args)",
)
def type_guards(t):
    from gatelens.operators.predicates import json_type_sql

    rows = t.v_call_args.withColumn("v", F.try_parse_json("args")).where("v IS NOT NULL")
    kind = F.expr(json_type_sql("try_variant_get(v, '$.amount_paise', 'variant')"))
    memo = F.expr(json_type_sql("try_variant_get(v, '$.memo', 'variant')"))
    return rows.select("call_id", (kind == "integer").alias("is_int"), (kind == "boolean").alias("is_bool"), F.coalesce(memo == "null", F.lit(False)).alias("null_memo"))


@query("scl21_after_first", "SELECT call_id, CASE WHEN instr(tool, '_') > 0 THEN substr(tool, instr(tool, '_') + 1) ELSE tool END AS rest FROM v_calls")
def after_first(t):
    return t.v_calls.select("call_id", sl.after_first("tool", "_").alias("rest"))


MU = "sign(x) * ln(1 + 255 * abs(x)) / ln(256)"


@query(
    "scl22_mu_law",
    f"SELECT event_id, round(sign(c) * (pow(256.0, abs(c)) - 1) / 255, 6) AS y FROM (SELECT event_id, round_even(({MU} + 1) / 2 * 255, 0) / 255 * 2 - 1 AS c FROM (SELECT event_id, greatest(-1.0, least(1.0, value / 100 - 0.3)) AS x FROM events) a) b",
)
def mu_law(t):
    return t.events.select("event_id", F.round(sl.mu_law(F.col("value") / 100 - 0.3), 6).alias("y"))


# ---------------------------------------------------------------- extension points


@query("udf01_pluggable_fact", "SELECT call_id, amount_paise % 2 = 0 AS fact_even FROM v_calls")
def pluggable_fact(t):
    from gatelens.operators import predicates as p
    from gatelens.operators.evaluate import with_facts
    from gatelens.operators.ruleset import Rule, RuleSet

    rules = RuleSet("own", {}, (Rule("OWN.EVEN", "CAP", 1, "", p.fact("even")),))
    own = t.v_calls.select("call_id", (F.col("amount_paise") % 2 == 0).alias("even"))
    return with_facts(t.v_calls, own, rules).select("call_id", "fact_even")


@query("udf02_pluggable_classifier", "SELECT doc_id, least(1.0, length(text) / 5000) AS score FROM documents")
def pluggable_classifier(t):
    from collections.abc import Iterator

    import pyarrow as pa
    import pyarrow.compute as pc

    from gatelens.operators.scan import score_texts

    @F.arrow_udf("double")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        limit = 5000.0  # a model would be loaded here, once per worker
        for texts in batches:
            share = pc.divide(pc.cast(pc.utf8_length(texts), pa.float64()), limit)
            yield pc.min_element_wise(share, 1.0, skip_nulls=False)

    return score_texts(t.documents.select("doc_id", "text"), classify).select("doc_id", "score")


@query("udf05_label_aggregate", "SELECT pointer, max(level) AS level, coalesce(string_agg(DISTINCT source_kind, ',' ORDER BY source_kind), '') AS kinds FROM v_call_labels GROUP BY pointer")
def label_aggregate(t):
    joined = t.v_call_labels.groupBy("pointer").agg(lb.joined_level(), lb.joined_kinds())
    return joined.select("pointer", "level", F.array_join("kinds", ",").alias("kinds"))


@query(
    "udf06_any_depth_leaves",
    "SELECT event_id AS call_id, '/a/b/c/d/e/f/0/g' AS pointer, event_id AS v FROM events UNION ALL SELECT event_id, '/a/b/x', 1 FROM events",
)
def deep_leaves(t):
    from gatelens.functions.leaves import flatten_args

    doc = F.expr("'{\"a\":{\"b\":{\"x\":1,\"c\":{\"d\":{\"e\":{\"f\":[{\"g\":' || event_id || '}]}}}}}}'")
    rows = t.events.select(F.col("event_id").alias("call_id"), doc.alias("args"))
    return flatten_args(rows, depth=None).select("call_id", "pointer", F.try_variant_get("value", "$", "bigint").alias("v"))


@query("vox02_model_spread", "SELECT label, count(*) AS n, min(len(embedding)) / 16.0 AS shortest_s, max(len(embedding)) / 16.0 AS longest_s FROM embeddings GROUP BY label")
def model_spread(t):
    quality = vo.clip_quality(t.embeddings.select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples")), frame=4, sample_rate=16)
    return quality.join(t.embeddings, F.col("clip_id") == F.col("vec_id")).groupBy("label").agg(
        F.count("*").alias("n"), F.min("duration_s").alias("shortest_s"), F.max("duration_s").alias("longest_s")
    )
