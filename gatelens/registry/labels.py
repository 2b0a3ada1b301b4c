"""Queries for labels, provenance and lineage."""

from pyspark.sql import functions as F

from gatelens.functions.leaves import flatten_args
from gatelens.functions.text import amount_tokens, close_tags
from gatelens.operators import evaluate as ev
from gatelens.operators import labels as lb
from gatelens.operators import predicates as p
from gatelens.operators import provenance as pv
from gatelens.registry.base import query
from gatelens.registry.predicates import DOC

CLOSED = (
    "(SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT DISTINCT unnest(CASE WHEN {tags} LIKE '%PII%' "
    "THEN list_append(string_split({tags}, ','), 'PII') ELSE string_split({tags}, ',') END) AS x) y WHERE x <> '')"
)
TREE = """
SELECT d.call_id, replace(replace(replace(t.fullkey, '$.', '/'), '.', '/'), '[', '/') AS raw, t.type, t.atom, t.value
FROM doc d, json_tree(d.j) t WHERE d.j IS NOT NULL
"""
# the documents hold one key that needs escaping; json_tree quotes it
LEAVES = """
SELECT call_id, replace(replace(replace(raw, ']', ''), '"a/b"', 'a~1b'), '"', '') AS pointer, type, value FROM tree
WHERE (atom IS NOT NULL OR type = 'NULL' OR value IN ('[]', '{}'))
"""
TREES = {"doc": DOC, "tree": TREE, "leaf": LEAVES}
COVER = """
SELECT f.call_id, f.pointer, l.level, l.source_kind, l.source_id, l.tag FROM leaf f
LEFT JOIN v_call_labels l ON l.call_id = f.call_id AND (l.pointer = f.pointer OR starts_with(f.pointer, l.pointer || '/'))
"""


def csv(column):
    return F.array_join(column, ",")


@query(
    "lbl01_label_join",
    "SELECT call_id, max(level) AS level, coalesce(string_agg(DISTINCT source_kind, ',' ORDER BY source_kind), '') AS kinds, "
    "bool_or(tag LIKE 'PII%') IS TRUE AS has_pii, count(DISTINCT tag) AS n_tags FROM v_call_labels GROUP BY call_id",
)
def label_join(t):
    joined = lb.label_join(t.v_call_labels, ["call_id"])
    pii = F.array_contains("tags", "PII")
    return joined.select(
        "call_id",
        "level",
        csv("kinds").alias("kinds"),
        pii.alias("has_pii"),
        (F.size("tags") - pii.cast("int")).cast("long").alias("n_tags"),
    )


@query(
    "lbl01_label_sources",
    "SELECT DISTINCT call_id, source_kind, source_id FROM v_call_labels",
)
def label_sources(t):
    return lb.label_sources(t.v_call_labels, ["call_id"])


PAIR = """
SELECT call_id, max(CASE WHEN pointer = '/subject' THEN level END) AS la, max(CASE WHEN pointer <> '/subject' THEN level END) AS lo,
  string_agg(DISTINCT CASE WHEN pointer = '/subject' THEN source_kind END, ',') AS ka, string_agg(DISTINCT CASE WHEN pointer <> '/subject' THEN source_kind END, ',') AS ko,
  string_agg(DISTINCT CASE WHEN pointer = '/subject' THEN tag END, ',') AS ta, coalesce(string_agg(DISTINCT CASE WHEN pointer <> '/subject' THEN tag END, ','), '') AS tb
FROM v_call_labels GROUP BY call_id
"""


@query(
    "lbl02_label_leq",
    "SELECT l.call_id, l.pointer, l.level <= m.level AND contains(m.ks, l.source_kind) AND (l.tag IS NULL OR contains(m.tg, l.tag)) AS below FROM "
    "(SELECT DISTINCT call_id, pointer, level, source_kind, tag FROM v_call_labels WHERE pointer = '/subject') l JOIN "
    "(SELECT call_id, max(level) AS level, string_agg(DISTINCT source_kind, ',') AS ks, coalesce(string_agg(DISTINCT tag, ','), '') AS tg FROM v_call_labels "
    "WHERE pointer <> '/to' GROUP BY call_id) m ON m.call_id = l.call_id",
)
def label_leq(t):
    labels = t.v_call_labels
    subject = lb.label_join(labels.where("pointer = '/subject'"), ["call_id", "pointer"])
    others = lb.label_join(labels.where("pointer <> '/to'"), ["call_id"])
    a = subject.select("call_id", "pointer", F.struct("level", "kinds", "tags").alias("a"))
    b = others.select("call_id", F.struct("level", "kinds", "tags").alias("b"))
    return a.join(b, "call_id").select(
        "call_id", "pointer", lb.label_leq(F.col("a"), F.col("b")).alias("below")
    )


@query(
    "lbl03_close_tags",
    "SELECT call_id, " + CLOSED.format(tags="tags") + " AS tags FROM (SELECT call_id, coalesce(string_agg(DISTINCT tag, ','), '') AS tags FROM v_call_labels GROUP BY call_id) g",
)
def close_tags_query(t):
    raw = t.v_call_labels.groupBy("call_id").agg(F.collect_set("tag").alias("tags"))
    return raw.select("call_id", csv(close_tags(F.col("tags"))).alias("tags"))


@query(
    "lbl04_flatten_args",
    "SELECT call_id, pointer, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS kind FROM leaf",
    **TREES,
)
def flatten(t):
    return flatten_args(t.v_call_args).select(
        "call_id", "pointer", F.expr(p.json_type_sql("value")).alias("kind")
    )


@query("lbl05_cover_labels", "SELECT DISTINCT * FROM cover", **TREES, cover=COVER)
def cover_labels(t):
    return lb.cover_labels(flatten_args(t.v_call_args), t.v_call_labels).distinct()


@query(
    "lbl06_default_missing_label",
    "SELECT call_id, pointer, max(coalesce(level, 2)) AS level, bool_and(level IS NULL) AS missing, "
    "coalesce(string_agg(DISTINCT source_kind, ',' ORDER BY source_kind), '') AS kinds FROM cover GROUP BY call_id, pointer",
    **TREES,
    cover=COVER,
)
def default_missing_label(t):
    effective = lb.leaf_labels(flatten_args(t.v_call_args), t.v_call_labels)
    return effective.select("call_id", "pointer", "level", "missing", csv("kinds").alias("kinds"))


@query(
    "lbl07_arg_label",
    "SELECT call_id, max(coalesce(level, 2)) AS level, coalesce(string_agg(DISTINCT source_kind, ',' ORDER BY source_kind), '') AS kinds "
    "FROM cover WHERE pointer = '/to' OR starts_with(pointer, '/to/') GROUP BY call_id",
    **TREES,
    cover=COVER,
)
def arg_label(t):
    effective = lb.leaf_labels(flatten_args(t.v_call_args), t.v_call_labels)
    return lb.arg_label(effective, "/to").select("call_id", "level", csv("kinds").alias("kinds"))


TOKENS = """
SELECT task_id, unnest(list_concat(
  ['s:pay', 's:rs', 's:' || split_part(text, ' ', 3), 's:to', 's:sup' || (n % 10) || '@okbank', 's:invoice', 's:inv-' || n || ')'],
  ['i:' || w, 'i:' || c, 'i:' || (n % 10), 'i:' || (n % 10) * 100, 'i:' || n, 'i:' || n * 100, 'i:' || (n % 900), 'i:' || (n % 900) * 100])) AS key
FROM (SELECT task_id, text, CAST(substr(task_id, 2) AS BIGINT) AS n, CAST(floor(CAST(split_part(text, ' ', 3) AS DECIMAL(18,2))) AS BIGINT) AS w,
  CAST(CAST(split_part(text, ' ', 3) AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM v_tasks) z
"""


@query("lbl08_register_task_tokens", "SELECT DISTINCT task_id, key FROM tok", tok=TOKENS)
def register_task_tokens(t):
    return pv.register_task_tokens(t.v_tasks)


@query(
    "lbl09_amount_tokens",
    "SELECT task_id, string_agg(DISTINCT substr(key, 3), ',' ORDER BY substr(key, 3)) AS amounts FROM tok WHERE key LIKE 'i:%' "
    "AND NOT (key = 'i:' || (CAST(substr(task_id, 2) AS BIGINT) % 900) AND NOT list_contains(own, key)) AND NOT (key = 'i:' || (CAST(substr(task_id, 2) AS BIGINT) % 900) * 100 AND NOT list_contains(own, key)) GROUP BY task_id",
    tok="SELECT task_id, key, own FROM (SELECT task_id, unnest(own) AS key, own FROM (SELECT task_id, ['i:' || w, 'i:' || c, 'i:' || (n % 10), 'i:' || (n % 10) * 100, 'i:' || n, 'i:' || n * 100] AS own "
    "FROM (SELECT task_id, CAST(substr(task_id, 2) AS BIGINT) AS n, CAST(floor(CAST(split_part(text, ' ', 3) AS DECIMAL(18,2))) AS BIGINT) AS w, "
    "CAST(CAST(split_part(text, ' ', 3) AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM v_tasks) z) y) x",
)
def amount_tokens_query(t):
    tokens = F.transform(amount_tokens("text"), lambda n: n.cast("string"))
    return t.v_tasks.select("task_id", csv(F.array_sort(tokens)).alias("amounts"))


VALUES = """
SELECT '  ' || CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' ' AS text, CAST(NULL AS BIGINT) AS number, CAST(event_id % 2 AS INT) AS level, 'tool_result' AS source_kind, CASE WHEN event_id % 5 = 0 THEN 'FINANCIAL' END AS tag FROM events
UNION ALL SELECT CAST(NULL AS STRING), CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT), 1, 'system', CAST(NULL AS STRING) FROM events
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) || '@Mail.example', CAST(NULL AS BIGINT), CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END, 'document', CASE WHEN c_acctbal > 5000 THEN 'PII_EMAIL' END FROM customer
"""
REGISTRY = """
SELECT key, max(level) AS level, coalesce(string_agg(DISTINCT source_kind, ',' ORDER BY source_kind), '') AS kinds, max(txt) AS txt FROM (
SELECT CASE WHEN number IS NOT NULL THEN 'i:' || number ELSE 's:' || lower(trim(text)) END AS key, lower(trim(text)) AS txt, * FROM vals) v GROUP BY key
"""


@query("lbl10_register_values", "SELECT key, level, kinds FROM reg", vals=VALUES, reg=REGISTRY)
def register_values(t):
    return pv.register_values(t.sql(VALUES.strip())).select("key", "level", csv("kinds").alias("kinds"))


USER_TASKS = """
SELECT 'T' || CAST(session_id AS STRING) AS task_id, min_by(text, created_ts) AS text, min_by(params, created_ts) AS params FROM v_tasks GROUP BY session_id
"""
USER_TOKENS = TOKENS.replace("FROM v_tasks", "FROM user_tasks").replace(
    "CAST(substr(task_id, 2) AS BIGINT) AS n", "CAST(regexp_extract(text, 'INV-([0-9]+)', 1) AS BIGINT) AS n"
)


def _leaves(t):
    calls = t.v_call_args
    return flatten_args(calls).join(calls.select("call_id", "task_id"), "call_id")


@query(
    "lbl11_label_for_value",
    "SELECT f.call_id, f.pointer, CASE WHEN f.type NOT IN ('VARCHAR', 'UBIGINT') THEN 1 WHEN u.key IS NOT NULL THEN 0 WHEN r.key IS NOT NULL THEN r.level ELSE 2 END AS level, "
    "CASE WHEN f.type NOT IN ('VARCHAR', 'UBIGINT') THEN 'constant' WHEN u.key IS NOT NULL THEN 'task' WHEN r.key IS NOT NULL THEN 'observed' "
    "WHEN f.pointer = '/body' AND h.call_id IS NOT NULL THEN 'contains' ELSE 'model' END AS found FROM "
    "(SELECT l.*, d.task_id, CASE WHEN type = 'UBIGINT' THEN 'i:' || l.value ELSE 's:' || lower(replace(CAST(l.value AS VARCHAR), '\"', '')) END AS key FROM leaf l JOIN doc d ON d.call_id = l.call_id) f "
    "LEFT JOIN (SELECT DISTINCT * FROM user_tok) u ON u.task_id = f.task_id AND u.key = f.key LEFT JOIN reg r ON r.key = f.key "
    "LEFT JOIN (SELECT DISTINCT d.call_id FROM doc d JOIN customer c ON d.tool = 'send_email' AND contains(lower(d.j->>'$.body'), 'c' || c.c_custkey || '@mail.example')) h ON h.call_id = f.call_id",
    **TREES,
    vals=VALUES,
    reg=REGISTRY,
    user_tasks=USER_TASKS,
    user_tok=USER_TOKENS,
)
def label_for_value(t):
    tokens = pv.register_task_tokens(t.sql(USER_TASKS.strip()))
    registry = pv.register_values(t.sql(VALUES.strip()))
    return pv.label_for_values(_leaves(t), tokens, registry).select(
        "call_id", "pointer", "level", "found"
    )


@query(
    "lbl12_substring_taint",
    "SELECT l.call_id, l.pointer, 'c' || c.c_custkey || '@mail.example' AS text FROM leaf l JOIN customer c ON l.type = 'VARCHAR' AND contains(CAST(l.value AS VARCHAR), 'c' || c.c_custkey || '@mail.example')",
    **TREES,
)
def substring_taint(t):
    leaves = flatten_args(t.v_call_args).where(F.schema_of_variant("value") == "STRING")
    values = leaves.select("call_id", "pointer", F.try_variant_get("value", "$", "string").alias("value"))
    registry = t.customer.select(F.concat(F.lit("c"), "c_custkey", F.lit("@mail.example")).alias("text"))
    return pv.substring_taint(values, registry, ["call_id", "pointer"])


# three derived handles per document, each derived from the one before
HANDLES = """
SELECT '$DOC_' || CAST(doc_id + 1 AS STRING) AS handle, CAST(NULL AS STRING) AS parent, 'doc' AS kind, 'document' AS source_kind, 'D' || CAST(doc_id AS STRING) AS ref,
  CAST(NULL AS STRING) AS op, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS level, 'doc ' || CAST(doc_id AS STRING) AS value FROM documents
UNION ALL SELECT '$VAR_' || CAST(3 * doc_id + 1 AS STRING), '$DOC_' || CAST(doc_id + 1 AS STRING), 'var', 'document', 'D' || CAST(doc_id AS STRING), 'payee_vpa', CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END, 'payee' FROM documents
UNION ALL SELECT '$VAR_' || CAST(3 * doc_id + 2 AS STRING), '$VAR_' || CAST(3 * doc_id + 1 AS STRING), 'var', 'document', 'D' || CAST(doc_id AS STRING), 'amount', 2, 'amount' FROM documents
UNION ALL SELECT '$VAR_' || CAST(3 * doc_id + 3 AS STRING), '$VAR_' || CAST(3 * doc_id + 2 AS STRING), 'var', 'document', 'D' || CAST(doc_id AS STRING), 'invoice_id', 2, 'inv' FROM documents
"""
USES = """
SELECT call_id, CASE WHEN call_id % 7 = 3 THEN 'extract_field' ELSE tool END AS tool, CASE WHEN call_id % 7 = 3 THEN '/handle' ELSE '/payee_vpa' END AS pointer,
  CASE WHEN call_id % 5 = 0 THEN '$DOC_' || CAST(call_id % 1500 + 1 AS STRING) WHEN call_id % 5 = 1 THEN 'sup1@okbank' ELSE '$VAR_' || CAST(call_id % 2000 + 1 AS STRING) END AS value FROM v_calls
"""


@query(
    "lbl13_resolve_handles",
    "SELECT u.call_id, u.pointer, u.value AS handle, CASE WHEN h.handle IS NOT NULL AND u.tool <> 'extract_field' THEN h.value ELSE u.value END AS value, h.level, "
    "CASE WHEN h.handle IS NULL THEN 'CORE.HANDLE.UNKNOWN' END AS rule_id FROM uses u LEFT JOIN han h ON h.handle = u.value WHERE u.value LIKE '$%'",
    uses=USES,
    han=HANDLES,
)
def resolve_handles(t):
    return pv.resolve_handles(t.sql(USES.strip()), t.sql(HANDLES.strip()))


@query(
    "lbl14_handle_roots",
    "SELECT handle, '$DOC_' || (CAST(substr(ref, 2) AS BIGINT) + 1) AS root, CASE op WHEN 'payee_vpa' THEN 1 WHEN 'amount' THEN 2 WHEN 'invoice_id' THEN 3 ELSE 0 END AS depth FROM han",
    han=HANDLES,
)
def handle_roots(t):
    return pv.handle_roots(t.sql(HANDLES.strip()))


LINEAGE = """
SELECT u.call_id, 'src:document:' || h.ref AS src, CASE WHEN h.kind = 'var' THEN 'var:' || h.handle ELSE 'sink:upi.' || c.tool END AS dst, CASE WHEN h.kind = 'var' THEN 'extract' ELSE 'arg:' || u.pointer END AS op
FROM uses u JOIN han h ON h.handle = u.value JOIN v_calls c ON c.call_id = u.call_id
UNION SELECT u.call_id, 'var:' || h.handle, 'sink:upi.' || c.tool, 'arg:' || u.pointer FROM uses u JOIN han h ON h.handle = u.value JOIN v_calls c ON c.call_id = u.call_id WHERE h.kind = 'var'
UNION SELECT l.call_id, 'src:' || l.source_kind || ':' || l.source_id, 'sink:upi.' || c.tool, 'arg:' || l.pointer FROM v_call_labels l JOIN v_calls c ON c.call_id = l.call_id
  WHERE NOT EXISTS (SELECT 1 FROM uses u WHERE u.call_id = l.call_id AND u.pointer = l.pointer AND u.value LIKE '$%')
"""


def _lineage(t):
    uses = t.sql(USES.strip()).where(F.startswith("value", F.lit("$")))
    return pv.lineage(
        t.v_calls.select("call_id", "server", "tool"),
        t.v_call_labels,
        uses.select("call_id", "pointer", F.col("value").alias("handle")),
        t.sql(HANDLES.strip()).select("handle", "kind", "source_kind", "ref", "op"),
    )


@query("lbl15_lineage_edges", "SELECT * FROM lin", uses=USES, han=HANDLES, lin=LINEAGE)
def lineage_edges(t):
    return _lineage(t)[1]


@query(
    "lbl15_lineage_nodes",
    "SELECT DISTINCT call_id, src AS id, CASE WHEN src LIKE 'var:%' THEN 'derivation' ELSE 'source' END AS kind, CAST(NULL AS INT) AS level FROM lin "
    "UNION ALL SELECT c.call_id, 'sink:upi.' || c.tool, 'sink', coalesce(max(l.level), 0) FROM v_calls c LEFT JOIN v_call_labels l ON l.call_id = c.call_id GROUP BY c.call_id, c.tool",
    uses=USES,
    han=HANDLES,
    lin=LINEAGE,
)
def lineage_nodes(t):
    return _lineage(t)[0]


RESULTS = """
SELECT event_id AS result_id, CASE event_type WHEN 'click' THEN 'crm' WHEN 'view' THEN 'files' WHEN 'error' THEN 'mail' WHEN 'signup' THEN 'web' ELSE 'upi' END AS server,
  CASE event_type WHEN 'click' THEN 'read_customer_data' WHEN 'view' THEN 'read_document' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'read_inbox' ELSE 'send_email' END WHEN 'signup' THEN 'fetch' ELSE 'pay_upi' END AS tool,
  'r' || CAST(event_id AS STRING) AS ref, CASE WHEN event_id % 3 = 0 THEN 'user_upload' WHEN event_id % 3 = 1 THEN 'external' END AS trust, 'T' || CAST(user_id AS STRING) AS task_id FROM events
"""


@query(
    "lbl16_label_results",
    "SELECT result_id, CASE WHEN server = 'crm' OR server = 'upi' OR tool = 'send_email' OR (server = 'files' AND trust = 'user_upload') THEN 1 ELSE 2 END AS level, "
    "CASE WHEN server = 'crm' THEN 'tool_result' WHEN server = 'files' THEN 'document' WHEN tool = 'read_inbox' THEN 'email' WHEN server = 'web' THEN 'model' ELSE 'system' END AS source_kind, "
    "CASE WHEN server = 'crm' THEN 'crm' WHEN server = 'files' OR tool = 'read_inbox' THEN ref WHEN server = 'web' THEN task_id ELSE server || '.' || tool END AS source_id FROM res",
    res=RESULTS,
)
def label_results(t):
    return lb.label_results(t.sql(RESULTS.strip())).select(
        "result_id", "level", "source_kind", "source_id"
    )


@query(
    "lbl18_display_labels",
    "SELECT call_id, split_part(pointer, '/', 2) AS arg, CASE max(level) WHEN 2 THEN 'UNTRUSTED_EXTERNAL:' || coalesce(min(CASE WHEN source_kind <> 'model' THEN source_kind END), 'model') "
    "WHEN 1 THEN 'TRUSTED_SYSTEM' ELSE 'TRUSTED_USER' END AS shown FROM v_call_labels GROUP BY call_id, split_part(pointer, '/', 2)",
)
def display_labels(t):
    return lb.display_labels(t.v_call_labels)


PINS = "SELECT *, CASE WHEN call_id % 20 = 0 THEN 'K' || CAST(call_id AS STRING) END AS pinned_task, call_id % 40 = 0 AS pin_ok FROM v_calls"


@query(
    "lbl19_bind_task",
    "SELECT p.call_id, CASE WHEN pinned_task IS NULL THEN a.task_id WHEN pin_ok THEN x.task_id END AS bound_task, CASE WHEN pinned_task IS NULL THEN a.purpose WHEN pin_ok THEN x.purpose END AS purpose, "
    "CASE WHEN CASE WHEN pinned_task IS NULL THEN a.task_id WHEN pin_ok THEN x.task_id END IS NULL THEN 'CORE.TASK.UNBOUND' END AS rule_id "
    "FROM pins p ASOF LEFT JOIN v_tasks a ON a.session_id = p.session_id AND a.created_ts <= p.ts LEFT JOIN v_tasks x ON x.task_id = p.pinned_task",
    pins=PINS,
)
def bind_task(t):
    tasks = t.v_tasks.select("task_id", "session_id", "created_ts", "purpose", "category")
    calls = t.sql(PINS).select("call_id", "session_id", "ts", "pinned_task", "pin_ok")
    return pv.bind_tasks(calls, tasks).select("call_id", "bound_task", "purpose", "rule_id")


@query(
    "lbl20_derive_label",
    "SELECT child, max(level) AS level, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ("
    "SELECT CAST(l_orderkey AS BIGINT) AS child, CAST(l_partkey % 2 AS INT) AS level, l_returnflag AS kind FROM lineitem UNION ALL "
    "SELECT o_orderkey, 2, 'order' FROM orders WHERE o_orderstatus = 'P') x GROUP BY child",
)
def derive_label(t):
    edges = t.lineitem.select(
        F.col("l_orderkey").alias("child"), F.concat_ws("/", "l_partkey", "l_returnflag").alias("parent")
    ).distinct()
    none = F.lit(None).cast("string")
    labels = t.lineitem.select(
        F.concat_ws("/", "l_partkey", "l_returnflag").alias("parent"),
        (F.col("l_partkey") % 2).cast("int").alias("level"),
        F.col("l_returnflag").alias("source_kind"),
        none.alias("source_id"),
        none.alias("tag"),
    ).distinct()
    extra = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("child"),
        F.lit(2).alias("level"),
        F.lit("order").alias("source_kind"),
        none.alias("source_id"),
        none.alias("tag"),
    )
    return lb.derive_label(edges, labels, extra).select("child", "level", csv("kinds").alias("kinds"))
