"""Queries for audit logs: trees, proofs, tamper checks."""

from pyspark.sql import functions as F

from gatelens.functions.hashing import leaf_hash, node_hash
from gatelens.operators import audit as au
from gatelens.registry.base import query

LEAF = "sha256(from_hex('00') || encode(payload))"
NODE = "sha256(from_hex('01' || {a} || {b}))"
# all levels, one list per level; pairs are hashed and an odd last node is promoted
LV = (
    "SELECT 0 AS level, (SELECT list(" + LEAF + " ORDER BY idx) FROM v_leaves) AS l UNION ALL SELECT level + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: "
    "CASE WHEN 2 * i + 1 < len(l) THEN " + NODE.format(a="l[2 * i + 1]", b="l[2 * i + 2]") + " ELSE l[2 * i + 1] END) FROM lv WHERE len(l) > 1"
)
NODES = "SELECT level, i - 1 AS \"index\", l[i] AS hash FROM (SELECT level, l, unnest(range(1, len(l) + 1)) AS i FROM lv) z"
SIZE = "(SELECT count(*) FROM v_leaves)"
HEADS = "SELECT idx + 1 AS size FROM v_leaves WHERE (idx + 1) % 16 = 0"
ROOTS = (
    "SELECT h.size, list_reduce(list(n.hash ORDER BY n.level), lambda acc, p: " + NODE.format(a="p", b="acc") + ") AS root FROM heads h JOIN (SELECT unnest(range(0, 40)) AS b) bits ON (h.size >> bits.b) & 1 = 1 "
    "JOIN nodes n ON n.level = bits.b AND n.\"index\" = (h.size >> bits.b) - 1 GROUP BY h.size"
)
PATHS = (
    "SELECT v.idx, string_agg(n.hash, ',' ORDER BY n.level) AS path FROM v_leaves v JOIN nodes n ON n.\"index\" = xor(v.idx >> n.level, 1) GROUP BY v.idx"
)
TREE = {"lv": LV, "nodes": NODES}
ROOTED = {**TREE, "heads": HEADS, "roots": ROOTS}


def _tree(t, **options):
    leaves = au.hash_leaves(t.v_leaves)
    size = t.events.count()
    return au.build_tree(leaves, size, **options), size


@query("aud01_leaf_hash", f"SELECT idx, {LEAF} AS hash FROM v_leaves")
def leaf_hashes(t):
    return au.hash_leaves(t.v_leaves)


@query("aud02_node_hash", "SELECT idx, " + NODE.format(a=LEAF, b=LEAF) + " AS hash FROM v_leaves")
def node_hashes(t):
    leaf = leaf_hash("payload")
    return t.v_leaves.select("idx", node_hash(leaf, leaf).alias("hash"))


@query("aud03_tree_levels", "SELECT * FROM nodes", **TREE)
def tree_levels(t):
    tree, size = _tree(t)
    return au.tree_nodes(tree, size)


@query("aud04_tree_root", "SELECT l[1] AS root FROM lv WHERE len(l) = 1", **TREE)
def tree_root(t):
    return au.tree_root(_tree(t)[0])


@query("aud05_prefix_roots", "SELECT size, root FROM roots", **ROOTED)
def prefix_roots(t):
    return au.prefix_roots(_tree(t)[0], au.head_schedule(t.v_leaves))


@query("aud06_inclusion_proofs", "SELECT idx, path FROM paths", **TREE, paths=PATHS)
def inclusion_proofs(t):
    proofs = au.inclusion_proofs(_tree(t)[0])
    return proofs.select("idx", F.array_join("path", ",").alias("path"))


# clicks carry a path for their neighbour, which must not verify
@query("aud07_verify_inclusion", "SELECT event_id AS idx, event_type <> 'click' AS ok FROM events")
def verify_inclusion(t):
    tree, size = _tree(t, keep=True)
    root = F.broadcast(au.tree_root(tree).withColumn("_k", F.lit(1)))
    kinds = t.events.select(F.col("event_id").alias("idx"), "event_type")
    proofs = au.proofs_beside(tree, kinds).withColumn("_k", F.lit(1)).join(root, "_k")
    used = F.when(F.col("event_type") == "click", F.col("idx").bitwiseXOR(F.lit(1))).otherwise(F.col("idx"))
    return proofs.select(
        "idx",
        au.verify_inclusion(F.col("leaf_hash"), used, F.lit(size), F.col("path"), F.col("root")).alias("ok"),
    )


CONSISTENT = (
    "SELECT h.size, concat_ws(',', CASE WHEN (h.size & (h.size - 1)) <> 0 THEN max(f.hash) END, string_agg(n.hash, ',' ORDER BY n.level)) AS path FROM "
    "(SELECT size, CAST(round(log2(size & -size)) AS BIGINT) AS z FROM heads) h JOIN nodes f ON f.level = h.z AND f.\"index\" = (h.size >> h.z) - 1 "
    "LEFT JOIN nodes n ON n.level >= h.z AND n.\"index\" = xor((h.size - 1) >> n.level, 1) WHERE h.size < " + SIZE + " GROUP BY h.size"
)


@query("aud08_consistency_proofs", "SELECT * FROM cons", **TREE, heads=HEADS, cons=CONSISTENT)
def consistency_proofs(t):
    tree, size = _tree(t)
    due = au.head_schedule(t.v_leaves).where(F.col("size") < size)
    return au.consistency_proofs(tree, due, size).select("size", F.array_join("path", ",").alias("path"))


@query("aud09_verify_consistency", "SELECT size, size % 64 <> 48 AS ok FROM heads", heads=HEADS)
def verify_consistency(t):
    tree, size = _tree(t)
    due = au.head_schedule(t.v_leaves)
    proofs = au.consistency_proofs(tree, due, size).join(au.prefix_roots(tree, due), "size")
    root = au.tree_root(tree).withColumn("_k", F.lit(1)).withColumnRenamed("root", "total_root")
    rows = proofs.withColumn("_k", F.lit(1)).join(root, "_k")
    claimed = F.when(F.col("size") % 64 == 48, F.col("size") - 1).otherwise(F.col("size"))
    return rows.select(
        "size",
        au.verify_consistency(claimed, F.lit(size), F.col("root"), F.col("total_root"), F.col("path")).alias("ok"),
    )


# stored hashes are of the original payload; expensive events were changed afterwards
TAMPERED = """
SELECT event_id AS idx, CASE WHEN value > 250 THEN replace(payload, '"type"', '"kind"') ELSE payload END AS payload, payload AS original FROM events JOIN v_leaves ON idx = event_id
"""
BAD = "SELECT min(idx) AS bad_index FROM tl WHERE payload <> original"


def _tampered(t):
    return t.sql(TAMPERED.strip()).withColumn("leaf_hash", leaf_hash("original")).drop("original")


@query("aud10_first_bad_leaf", "SELECT * FROM bad", tl=TAMPERED, bad=BAD)
def first_bad_leaf(t):
    return au.first_bad_leaf(_tampered(t))


BROKEN = "size % 160 = 0 OR size % 208 = 0 OR size % 240 = 0"


def _stored_heads(t, tree):
    roots = au.prefix_roots(tree, au.head_schedule(t.v_leaves))
    return roots.select(
        "size",
        F.when(F.col("size") % 160 == 0, F.reverse("root")).otherwise(F.col("root")).alias("root"),
        F.when(F.col("size") % 208 == 0, "gateway-tool").otherwise("tree-head-signer").alias("key_id"),
        (F.col("size") % 240 != 0).alias("sig_ok"),
    )


@query("aud11_invalid_heads", f"SELECT size FROM heads WHERE {BROKEN}", heads=HEADS)
def invalid_heads(t):
    tree, size = _tree(t)
    heads = _stored_heads(t, tree)
    return au.invalid_heads(heads, au.prefix_roots(tree, heads.select("size")), size)


@query(
    "aud12_verify_log",
    f"SELECT false AS ok, {SIZE} AS size, b.bad_index, (SELECT count(*) FROM heads WHERE {BROKEN} OR size > b.bad_index) AS n_invalid_heads FROM bad b",
    tl=TAMPERED,
    bad=BAD,
    heads=HEADS,
)
def verify_log(t):
    return au.verify_log(_tampered(t), _stored_heads(t, _tree(t)[0]))


@query(
    "aud13_leaf_page",
    "SELECT idx, payload = original AS intact FROM tl WHERE idx >= 100 ORDER BY idx LIMIT 200",
    tl=TAMPERED,
)
def leaf_page(t):
    return au.leaf_page(_tampered(t), 100, 500).select("idx", "intact")


@query("aud14_head_schedule", "SELECT size FROM heads", heads=HEADS)
def head_schedule(t):
    return au.head_schedule(t.v_leaves)


@query(
    "aud15_canonical_leaf",
    "SELECT idx, payload, sha256(from_hex('00') || encode(payload)) AS leaf_hash FROM (SELECT event_id + 5 AS idx, "
    "'{\"domain\":\"x\",\"inner\":{\"a\":{\"b\":{\"list\":[{\"ok\":1}]}},\"kind\":\"' || event_type || '\"},\"items\":[{},\"x\"],\"n\":' || event_id || '}' AS payload FROM events) e",
)
def canonical_leaf(t):
    events = t.sql(
        "SELECT event_id AS seq, '{\"n\": ' || CAST(event_id AS STRING) || ', \"sig\": \"s\", \"inner\": {\"Token\": 1, \"kind\": \"' || event_type || '\", \"Seed\": 2, \"a\": {\"b\": {\"password\": \"hunter2\", \"list\": [{\"api_key\": \"k\", \"ok\": 1}]}}}, "
        "\"items\": [{\"secret\": \"s\"}, \"x\"], \"domain\": \"x\"}' AS event FROM events"
    ).withColumn("event", F.replace("event", F.lit('"Token": 1, '), F.lit("")))
    return au.canonical_leaves(events, start=5)


@query(
    "aud15_hostile_events",
    "SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN '{\"note\":\"' || chr(57344) || 'number:true\"}' WHEN 1 THEN '{\"a\":[{},2],\"b\":-7}' WHEN 4 THEN '{\"k\":\"a' || chr(92) || '\"b\"}' "
    "WHEN 5 THEN '{\"note\":\"7\",\"s\":\"{' || chr(92) || '\"seed' || chr(92) || '\":1}\"}' END AS payload, CASE event_id % 6 WHEN 2 THEN 'a number with a fraction' WHEN 3 THEN 'not a JSON object' END AS refused FROM events",
)
def hostile_events(t):
    texts = [
        '{"password":"x","note":"\ue000number:true"}',
        '{"b":-7,"a":[{"SECRET":{"deep":[1,{}]}},2]}',
        '{"password":1,"v":1.5}',
        '["password"]',
        '{"pass\\u0077ord":1,"k":"a\\"b"}',
        '{"s":"{\\"seed\\":1}","seed":null,"note":"7"}',
    ]
    event = F.array(*[F.lit(x) for x in texts])[(F.col("event_id") % 6).cast("int")]
    return au.event_payloads(t.events.select(F.col("event_id").alias("seq"), event.alias("event")))


@query("aud16_verify_report", "SELECT true AS ok FROM events HAVING count(*) > 0")
def verify_report(t):
    tree, size = _tree(t, keep=True)
    root = au.tree_root(tree).withColumn("_k", F.lit(1))
    entries = (
        au.proofs_beside(tree, t.v_leaves.where("payload LIKE '%\"domain\":\"purposelock\"%'"))
        .withColumn("_k", F.lit(1))
        .join(F.broadcast(root), "_k")
        .select("idx", F.col("idx").alias("proof_idx"), "payload", F.lit("purposelock").alias("domain"), "leaf_hash", "path", F.lit(size).cast("long").alias("tree_size"), "root")
    )
    head = root.select(F.lit(size).cast("long").alias("size"), "root", F.lit(True).alias("sig_ok"))
    return au.verify_report(entries, head, "purposelock")


@query(
    "aud17_tamper_diff",
    "SELECT idx, original AS left_payload, payload AS right_payload FROM tl WHERE payload <> original",
    tl=TAMPERED,
)
def tamper_diff(t):
    return au.tamper_diff(t.v_leaves, _tampered(t))
