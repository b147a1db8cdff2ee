"""SQL pieces that several reference statements share."""

DAY0 = "TIMESTAMP '2024-01-01'"


def slug(c: str) -> str:
    return f"regexp_replace(lower({c}), '[ #]+', '_', 'g')"


def node(id_: str, type_: str, name: str, table: str, updated: str = DAY0) -> str:
    return f"SELECT {id_} AS id, '{type_}' AS type, CAST({name} AS VARCHAR) AS name, {updated} AS updated_at FROM {table}"


def days(c: str) -> str:
    return f"{DAY0} + to_days(CAST({c} % 30 AS INTEGER))"


NODES = "nodes AS (" + " UNION ALL ".join([
    node("'person:' || c_custkey", "Person", "c_name", "customer", days("c_custkey")),
    node("'org:region:' || r_regionkey", "Organization", "r_name", "region"),
    node("'org:nation:' || n_nationkey", "Organization", "n_name", "nation"),
    node("'org:supplier:' || s_suppkey", "Organization", "s_name", "supplier", days("s_suppkey")),
    node(f"'org:segment:' || {slug('m')}", "Organization", "m", "(SELECT DISTINCT c_mktsegment AS m FROM customer)"),
    node("'asset:' || p_partkey", "Asset", "p_name", "part", days("p_partkey")),
    node("'order:' || o_orderkey", "Event", "NULL", "orders", "o_orderdate"),
    node("'event:' || event_id", "Event", "NULL", "events", "ts"),
    node("'message:' || conv_id || ':' || turn", "Message", "NULL", "conversations"),
    node("'doc:' || doc_id", "Document", "NULL", "documents"),
    node("'page:' || page_id", "Document", "NULL", "pages"),
    node(f"'topic:brand:' || {slug('b')}", "Topic", "b", "(SELECT DISTINCT p_brand AS b FROM part)"),
    node("'topic:lang:' || l", "Topic", "l", "(SELECT DISTINCT lang AS l FROM documents WHERE lang IS NOT NULL)"),
]) + ")"


def edge(rel: str, src: str, dst: str, table: str) -> str:
    return f"SELECT {src} AS src, '{rel}' AS rel, {dst} AS dst FROM {table}"


EDGES = "edges AS (SELECT *, 'edge_' || substring(sha256(src || '|' || rel || '|' || dst || '|'), 1, 24) AS id FROM (" + " UNION ALL ".join([
    edge("MEMBER_OF", "'person:' || c_custkey", "'org:nation:' || c_nationkey", "customer"),
    edge("MEMBER_OF", "'org:nation:' || n_nationkey", "'org:region:' || n_regionkey", "nation"),
    edge("MEMBER_OF", "'org:supplier:' || s_suppkey", "'org:nation:' || s_nationkey", "supplier"),
    edge("MEMBER_OF", "'person:' || c_custkey", f"'org:segment:' || {slug('c_mktsegment')}", "customer"),
    edge("PURCHASED", "'person:' || o_custkey", "'asset:' || l_partkey", "(SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"),
    edge("ASSIGNED_TO", "'order:' || o_orderkey", "'person:' || o_custkey", "orders"),
    edge("RELATED_TO", "'order:' || l_orderkey", "'asset:' || l_partkey", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    edge("PART_OF", "'asset:' || p_partkey", f"'topic:brand:' || {slug('p_brand')}", "part"),
    edge("TAGGED", "'doc:' || doc_id", "'topic:lang:' || lang", "documents WHERE lang IS NOT NULL"),
    edge("REPORTS_TO", "'person:' || c_custkey", "'person:' || (c_custkey // 4)", "customer WHERE c_custkey > 0"),
]) + "))"
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"
BOTH = "both_ways AS (SELECT src AS at_id, dst AS other, rel, 'out' AS direction FROM edges UNION ALL SELECT dst, src, rel, 'in' FROM edges)"
TYPES = "(VALUES ('Person'), ('Organization'), ('Document'), ('Message'), ('Event'), ('Asset'), ('Topic')) t(type)"
