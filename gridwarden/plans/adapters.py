"""The test tables seen as the library's domain tables. Each is one projection."""

from pyspark.sql import functions as F

from gridwarden.sinks import to_table


def table(spark, sf_dir, name):
    # The files hold times without a zone; they are taken as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col):
    return (F.unix_micros(F.col(col).cast("timestamp")) / 1000000).alias("ts")


def host(col):
    u = F.col(col).cast("bigint")
    return F.concat(
        F.lit("10."), (u % 4).cast("string"), F.lit("."),
        F.floor(u / 250).cast("string"), F.lit("."), (u % 250).cast("string"))


_SERVICE = """CASE event_id % 6 WHEN 0 THEN 'ssl,modbus' WHEN 1 THEN 'SSL' WHEN 2 THEN ''
              WHEN 3 THEN 'ssh' WHEN 4 THEN 'http' END"""
_PORT = """CASE event_id % 6 WHEN 0 THEN 502 WHEN 1 THEN 443 WHEN 2 THEN 2404
           WHEN 3 THEN 22 WHEN 4 THEN 80 ELSE 53 END"""
_RESPONDER = """CASE WHEN event_id % 7 = 0 THEN '8.8.8.8'
                ELSE concat('192.168.1.', event_id % 250) END"""


def conn(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        seconds("ts"), host("user_id").alias("orig_h"), F.expr(_RESPONDER).alias("resp_h"),
        F.expr(_PORT).alias("resp_p"),
        F.expr("CASE WHEN event_id % 6 = 5 THEN 'udp' ELSE 'tcp' END").alias("proto"),
        F.expr(_SERVICE).alias("service"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN 'S0' ELSE 'SF' END").alias("conn_state"))


def agent_conn(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("agent-"), F.col("user_id") % 20).alias("agent_id"),
        seconds("ts"), F.expr(_PORT).alias("resp_p"))


def alerts(spark, sf_dir):
    return to_table(table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), seconds("ts"),
        F.expr("""CASE event_type WHEN 'error' THEN 'OTPolicy::Unauthorized_Modbus_Write'
            WHEN 'view' THEN 'Signatures::Sensitive_Signature'
            WHEN 'click' THEN 'ScanDetect::Possible_Port_Scan'
            ELSE concat('Note::', event_type) END""").alias("note_type"),
        F.concat_ws(" ", F.lit("event"), "event_type", "props").alias("message"),
        host("user_id").alias("src_h"), F.expr(_RESPONDER).alias("dst_h"),
        F.expr("CASE WHEN event_type IN ('error', 'view') THEN 'high' ELSE 'medium' END")
        .alias("severity"),
        F.expr("CASE WHEN event_id % 6 IN (0, 2) THEN 'OT' ELSE 'IT' END").alias("zone"),
        F.lit("zeek").alias("source")), "alerts")


def alert_actions(spark, sf_dir):
    return to_table(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        ((F.col("o_orderkey") % 5000) * 2).cast("string").alias("alert_id"),
        F.expr("""CASE o_orderstatus WHEN 'F' THEN 'block' WHEN 'O' THEN 'allow'
            ELSE 'investigate' END""").alias("action"),
        F.concat(F.lit("analyst"), F.col("o_custkey") % 5).alias("actor"),
        F.col("o_orderpriority").alias("notes"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'stubbed' ELSE 'not_applicable' END")
        .alias("enforcement_status"),
        F.lit("").alias("enforcement_detail"), seconds("o_orderdate")), "alert_actions")


def agents(spark, sf_dir):
    return to_table(table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("agent_id"),
        F.concat(F.lit("h"), F.col("user_id")).alias("hostname"),
        host("user_id").alias("ip"), F.col("event_type").alias("os"),
        F.expr("CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('g', user_id % 7) END")
        .alias("agent_group"),
        F.concat(F.lit("1."), (F.col("event_id") % 4)).alias("version"),
        seconds("ts").alias("last_checkin")), "agents")


_PRIORITY_CLASS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical'
    WHEN '2-HIGH' THEN 'high' ELSE 'low' END"""


def asset_admin(spark, sf_dir):
    return to_table(table(spark, sf_dir, "orders").select(
        host("o_custkey").alias("ip"),
        F.concat(F.lit("team"), F.col("o_orderkey") % 9).alias("owner"),
        F.expr(_PRIORITY_CLASS).alias("criticality"),
        F.col("o_orderstatus").alias("tags"), F.col("o_orderpriority").alias("notes"),
        F.lit("admin").alias("actor"), seconds("o_orderdate")), "asset_admin")


def ip_policies(spark, sf_dir):
    return to_table(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), host("o_custkey").alias("ip"),
        F.expr("""CASE o_orderstatus WHEN 'F' THEN 'blacklist' WHEN 'O' THEN 'whitelist'
            ELSE 'quarantine' END""").alias("policy"),
        F.lit("admin").alias("actor"), F.col("o_orderpriority").alias("notes"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'not_applicable' ELSE 'stubbed' END")
        .alias("enforcement_status"),
        F.lit("").alias("enforcement_detail"), seconds("o_orderdate")), "ip_policies")


def policy_requests(spark, sf_dir):
    """A request two days after each order's date, some with an unknown policy."""
    return table(spark, sf_dir, "orders").select(
        host("o_custkey").alias("ip"),
        F.expr("""CASE o_orderkey % 5 WHEN 0 THEN 'blacklist' WHEN 1 THEN 'whitelist'
            WHEN 2 THEN 'quarantine' WHEN 3 THEN 'none' ELSE 'drop' END""").alias("policy"),
        F.concat(F.lit("analyst"), F.col("o_orderkey")).alias("actor"),
        F.col("o_orderpriority").alias("notes"),
        F.expr("o_orderkey % 3 = 0").alias("confirm_critical"),
        F.expr("CAST(unix_seconds(CAST(o_orderdate AS timestamp)) + 172800 AS double)")
        .alias("ts"))


def action_requests(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("alert_id"),
        host("o_custkey").alias("src_h"),
        F.concat(F.lit("192.168.1."), F.col("o_custkey") % 250).alias("dst_h"),
        F.expr("""CASE o_orderkey % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'block'
            WHEN 2 THEN 'investigate' ELSE 'close' END""").alias("action"),
        F.concat(F.lit("analyst"), F.col("o_custkey") % 5).alias("actor"),
        F.col("o_orderpriority").alias("notes"), seconds("o_orderdate"))


def asset_requests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.expr("""CASE WHEN c_custkey % 11 = 0 THEN concat('10.0.0.', c_custkey + 250)
            ELSE concat(' 10.', c_custkey % 256, '.', c_nationkey, '.7 ') END""").alias("ip"),
        F.expr("CASE c_custkey % 7 WHEN 0 THEN 'OT' WHEN 1 THEN 'DMZ' ELSE 'IT' END")
        .alias("zone"),
        F.col("c_name").alias("owner"),
        F.expr("""CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'MACHINERY'
            THEN 'high' WHEN 'FURNITURE' THEN 'urgent' ELSE '' END""").alias("criticality"),
        F.col("c_mktsegment").alias("tags"), F.lit("").alias("notes"),
        F.lit("admin").alias("actor"), F.col("c_custkey").cast("double").alias("ts"))


def checkins(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("agent_id"),
        F.concat(F.lit("h"), F.col("user_id")).alias("hostname"),
        F.expr("""CASE event_id % 9 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '224.0.0.5'
            WHEN 2 THEN '::1' WHEN 3 THEN concat('fe80::', hex(user_id)) WHEN 4 THEN 'n/a'
            WHEN 5 THEN concat('8.8.4.', user_id % 256)
            ELSE concat('10.9.', floor(user_id / 250), '.', user_id % 250) END""").alias("ip"),
        F.col("event_type").alias("os"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'plant' END").alias("agent_group"),
        F.lit(None).cast("string").alias("version"), seconds("ts"))


def agent_batches(spark, sf_dir):
    """One report per event: up to two alerts and a count map."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("agent-"), F.col("user_id")).alias("agent_id"),
        F.expr("""transform(
            CASE event_type WHEN 'error' THEN sequence(0, 1) WHEN 'click' THEN sequence(0, 0)
                 ELSE array() END,
            i -> named_struct('ts', CAST(event_id * 2 + i AS double),
                'note_type', concat('Agent::', event_type), 'message', props,
                'src_h', CAST(NULL AS string), 'dst_h', concat('10.0.0.', i),
                'severity', CASE WHEN i = 1 THEN 'high' END,
                'zone', CASE WHEN event_id % 2 = 0 THEN 'OT' END))""").alias("alerts"),
        F.expr("""map_from_arrays(
            array(concat(CASE WHEN event_id % 4 = 0 THEN '' ELSE 'OT' END, '|modbus'),
                  concat('IT|', CASE WHEN event_id % 3 = 0 THEN '' ELSE 'http' END), 'bare'),
            array(event_id % 10, user_id, CAST(1 AS bigint)))""").alias("conn_counts"),
        seconds("ts"))


def software(spark, sf_dir):
    """Each order line is a product seen on the supplier's host."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    products = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.lit("APP").alias("software_type"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("unparsed_version"))
    # The join moves numbers; texts are made of them after it.
    return to_table(lines.join(products, "l_partkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        seconds("l_shipdate"), host("l_suppkey").alias("host"), "software_type", "name",
        "unparsed_version"), "software")


def cve_items(spark, sf_dir):
    """A vulnerability per product name and type, listed by its lowest part number."""
    return table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(
        F.min("p_partkey").alias("pos"), F.max("p_retailprice").alias("price"),
    ).select(
        "pos", F.concat(F.lit("CVE-"), F.col("pos")).alias("cve_id"),
        F.col("p_name").alias("keyword"),
        F.concat(F.lit("Overflow in "), "p_name", F.lit(" as used by "), "p_type").alias(
            "description"),
        F.round((F.col("price") - 900) / 10, 1).alias("cvss_score"))


def technique_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("pos"),
        F.concat(F.lit("T"), F.col("item_id") + 1000).alias("technique_id"),
        F.concat(F.lit("Technique "), F.col("item_id")).alias("name"),
        F.concat(F.lit("tactic-"), F.col("item_id") % 12).alias("tactic"),
        F.concat(F.col("text"), F.lit(" event "), F.element_at(F.array(
            F.lit("error"), F.lit("view"), F.lit("unauthorized modbus write"),
            F.lit("signature")), (F.col("item_id") % 4 + 1).cast("int"))).alias("description"))


def scored_matches(spark, sf_dir):
    """Rows shaped like vulnerability matches, one per order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
            "source_key"),
        F.concat(F.lit("product "), F.col("l_partkey") % 40).alias("software"),
        F.concat(F.lit("Technique "), F.col("l_suppkey") % 30).alias("technique_name"),
        F.concat(F.lit("tactic-"), F.col("l_linenumber") % 5).alias("tactic"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") * 100).alias("cvss_score"))


def scan_events(spark, sf_dir):
    """One event a second from three sources over a thousand ports."""
    return table(spark, sf_dir, "events").select(
        (F.lit(1700000000.0) + F.col("event_id")).alias("ts"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 3).alias("orig_h"),
        F.expr(_RESPONDER).alias("resp_h"),
        ((F.col("event_id") * 7) % 1000).cast("int").alias("resp_p"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END").alias("proto"))


def modbus(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        seconds("ts"), host("user_id").alias("orig_h"), F.expr(_RESPONDER).alias("resp_h"),
        F.expr("""CASE event_type WHEN 'error' THEN 'WRITE_SINGLE_COIL'
            WHEN 'click' THEN 'WRITE_SINGLE_COIL' ELSE 'READ_COILS' END""").alias("func"),
        F.expr("event_type <> 'click' OR event_id % 2 = 0").alias("is_request"),
        (F.col("event_id") % 100).alias("address"))


def payloads(spark, sf_dir):
    """Requests from pages, payload text from documents and conversation turns."""
    def rows(df, key, port, payload, request):
        return df.select(
            F.col(key).cast("double").alias("ts"),
            F.concat(F.lit("10.1.0."), F.col(key) % 250).alias("src_h"),
            F.lit("192.168.1.10").alias("dst_h"), F.lit("tcp").alias("proto"),
            port.alias("dst_port"), payload.alias("payload"), request.alias("http_request"))

    none = F.lit(None).cast("string")
    pages = rows(table(spark, sf_dir, "pages"), "page_id", F.lit(80), F.col("html"), F.col("url"))
    docs = rows(table(spark, sf_dir, "documents"), "doc_id", F.lit(80), none, F.col("text"))
    turns = rows(
        table(spark, sf_dir, "conversations"), "conv_id",
        F.expr("CASE WHEN role = 'user' THEN 21 ELSE 502 END"),
        F.expr("""CASE WHEN role = 'user' THEN concat(upper(role), ' ', text)
            ELSE concat('\\0', text, '\\b\\0') END"""), none)
    return pages.unionByName(docs).unionByName(turns)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
