import io
import json
import shutil
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from packetloom import serving
from packetloom.functions import scalars as S
from packetloom.operators import sinks, verdict
from packetloom.plans import classify
from packetloom.schemas import FEATURE_TABLE, MODEL_FEATURES, assert_model_input
from packetloom.sources import fetch, frames, pcap, tables

from . import builders as B


def decoded(frame, linktype=1):
    return frames.decode(frame, 0, 1.0, linktype)


def test_ethernet_kinds():
    r = decoded(B.ethernet(0x0800, B.ipv4(6, B.tcp(1234, 1883, 0x12, b"hi"))))
    assert (r["protocol_name"], r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["tcp_flag_syn"], r["tcp_flag_ack"], r["tcp_flag_fin"], r["tcp_payload"]) == ("tcp", "10.0.0.1", "10.0.0.2", 1234, 1883, True, True, False, b"hi")
    assert r["src_mac"] == "02:00:00:00:00:01" and r["is_ipv4"] and r["parse_status"] == "ok"
    r = decoded(B.ethernet(0x0800, B.ipv4(17, B.udp()), tags=(5, 4095)))
    assert (r["vlan_ids"], r["ethertype"], r["is_udp"], r["ethernet_type_or_length"]) == ([5, 4095], 0x0800, True, 0x8100)
    assert decoded(B.ethernet(0x0800, B.ipv4(1, b"")))["is_icmp"] and decoded(B.ethernet(0x0800, B.ipv4(2, b"")))["is_igmp"]
    r = decoded(B.ethernet(0x86DD, B.ipv6(0, b"\x3a\0\0\0\0\0\0\0" + b"\x80\0\0\0")))
    assert (r["is_icmpv6"], r["ip_protocol"], r["ipv6_first_next_header"], r["src_ip"]) == (True, 58, 0, "::1")
    r = decoded(B.ethernet(0x0806, B.arp(2)))
    assert (r["is_arp"], r["arp_op"], r["arp_sha"], r["src_ip"], r["dst_ip"]) == (True, 2, "02:00:00:00:00:01", "10.0.0.1", "10.0.0.2")
    r = decoded(B.ethernet(3, b"\x42\x42\x03"))
    assert (r["is_llc"], r["llc_dsap"], r["is_ethernet_ii"], r["parse_status"]) == (True, 0x42, False, "ok")


@pytest.mark.parametrize(
    ("frame", "linktype", "status", "name"),
    [
        (b"short", 1, "malformed", "ethernet"), (B.ethernet(0x88CC, b""), 1, "unsupported", "lldp"), (B.ethernet(0x88B5, b""), 1, "unsupported", "ethertype_0x88b5"), (B.ethernet(0x0806, B.arp()[:20]), 1, "partial", "ethernet"),
        (B.ethernet(0x0800, b"\x45\0\0"), 1, "partial", "ethernet"), (B.ethernet(0x0800, B.ipv4(6, b"abc")), 1, "partial", "ipv4"), (B.ethernet(0x0800, B.ipv4(17, b"abc")), 1, "partial", "ipv4"), (B.ethernet(0x86DD, B.ipv6(6, b"a")), 1, "partial", "ipv6"),
        (B.ethernet(0x0800, B.ipv4(99, b"")), 1, "unsupported", "ip_proto_99"), (b"\x45", 101, "malformed", None), (B.ipv4(17, B.udp()), 101, "ok", "udp"), (B.ipv6(17, B.udp()), 229, "ok", "udp"), (b"x", 147, "unsupported", "linktype_147"), (B.ethernet(2, b"ab"), 1, "partial", "ieee802.3"),
    ],
)
def test_statuses(frame, linktype, status, name):
    r = decoded(frame, linktype)
    assert (r["parse_status"], r["protocol_name"], r["frame_length"]) == (status, name, len(frame))


def test_unforeseen_is_an_error_row():
    assert decoded(None if False else bytearray(20), "x")["parse_status"] == "unsupported"


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True), (">", True)])
def test_headers(order, nano):
    raw = B.capture([(1.5, b"ab"), (2.25, b"c")], 101, order, nano)
    assert [(t, f, k) for t, f, k in pcap.records(io.BytesIO(raw))] == [(1.5, b"ab", 101), (2.25, b"c", 101)]


def test_cut_records():
    raw = B.capture([(1.0, b"abcd"), (2.0, b"efgh")])
    for cut in (raw[:-1], raw[:-10]):
        with pytest.raises(pcap.BadCapture):
            list(pcap.scan(io.BytesIO(cut)))
        with pytest.raises(pcap.BadCapture):  # also behind the limit
            list(pcap.scan(io.BytesIO(cut), max_packets=1))
    assert len(list(pcap.scan(io.BytesIO(raw), max_packets=1))) == 1
    with pytest.raises(pcap.BadCapture):
        pcap.linktype_of(b"no")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    (root / "a/b").mkdir(parents=True)
    frame = B.ethernet(0x0800, B.ipv4(6, B.tcp()))
    (root / "a/one.pcap").write_bytes(B.capture([(float(i), frame) for i in range(60)]))
    (root / "a/b/two.pcap").write_bytes(B.capture([(float(i), frame) for i in range(10)]))
    (root / "a/b/raw.pcap").write_bytes(B.capture([(1.0, b"x")], 147, ">"))
    (root / "a/b/other.txt").write_text("x")
    return root


def test_data_source(spark, tree):
    df = pcap.packets(spark, str(tree), relativeTo=str(tree))
    assert df.count() == 71
    own = pcap.capture_id("a/one.pcap")
    assert df.where(df.pcap_id == own).count() == 60 and own.startswith("one-")
    assert pcap.packets(spark, str(tree), maxPackets=5).count() == 11
    slim = pcap.packets(spark, str(tree), decode="none")
    assert slim.columns == ["pcap_id", "packet_index", "timestamp", "frame_length", "linktype"] and slim.count() == 71
    assert sorted(map(tuple, pcap.stored_packets(spark, str(tree)).select("packet_index", "src_port").collect()), key=str) == sorted(map(tuple, df.select("packet_index", "src_port").collect()), key=str)
    assert [r.pcap_path.rsplit("/", 1)[1] for r in pcap.discover(spark, str(tree)).collect()] == ["raw.pcap", "two.pcap", "one.pcap"]
    assert {r.pcap_path.rsplit("/", 1)[1]: r.linktype for r in pcap.linktypes(spark, str(tree)).collect()} == {"one.pcap": 1, "two.pcap": 1, "raw.pcap": 147}
    assert pcap.file_hashes(spark, str(tree), "*.txt").first().sha256.startswith("2d711642")


def test_classify(spark, tree):
    out = {r.pcap_id.split("-")[0]: r for r in classify.classify_files(spark, str(tree), lambda df: df.selectExpr("pcap_id", "tcp_ratio AS score"), least=1, k=1).collect()}
    assert (out["one"].status, out["one"].prediction, out["one"].total_windows) == ("OK", "ATTACK", 2)
    assert (out["two"].status, out["two"].prediction, out["two"].total_windows) == ("INSUFFICIENT_DATA", None, 0)
    assert out["raw"].status == "UNSUPPORTED_INPUT"


def test_build_and_resume(spark, tree, tmp_path):
    packets = pcap.packets(spark, f"{tree}/a/one.pcap").unionByName(pcap.packets(spark, f"{tree}/a/b/two.pcap"))
    labels = packets.select("pcap_id").distinct().selectExpr("pcap_id", "concat(pcap_id, '.pcap') AS pcap_path", "'BENIGN' AS binary_label")
    built = sinks.build(packets, labels, f"{tmp_path}/features")
    manifest = spark.createDataFrame(built.collect(), built.schema)
    rows = {r.pcap_id.split("-")[0]: r for r in manifest.collect()}
    assert (rows["one"].output_row_count, rows["two"].output_row_count, rows["two"].status) == (2, 0, "ok")
    again = sinks.build_incremental(packets, labels, f"{tmp_path}/features", manifest)
    assert again.count() == 2 and spark.read.parquet(f"{tmp_path}/features").count() == 2
    sinks.write_manifest(manifest, f"{tmp_path}/manifest")
    assert spark.read.option("header", True).csv(f"{tmp_path}/manifest").count() == 2
    assert tables.features(spark, f"{tmp_path}/features").schema.fieldNames() == FEATURE_TABLE.fieldNames()
    mark = f"{tmp_path}/done.json"
    assert sinks.mark_complete(mark, True, {"rows": 2}) and json.load(open(mark))["rows"] == 2
    assert not sinks.mark_complete(mark, False, {}) and not (tmp_path / "done.json").exists()


def test_a_repeated_build_leaves_the_same_rows(spark, tree, tmp_path):
    packets = pcap.packets(spark, f"{tree}/a/one.pcap")
    labels = packets.select("pcap_id").distinct().selectExpr("pcap_id", "'a/one.pcap' AS pcap_path", "'BENIGN' AS binary_label", "1L AS file_size")
    for _ in range(2):  # as after a build that died before its manifest was there
        (row,) = sinks.build(packets, labels, f"{tmp_path}/f").collect()
        assert (row.status, row.output_row_count, row.windows_written, row.packets_processed) == ("ok", 2, 2, 60)
    short = packets.where("packet_index < 20")  # now it has no window: the old shard goes
    (row,) = sinks.build(short, labels, f"{tmp_path}/f").collect()
    assert (row.status, row.output_row_count) == ("ok", 0) and sinks.shards(spark, f"{tmp_path}/f").isEmpty()
    bad = packets.withColumn("parse_status", F.expr("CASE WHEN packet_index = 30 THEN 'error' ELSE parse_status END"))
    (row,) = sinks.build(bad, labels, f"{tmp_path}/f").collect()
    assert (row.status, row.error_message) == ("error", "packet with status error at 30") and sinks.shards(spark, f"{tmp_path}/f").isEmpty()


@pytest.mark.parametrize("change", ["nothing", "pcap_path", "binary_label", "output_path", "file_size", "feature_strategy_version", "feature_build_strategy_version", "feature_schema_sha256", "policy", "status", "shard", "bytes"])
def test_what_makes_a_build_stale(spark, tree, tmp_path_factory, change):
    folder = tmp_path_factory.mktemp("stale")
    packets = pcap.packets(spark, f"{tree}/a/one.pcap")
    labels = packets.select("pcap_id").distinct().selectExpr("pcap_id", "'a/one.pcap' AS pcap_path", "'BENIGN' AS binary_label", "1L AS file_size")
    built = sinks.build(packets, labels, f"{folder}/f")
    manifest = spark.createDataFrame(built.collect(), built.schema)
    if change in ("pcap_path", "binary_label"):
        labels = labels.withColumn(change, F.lit("ATTACK"))
    elif change == "file_size":
        labels = labels.withColumn(change, F.lit(2).cast("long"))
    elif change == "shard":
        shutil.rmtree(next((folder / "f").glob("pcap_id=*")))
    elif change == "bytes":
        manifest = manifest.withColumn("output_file_size", F.col("output_file_size") + 1)
    elif change != "nothing":
        manifest = manifest.withColumn(change, F.lit("other"))
    assert sinks.resumable(manifest, labels, f"{folder}/f").count() == (change == "nothing")
    if change in ("nothing", "shard"):
        (row,) = sinks.build_incremental(packets, labels, f"{folder}/f", manifest).collect()
        assert (row.status, row.output_row_count, row.resumed) == ("ok", 2, change == "nothing")


def test_a_file_without_a_header_fails_alone(spark, tree, tmp_path):
    shutil.copytree(tree, tmp_path / "t")
    (tmp_path / "t/broken.pcap").write_text("this is no capture")
    out = {r.pcap_id.split("-")[0]: r.status for r in classify.classify_files(spark, f"{tmp_path}/t", lambda df: df.selectExpr("pcap_id", "tcp_ratio AS score"), least=1, k=1).collect()}
    assert out == {"one": "OK", "two": "INSUFFICIENT_DATA", "raw": "UNSUPPORTED_INPUT", "broken": "ERROR"}
    (tmp_path / "u").mkdir()
    (tmp_path / "u/broken.pcap").write_text("")
    assert [r.status for r in classify.classify_files(spark, f"{tmp_path}/u", lambda df: df).collect()] == ["ERROR"]


def test_addresses_in_two_spellings_are_equal(spark):
    pairs = [("2001:db8::1", "2001:0DB8:0:0:0:0:0:1"), ("::", "0:0:0:0:0:0:0:0"), ("::1", "0::0:1"), ("10.0.0.1", "10.0.0.1")]
    for a, b in pairs:
        df = spark.createDataFrame([(a, b)], "a string, b string").select(S.packed_ip(F.col("a")).alias("a"), S.packed_ip(F.col("b")).alias("b")).first()
        assert df.a == df.b and len(df.a) in (4, 16)
    odd = ["", "10.0.0.256", "1:2:3", "::1::", "not an address", "1:2:3:4:5:6:7:8:9", None]
    for x, r in zip(odd, spark.createDataFrame([(x,) for x in odd], "x string").select(S.packed_ip(F.col("x")).alias("p")).collect()):
        assert (None if r.p is None else bytes(r.p)) == (None if x is None else x.encode())


def test_csv_nulls(spark, tmp_path):
    (tmp_path / "s.csv").write_text("pcap_path,source,grouping_key,split,split_origin,strategy_version,seed\na,x,,train,o,v,1\na,x,,test,o,v,\n")
    (row,) = tables.splits(spark, f"{tmp_path}/s.csv").collect()
    assert (row.split, row.seed, row.grouping_key) == ("test", None, None)


def test_contract_and_guards(tmp_path):
    (tmp_path / "c.json").write_text("{}")
    assert tables.contract(f"{tmp_path}/c.json") == {}
    with pytest.raises(ValueError):
        tables.contract(f"{tmp_path}/c.json", "0")
    with pytest.raises(ValueError):
        tables.reject_test_path("data/Test/x")
    assert_model_input(list(MODEL_FEATURES))
    with pytest.raises(ValueError):
        assert_model_input(["pcap_id"])


@pytest.mark.parametrize("uri", ["", "s3://a/b", "gs://a", "gs://a/", "gs:///b", "gs://a/../b", "gs://a//b", "gs://a/b\\c"])
def test_bad_uris(uri):
    with pytest.raises(fetch.InvalidUri):
        fetch.parse_uri(uri)


def test_fetchers(tmp_path, spark):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok/x.pcap").write_bytes(b"12345")
    f = fetch.FolderFetcher(str(tmp_path), "bucket", "ok/", 5)
    assert open(f.fetch("gs://bucket/ok/x.pcap", f"{tmp_path}/to"), "rb").read() == b"12345"
    for uri, kind in (("gs://other/ok/x.pcap", fetch.NotAllowed), ("gs://bucket/no/x.pcap", fetch.NotAllowed), ("gs://bucket/ok/y.pcap", fetch.NotFound)):
        with pytest.raises(kind):
            f.fetch(uri, f"{tmp_path}/to")
    f.most_bytes = 4
    with pytest.raises(fetch.TooLarge):
        f.fetch("gs://bucket/ok/x.pcap", f"{tmp_path}/to")
    (tmp_path / "ok/link").symlink_to("/etc/hostname")
    with pytest.raises(fetch.NotAllowed):
        f.fetch("gs://bucket/ok/link", f"{tmp_path}/to")


def test_http():
    fake = fetch.FakeFetcher({"gs://b/x": b"1"}, {"gs://b/secret"})
    s = serving.server(fake, lambda path: {"status": "OK", "bytes": len(open(path, "rb").read())})
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"

    def post(body):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/predict", json.dumps(body).encode())) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert json.load(urllib.request.urlopen(f"{url}/health")) == {"status": "ok"}
    assert post({"instances": [{"gcs_uri": "gs://b/x"}]}) == (200, {"predictions": [{"status": "OK", "bytes": 1}]})
    assert [post(b)[0] for b in ({}, {"instances": []}, {"instances": [{"gcs_uri": "gs://b/x"}] * 2}, {"instances": [{"gcs_uri": "x"}]})] == [422] * 4
    assert post({"instances": [{"gcs_uri": "gs://b/secret"}]})[0] == 403 and post({"instances": [{"gcs_uri": "gs://b/none"}]})[0] == 404
    s.shutdown()
    with pytest.raises(ValueError):
        serving.Settings(in_flight=0)
    assert verdict.LEAST_WINDOWS == 3
