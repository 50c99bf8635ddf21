import pytest

from packetloom import cli, contracts

from . import builders as B


def test_commands():
    assert len(cli.COMMANDS) >= 36 and {"build-manifests", "classify-pcap", "run-final-test", "prepare-hgb-sensitivity"} <= set(cli.COMMANDS)


def test_contracts(tmp_path):
    (tmp_path / "in").write_text("1")
    path = f"{tmp_path}/c/contract.json"
    contracts.prepare(path, "final-test", {"x": f"{tmp_path}/in"}, {"threshold": 0.5})
    assert contracts.prepare(path, "final-test", {"x": f"{tmp_path}/in"}, {"threshold": 0.5})["kind"] == "final-test"
    with pytest.raises(ValueError):
        contracts.prepare(path, "final-test", {}, {})
    contracts.verify(path, "final-test", {"threshold": 0.5, "other": None})
    for kind, over in (("other", None), ("final-test", {"threshold": 0.6})):
        with pytest.raises(ValueError):
            contracts.verify(path, kind, over)
    (tmp_path / "in").write_text("2")
    with pytest.raises(ValueError, match="changed"):
        contracts.verify(path, "final-test")


def test_from_files_to_features(spark, tmp_path):
    frame = B.ethernet(0x0800, B.ipv4(6, B.tcp()))
    for name in ("attacks/pcap/train/ARP_Spoofing_train.pcap", "profiling/PCAP/Idle/Idle.pcap"):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(B.capture([(float(i), frame) for i in range(30)]))
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    run = lambda *a: cli.main([*a, "--input", raw, "--root", raw, "--output", out])
    assert run("build-manifests") == 0
    inventory = f"{out}/pcap_inventory"
    rows = {r.pcap_path: r for r in spark.read.option("header", True).csv(inventory).collect()}
    assert rows["attacks/pcap/train/ARP_Spoofing_train.pcap"].attack_family == "Spoofing" and rows["profiling/PCAP/Idle/Idle.pcap"].split == "train"
    assert run("build-feature-dataset", "--inventory", inventory) == 0
    assert spark.read.parquet(f"{out}/features").count() == 2
    assert run("audit-corpus") == 0 and run("extract-features") == 0
    assert spark.read.option("header", True).csv(f"{out}/violations").count() == 0
