import random

import corpus_pipeline
import pytest

from packetloom.llm import common
from packetloom.llm.components import components


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    item = " ".join(word() for _ in range(30))
    line = "This long line is in very many of the documents of this corpus."
    rows = []
    for i in range(60):
        body = [word() for _ in range(80)]
        rows.append((i, " ".join(body) + ("\n" + line if i % 4 == 0 else ""), "en", f"s{i % 4}"))
    rows += [(100, rows[1][1], "en", "s0"), (101, rows[1][1] + " end", "en", "s1"), (102, " ".join(word() for _ in range(30)) + " " + item, "en", "s2"), (103, "", "en", "s2"), (104, "123 456", "en", None)]
    spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_do_what_they_say(spark, tables):
    docs = common.read(spark, tables, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = common.written(stage(spark, docs, tables), "test")
        assert docs.columns == (before if name != "mixing" else [*before, "copies"])
        seen[name] = {r.doc_id: r for r in docs.collect()}
    everything = set(range(60)) | {100, 101, 102, 103, 104}
    assert set(seen["language_id"]) == everything - {103, 104}
    assert set(seen["line_dedup"]) == set(seen["language_id"])
    assert [d for d, r in seen["line_dedup"].items() if "This long line" in r.text] == [56]
    assert all(len(r.text) == r.n_chars for r in seen["line_dedup"].values())
    assert set(seen["jaccard_join"]) == set(seen["line_dedup"]) - {100, 101}
    assert set(seen["decontaminate"]) == set(seen["jaccard_join"]) - {102}
    assert set(seen["mixing"]) <= set(seen["decontaminate"]) and all(1 <= r.copies <= 3 for r in seen["mixing"].values())
    assert sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, tables).collect()) == sorted((d, r.copies) for d, r in seen["mixing"].items())


def test_every_stage_takes_odd_tables(spark, odd, nothing, tables):
    for docs in (odd, nothing):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, tables).count() <= n


def test_stages_judge_rows_without_an_id_and_rows_that_repeat_one(spark, tables):
    clean = {r.doc_id: r.text for r in common.read(spark, tables, "documents").collect()}
    item = common.read(spark, tables, "benchmark").first().text
    rows = [(None, clean[2], "a"), (None, clean[2] + " end", "b"), (None, "123 456", "c"), (None, f"{clean[3]} {item}", "d"), (7, "123 456", "e"), (7, clean[5], "f"), (8, clean[6], "g"), (8, clean[6], "g"), (9, f"{clean[9]} {item}", "h"), (9, clean[10], "i"), (2, clean[2], "j")]
    docs = spark.createDataFrame([(i, text, "en", "s", len(text), tag, "n", "l", "k", "w", "t") for i, text, tag in rows], "doc_id long, text string, lang string, source string, n_chars long, tag string, n_lines string, kept_lines string, copies string, row string, component_id string")
    stage = dict(corpus_pipeline.STAGES)
    tags = lambda df: "".join(sorted(r.tag for r in df.collect()))
    assert tags(stage["language_id"](spark, docs, tables)) == "abdfgghij"
    assert tags(stage["decontaminate"](spark, docs, tables)) == "abcefggij"
    near = docs.where("tag NOT IN ('c', 'e')")
    assert tags(stage["jaccard_join"](spark, near, tables)) == "dfgghij"  # rows without an id give way to the one with an id
    out = stage["line_dedup"](spark, docs, tables)
    assert out.columns == docs.columns and {(r.n_lines, r.kept_lines, r.row) for r in out.collect()} == {("n", "l", "w")}
    mix = stage["mixing"](spark, docs, tables)
    assert mix.columns == [*[c for c in docs.columns if c != "copies"], "copies"] and all(r.copies >= 1 and r.n_lines == "n" for r in mix.collect())


def test_tables_of_a_stage_go_with_it(spark, tmp_path):
    df = spark.range(5)
    with common.scratch():
        inner = common.written(df, "gone")
        with common.scratch():
            kept = common.written(df, "kept", keep=True)
        assert kept.count() == inner.count() == 5
        last = common.written(df, "last", keep=True)
    assert last.count() == 5
    for gone in (inner, kept):
        with pytest.raises(Exception):
            gone.count()


def test_nothing_local_where_the_cluster_names_a_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.checkpoint.dir": "hdfs://shared/folder"}.get(key, default))

    assert common.shared_folder(Session) == "hdfs://shared/folder"
    Session.conf.get = staticmethod(lambda key, default=None: default)
    assert common.shared_folder(Session).startswith("file:///")
