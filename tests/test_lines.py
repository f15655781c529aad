"""Text files in byte ranges: sentences equal those of the whole text for every size of the ranges."""

import random

import pytest

from textsieve.operators.sentences import text_to_sentences
from textsieve.sources import lines, readers


def in_order(spark, docs):
    found = text_to_sentences(docs, 1, 500).collect()
    return [r["tokens"] for r in sorted(found, key=lambda r: (r["doc_id"], r["sent_pos"]))]


@pytest.fixture
def ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield set_size
    for n, v in before.items():
        spark.conf.set(n, v)


def test_sentences_equal_those_of_the_whole_text(spark, tmp_path, ranges):
    rng = random.Random(4)
    bits = ["слово", "two", "3:16", "a.b", "x. ", "! ", " ", " ", "<", ">", "<>", "<b>", "</i\n>", "\n", "\n\n", "\r\n", "; ", "�", "<a\nb\nc>", "й. к"]
    for k in range(6):
        text = "".join(rng.choice(bits) + rng.choice(("", " ")) for _ in range(250))
        if k == 5:
            text = "end <open " + text.replace(">", "")  # nothing closes it
        (tmp_path / f"{k}.txt").write_bytes(text.encode() + (b"\xff tail" if k == 3 else b""))
    (tmp_path / "6.txt").write_bytes(b"")
    (tmp_path / "7.txt").write_text("one two <" + "x y\n" * 400 + "> three. four <i\n>five")
    for k in (2, 3, 5, 6, 7):
        path = str(tmp_path / f"{k}.txt")
        want = in_order(spark, readers.read_text(spark, path))
        rows = []
        for size in (37, 200, 1 << 27):
            ranges(size)
            found = lines.read_text_lines(spark, path)
            if size == 37 and k not in (5, 6):
                assert spark.read.text(path).rdd.getNumPartitions() > 3
            rows.append(sorted(map(tuple, found.collect())))
            assert in_order(spark, found) == want, (k, size)
        assert rows[0] == rows[1] == rows[2]


def test_many_files_and_tags_kept(spark, tmp_path, ranges):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text(f"first {k} <b\nsecond> {k}\n" + "more words here.\n" * 40)
    ranges(100)
    found = lines.read_text_lines(spark, str(tmp_path / "*.txt"))
    assert in_order(spark, found) == [w for k in range(3) for w in [["first"], *[["more", "words", "here"]] * 40]]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
    rows = sorted(map(tuple, found.collect()))
    ranges(200)  # all of these begin where a counted one does
    assert sorted(map(tuple, found.select("*").collect())) == rows
    ranges(70)
    with pytest.raises(Exception, match="ranges of the files have changed"):
        found.select("*").collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Union")[0]
    kept = sorted(r["text"] for r in lines.read_text_lines(spark, [str(tmp_path / "1.txt")], drop_tags=False).collect())
    assert kept == sorted(["first 1 <b", "second> 1", *["more words here."] * 40])
