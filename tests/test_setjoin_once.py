from pyspark.sql import functions as F

from tracewell.operators import setjoin


def test_tokens_are_made_once_and_only_copies_are_looked_up(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        made.add(1)
        return None if text is None else text.split()

    rows, staged = {}, setjoin.staged

    def counted(df, name):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(setjoin, "staged", counted)
    texts = [f"w{i} x{i} y z{i % 5}" for i in range(40)] + ["w1 x1 y z1", "w1 x1 y z1", "w2 x2 y z2", "", None, "y"]
    side = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3).select("id", split("text").alias("tokens"))
    lists, members = setjoin._classes(side, "left")
    assert made.value == len(texts)
    assert rows["left-copies"] == 3
    got = {r.id: r.tokens for r in lists.select("id", "tokens").collect()}
    assert got == {i: t.split() for i, t in enumerate(texts) if t and i not in (40, 41, 42)}
    assert {(r.id, r.stands) for r in members.collect()} == {(i, {40: 1, 41: 1, 42: 2}.get(i, i)) for i, t in enumerate(texts) if t}
    assert members.columns == ["id", "stands"]


def test_a_run_has_one_hash_wherever_it_is_and_a_shorter_list_another(spark):
    lists = ["a b c d e f", "z a b c d e", "a b c d", "a b c d e", "e d c b a", "ab c d e f"]
    df = spark.createDataFrame([(x.split(), "") for x in lists] + [("a b c d e".split(), "python")], "tokens array<string>, kind string")
    h = [r.h for r in df.select(setjoin._hashes(5).alias("h")).collect()]
    assert [len(x) for x in h] == [2, 2, 1, 1, 1, 1, 1]
    assert h[0][0] == h[1][1] == h[3][0]
    assert len({h[0][0], h[0][1], h[1][0], h[2][0], h[4][0], h[5][0], h[6][0]}) == 7
    one = [r.h for r in df.select(setjoin._hashes(1).alias("h")).collect()]
    assert one[0][:5] == one[3] and len(one[2]) == 4
