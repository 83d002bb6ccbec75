"""A thousand repositories in one scan with pushed filters; one parse a program by a table function."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import pycode
from tracewell.sources import repos


def test_many_repositories_in_one_scan(spark, tmp_path):
    roots = {}
    for i in range(1000):
        root = tmp_path / f"r{i}"
        (root / "pkg").mkdir(parents=True)
        (root / "pkg" / "__init__.py").write_text(f"N = {i}\n")
        (root / "README.md").write_text("# x")
        roots[f"o/r{i}"] = str(root)
    (tmp_path / "r7" / ".git").mkdir()
    (tmp_path / "r7" / ".git" / "config").write_text("no")
    with open(tmp_path / "r7" / "huge.bin", "wb") as f:  # would not fit into memory if it were read
        f.truncate(1 << 38)
    files = repos.trees(spark, roots)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and files.rdd.getNumPartitions() == 63
    assert files.count() == 2001
    huge = files.where("path = 'huge.bin'").first()
    assert huge.length == 1 << 38 and huge.content is None
    some = files.where("repo_id in ('o/r7', 'o/r8') and path like 'pkg/%' and length < 100")
    assert sorted((r.repo_id, r.path, bytes(r.content)) for r in some.collect()) == [(f"o/r{i}", "pkg/__init__.py", b"N = %d\n" % i) for i in (7, 8)]
    assert some.rdd.getNumPartitions() == 1  # the others aren't even walked
    assert repos.trees(spark, {}).count() == 0


PROGRAMS = [
    "import os\nfrom a.b import c as d\n\nX = 1\n\n\n@dec\n@two\ndef f(a, *b):\n    import inner\n    def g():\n        return 1\n    return g\n\n\nasync def h(): pass\n\n\nclass K:\n    y: int = 2\n\n\nif X:\n    print('x')\n",
    "def (", "", "\n\n# only a note\n", "from . import z\nfrom .m import q\n", "x = '''\nno\n'''\n", "\tbad indent\n  x", "a = 1\x00",
]


def test_facts_equal_the_single_functions(spark, monkeypatch):
    pycode.register(spark)
    spark.createDataFrame([*enumerate(PROGRAMS), (99, None)], "id int, text string").createOrReplaceTempView("progs")
    rows = spark.sql("select id, t.* from progs, lateral python_facts(text, 'chunk,import,token,shape') t").collect()
    for i, text in enumerate(PROGRAMS):
        of = lambda kind: [r for r in sorted(rows, key=lambda r: r.place) if r.id == i and r.kind == kind]  # noqa: E731, B023
        assert [r.value for r in of("import")] == pycode.imported(text) and [r.value for r in of("token")] == pycode.lexed(text) and [r.value for r in of("shape")] == pycode.shape(text)
        assert [{"start_line": r.start_line, "end_line": r.end_line, "body": r.body, "symbol": r.value} for r in of("chunk")] == pycode.top_level(text)
    assert not [r for r in rows if r.id == 99]
    assert spark.sql("select t.* from progs, lateral python_facts(text, 'import') t").columns == ["kind", "place", "value"]
    with pytest.raises(Exception, match="constant list"):
        spark.sql("select t.* from progs, lateral python_facts(text, 'nothing') t").collect()
    parsed = []
    monkeypatch.setattr(pycode, "_tree", lambda s, f=pycode._tree: parsed.append(s) or f(s))
    assert len(list(pycode.PythonFacts().eval(PROGRAMS[0], "chunk,import,token,shape"))) > 40 and len(parsed) == 1
