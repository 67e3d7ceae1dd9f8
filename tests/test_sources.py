import pytest

from entloom.functions import transforms as tr
from entloom.sources import files
from entloom.sources.store import Store


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    for i in range(10):
        (tmp_path / f"0-{i:02d}.txt").write_text(f"flat {i}\nsecond")
        (tmp_path / "sub" / f"1-{i:02d}.txt").write_text(f"deep {i}")
    return str(tmp_path)


@pytest.mark.parametrize("pattern, flat, deep", [(r"[7-9]\.txt", 3, 6), (r"01\.txt", 1, 2), (None, 10, 20), (r"1-\d+\.txt", 0, 10)])
def test_file_names(spark, tree, pattern, flat, deep):
    assert files.file_names(spark, tree, pattern).count() == flat
    assert files.file_names(spark, tree, pattern, recursive=True).count() == deep


def test_file_texts(spark, tree):
    rows = {r["file_name"].rsplit("/", 1)[1]: r["text"] for r in files.file_texts(spark, tree).collect()}
    assert rows["0-03.txt"] == "flat 3\nsecond"


def test_yaml(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.yml").write_text(f"{{i: {i}, l: [a, b]}}")
    got = sorted(r["parsed"] for r in files.yaml_files(spark, str(tmp_path)).collect())
    assert got[0] == '{"i": 0, "l": ["a", "b"]}' and len(got) == 3


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("index;a\n0;i\n1;j\n2;k\n")
    assert [tuple(r) for r in files.csv_file(spark, str(p), delimiter=";").collect()] == [("0", "i"), ("1", "j"), ("2", "k")]
    q = tmp_path / "y.csv"
    q.write_text("Alice,Smith,34\n")
    assert files.csv_file(spark, str(q), ["first", "last", "age"], header=False).first().asDict() == {"first": "Alice", "last": "Smith", "age": "34"}
    with pytest.raises(ValueError):
        files.csv_file(spark, str(q), header=False)


def test_generated(spark):
    df = files.generated(spark, lambda n: ((n, i) for i in range(n)), "a int, b int", parts=[1, 2, 3])
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3
    assert [r[0] for r in files.generated(spark, lambda: [None, {"a": 1}, (2,), 3], "a int").collect()] == [None, 1, 2, 3]


def test_normalised_rows():
    with pytest.raises(ValueError):
        files.normalised((1, 2), ["a"])
    with pytest.raises(ValueError):
        files.normalised(1, ["a", "b"])
    with pytest.raises(ValueError):
        files.normalised({"z": 1}, ["a"])


def test_masked():
    assert files.masked("jdbc:postgresql://user:secret@host/db") == "jdbc:postgresql://user:***@host/db"


def test_store_versions(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path))
    df = spark.range(3)
    assert store.read("t", df.schema).count() == 0
    assert store.write("t", df) == 1
    assert store.write("t", store.read("t", df.schema).union(df)) == 2
    assert store.read("t", df.schema).count() == 6
    store.drop("t")
    assert store.version("t") == 0


def test_map_lists(spark):
    df = spark.createDataFrame([([1, 2], [10]), ([], [10])], "a array<int>, b array<int>")
    out = tr.map_lists("c", lambda a, b: a * b, "a", "b").apply(df, {})
    assert [r["c"] for r in out.collect()] == [[10, 20], []]
