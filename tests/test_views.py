import pytest

from entloom.config import Config
from entloom.entity import entity
from entloom.operators.views import KeptView, create_view, load_keyed, register_entities
from entloom.sources.store import Store


def test_views_and_keyed_rows(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path))
    e = entity("thing", {"x": "int4", "y": "text"}, ["x"], registry={})
    load_keyed(store, e, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, x int"))
    load_keyed(store, e, spark.createDataFrame([("b", "new")], "id string, y string"))
    rows = {r["id"]: r for r in store.read(e.full_name, e.struct).collect()}
    assert len(rows) == 2 and (rows["b"]["x"], rows["b"]["y"]) == (3, "new")
    with pytest.raises(ValueError):
        load_keyed(store, e, spark.createDataFrame([("b", 1)], "id string, nope int"))
    register_entities(spark, store, [e])
    assert spark.sql("SELECT count(*) FROM public_thing").first()[0] == 2
    create_view(spark.range(2), "two")
    kept = KeptView(store, "count", lambda: spark.sql("SELECT count(*) AS n FROM two"))
    assert kept.read().first()["n"] == 2
    create_view(spark.range(5), "two")
    assert kept.read().first()["n"] == 2
    kept.refresh()
    assert kept.read().first()["n"] == 5


def test_config():
    assert Config.from_env({}) == Config()
    assert Config.from_env({"ENTLOOM_STORE": "s", "ENTLOOM_RETRY": "true"}) == Config(store="s", retry=True)
    with pytest.raises(ValueError):
        Config.from_env({"ENTLOOM_VALIDATION": "x"})
