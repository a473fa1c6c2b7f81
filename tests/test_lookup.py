import pytest

from keyfold.features import catalog, lookup
from keyfold.features.engine import attach, attach_all
from keyfold.features.spec import Feature
from keyfold.session import write_stage
from keyfold.sources.items import items as base_items

FEATURES = [Feature("n_a", ("a",), fill=0), Feature("n_ab", ("a", "b"), fill=0), Feature("n_x", ("x",), fill=0),
            Feature("n_abxd", ("a", "b", "x", "d"), fill=0), Feature("days", ("b", "x"), "span", "d"),
            Feature("open", ("a",), "span", "d", fill=-1), Feature("uq", ("a", "x"), "distinct", "b", fill=0),
            Feature("own", ("b",), "distinct", "b"), Feature("given", ("d",), "count_col", "x", fill=0)]


@pytest.fixture(scope="module")
def frame(spark):
    """NULLs in every column, NaN of two forms, both zeros, equal rows, text that is empty."""
    return write_stage(spark.range(0, 900, 1, 5).selectExpr(
        "id % 300 AS id", "CASE WHEN id % 11 > 0 THEN concat('k', id % 7 % 5) WHEN id % 2 = 0 THEN '' END AS a", "nullif(id % 13, 4) AS b",
        "CASE id % 6 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') WHEN 3 THEN -double('NaN') WHEN 4 THEN 2.5D END AS x",
        "IF(id % 17 = 0, NULL, date_add(date'2017-01-01', cast(id % 19 AS int))) AS d"), "lookup_rows")


def shown(df, names):
    return sorted(map(repr, df.select("id", *names).collect()))


@pytest.mark.parametrize("most,dense", [(250_000, 8), (250_000, 0), (20, 8), (0, 8)])
def test_tables_looked_up_are_as_joined_ones(frame, monkeypatch, most, dense):
    """All small, by place or by search; some or all too large and joined."""
    monkeypatch.setattr(lookup, "LOOKUP_SET_ROWS", most)
    monkeypatch.setattr(lookup, "DENSE", dense)
    monkeypatch.setattr(lookup, "BULK_ROWS", 50)
    monkeypatch.setattr(lookup, "COLLECTED_ROWS", 30)
    names = [f.name for f in FEATURES]
    joined, found = attach(frame, FEATURES), attach(frame, FEATURES, lookups=True)
    assert joined.dtypes == found.dtypes and shown(joined, names) == shown(found, names)


def test_target_with_other_keys_and_empty_source(frame):
    names = [f.name for f in FEATURES]
    for source in (frame.filter("b > 6 AND a <> 'k1'"), frame.filter("false")):
        joined, found = (attach(frame, FEATURES, write_stage(source, "source"), lookups=lookups) for lookups in (False, True))
        assert shown(joined, names) == shown(found, names)


def test_stage_five_joins_none_of_its_small_tables(spark):
    items = write_stage(base_items(spark, "/root/testdata/sf0.001"), "items")
    columns = sorted({c for f in catalog.STAGE5 for c in (*f.keys, f.arg) if c})
    plan = attach_all(items.select("item_id", *columns), catalog.STAGE5, cell_columns=catalog.TRIPLE_CELLS)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
